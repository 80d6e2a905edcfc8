"""Typed settings: defaults, then a YAML file, then dotted overrides."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml


@dataclass(frozen=True)
class GraphSettings:
    edges_per_term: int = 400
    min_weight: float = 1.0
    terms: int = 20
    facts_per_term: int = 6
    facts: int = 40
    two_hop: float = 0.6


@dataclass(frozen=True)
class ReasoningSettings:
    shortlist: int = 8
    w_scorer: float = 1.0
    w_support: float = 0.5
    w_draft: float = 1.0
    temperature: float = 0.2
    margin: float = 0.15
    context_facts: int = 10


@dataclass(frozen=True)
class SamplingSettings:
    interval_s: float = 2.0
    scene_change: float = 0.25
    refresh: int = 3
    blur: float = 60.0
    dark: float = 60.0
    contrast: float = 25.0


@dataclass(frozen=True)
class MomentSettings:
    most: int = 7
    scan_fps: float = 4.0
    scan_samples: int = 900
    change: float = 0.35
    min_split_s: float = 6.0


@dataclass(frozen=True)
class Settings:
    graph: GraphSettings = field(default_factory=GraphSettings)
    reasoning: ReasoningSettings = field(default_factory=ReasoningSettings)
    sampling: SamplingSettings = field(default_factory=SamplingSettings)
    moments: MomentSettings = field(default_factory=MomentSettings)


def _changed(node: Any, key: str, value: Any, path: str) -> Any:
    names = {f.name for f in dataclasses.fields(node)}
    head, _, rest = key.partition(".")
    if head not in names:
        raise KeyError(f"unknown setting {path}{head}")
    old = getattr(node, head)
    if rest or (dataclasses.is_dataclass(old) and isinstance(value, dict)):
        changes = {rest: value} if rest else value
        for name, v in changes.items():
            old = _changed(old, name, v, f"{path}{head}.")
        return dataclasses.replace(node, **{head: old})
    return dataclasses.replace(node, **{head: tuple(value) if isinstance(value, list) else value})


def from_environment(environment: Mapping[str, str], prefix: str = "VERDIGRIS") -> Settings:
    """`load` with the file of <prefix>_CONFIG and the comma-separated overrides of
    <prefix>_SET; empty ones count for nothing."""
    overrides = [item.strip() for item in environment.get(f"{prefix}_SET", "").split(",") if item.strip()]
    return load(environment.get(f"{prefix}_CONFIG", "").strip() or None, overrides)


def load(path: str | Path | None = None, overrides: list[str] | None = None, default: str | Path = "verdigris.yaml") -> Settings:
    """Defaults < YAML file < overrides like ``graph.facts=10`` (values typed as YAML).

    An explicit path must exist; the default file may be missing.  Unknown keys raise
    KeyError.
    """
    settings = Settings()
    file = Path(path or default)
    if path and not file.exists():
        raise FileNotFoundError(file)
    if file.exists():
        for key, value in (yaml.safe_load(file.read_text()) or {}).items():
            settings = _changed(settings, key, value, "")
    for item in overrides or []:
        key, _, value = item.partition("=")
        settings = _changed(settings, key.strip(), yaml.safe_load(value), "")
    return settings
