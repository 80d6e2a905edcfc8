"""Image statistics and sizes over pixel columns (bytes, height, width, channels)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.vectors import fitted_size
from verdigris.operators.metrics import quality_flags

_LONGEST = 640


def gray(pixels: bytes, height: int, width: int, channels: int) -> np.ndarray:
    image = np.frombuffer(pixels, np.uint8).reshape(height, width, channels).astype(np.float32)
    return image[:, :, 0] if channels == 1 else image[:, :, :3] @ np.array([0.299, 0.587, 0.114], np.float32)


def sharpness(image: np.ndarray) -> float:
    """Variance of the Laplacian at a longest side of 640 at most (block means)."""
    k = -(-max(image.shape) // _LONGEST)
    if k > 1:
        h, w = image.shape[0] // k * k, image.shape[1] // k * k
        image = image[:h, :w].reshape(h // k, k, w // k, k).mean((1, 3))
    p = np.pad(image, 1, mode="reflect") if min(image.shape) > 1 else np.pad(image, 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * image).var())


def pixel_stats(pixels: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.DataFrame:
    """Mean and deviation of gray values, and sharpness; nulls for unreadable rows."""
    rows = []
    for p, h, w, c in zip(pixels, height, width, channels, strict=True):
        if p is None or not h or not w or len(p) != h * w * c:
            rows.append((None, None, None))
        else:
            g = gray(p, int(h), int(w), int(c))
            rows.append((float(g.mean(dtype=np.float64)), float(g.std(dtype=np.float64)), sharpness(g)))
    return pd.DataFrame(rows, columns=["brightness", "contrast", "sharpness"])


def assess(images: DataFrame) -> DataFrame:
    """`images` (pixels, height, width, channels) with statistics (two places) and flags."""
    stats = F.pandas_udf(pixel_stats, "struct<brightness:double,contrast:double,sharpness:double>")
    measured = images.withColumn("__s", stats("pixels", "height", "width", "channels")).select("*", "__s.*").drop("__s")
    flagged = quality_flags(measured, "sharpness", "brightness", "contrast")
    return flagged.withColumns({c: F.round(c, 2) for c in ("brightness", "contrast", "sharpness")})


def target_size(width: Column, height: Column, target: int, mode: str = "fit", upscale: bool = False) -> Column:
    """struct<width, height> after resizing: "none", "fit" (longest side) or "center_crop"."""
    if mode == "none":
        return F.struct(width.alias("width"), height.alias("height"))
    if mode == "center_crop":
        return F.struct(F.lit(target).alias("width"), F.lit(target).alias("height"))
    if mode != "fit":
        raise ValueError(f"unknown resize mode {mode}")
    return fitted_size(width, height, target, upscale)


def hue_saturation(image: np.ndarray, bins: int = 16) -> np.ndarray:
    """Shares of an RGB image's pixels by hue (rows) and saturation (columns)."""
    rgb = image[:, :, :3].reshape(-1, 3).astype(np.float64)
    high, low = rgb.max(1), rgb.min(1)
    spread = np.maximum(high - low, 1e-12)
    r, g, b = ((high - rgb[:, i]) / spread for i in range(3))
    turn = np.where(high == rgb[:, 0], b - g, np.where(high == rgb[:, 1], 2 + r - b, 4 + g - r)) / 6 % 1
    hue = np.where(high > low, turn, 0.0)
    saturation = np.where(high > 0, (high - low) / np.maximum(high, 1e-12), 0.0)
    cell = np.minimum((hue * bins).astype(int), bins - 1) * bins + np.minimum((saturation * bins).astype(int), bins - 1)
    return np.bincount(cell, minlength=bins * bins) / max(len(cell), 1)


def colour_histogram(bins: int = 16) -> Callable[..., Column]:
    """A function of (pixels, height, width, channels): the shares of `hue_saturation`, row
    by row; null for unreadable rows and images without colour."""

    def each(pixels: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
        good = lambda p, h, w, c: p is not None and h and w and c >= 3 and len(p) == h * w * c
        rows = zip(pixels, height, width, channels, strict=True)
        return pd.Series([hue_saturation(np.frombuffer(p, np.uint8).reshape(int(h), int(w), int(c)), bins).tolist() if good(p, h, w, c) else None for p, h, w, c in rows])

    each.__annotations__ = {"pixels": pd.Series, "height": pd.Series, "width": pd.Series, "channels": pd.Series, "return": pd.Series}
    return F.pandas_udf(each, "array<double>")
