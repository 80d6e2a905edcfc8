"""A paged REST graph as a Spark data source ("graph_api")."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
import warnings
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from verdigris.operators import graph
from verdigris.sources.dump import empty_edges

#: Calls in a row that fail before a task calls no more.
GIVE_UP = 3
RETRY_ON = (429, 500, 502, 503, 504)
PAGE = 1000


def fetch(url: str, retries: int = 3, backoff: float = 0.5, open_url: Callable[..., Any] = urllib.request.urlopen) -> dict:
    """JSON of a URL; server errors, rate limits and failed connections are tried again."""
    for attempt in range(retries + 1):
        try:
            with open_url(url, timeout=20) as reply:
                return json.load(reply)
        except (urllib.error.URLError, TimeoutError) as error:  # HTTPError is a URLError with a code
            if getattr(error, "code", RETRY_ON[0]) not in RETRY_ON or attempt == retries:
                raise
            time.sleep(backoff * 2**attempt)
    raise AssertionError


def edges_of(page: dict, language: str = "en") -> Iterator[tuple[str, str, str, float, str]]:
    """(rel, start, end, weight, surface) of a page's edges within one language."""
    for edge in page.get("edges", []):
        ends = [edge.get(side, {}).get("@id", "").split("/") for side in ("start", "end")]
        if all(len(p) >= 4 and p[1] == "c" and p[2] == language for p in ends):
            yield edge.get("rel", {}).get("label", ""), ends[0][3], ends[1][3], float(1.0 if edge.get("weight") is None else edge["weight"]), edge.get("surfaceText") or ""


class Terms(InputPartition):
    """Terms that one task looks up, one after the other."""

    def __init__(self, terms: list[str]) -> None:
        super().__init__(terms)
        self.terms = terms


class GraphReader(DataSourceReader):
    """Looks up the terms that filters on `term` name (or the option `terms`, by commas).

    Each term's pages are followed up to the limit.  A term whose call fails has no rows;
    after GIVE_UP failures in a row a task calls no more.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.base, self.limit = options["url"].rstrip("/"), int(options.get("limit", "400"))
        self.language, self.per_task = options.get("language", "en"), int(options.get("terms_per_task", "16"))
        named = [t for t in options.get("terms", "").split(",") if t]
        self.terms: list[str] | None = list(dict.fromkeys(named)) or None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and membership of `term`; Spark applies all other filters itself."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("term",):
                wanted = [f.value] if isinstance(f, EqualTo) else [v for v in f.value if v is not None]
                self.terms = [t for t in dict.fromkeys(wanted) if self.terms is None or t in self.terms]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if self.terms is None:
            raise ValueError("a graph service is asked for terms: filter by term = ... or term IN (...)")
        return [Terms(self.terms[i : i + self.per_task]) for i in range(0, len(self.terms), self.per_task)] or [Terms([])]

    def read(self, partition: Terms) -> Iterator[tuple]:
        failed = 0
        for term in partition.terms:
            if failed >= GIVE_UP:
                return
            try:
                found = self._edges(term)
                failed = 0
            except (OSError, ValueError):  # URL errors are OSErrors, a page that is no JSON a ValueError
                failed += 1
                continue
            yield from ((term, *edge) for edge in found)

    def _edges(self, term: str) -> list[tuple]:
        url: str | None = f"{self.base}/c/{self.language}/{urllib.parse.quote(term)}?limit={min(PAGE, self.limit)}"
        found: list[tuple] = []
        while url and len(found) < self.limit:
            page = fetch(url)
            found += edges_of(page, self.language)
            following = page.get("view", {}).get("nextPage")
            url = urllib.parse.urljoin(self.base + "/", following) if following else None
        return sorted(found, key=lambda e: -e[3])[: self.limit]


class GraphApi(DataSource):
    """spark.dataSource.register(GraphApi); spark.read.format("graph_api").option("url", ...)"""

    @classmethod
    def name(cls) -> str:
        return "graph_api"

    def schema(self) -> str:
        return "term string, rel string, start string, end string, weight double, surface string"

    def reader(self, schema: Any) -> GraphReader:
        return GraphReader(dict(self.options))


def read_api(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """(term, rel, start, end, weight, surface) of a service, to be filtered by term."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GraphApi)
    return spark.read.format("graph_api").options(url=url, **options).load()


def reachable(url: str, open_url: Callable[..., Any] = urllib.request.urlopen) -> bool:
    """Whether the service answers a small call with edges."""
    try:
        return "edges" in fetch(f"{url.rstrip('/')}/c/en/person?limit=1", retries=0, open_url=open_url)
    except (OSError, ValueError):
        return False


def choose(kind: str, table_exists: bool, api_answers: Callable[[], bool]) -> str:
    """Which graph to use: "local", "api" or "offline", for kind auto/local/api/offline."""
    if kind not in ("auto", "local", "api", "offline"):
        raise ValueError(f"unknown graph source {kind}")
    if kind in ("auto", "local") and table_exists:
        return "local"
    if kind == "api" or (kind == "auto" and api_answers()):
        return "api"
    return "offline"


def open_graph(spark: SparkSession, kind: str, table: str, url: str, api_answers: Callable[[], bool] | None = None) -> graph.StoredGraph | DataFrame:
    """The graph that `choose` names: the stored tables, the service's relation, or no edges.

    Being offline against one's wish is told by a warning.
    """
    there = graph.is_stored(spark, table)
    source = choose(kind, there, api_answers or (lambda: reachable(url)))
    if source == "local":
        return graph.load_graph(spark, table)
    if source == "api":
        return read_api(spark, url)
    if kind != "offline":
        warnings.warn(f"no graph: table {table} is not there{' and the service does not answer' if kind == 'auto' else ''}; going on offline", stacklevel=2)
    return empty_edges(spark)
