"""Exact top-k by inner product with multi-resolution segment statistics.

Vectors are cut into segments.  By Cauchy-Schwarz on the parts around their means, a
segment of length l adds at most l (mean_q mean_x + dev_q dev_x) to an inner product,
so segment means and deviations bound a score from above (a distance from below).  One
segment is the coarsest view, and each finer one bounds tighter: candidates whose bound
falls under the query's floor leave at the first level that shows it, and exact scores
are computed for the survivors alone.

A query's floor is a score that k candidates are known to reach: those of highest bound
in every block that the task has met are scored first.

Vectors are packed into blocks of rows; every block of queries meets every block of
candidates in its own task step, whatever the sizes of both sides.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.llm._shared import bounded_batches, store

SCALE, TOP = 256, 5
#: Vectors of a block of candidates and of queries.
CANDIDATES, QUERIES = 2048, 512
#: Blocks of candidates that share a group, and so one copy of the query blocks.
BLOCKS_PER_GROUP = 16
#: Segments of the levels, coarse to fine.
LEVELS = (1, 4, 16, 32)
#: Candidates of highest bound whose exact scores raise a query's floor in a block.
PROMISING = 96
#: Blocks of queries whose floors a task keeps.
FLOORS = 1024


def scaled(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) of doubles: whole numbers, exact as doubles (infinite beyond their range)."""
    return np.floor(SCALE * vectors.astype(np.float64))


def _whole(vectors: np.ndarray) -> list[list[int]]:
    """floor(256 x) as integers of any size."""
    return [[SCALE * int(v) if abs(v) >= 1 << 53 else math.floor(SCALE * v) for v in row] for row in vectors.tolist()]


def features(values: np.ndarray, segments: int) -> np.ndarray:
    """Scaled segment means and deviations: their inner product bounds that of the rows."""
    parts = np.array_split(values.astype(np.float64), min(segments, max(values.shape[1], 1)), axis=1)
    parts = [p for p in parts if p.shape[1]]
    root = [np.sqrt(p.shape[1]) for p in parts]
    columns = [r * p.mean(1) for r, p in zip(root, parts, strict=True)] + [r * p.std(1) for r, p in zip(root, parts, strict=True)]
    return np.stack(columns, 1) if columns else np.zeros((len(values), 1))


class _Exact:
    """Exact integer scores: in doubles or 64-bit integers where all sums fit, else in
    integers of any size."""

    def __init__(self, q: np.ndarray, x: np.ndarray) -> None:
        self.computed = 0
        a, b = scaled(q), scaled(x)
        most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, q.shape[1])
        self.kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object
        self._q, self._x = (_whole(q), _whole(x)) if self.kind is object else (a.astype(self.kind), b.astype(self.kind))

    def of(self, row: int, columns: np.ndarray) -> np.ndarray:
        """Scores of a query with some candidates."""
        self.computed += len(columns)
        if self.kind is object:
            out = np.empty(len(columns), object)
            out[:] = [sum(map(int.__mul__, self._q[row], self._x[c])) for c in columns.tolist()]
            return out
        return (self._x[columns] @ self._q[row]).astype(np.int64)

    def grid(self, columns: np.ndarray) -> np.ndarray:
        """Scores of every query with its own row of candidates, as doubles."""
        self.computed += columns.size
        return np.einsum("qcd,qd->qc", self._x[columns], self._q).astype(np.float64)


def best_of_block(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int = TOP, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, candidate row, score) of every query's k best in this block, but for
    those under its `floor`, which is raised; and the number of exact scores computed.

    A candidate of the query's own id takes no part; ties go to the smaller id.
    """
    floor = np.full(len(q), -np.inf) if floor is None else floor
    if not len(q) or not len(x):
        return (np.zeros(0, np.int64),) * 3 + (0,)
    alive = q_ids[:, None] != x_ids[None, :]
    exact = _Exact(q, x)
    with np.errstate(all="ignore"):  # a bound that is no number keeps its pair
        a, b = scaled(q), scaled(x)
        slack = 1e-9 * np.linalg.norm(a, axis=1, keepdims=True) * np.linalg.norm(b, axis=1).max() + 1e-6
        for segments in (n for n in LEVELS if n == 1 or n < q.shape[1]):
            bound = features(a, segments) @ features(b, segments).T
            alive &= ~(bound < floor[:, None] - slack)
            if not alive.any():
                break
        if exact.kind is not object and x.shape[0] > PROMISING >= k and alive.any():
            bound = np.where(alive, bound, -np.inf)
            some = np.argpartition(-bound, PROMISING - 1, axis=1)[:, :PROMISING]
            score = np.where(np.take_along_axis(alive, some, 1), exact.grid(some), -np.inf)
            np.maximum(floor, np.partition(score, PROMISING - k, axis=1)[:, PROMISING - k], out=floor)
            alive &= ~(bound < floor[:, None] - slack)
    rows, columns, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for row in np.flatnonzero(alive.any(1)).tolist():
        left = np.flatnonzero(alive[row])
        score = exact.of(row, left)
        best = np.array(sorted(range(len(left)), key=lambda i: (-score[i], x_ids[left[i]]))[:k]) if exact.kind is object else np.lexsort((x_ids[left], -score))[:k]
        rows.append(np.full(len(best), row))
        columns.append(left[best])
        scores.append(score[best])
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(scores), exact.computed


_BLOCK = "dim int, {0}_ids binary, {0}_values binary"


def _usable(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, vectors) of the rows with an id and finite components, by length."""
    rows = batch.filter(pa.compute.is_valid(batch.column(0)))
    lists = rows.column(1)
    lengths = pa.compute.fill_null(pa.compute.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[lengths >= 0]).tolist():
        own = rows.filter(pa.array(lengths == dim))
        flat = own.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), dim)
        fine = np.isfinite(flat).all(1)  # nulls have become NaN
        yield dim, own.column(0).to_numpy()[fine].astype(np.int64), flat[fine]


def _pack(size: int, side: str):
    """mapInArrow function: rows (vec_id, embedding) to blocks of one dimension."""

    def flush(held: list[tuple[np.ndarray, np.ndarray]], dim: int) -> pa.RecordBatch:
        ids, values = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        return pa.record_batch([pa.array([dim], pa.int32()), pa.array([ids.tobytes()]), pa.array([values.tobytes()])], names=["dim", f"{side}_ids", f"{side}_values"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for dim, ids, values in _usable(batch):
                for a in range(0, len(ids), size):
                    held.setdefault(dim, []).append((ids[a : a + size], values[a : a + size]))
                    if sum(len(h[0]) for h in held[dim]) >= size:
                        yield flush(held.pop(dim), dim)
        for dim, parts in held.items():
            yield flush(parts, dim)

    return run


def _order(scores: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Columns by which scores of any size are ordered: class, long, sortable bytes.

    Class 1 is above all longs and -1 below them; their score is null.
    """
    if scores.dtype != object:
        return pa.array(np.zeros(len(scores), np.int32)), pa.array(scores, pa.int64()), pa.nulls(len(scores), pa.binary())
    kinds = [(s > (1 << 63) - 1) - (s < -(1 << 63)) for s in scores]
    wide = []
    for s, kind in zip(scores, kinds, strict=True):
        size = (abs(s).bit_length() + 7) // 8
        raw = size.to_bytes(2, "big") + abs(s).to_bytes(size, "big")
        wide.append(None if not kind else raw if kind > 0 else bytes(255 - b for b in raw))
    return pa.array(kinds, pa.int32()), pa.array([None if kind else s for s, kind in zip(scores, kinds, strict=True)], pa.int64()), pa.array(wide, pa.binary())


_FOUND = "query_id long, vec_id long, class int, score long, wide binary"


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: OrderedDict[tuple[bytes, bytes], np.ndarray] = OrderedDict()
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, x_ids = (np.frombuffer(row[c], np.int64) for c in ("q_ids", "x_ids"))
                q, x = (np.frombuffer(row[c], np.float64).reshape(len(ids), row["dim"]) for c, ids in (("q_values", q_ids), ("x_values", x_ids)))
                block = (row["q_ids"], row["q_values"][:64])
                if block not in floors:
                    floors[block] = np.full(len(q), -np.inf)
                    if len(floors) > FLOORS:
                        floors.popitem(last=False)
                r, c, score, _ = best_of_block(q_ids, q, x_ids, x, k, floors[block])
                yield pa.record_batch([pa.array(q_ids[r]), pa.array(x_ids[c]), *_order(score)], names=["query_id", "vec_id", "class", "score", "wide"])

    return run


def search(vectors: DataFrame, is_query: str, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query.

    `vectors` has vec_id and embedding (array of float or double), and any columns more;
    `is_query` is a condition on its columns.  Scores are inner products of floor(256 x),
    exact for components of any size; a score beyond a long is ranked exactly and null.
    Vectors that are null or hold null or non-finite components take no part, nor do rows
    without an id; only vectors of one length meet.  Every row is a candidate of its own,
    and a query meets no candidate of its id: of rows that repeat a query's id each one's
    results count.  Fewer candidates than k give fewer rows, an empty table none.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    ids = F.col("vec_id").cast("long").alias("vec_id")
    plain = vectors.select(ids, "embedding")
    candidates, _ = store(plain.mapInArrow(_pack(CANDIDATES, "x"), _BLOCK.format("x")), "candidates")
    asked = vectors.where(is_query).select(ids, "embedding")
    blocks = -(-asked.where("vec_id is not null").count() // QUERIES)
    queries, _ = store(asked.repartition(max(1, blocks)).mapInArrow(_pack(QUERIES, "q"), _BLOCK.format("q")), "queries")
    # Every block of queries goes to every group of candidate blocks: an equi-join on the
    # group, whose rows are pairs of blocks.
    groups = max(1, spark.sparkContext.defaultParallelism, candidates.count() // BLOCKS_PER_GROUP)
    # (A fixed number of partitions: groups are few bytes, but much work.)
    part = lambda number: F.struct("dim", number.cast("int").alias("number"))
    grouped = candidates.select(part(F.pmod(F.xxhash64("x_ids"), F.lit(groups))).alias("part"), "x_ids", "x_values").repartition(groups, "part")
    spread = queries.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(part(F.col("number")).alias("part"), "q_ids", "q_values")
    pairs = grouped.join(spread.repartition(groups, "part"), "part")
    found = pairs.select("part.dim", "q_ids", "q_values", "x_ids", "x_values").mapInArrow(_search(k), _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("class"), F.desc("score"), F.desc("wide"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
