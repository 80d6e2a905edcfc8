"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix has as many words as all sources together.  Each source's target is its
share by weight, limited to `EPOCHS` times its own size with the excess reshared.
The mix is cut into equal blocks of words; Sainte-Laguë's method (highest quotients
votes / (2 seats + 1)) gives every source a whole number of blocks, and then, within
a source, every shard.  In a shard, documents in seeded order form one stream of
words cut into blocks, and a seeded systematic draw takes each block floor(q / n) or
that plus one times, for a quota q of n blocks.

A block is never a row: a document's taken words follow from its place in the
stream, so the work is one narrow row per document.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType
from pyspark.sql.window import Window

from verdigris.llm._shared import store

WEIGHTS = (5.0, 2.0, 1.0)
EPOCHS = 3
SEED = "mixture-1"
#: A block has 64 words, or fewer where the mix would have under so many blocks.
BLOCK_WORDS, LEAST_BLOCKS = 64, 1 << 16
#: Documents of a shard on average; shards of a source at most (they then grow, and
#: are sorted on disk like any window).
SHARD_DOCS, MOST_SHARDS = 256, 1 << 16


def words(text: Column) -> Column:
    """Number of runs of characters other than space and \\x09-\\x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: np.ndarray, weights: np.ndarray, epochs: float = EPOCHS) -> np.ndarray:
    """Words of each source in the mix: shares by weight, none above `epochs` x its size."""
    limit, target = epochs * sizes.astype(float), np.zeros(len(sizes))
    free = np.ones(len(sizes), bool)
    while free.any():
        left = sizes.sum() - limit[~free].sum()
        target[free] = left * weights[free] / weights[free].sum()
        over = free & (target > limit)
        if not over.any():
            break
        free &= ~over
        target[over] = limit[over]
    return target


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats of each party by highest quotients votes / (2 seats + 1).

    No party gets more than `most`; ties go to the earlier party.  Starting from
    votes rounded at the mean price of a seat, which is this method's answer for some
    number of seats, single seats are added or taken back to reach `seats`.
    """
    votes = np.asarray(votes, float)
    total = votes.sum()
    got = np.minimum(np.floor(votes * seats / total + 0.5).astype(np.int64), most) if total > 0 else np.zeros(len(votes), np.int64)
    missing = int(min(seats, np.where(votes > 0, most, 0).sum()) - got.sum())
    if missing > 0:
        heap = [(-votes[i] / (2 * got[i] + 1), i) for i in np.flatnonzero((votes > 0) & (got < most))]
        heapq.heapify(heap)
        for _ in range(missing):
            _, i = heapq.heappop(heap)
            got[i] += 1
            if got[i] < most[i]:
                heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    elif missing < 0:
        heap = [(votes[i] / (2 * got[i] - 1), -i) for i in np.flatnonzero(got > 0)]
        heapq.heapify(heap)
        for _ in range(-missing):
            _, i = heapq.heappop(heap)
            got[-i] -= 1
            if got[-i] > 0:
                heapq.heappush(heap, (votes[-i] / (2 * got[-i] - 1), i))
    return got


def _source_quotas(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All sources, one row each: their targets and quotas of blocks."""
    table = pd.concat([*frames, pd.DataFrame({"source_key": [], "source_size": []})], ignore_index=True).sort_values("source_key", ignore_index=True)
    sizes = table.source_size.to_numpy(np.int64)
    table["target"] = targets(sizes, np.array([WEIGHTS[i % len(WEIGHTS)] for i in range(len(table))]))
    block = int(max(1, min(BLOCK_WORDS, sizes.sum() // LEAST_BLOCKS)))
    table["block"] = block
    table["blocks"] = sainte_lague(table.target.to_numpy(), round(int(sizes.sum()) / block), EPOCHS * -(-sizes // block))
    table["source_key"] = table["source_key"].astype(object)  # one array, however many frames came
    yield table[["source_key", "target", "block", "blocks"]]


def _shard_quotas(shards: pd.DataFrame) -> pd.DataFrame:
    """The shards of one source (MOST_SHARDS at most): each gets its quota of blocks."""
    shards = shards.sort_values("shard", ignore_index=True)
    size, block = shards.shard_size.to_numpy(np.int64), int(shards.block.iloc[0])
    shards["source_key"] = shards["source_key"].astype(object)
    shards["quota"] = sainte_lague(size, int(shards.blocks.iloc[0]), EPOCHS * -(-size // block))
    return shards[["source_key", "shard", "shard_size", "source_size", "target", "block", "quota"]]


def _stream(docs: DataFrame, mark: Column) -> DataFrame:
    """Every row of `docs` with its place in a shard's stream of words, and what the mix takes
    of it: doc_id, mark, size, source_size, target, taken, source_key, shard, draw."""
    # Null is a source of its own: "1" sorts after "0" and any name.
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    # The text counts too, so that rows without an id, or of one id, are spread over shards.
    draw = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text", F.lit(SEED))
    # The only pass over the texts; from here on rows are narrow.
    rows, _ = store(docs.select("doc_id", mark.alias("mark"), words(F.col("text")).alias("size"), key.alias("source_key"), draw.alias("draw")), "sizes")
    shard_count = F.least(F.lit(MOST_SHARDS), F.ceil(F.count("*") / SHARD_DOCS)).cast("long")
    sources, _ = store(rows.groupBy("source_key").agg(F.sum("size").alias("source_size"), shard_count.alias("shards")), "sources")
    # One row a source; quotas of one source's shards (MOST_SHARDS at most) are one group.
    quotas = sources.select("source_key", "source_size").coalesce(1).mapInPandas(_source_quotas, "source_key string, target double, block long, blocks long")

    # Spark broadcasts the sources if they are few, and else splits the hot ones (AQE).
    placed = rows.join(sources.select("source_key", "shards"), "source_key").select("doc_id", "mark", "size", "source_key", "draw", F.pmod("draw", "shards").alias("shard"))
    shards = placed.groupBy("source_key", "shard").agg(F.sum("size").alias("shard_size"))
    shards = shards.join(sources.select("source_key", "source_size"), "source_key").join(quotas, "source_key")
    shards = shards.groupBy("source_key").applyInPandas(_shard_quotas, "source_key string, shard long, shard_size long, source_size long, target double, block long, quota long")
    shards, _ = store(shards, "shards")

    stream = Window.partitionBy("source_key", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    streamed = placed.withColumn("end", F.sum("size").over(stream)).join(shards, ["source_key", "shard"])
    blocks = F.greatest(F.lit(1), F.expr("(shard_size + block - 1) div block"))
    streamed = streamed.withColumn("n", blocks).withColumn("turn", F.pmod(F.xxhash64("source_key", "shard", F.lit(SEED)), F.col("n")))
    # Blocks before j are taken (j * quota + turn) div n times in all, so block j is
    # taken the next such count less this one; a place inside it adds its words so far.
    before = lambda j: f"(({j}) * quota + turn) div n"
    upto = lambda x: f"(block * ({before(f'({x}) div block')}) + (({x}) % block) * (({before(f'({x}) div block + 1')}) - ({before(f'({x}) div block')})))"
    taken = F.expr(f"{upto('end')} - {upto('end - size')}")
    return streamed.select("doc_id", "mark", "size", "source_size", "target", taken.alias("taken"), "source_key", "shard", "draw")


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of `docs` (doc_id, source, text).

    Sources are ordered by code point with null last and weigh WEIGHTS in turn.  A
    document without words takes part with size and taken 0.  Repeated rows are
    separate documents, next to each other in the stream; rows without an id are told
    apart by their texts.  An empty table gives an empty one.
    """
    return _stream(docs, F.lit(0)).select("doc_id", "size", "source_size", "target", "taken")


def repeat_documents(docs: DataFrame) -> DataFrame:
    """`docs` with every document as often as the mix takes it: 0 to EPOCHS times.

    Taken words are a whole number of copies and a part of one.  The parts of a shard's
    documents, in order of size, are added up, and a document becomes one more copy
    where the sum passes a whole number from a seeded start: each shard emits as many
    copies as it takes, to less than one.  Documents without words go.

    Rows are told apart by id, text and all other plain columns, so rows of one id or
    without one have copies of their own; rows that are equal in all of these share
    theirs.  Columns may have any name.
    """
    plain = [f.name for f in docs.schema.fields if isinstance(f.dataType, AtomicType)]
    mark = F.xxhash64(*[F.col(f"`{name}`") for name in plain])
    part = (F.col("taken") % F.col("size")) / F.col("size")
    line = Window.partitionBy("source_key", "shard").orderBy("size", "draw", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.pmod(F.xxhash64("source_key", "shard", F.lit(f"{SEED}/copies")), F.lit(1 << 20)) / (1 << 20)
    mixed = _stream(docs, mark).where("size > 0").withColumn("part", part).withColumn("sum", F.round(F.sum("part").over(line), 9) + start)
    # Rounded sums begin where the one before ends, so no copy is lost between them.
    ended = F.lag(F.floor("sum"), 1).over(Window.partitionBy("source_key", "shard").orderBy("size", "draw", "doc_id", "mark"))
    extra = F.floor("sum") - F.coalesce(ended, F.floor(start))
    copies = mixed.select("doc_id", "mark", (F.expr("taken div size") + extra).alias("copies"))
    chosen = copies.groupBy(_named("doc_id"), "mark").agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    # The row as one struct, so that no column of it can clash.
    rows = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"), _named("doc_id"), mark.alias("mark"))
    # Equal rows stand for all of their copies once; the join's partitioning serves that too.
    joined = rows.join(chosen, ["id", "mark"]).dropDuplicates(["id", "mark"])
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def _named(column: str) -> Column:
    """An id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("")).alias("id")
