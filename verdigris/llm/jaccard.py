"""Exact Jaccard join of documents by word shingles, with token-combination prefixes.

Documents are sets of shingle hashes; equal sets are one node from the start.  A global
order of shingles puts a fixed share of the hash space first, by rising document
frequency, and the rest behind, by hash.  Of a set of n shingles at most
missing(n) = floor((1 - t) n) are absent from a set that it links to.

Shingles are of three classes by their document frequency: rare ones are signatures by
themselves, frequent ones in pairs, very frequent ones in triples.  The prefix of a set
is extended until destroying all its signatures takes missing(n) + 1 absent shingles: a
rare one counts 1, and k-combinations among c shingles count c - (k - 1).  Of two linked
sets, the one whose prefix ends first has a signature that the other has too.  To keep
combinations few, they are formed within buckets of about 32 shingles of a set: the
number of buckets belongs to a band of sizes, and each set has signatures for its own
band and the next, so that linked sets meet in one.

Sets that share signatures, directly or through others, make up a block.  The sets of a
block are verified against each other in tiles of bounded size; of a block with many
tiles, each tile first by itself, and then only what that has not yet joined.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm._shared import MANY_ROWS, bounded_batches, drop, store
from verdigris.llm.graph import components
from verdigris.llm.words import WordHashes, grams, mixed

SHINGLE, PERCENT = 4, 85
#: Hashes below this come first, by frequency: a third of all.
FIRST = np.uint64((1 << 64) // 3)
#: Most documents of a rare and of a frequent shingle; frequencies count up to SATURATED.
RARE, FREQUENT, SATURATED = 64, 4096, 1 << 16
BUCKET = 32
#: Sets and shingles of one tile, about.
TILE_SETS, TILE_SHINGLES = 1024, 1 << 21
#: Sets that a task remembers to have passed on.
MOST_SEEN = 1 << 20
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_U = np.uint64


# ------------------------------------------------------------------------- sets


def shingles(text: str | None, hashes: WordHashes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; of fewer words, one of all of them."""
    words = hashes.of(_WORD.findall((text or "").encode("utf-8", "replace").lower()))
    return np.unique(grams(words, min(shingle, len(words)))) if len(words) else np.zeros(0, np.uint64)


def node(tokens: np.ndarray) -> int:
    """The 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(tokens.tobytes())).view(np.int64))


class Join:
    """What the threshold (a per cent) implies for sets of n shingles."""

    def __init__(self, percent: int = PERCENT):
        if not 50 <= percent <= 100:
            raise ValueError("a threshold of 50 to 100 per cent")
        self.percent = percent
        least = next((n for n in range(1, 200) if self.linkable(n)), 200)
        #: Classes of shingles; combinations need sets that are long enough for them.
        self.classes = 3 if least - self.missing(least) >= 4 else 1
        # A little wider than the threshold, so that rounding puts no pair two bands apart.
        self.base = 1 / (percent / 100 * 0.999)

    def missing(self, n: int) -> int:
        return n - -(-self.percent * n // 100)

    def linkable(self, n: int) -> bool:
        """Whether a set of n can link to an unequal one."""
        return 100 * n >= self.percent * (n + 1)

    def band(self, n: int) -> int:
        return int(np.floor(np.log(n) / np.log(self.base)))

    def buckets(self, label: int) -> int:
        return max(1, int(self.base ** (label - 1)) // BUCKET)

    def needed(self, n: int) -> int:
        """Shingles that hold every prefix of a set of n."""
        waste = 3 * self.buckets(self.band(n) + 1) if self.classes == 3 else 0
        return min(n, self.missing(n) + 1 + waste)

    def links(self, common, n, m):
        return 100 * common >= self.percent * (n + m - common)


def prefix_tokens(tokens: np.ndarray, join: Join) -> tuple[np.ndarray, int]:
    """The shingles of a sorted set that its prefixes are taken from, and how many of them
    are of the first part of the order."""
    first = int(np.searchsorted(tokens, FIRST))
    return tokens[: max(first, join.needed(len(tokens)))], first


def set_signatures(n: int, first: int, tokens: np.ndarray, df: np.ndarray, join: Join) -> Iterator[int]:
    """Signatures of a set from its shingles in order of `prefix_tokens` (those of the first
    part that are met in one set only may be left out; `first` counts them too)."""
    front = tokens < FIRST
    order = np.lexsort((tokens, np.where(front, df, 0), ~front))
    tokens, df = tokens[order], df[order]
    alone = first - int(front.sum())
    need = join.missing(n) + 1 - alone  # lone shingles come first and count 1 each
    if need <= 0:
        return
    kind = np.where(df <= RARE, 1, np.where(df <= FREQUENT, 2, 3)) if join.classes == 3 else np.ones(len(df), np.int64)
    for label in (join.band(n), join.band(n) + 1):
        buckets = join.buckets(label)
        bucket = np.where(kind == 1, -1, (mixed(tokens) % _U(buckets)).astype(np.int64))
        held: dict[tuple[int, int], list[int]] = {}
        left = need
        for token, k, b, f in zip(tokens.tolist(), kind.tolist(), bucket.tolist(), df.tolist(), strict=True):
            if left <= 0:
                break
            if k == 1:
                left -= 1
                if f > 1:
                    yield hash_of(label, (token,))
                continue
            own = held.setdefault((k, b), [])
            for others in itertools.combinations(own, k - 1):
                yield hash_of(label, (*others, token))
            own.append(token)
            left -= len(own) >= k


def hash_of(label: int, tokens: tuple[int, ...]) -> int:
    """A signature: tokens in the global order, which is the same in all sets."""
    return xxhash.xxh64_intdigest(np.array(tokens, np.uint64).tobytes(), label) - (1 << 63)


# --------------------------------------------------------------- Spark: candidates


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, mark, node, n) of every row (doc_id, mark, text)."""
    hashes = WordHashes()
    for batch in batches:
        sets = [shingles(t.as_py(), hashes) for t in batch.column(2)]
        nodes = pa.array([node(s) for s in sets], pa.int64())
        yield pa.record_batch([batch.column(0), batch.column(1), nodes, pa.array([len(s) for s in sets], pa.int64())], names=["doc_id", "mark", "node", "n"])


def _tokens(join: Join):
    """(token, node, n, first) of every distinct linkable set of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            kept = []
            for text in batch.column(0):
                tokens = shingles(text.as_py(), hashes)
                if not join.linkable(len(tokens)) or (name := node(tokens)) in seen:
                    continue
                if len(seen) >= MOST_SEEN:
                    seen.clear()
                seen.add(name)
                front, first = prefix_tokens(tokens, join)
                kept.append((front, name, len(tokens), first))
            if kept:
                sizes = [len(k[0]) for k in kept]
                spread = lambda i, kind: pa.array(np.repeat(np.array([k[i] for k in kept], kind), sizes))  # noqa: B023, E731
                yield pa.record_batch([pa.array(np.concatenate([k[0] for k in kept]).view(np.int64)), spread(1, np.int64), spread(2, np.int32), spread(3, np.int32)], names=["token", "node", "n", "first"])

    return run


_FOUND = "node long, n int, first int, token long, df int"


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n, first, token, df) from rows sorted by token and node.

    Shingles of one set in the first part of the order are left out.  A shingle with
    more than SATURATED sets is passed on as it comes.
    """
    names = ["node", "n", "first", "token", "df"]
    rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)]  # token, node, n, first
    full = None

    def out(rows, df):
        kept = (df > 1) | (rows[0].view(np.uint64) >= FIRST)
        token, name, n, first = (c[kept] for c in rows)
        return pa.record_batch([pa.array(name), pa.array(n), pa.array(first), pa.array(token), pa.array(df[kept].astype(np.int32))], names=names)

    def closed(rows):
        starts = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))
        counts = np.diff(np.append(starts, len(rows[0])))
        return out(rows, np.minimum(np.repeat(counts, counts), SATURATED))

    for batch in batches:
        rows = [np.concatenate([a, batch.column(i).to_numpy()]) for i, a in enumerate(rest)]
        if len(rows[0]) > 1:  # a set comes once from every task that has met it
            fresh = np.concatenate([[True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])])
            rows = [c[fresh] for c in rows]
        if full is not None:
            same = rows[0] == full
            # The last one stays, to be compared with what follows.
            if same.all():
                if len(rows[0]) > 1:
                    yield out([c[1:] for c in rows], np.full(len(rows[0]) - 1, SATURATED))
                rest = [c[-1:] for c in rows]
                continue
            if same.sum() > 1:
                yield out([c[same][1:] for c in rows], np.full(int(same.sum()) - 1, SATURATED))
            rows, full = [c[~same] for c in rows], None
        open_from = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
        if open_from:
            yield closed([c[:open_from] for c in rows])
        rest = [c[open_from:] for c in rows]
        if len(rest[0]) > SATURATED:
            full = int(rest[0][0])
            yield out(rest, np.full(len(rest[0]), SATURATED))
            rest = [c[-1:] for c in rest]
    if full is None and len(rest[0]):
        yield closed(rest)


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.RecordBatch]:
    """Record batches that each hold whole groups of column `by`, by which rows are sorted."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(by)
        other = np.flatnonzero(pc.not_equal(key, key[batch.num_rows - 1]).to_numpy(zero_copy_only=False))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut or (rest and rest[-1].column(by)[0] != key[0]):
            head = [*rest, batch.slice(0, cut)] if cut else rest
            yield pa.Table.from_batches(head).combine_chunks().to_batches()[0]
            rest = [batch.slice(cut)]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def _signed(join: Join):
    """(key, node) of every signature, from rows of `_frequencies` sorted by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 0):
            name, n, first, token, df = (rows.column(i).to_numpy() for i in range(5))
            token = token.view(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            keys, owners = [], []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(name)], strict=True):
                own = np.fromiter(set_signatures(int(n[a]), int(first[a]), token[a:b], df[a:b], join), np.int64)
                keys.append(own), owners.append(np.full(len(own), name[a]))
                if sum(map(len, keys)) > 1 << 17:
                    yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], names=["key", "node"])
                    keys, owners = [], []
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], names=["key", "node"])

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): each node of a signature with the signature's first one; rows sorted by key."""
    key, head = None, None
    for batch in batches:
        keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        starts = np.concatenate([[True], keys[1:] != keys[:-1]])
        if keys[0] == key:
            starts[0] = False
        at = np.maximum.accumulate(np.where(starts, np.arange(len(keys)), -1))
        heads = np.where(at >= 0, nodes[at], head if head is not None else 0)
        key, head = keys[-1], heads[-1]
        linked = heads != nodes
        yield pa.record_batch([pa.array(heads[linked]), pa.array(nodes[linked])], names=["a", "b"])


def candidate_blocks(texts: DataFrame, join: Join) -> DataFrame:
    """(node, root) of the sets of `texts` (text) that share a signature with another one."""
    rows = texts.mapInArrow(_tokens(join), "token long, node long, n int, first int")
    found = rows.repartition("token").sortWithinPartitions("token", "node").mapInArrow(_frequencies, _FOUND)
    keyed = found.repartition("node").sortWithinPartitions("node").mapInArrow(_signed(join), "key long, node long")
    stars = keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_stars, "a long, b long")
    return components(stars.distinct())


# ------------------------------------------------------------- Spark: verification


def _linked(sets: list[np.ndarray], side: np.ndarray, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """(row, row) of links as stars; rows of one side 2 are not compared with each other."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    if n <= 6:
        for i, j in itertools.combinations(range(n), 2):
            if (side[i] != 2 or side[j] != 2) and join.links(min(sizes[i], sizes[j]), sizes[i], sizes[j]):
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if join.links(common, sizes[i], sizes[j]):
                    pairs.append((np.array([i]), np.array([j])))
    else:
        owner = np.repeat(np.arange(n), sizes)
        _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count > 1
        column = np.cumsum(shared) - 1
        keep = shared[place]
        owner, column = owner[keep], column[place[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        width = max(256, min(4096, (1 << 24) // n))
        common = np.zeros((n, n), np.float32)
        for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            lo, hi = np.searchsorted(column, [a, a + width])
            held = np.zeros((n, width), np.float32)
            held[owner[lo:hi], column[lo:hi] - a] = 1
            common += held @ held.T
        ok = np.triu(join.links(common.astype(np.int64), sizes[:, None], sizes[None, :]), 1)
        ok &= (side[:, None] != 2) | (side[None, :] != 2)
        pairs.append(np.nonzero(ok))
    a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
    b = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low), np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(before, root):
            break
    rows = np.flatnonzero(root != np.arange(n))
    return root[rows], rows


def _verified(join: Join):
    """Links (a, b) among rows (key, side, node, tokens) sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 0):
            key = np.array(rows.column(0).to_pylist())
            side, name = rows.column(1).to_numpy(), rows.column(2).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist()
            a, b = [], []
            for lo, hi in zip(starts, [*starts[1:], len(key)], strict=True):
                sets = [np.frombuffer(rows.column(3)[i].as_py(), np.uint64) for i in range(lo, hi)]
                i, j = _linked(sets, side[lo:hi], join)
                a.append(name[lo + i]), b.append(name[lo + j])
            yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, node, ...) with tokens for the text, each node once in a task."""
    hashes, seen = WordHashes(), set()
    for batch in batches:
        names, kept = batch.column(1).to_pylist(), []
        for i, name in enumerate(names):
            if name not in seen:
                seen.add(name), kept.append(i)
        if len(seen) > MOST_SEEN:
            seen.clear()
        batch = batch.take(pa.array(kept, pa.int64()))
        tokens = pa.array([shingles(t.as_py(), hashes).tobytes() for t in batch.column(0)], pa.binary())
        yield pa.record_batch([*batch.columns[1:], tokens], names=[*batch.schema.names[1:], "tokens"])


def _compare(rows: DataFrame, join: Join) -> DataFrame:
    return rows.select("key", "side", "node", "tokens").repartition("key").sortWithinPartitions("key").mapInArrow(_verified(join), "a long, b long")


def _tiles(sets: Column, tokens: Column) -> Column:
    return F.greatest(F.ceil(sets / TILE_SETS), F.ceil(tokens / TILE_SHINGLES)).cast("int")


def links(docs: DataFrame, described: DataFrame, join: Join) -> DataFrame:
    """(a, b): links that join what all links among the sets of `docs` (doc_id, text) join.

    `described` has (doc_id, mark, node, n) of every row.
    """
    blocks, blocks_at = store(candidate_blocks(docs.select("text"), join).withColumnRenamed("root", "block"), "blocks")
    size = described.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("copy"), F.first("n").alias("n"))
    members = size.join(blocks, "node")
    tiles = members.groupBy("block").agg(_tiles(F.count("*"), F.sum("n")).alias("tiles"))
    placed = members.join(tiles, "block").select(named("copy.doc_id"), F.col("copy.mark").alias("mark"), "node", "block", "n", "tiles", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("tile"))
    texts = docs.select("text", named("doc_id"), mark())
    # One text of each set: repeated rows of one id are one text.
    read = texts.join(placed, ["id", "mark"]).select("text", "node", "block", "n", "tiles", "tile").mapInArrow(_sets, "node long, block long, n long, tiles int, tile int, tokens binary")
    sets, sets_at = store(read, "sets")
    key = lambda *parts: F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]).alias("key")
    first, _ = store(_compare(sets.select(key("block", "tile"), F.lit(1).alias("side"), "node", "tokens"), join).distinct(), "links")
    large = sets.where("tiles > 1")
    if large.isEmpty():
        drop(docs.sparkSession, blocks_at)
        return first
    # The largest component of each block needs no comparison within itself.
    rooted = large.select("node", "block", "n", "tiles").distinct().join(components(first), "node", "left").withColumn("root", F.coalesce("root", "node"))
    main = rooted.groupBy("block", "root").agg(F.count("*").alias("size")).groupBy("block").agg(F.max_by("root", F.struct("size", "root")).alias("main"))
    sided = rooted.join(main, "block").withColumn("stray", F.col("root") != F.col("main"))
    parts = sided.groupBy("block").agg(_tiles(F.count_if("stray"), F.sum(F.when(F.col("stray"), F.col("n")))).alias("strays"))
    cast = sided.join(parts, "block").where("strays > 0").select("node", "stray", "strays")
    rows = large.join(cast, "node")
    own = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("strays")).cast("int")
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    # Strays meet strays of every part, and all others part by part.
    among = F.transform(numbers(F.col("strays")), lambda j: F.struct(F.concat(F.lit("s"), F.least(own, j).cast("string"), F.lit(":"), F.greatest(own, j).cast("string")).alias("key"), F.lit(1).alias("side")))
    across = F.transform(numbers(F.col("tiles")), lambda j: F.struct(F.concat(F.lit("m"), own.cast("string"), F.lit(":"), j.cast("string")).alias("key"), F.lit(1).alias("side")))
    others = F.transform(numbers(F.col("strays")), lambda j: F.struct(F.concat(F.lit("m"), j.cast("string"), F.lit(":"), F.col("tile").cast("string")).alias("key"), F.lit(2).alias("side")))
    spread = rows.select("node", "block", "tokens", F.explode(F.when(F.col("stray"), F.concat(among, across)).otherwise(others)).alias("to"))
    second = _compare(spread.select(key("block", F.col("to.key")), "to.side", "node", "tokens"), join)
    return first.unionByName(second).distinct()


def named(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias("id")


def mark() -> Column:
    """A hash of the text, by which rows of one id are told apart."""
    return F.xxhash64("text").alias("mark")


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs` (doc_id, text).

    Two documents link when 100 times their common shingles are `percent` times their
    union or more.  component_id is the smallest doc_id reachable (null only where none
    has an id); texts without words (null, empty, white space) link with nothing, not
    with each other either.  Repeated rows stay; other columns are not looked at; an
    empty table gives an empty result.  Shingles and sets are told apart by 64-bit
    hashes.
    """
    spark = docs.sparkSession
    bounded_batches(spark, MANY_ROWS)
    join = Join(percent)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described, _ = store(rows.select("doc_id", mark(), "text").mapInArrow(_described, "doc_id long, mark long, node long, n long"), "described")
    linked = links(rows, described.where("n > 0"), join)
    roots, _ = store(components(linked), "roots")
    least = described.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    moved = least.join(roots, "node")
    lowest = moved.groupBy("root").agg(F.min("least").alias("lowest"))
    owner = least.join(moved.join(lowest, "root").select("node", "lowest"), "node", "left").select("node", F.coalesce("lowest", "least").alias("owner"))
    owners, _ = store(owner, "owners")
    joined = described.join(owners, "node", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("owner")).otherwise(F.col("doc_id")).alias("component_id"))


def oracle() -> str:
    """DuckDB SQL of `jaccard_components`."""
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - {SHINGLE - 1}) + 1), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' '))) AS s FROM w WHERE len(w) > 0
), t AS (
  SELECT DISTINCT doc_id, s FROM s
), n AS (
  SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least_id, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT a, min(b) AS least_id FROM reach GROUP BY a) r ON r.a = w.doc_id
"""
