"""SimHash near-duplicates, found by fuzzy hashing with the binary Golay code.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each read as
a word of the perfect (23, 12) Golay code, which decodes any word to the one
codeword within 3 bits.  Decoding a segment and its one-bit neighbours gives one to
six codeword indices; two segments within 2 bits of each other share one of them,
that of a word halfway.

Fingerprints within 4 bits have segment errors that sum to 4 at most, so
  * one segment has no error, and another has 2 at most: key = that segment's exact
    bits and an index of the other; or
  * every segment has an error, so that two have exactly one and the third has 1 or
    2: walking half the way from either side flips one bit in each of at most two
    segments, and the triples of indices there hold a common one: key = the triple.
Every link thus shares a key of 34 or 36 bits; sharing one proves nothing, so the
pairs of a key are compared bit by bit.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from verdigris.llm._shared import bounded_batches, drop, store
from verdigris.llm.graph import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: (first bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Distinct fingerprints of one key that are compared with each other in a task.  A
#: larger group is linked through the words halfway between its members instead.
LARGE_GROUP = 2048
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if more than half the shingles' XXH64 values have it; 0 without words."""
    joined = b" ".join(_WORD.findall((text or "").encode("utf-8", "replace").lower()))
    if not joined:
        return 0
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20), len(joined))
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(shingle, len(ends)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), last, strict=False)), np.uint64, len(last))
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[a : a + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint_of(spark: SparkSession) -> Column:
    """A function of a text column: its fingerprint as a long (the same 64 bits)."""
    bounded_batches(spark)

    @F.arrow_udf("long")
    def prints(text: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py()) for t in text], np.uint64).view(np.int64))

    return prints


# ------------------------------------------------------------------ Golay code


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the three bytes of a word, and the error pattern of a syndrome."""

    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= _GENERATOR << (bit - 11)
        return word

    of_bit = [syndrome(1 << b) for b in range(23)]
    by_byte = np.zeros((3, 256), np.int32)
    for byte in range(3):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1 and 8 * byte + bit < 23:
                    by_byte[byte, value] ^= of_bit[8 * byte + bit]
    error = np.zeros(2048, np.int32)
    bits = range(23)
    for a in bits:
        error[of_bit[a]] = 1 << a
        for b in range(a):
            error[of_bit[a] ^ of_bit[b]] = 1 << a | 1 << b
            for c in range(b):
                error[of_bit[a] ^ of_bit[b] ^ of_bit[c]] = 1 << a | 1 << b | 1 << c
    return by_byte, error


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword within 3 bits of each 23-bit word."""
    by_byte, error = _tables()
    syndrome = by_byte[0][words & 255] ^ by_byte[1][words >> 8 & 255] ^ by_byte[2][words >> 16]
    return (words ^ error[syndrome]) >> 11


def _nearby(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each word's own index, and the other indices within one bit, padded with -1."""
    own = decode(words)
    around = np.sort(decode(words[:, None] ^ (1 << np.arange(bits))), axis=1)
    fresh = (around != own[:, None]) & np.concatenate([np.ones((len(words), 1), bool), around[:, 1:] != around[:, :-1]], 1)
    width = max(1, int(fresh.sum(1).max(initial=0)))
    order = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
    return own, np.where(np.take_along_axis(fresh, order, 1), np.take_along_axis(around, order, 1), -1)


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of the fingerprints (uint64), no key twice for a row."""
    segments = [(prints >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [_nearby(s, n) for s, (_, n) in zip(segments, SEGMENTS, strict=True)]
    kept: list[tuple[np.ndarray, np.ndarray]] = []

    def emit(kind: int, key: np.ndarray, valid: np.ndarray) -> None:
        row, column = np.nonzero(valid)
        kept.append((row, (kind << 48) | key[row, column]))

    kind = 0
    for exact in range(3):
        for fuzzy in range(3):
            if exact != fuzzy:
                index = np.concatenate([near[fuzzy][0][:, None], near[fuzzy][1]], 1)
                emit(kind, segments[exact][:, None] << 12 | index, index >= 0)
                kind += 1
    place = (24, 12, 0)
    own = sum(near[s][0] << place[s] for s in range(3))[:, None]
    emit(kind, own, np.ones_like(own, bool))
    moved = [np.where(near[s][1] >= 0, near[s][1] - near[s][0][:, None] << place[s], 0) for s in range(3)]
    for s in range(3):
        emit(kind, own + moved[s], near[s][1] >= 0)
        for t in range(s):
            both = (near[s][1] >= 0)[:, :, None] & (near[t][1] >= 0)[:, None, :]
            pair = own[:, :, None] + moved[s][:, :, None] + moved[t][:, None, :]
            emit(kind, pair.reshape(len(prints), -1), both.reshape(len(prints), -1))
    return np.concatenate([r for r, _ in kept]), np.concatenate([k for _, k in kept])


def halfway(prints: np.ndarray) -> np.ndarray:
    """All 2081 words within 2 bits of each fingerprint: two that share one are linked."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    return prints[:, None] ^ np.concatenate([np.zeros(1, np.uint64), one, one[i] | one[j]])


# ----------------------------------------------------------------------- links


def _close_pairs(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows of the same key, as stars; rows come sorted by key.

    All rows of a key are compared, but of the links only what holds the linked rows
    together leaves: each row with the smallest one that links lead to.
    """
    own = np.arange(len(key))
    found: list[np.ndarray] = []
    at, lag = own, 0
    while True:
        lag += 1
        at = at[at + lag < len(key)]
        at = at[key[at + lag] == key[at]]
        if not len(at):
            break
        close = at[np.bitwise_count(value[at] ^ value[at + lag]) <= DISTANCE]
        found.append(np.stack([close, close + lag]))
    pairs = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
    root = own.copy()
    while True:
        low = np.minimum(root[pairs[0]], root[pairs[1]])
        before = root.copy()
        for side in pairs:
            np.minimum.at(root, side, low)
        root = root[root]
        if np.array_equal(before, root):
            break
    linked = root != own
    stars = np.stack([value[root[linked]], value[linked]]).view(np.int64)
    stars = np.unique(np.sort(stars[:, stars[0] != stars[1]], axis=0), axis=1)
    return stars[0], stars[1]


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows (key, print) sorted by key.

    A row (print, null) marks a member of a group beyond LARGE_GROUP.
    """
    key, value = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    streaming = None  # the large group whose members are being passed on

    def finish(key: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        heads, counts = np.unique(key, return_counts=True)
        large = np.isin(key, heads[counts > LARGE_GROUP])
        a, b = _close_pairs(key[~large], value[~large])
        yield pa.record_batch([pa.array(a), pa.array(b)], _LINK)
        if large.any():
            yield passed(value[large])

    def passed(value: np.ndarray) -> pa.RecordBatch:
        v = np.unique(value.view(np.int64))
        return pa.record_batch([pa.array(v), pa.nulls(len(v), pa.int64())], _LINK)

    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy()])
        value = np.concatenate([value, batch.column(1).to_numpy().view(np.uint64)])
        if streaming is not None:
            same = key == streaming
            if same.any():
                yield passed(value[same])
            if same.all():
                key, value = key[:0], value[:0]
                continue
            key, value, streaming = key[~same], value[~same], None
        if not len(key):
            continue
        open_from = int(np.searchsorted(key, key[-1]))  # the last group may go on in the next batch
        if open_from:
            yield from finish(key[:open_from], value[:open_from])
            key, value = key[open_from:], value[open_from:]
        if len(key) > LARGE_GROUP:
            streaming = int(key[0])
            yield passed(value)
            key, value = key[:0], value[:0]
    if len(key):
        yield from finish(key, value)


def _emit(of: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            for a in range(0, len(prints), 1024):
                part = prints[a : a + 1024]
                if of == "keys":
                    row, key = keys(part)
                else:
                    words = halfway(part)
                    row, key = np.repeat(np.arange(len(part)), words.shape[1]), words.reshape(-1).view(np.int64)
                yield pa.record_batch([pa.array(key), pa.array(part[row].view(np.int64))], names=["key", "print"])

    return rows


def links(prints: DataFrame) -> DataFrame:
    """(a, b) for distinct fingerprints (one long column): pairs that join what links of
    up to DISTANCE bits join, as many as rows at most (not all pairs of a dense group)."""
    spark = prints.sparkSession
    keyed = prints.mapInArrow(_emit("keys"), "key long, print long")
    found, found_at = store(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_compare, "a long, b long"), "close")
    large = found.where("b is null").select("a").distinct()
    near = found.where("b is not null")
    if large.isEmpty():
        return near
    # Exact for any size: fingerprints that share a word halfway are linked, whichever
    # they are, so a chain to the word's smallest fingerprint loses no link.
    words = large.mapInArrow(_emit("halfway"), "key long, print long")
    least = words.groupBy("key").agg(F.min("print").alias("b"))
    return near.unionByName(words.join(least, "key").where("print <> b").select(F.col("print").alias("a"), "b").distinct())


def _owners(rows: DataFrame, first: Column) -> DataFrame:
    """(print, owner) of every fingerprint of `rows`: the least `first` of its component."""
    spark = rows.sparkSession
    classes, classes_at = store(rows.groupBy("print").agg(F.min(first).alias("first")), "classes")
    roots = components(links(classes.select("print")))
    linked = classes.join(roots.withColumnRenamed("node", "print"), "print")
    lowest = linked.groupBy("root").agg(F.min("first").alias("lowest"))
    moved = linked.join(lowest, "root").select("print", "lowest")
    # Components first, then one join that carries the ids of all rows.
    owners, _ = store(classes.join(moved, "print", "left").select("print", F.coalesce("lowest", "first").alias("owner")), "owners")
    drop(spark, classes_at)
    return owners


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of `docs` (doc_id, text).

    Exact copies are one fingerprint from the start; components are found among
    distinct fingerprints.  Texts without words (null, empty, white space) have
    fingerprint zero and are linked like others.  component_id is the smallest
    doc_id reachable (null only if the component has no id); repeated rows stay.
    """
    rows, _ = store(docs.select("doc_id", fingerprint_of(docs.sparkSession)("text").alias("print")), "fingerprints")
    owners = _owners(rows, F.col("doc_id")).withColumnRenamed("owner", "component_id")
    return rows.join(owners, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id.

    A row without an id comes after all that have one.  Of rows of one id, the one whose
    text and other plain columns have the least hash comes first; rows of one id that
    are no near-duplicates of each other are separate groups, and each has its row.
    Other columns may have any name.
    """
    plain = [f.name for f in docs.schema.fields if isinstance(f.dataType, AtomicType)]
    absent, mark = F.col("doc_id").isNull(), F.xxhash64(*[F.col(f"`{name}`") for name in plain])
    rows, rows_at = store(docs.select(absent.alias("absent"), "doc_id", mark.alias("mark"), fingerprint_of(docs.sparkSession)("text").alias("print")), "fingerprints")
    owners = _owners(rows, F.struct("absent", "doc_id", "mark"))
    drop(docs.sparkSession, rows_at)
    first = owners.select("owner.doc_id", "owner.mark").distinct()
    # An id as text that is never null: one partitioning serves the join and the last step.
    named = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")).alias("id")
    whole = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"), named(F.col("doc_id")), mark.alias("mark"))
    kept = whole.join(first.select(named(F.col("doc_id")), "mark"), ["id", "mark"], "left_semi")
    # Equal rows are one document.
    return kept.dropDuplicates(["id", "mark"]).select("row.*")
