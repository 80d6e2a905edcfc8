"""Phrases whose words occur together more often than apart, per language.

Every phrase of one to LONGEST words that occurs FEWEST times or more is counted exactly
in two steps:

1. Misra-Gries summaries.  The hash space of phrases is cut into cells.  Each task keeps
   one summary a cell: distinct phrases (64-bit hashes) with counts, at most `capacity`
   of them; where there are more, the count that leaves `capacity` is taken off all.
   Summaries of a cell are merged in the same way.  With M occurrences in the cell, a
   capacity above M / FEWEST bounds what a count can lose below FEWEST, so every
   frequent phrase survives, whatever the order and partitioning.  What has been taken
   off is kept too: phrases that fall short of FEWEST even with it are no survivors.
   Words come first, then pairs, then longer phrases, each with the phrases only whose
   parts have survived (no part of a frequent phrase is less frequent).
2. Phrases that have survived are counted exactly in a second pass over the texts.

What has survived is told to tasks as bits at hashed places in a table of fixed size.
Two phrases at one place cost time, never a result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.llm._shared import MANY_ROWS, bounded_batches, drop, store
from verdigris.llm.words import BreakHashes, grams

LONGEST, FEWEST, MOST = 5, 100, 2000
#: A candidate goes if a longer one that holds it has this share (per cent) of its occurrences.
ABSORBED = 100
#: Bits of the table of survivors of each length (8 MB).
FILTER_BITS = 1 << 26
#: UTF-8 bytes of text for each cell of the hash space, and the fewest cells.
BYTES_PER_CELL, FEWEST_CELLS = 1 << 30, 64
#: Words that a task takes at once, and counters that it gathers before it merges them.
WORDS_PER_STEP, COUNTERS_PER_MERGE = 1 << 17, 1 << 20
#: Phrases that a task counts exactly before it passes them on.
MOST_COUNTED = 200_000
UNKNOWN = "und"

_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_TOKEN = re.compile(rb"[.,;:!?\x0A-\x0D]|[^\x20\x09.,;:!?\x0A-\x0D]+")
_U = np.uint64
#: Bits that keys of summaries go without: phrases that are alike in the rest are counted
#: as one there, which can only add a survivor.
KEY_CUT = 16


# ----------------------------------------------------------------------- texts


class _Reader:
    """Texts as hashes of their words, 0 between pieces, and the language's hash of each."""

    def __init__(self):
        self.hashes = BreakHashes(_BREAKS)

    def chunks(self, batches: Iterator[pa.RecordBatch], keep: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, list, list]]:
        """(word hashes, language hash of each, tokens, (language, words) of texts)."""
        hashes, langs, tokens, told, size = [], [], [], [], 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                name, found = UNKNOWN if not lang.is_valid else lang.as_py(), _TOKEN.findall((text.as_py() or "").encode().lower())
                found.append(b".")
                h = self.hashes.of(found)
                hashes.append(h)
                langs.append(np.full(len(h), xxhash.xxh64_intdigest(name, 7), np.uint64))
                told.append((name, int(np.count_nonzero(h)), len(h)))
                if keep:
                    tokens += found
                size += len(h)
                if size >= WORDS_PER_STEP:
                    yield np.concatenate(hashes), np.concatenate(langs), tokens, told
                    hashes, langs, tokens, told, size = [], [], [], [], 0
        if hashes:
            yield np.concatenate(hashes), np.concatenate(langs), tokens, told


def _whole(hashes: np.ndarray, size: int) -> np.ndarray:
    """Whether a window of `size` words at each place lies within a piece."""
    breaks = np.concatenate([[0], np.cumsum(hashes == 0)])
    return breaks[size:] == breaks[:-size]


def _keys(hashes: np.ndarray, langs: np.ndarray, size: int) -> np.ndarray:
    return grams(hashes, size, seed=11) ^ langs[: max(0, len(langs) - size + 1)]


def packed(keys: np.ndarray) -> bytes:
    """Keys without their lowest KEY_CUT bits, six bytes each."""
    return np.ascontiguousarray((keys >> _U(KEY_CUT)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").reshape(-1) << _U(KEY_CUT)


class Survivors:
    """Bits of the phrases that may be frequent, by length."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def holds(self, keys: np.ndarray) -> np.ndarray:
        place = (keys >> _U(KEY_CUT)) & _U(len(self.bits) * 64 - 1)
        return (self.bits[(place >> _U(6)).astype(np.int64)] >> (place & _U(63)) & _U(1)).astype(bool)


def _phrases(hashes: np.ndarray, langs: np.ndarray, sizes: tuple[int, ...], known: dict[int, Survivors]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, places, keys) of the phrases that may be frequent, as far as is known of
    themselves and of their parts."""
    part = max((k for k in known if k < sizes[0]), default=0)
    held = {}
    for size in range(part, max(sizes) + 1) if part else sizes:
        at = np.flatnonzero(_whole(hashes, size)) if len(hashes) >= size else np.zeros(0, np.int64)
        if size - 1 in held:
            shorter = held[size - 1]
            at = at[shorter[at] & shorter[at + 1]]
        keys = _keys(hashes, langs, size)[at]
        if size in known:
            kept = known[size].holds(keys)
            at, keys = at[kept], keys[kept]
        held[size] = np.zeros(len(hashes) + 1, bool)
        held[size][at] = True
        if size in sizes:
            yield size, at, keys


# ------------------------------------------------------------------- summaries


def reduced(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """At most `capacity` counters, and what has been taken off all of them: the count of the
    next largest one.  A true count is at most its counter and that."""
    if len(keys) <= capacity:
        return keys, counts, 0
    off = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    stays = counts > off
    return keys[stays], counts[stays] - off, off


def merged(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The counters of summaries, added up, by key."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")  # runs that are sorted already are merged
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _cells(keys: np.ndarray, cells: int) -> np.ndarray:
    """Where each cell begins among sorted keys (the cell is a key's highest bits)."""
    shift = _U(64 - (cells - 1).bit_length())
    return np.searchsorted(keys >> shift, np.arange(cells + 1).astype(np.uint64)) if cells > 1 else np.array([0, len(keys)])


def _by_cell(keys: np.ndarray, counts: np.ndarray, capacity: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`reduced` in each cell of sorted keys; what is taken off is added to `error`."""
    starts = _cells(keys, len(capacity))
    if not (np.diff(starts) > capacity).any():
        return keys, counts
    parts = [reduced(keys[a:b], counts[a:b], int(c)) for a, b, c in zip(starts[:-1].tolist(), starts[1:].tolist(), capacity.tolist(), strict=True)]
    error += np.array([off for *_, off in parts])
    return np.concatenate([k for k, *_ in parts]), np.concatenate([c for _, c, _ in parts])


_SUMMARY = "size int, cell int, mass long, keys binary, counts binary, error long"
_SUMMARY_ARROW = pa.schema([("size", pa.int32()), ("cell", pa.int32()), ("mass", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("error", pa.int64())])


def _summaries(sizes: tuple[int, ...], capacity: dict[int, np.ndarray], known, masses: bool):
    """Summaries of one task; with `masses`, only the occurrences of longer phrases too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: Survivors(v.value) for k, v in known.items()}
        cells = len(capacity[sizes[0]])
        total = {k: (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for k in sizes}
        mass, error = ({k: np.zeros(cells, np.int64) for k in range(1, LONGEST + 1)} for _ in range(2))
        shift = _U(64 - (cells - 1).bit_length())
        waiting: dict[int, list] = {k: [] for k in sizes}

        def merge(size: int) -> None:
            if waiting[size]:
                total[size] = _by_cell(*merged(total[size], *waiting[size]), capacity[size], error[size])
                waiting[size] = []

        for hashes, langs, _, _ in _Reader().chunks(batches):
            for size, _, keys in _phrases(hashes, langs, sizes, held):
                waiting[size].append(np.unique(keys >> _U(KEY_CUT) << _U(KEY_CUT), return_counts=True))
                if sum(len(k) for k, _ in waiting[size]) > COUNTERS_PER_MERGE:
                    merge(size)
            for size in range(1, LONGEST + 1) if masses else ():
                if len(hashes) >= size:
                    keys = _keys(hashes, langs, size)[_whole(hashes, size)]
                    mass[size] += np.bincount((keys >> shift).astype(np.int64), minlength=cells)
        rows = []
        for size in sizes:
            merge(size)
        for size in range(1, LONGEST + 1):
            keys, counts = total.get(size, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            starts = _cells(keys, cells)
            for cell in range(cells):
                a, b = starts[cell], starts[cell + 1]
                if b > a or mass[size][cell]:
                    rows.append((size, cell, int(mass[size][cell]), packed(keys[a:b]), counts[a:b].tobytes(), int(error[size][cell])))
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _SUMMARY_ARROW, strict=True)] if rows else [pa.array([], t.type) for t in _SUMMARY_ARROW], schema=_SUMMARY_ARROW)

    return run


def _merge(capacity: dict[int, np.ndarray], fewest: int):
    """Survivors as (size, word, bits) from summaries sorted by size and cell, one at a time:
    the phrases whose counter and error reach `fewest`."""

    def bits(size: int, keys: np.ndarray) -> pa.RecordBatch:
        place = (keys >> _U(KEY_CUT)) & _U(FILTER_BITS - 1)
        word, value = (place >> _U(6)).astype(np.int64), _U(1) << (place & _U(63))
        order = np.argsort(word, kind="stable")
        word, value = word[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
        value = np.bitwise_or.reduceat(value, first) if len(word) else value
        return pa.record_batch([pa.array(np.full(len(first), size, np.int32)), pa.array(word[first].astype(np.int32)), pa.array(value.view(np.int64))], names=["size", "word", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept, error = None, (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 0

        def ended() -> pa.RecordBatch:
            return bits(at[0], kept[0][kept[1] + error >= fewest])

        for batch in batches:
            for size, cell, keys, counts, less in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)], strict=True):
                new = unpacked(keys), np.frombuffer(counts, np.int64)
                if (size, cell) == at:
                    *kept, off = reduced(*merged(kept, new), int(capacity[size][cell]))
                    error += less + off
                else:
                    if at is not None:
                        yield ended()
                    at, kept, error = (size, cell), new, less
        if at is not None:
            yield ended()

    return run


# ---------------------------------------------------------------- exact counts


_COUNTS = "cell int, lang array<string>, phrase array<string>, words array<int>, n array<long>"


def _counted(known, cells: int):
    """What a task has counted exactly, one row a cell: language, phrase, its words and
    occurrences; without a phrase, a language's number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: Survivors(v.value) for k, v in known.items()}
        words: dict[str, int] = {}
        # Phrases are equal here if two independent hashes are.
        found: dict[tuple[int, int], list] = {}

        shift = 64 - (cells - 1).bit_length()

        def rows() -> pa.RecordBatch:
            by_cell: dict[int, list] = {}
            for (key, _), row in found.items():
                by_cell.setdefault(key >> shift, []).append(row)
            if words:
                by_cell.setdefault(0, []).extend((name, None, 0, n) for name, n in words.items())
            words.clear(), found.clear()
            columns = [list(map(list, x)) for x in zip(*(zip(*told, strict=True) for told in by_cell.values()), strict=True)] if by_cell else [[]] * 4
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
            return pa.record_batch([pa.array(list(by_cell), pa.int32()), *(pa.array(c, pa.list_(t)) for c, t in zip(columns, kinds, strict=True))], names=["cell", "lang", "phrase", "words", "n"])

        for hashes, langs, tokens, told in _Reader().chunks(batches, keep=True):
            ends = np.cumsum([n for _, _, n in told])
            for name, n, _ in told:
                words[name] = words.get(name, 0) + n
            for size, at, keys in _phrases(hashes, langs, tuple(range(1, LONGEST + 1)), held):
                second = grams(hashes, size, seed=90)[at]
                order = np.lexsort((second, keys))
                k, s = keys[order], second[order]
                first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])) if len(k) else np.zeros(0, np.int64)
                place, counts = at[order[first]], np.diff(np.append(first, len(k)))
                for a, b, p, n in zip(k[first].tolist(), s[first].tolist(), place.tolist(), counts.tolist(), strict=True):
                    row = found.get((a, b))
                    if row is None:
                        owner = int(np.searchsorted(ends, p, side="right"))
                        found[a, b] = [told[owner][0], b" ".join(tokens[p : p + size]).decode(), size, n]
                    else:
                        row[3] += n
            if len(found) > MOST_COUNTED:
                yield rows()
        yield rows()

    return run


def _summed(fewest: int):
    """(lang, phrase, words, n) of the phrases that are frequent in all, from rows of
    `_counted` sorted by cell; a cell has M / `fewest` of them at most, and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, {}

        def ended() -> pa.RecordBatch:
            told = [(lang, phrase, k, n) for (lang, phrase, k), n in total.items() if phrase is None or n >= fewest]
            columns = zip(*told, strict=True) if told else ([],) * 4
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["lang", "phrase", "words", "n"])

        for batch in batches:
            for cell, *columns in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if cell != at:
                    if at is not None:
                        yield ended()
                    at, total = cell, {}
                for *key, n in zip(*columns, strict=True):
                    key = tuple(key)
                    total[key] = total.get(key, 0) + n
        if at is not None:
            yield ended()

    return run


def frequent_phrases(docs: DataFrame, fewest: int = FEWEST) -> tuple[DataFrame, str]:
    """A stored table (lang, phrase, words, n) of all phrases of 1 to LONGEST words that
    occur `fewest` times or more, with exact counts, and its path; the row of a language
    without a phrase (null) has the number of all its words."""
    spark = docs.sparkSession
    bounded_batches(spark, MANY_ROWS)
    texts = docs.select("lang", "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = max(FEWEST_CELLS, 1 << max(0, -(-size // BYTES_PER_CELL) - 1).bit_length())
    # There are at most (bytes + 1) / 2 words in a text.
    capacity = {1: np.full(cells, (size + 1) // 2 // fewest + 1 + 1)}
    known: dict = {}
    for sizes in ((1,), (2,), tuple(range(3, LONGEST + 1))):
        made, path = texts.mapInArrow(_summaries(sizes, capacity, known, sizes == (1,)), _SUMMARY), None
        if sizes == (1,):  # read twice
            made, path = store(made, "summaries")
            mass = made.groupBy("size", "cell").agg(F.sum("mass").alias("mass")).collect()  # one row a cell
            for k in range(2, LONGEST + 1):
                capacity[k] = np.ones(cells, np.int64)
                for row in mass:
                    if row["size"] == k:
                        capacity[k][row.cell] = row.mass // fewest + 1
        ordered = made.where(F.length("keys") > 0).repartition("size", "cell").sortWithinPartitions("size", "cell")
        bits = ordered.mapInArrow(_merge(capacity, fewest), "size int, word int, bits long").groupBy("size", "word").agg(F.bit_or("bits").alias("bits"))
        known |= _told(spark, bits, sizes)
        if path:
            drop(spark, path)
    counted = texts.mapInArrow(_counted(known, cells), _COUNTS).repartition("cell").sortWithinPartitions("cell")
    done = store(counted.mapInArrow(_summed(fewest), "lang string, phrase string, words int, n long"), "phrases")
    for v in known.values():
        v.destroy()
    return done


def _told(spark: SparkSession, bits: DataFrame, sizes: tuple[int, ...]) -> dict:
    """Broadcast tables of survivors, one a size; FILTER_BITS each at most."""
    tables = {k: np.zeros(FILTER_BITS // 64, np.uint64) for k in sizes}
    found = bits.toArrow()
    size, word, value = (found.column(i).combine_chunks().to_numpy() for i in range(3))
    for k in sizes:
        own = size == k
        tables[k][word[own]] = value[own].view(np.uint64)
    return {k: spark.sparkContext.broadcast(v) for k, v in tables.items()}


# ----------------------------------------------------------------- collocations


def collocations(docs: DataFrame, fewest: int = FEWEST, most: int = MOST, absorbed: int = ABSORBED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `most` phrases.

    A phrase of 2 to LONGEST words within a piece of text that occurs a >= `fewest` times
    is cut after each of its words; the cut of the least floor(1000 a n / (l r)) counts
    (ties: the first).  Phrases inside a longer frequent one with `absorbed` per cent of
    their occurrences go.  Ties of a score go by a, then by the phrase's bytes.

    Null and empty texts have no words, a null language is "und" (an empty one is itself); repeated rows count
    again; an empty table gives an empty result; other columns are not looked at.
    Sums are exact up to 38 digits.
    """
    table, _ = frequent_phrases(docs, fewest)
    counts = table.where("phrase IS NOT NULL").select("lang", "phrase", F.col("n").alias("count"))
    totals = table.where("phrase IS NULL").select("lang", "n")
    longer = table.where("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    joined = lambda a, b: F.array_join(F.slice("w", a, b), " ")

    # Every phrase inside a longer one, with the most occurrences of such.
    inside = longer.where("words >= 3").select(
        "lang",
        "words",
        "a",
        "w",
        F.explode(F.expr("flatten(transform(sequence(2, words - 1), k -> transform(sequence(1, words - k + 1), i -> struct(i, k))))")).alias("part"),
    )
    holders = inside.select("lang", joined(F.col("part.i"), F.col("part.k")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("held"))

    cuts = longer.select("lang", "phrase", "a", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    side = lambda part, count: counts.select("lang", F.col("phrase").alias(part), F.col("count").alias(count))
    scored = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    # 38 digits hold the products: a and n have 17 each at most, beside the factor.
    big = lambda c: F.col(c).cast("decimal(17,0)")
    score = F.expr("CAST((1000 * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0))) DIV (CAST(l AS DECIMAL(17,0)) * CAST(r AS DECIMAL(17,0))) AS BIGINT)")
    best = scored.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut"))
    left = best.join(holders, ["lang", "phrase"], "left").where(F.col("held").isNull() | (big("held") * 100 < F.col("cut.a").cast("decimal(17,0)") * absorbed))
    by = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("cut.a").desc(), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")


def oracle() -> str:
    """DuckDB SQL of `collocations`."""
    return f"""
WITH text AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL
), piece AS (
  SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM text
), line AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM piece
), total AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM line GROUP BY lang
), gram AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM line, range(1, {LONGEST + 1}) AS s(k))
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM gram GROUP BY ALL HAVING count(*) >= {FEWEST}
), long AS (
  SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2
), cut AS (
  SELECT *, array_to_string(w[1 : j], ' ') AS p1, array_to_string(w[j + 1 : k], ' ') AS p2 FROM (SELECT *, unnest(range(1, k)) AS j FROM long)
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.j, x.a AS l, y.a AS r, t.n, (1000::HUGEINT * c.a * t.n // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = c.p1 JOIN f y ON y.lang = c.lang AND y.phrase = c.p2 JOIN total t ON t.lang = c.lang
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM scored) WHERE o = 1
), held AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS held
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM long)) GROUP BY 1, 2
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase WHERE h.held IS NULL OR 100 * h.held < {ABSORBED} * b.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {MOST}
"""
