"""Spelling variants of words, found by PartEnum signatures of their letter multisets.

A word is a binary vector with one dimension for each letter and occurrence ("the
second e").  One inserted or deleted letter changes one dimension, a replaced letter
two, so near words have Hamming distance 2 at most.  The dimensions are dealt to PARTS
parts; of these at least PARTS - 2 are equal in two near words.  Each word has one
signature for every choice of PARTS - 2 parts (15 of them): two near words share one.
Signatures are equi-joined by sorting, and words of one signature are verified letter
by letter.

Within a signature only words with the same first three or the same last three letters
are compared: one edit cannot touch both ends of a word of seven letters or more.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm._shared import MANY_ROWS, bounded_batches, drop, ranges, store
from verdigris.llm.words import mixed

PARTS, DISTANCE = 6, 2
#: Code points of a word, occurrences of a word, and times that a form is more frequent.
SHORTEST, FEWEST, RATIO = 7, 2, 10
#: One in so many runs of a document loses a letter.
SLIPS = 31
#: Distinct words that a task counts before it passes them on.
MOST_COUNTED = 200_000
_SUBSETS = list(itertools.combinations(range(PARTS), DISTANCE))
END = 3  # letters at either end of a word of which one edit leaves one end alone


def runs(text: str | None, doc_id: int | None, shortest: int = SHORTEST, slips: int = SLIPS) -> Counter:
    """Words (Latin-1 bytes) of a text: maximal runs of letters in lower case (A-Z only),
    of which those whose crc32 with the document's id divides by `slips` lose a letter.

    A null text has none; a null id is written as nothing.
    """
    found: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    low: Counter = Counter()
    for run, n in Counter(re.findall(f"[A-Za-zÀ-ÿ]{{{shortest},}}", text or "")).items():
        low[run.encode("latin-1").lower()] += n
    for run, n in low.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % slips == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < shortest:
                continue
        found[run] += n
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            total.update(runs(text.as_py(), doc_id))
            if len(total) > MOST_COUNTED:
                yield out()
                total.clear()
    yield out()


def words_of(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of `docs` (doc_id, text) that occur at least FEWEST times."""
    bounded_batches(docs.sparkSession, MANY_ROWS)
    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_counted, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= FEWEST)


# ------------------------------------------------------------------- signatures


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All letters (one byte each), and each word's first letter and length."""
    raw = [w.encode("latin-1") for w in words.to_pylist()]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum(lengths) - lengths, lengths


def signatures(words: pa.Array) -> np.ndarray:
    """Signatures of each word (a row), one for every choice of parts that are left out."""
    letters, starts, lengths = _letters(words)
    row = np.repeat(np.arange(len(starts)), lengths)
    order = np.lexsort((letters, row))
    row, letter = row[order], letters[order].astype(np.uint64)
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (letter[1:] != letter[:-1])
    at = np.arange(len(row))
    occurrence = at - np.maximum.accumulate(np.where(fresh, at, 0))
    dimension = mixed(letter << np.uint64(32) | occurrence.astype(np.uint64))
    sums = np.zeros((len(starts), PARTS), np.uint64)
    np.add.at(sums, (row, (dimension % np.uint64(PARTS)).astype(np.int64)), mixed(dimension + np.uint64(1)))
    whole = sums.sum(1)
    return np.stack([mixed(whole - sums[:, i] - sums[:, j] + np.uint64(k + 1)) for k, (i, j) in enumerate(_SUBSETS)], 1)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            words = batch.column(0).slice(a, 4096)
            keys = signatures(words)
            word = pa.array(np.repeat(np.arange(len(words)), keys.shape[1]))
            yield pa.record_batch([pa.array(keys.reshape(-1).view(np.int64)), words.take(word)], names=["key", "word"])


_U = np.uint64
_ONES = _U(0x0101010101010101)
PACKED = 16  # letters of a word that are compared at once


def _marked(x: np.ndarray) -> np.ndarray:
    """1 in each byte that is not 0."""
    x = x | x >> _U(4)
    x = x | x >> _U(2)
    return (x | x >> _U(1)) & _ONES


def _packed(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first PACKED letters of each word as two 64-bit numbers, first letter lowest."""
    n = np.minimum(lengths, PACKED)
    table = np.zeros((len(starts), PACKED), np.uint8)
    table[np.repeat(np.arange(len(starts)), n), ranges(np.zeros(len(starts), np.int64), n)] = letters[ranges(starts, n)]
    return table.view("<u8")


def _one_edit(packed: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a[i] and b[i], of PACKED letters at most, differ by one inserted,
    deleted or replaced letter."""
    swap = lengths[a] > lengths[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    low, high = packed[a, 0], packed[a, 1]
    low_b, high_b = packed[b, 0], packed[b, 1]
    e0, e1 = _marked(low ^ low_b), _marked(high ^ high_b)
    replaced = np.bitwise_count(e0) + np.bitwise_count(e1) == 1
    # Without one letter of b, the words are equal: behind the first place that differs,
    # a equals b moved by one letter.
    f0, f1 = _marked(low ^ (low_b >> _U(8) | high_b << _U(56))), _marked(high ^ high_b >> _U(8))
    inserted = np.where(e0 != 0, (f1 == 0) & (f0 < (e0 & -e0)), f1 < (e1 & -e1))
    gap = lengths[b] - lengths[a]
    return np.where(gap == 0, replaced, (gap == 1) & inserted)


def _one_edit_long(a: bytes, b: bytes) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :])


def _pairs(key: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of near words with the same key."""
    letters, starts, lengths = _letters(words)
    packed, long = _packed(letters, starts, lengths), lengths > PACKED
    found = []
    for end in (starts, starts + lengths - END):
        affix = sum(letters[end + i].astype(np.int64) << 8 * i for i in range(END))
        order = np.lexsort((affix, key))
        k, x = key[order], affix[order]
        at, lag = np.arange(len(k)), 0
        while True:
            lag += 1
            at = at[at + lag < len(k)]
            at = at[(k[at + lag] == k[at]) & (x[at + lag] == x[at])]
            if not len(at):
                break
            i, j = order[at], order[at + lag]
            near = _one_edit(packed, lengths, i, j)
            for p in np.flatnonzero(long[i] | long[j]).tolist():
                near[p] = _one_edit_long(*[letters[starts[w] : starts[w] + lengths[w]].tobytes() for w in (i[p], j[p])])
            found.append(np.stack([i[near], j[near]]))
    pairs = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
    return pairs[0], pairs[1]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of near words among rows (key, word) that come sorted by key."""
    open_rows: pa.RecordBatch | None = None

    def near(rows: pa.RecordBatch) -> pa.RecordBatch:
        i, j = _pairs(rows.column(0).to_numpy(), rows.column(1))
        once = np.unique(np.minimum(i, j) * rows.num_rows + np.maximum(i, j))  # both ends may be equal
        return pa.record_batch([rows.column(1).take(pa.array(x)) for x in (once // rows.num_rows, once % rows.num_rows)], names=["word", "near"])

    for batch in batches:
        rows = batch if open_rows is None else pa.Table.from_batches([open_rows, batch]).combine_chunks().to_batches()[0]
        key = rows.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last group may go on
        if last:
            yield near(rows.slice(0, last))
        open_rows = rows.slice(last)
    if open_rows is not None and open_rows.num_rows:
        yield near(open_rows)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near), once for every word and each word that differs from it by one edit."""
    keyed = words.select("word").mapInArrow(_signed, "key long, word string")
    pairs = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_compared, "word string, near string")
    once = pairs.select(F.least("word", "near").alias("a"), F.greatest("word", "near").alias("b")).distinct()
    return once.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))))


# ------------------------------------------------------------------------ forms


def group_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of `docs` (doc_id, text).

    A word's form is its most frequent near word (ties: the first in code-point order),
    if that occurs at least RATIO times as often; root is where forms lead to in the
    end.  Null and empty texts have no words; repeated rows count again; an empty table
    gives an empty result; other columns of `docs` are not looked at.
    """
    spark = docs.sparkSession
    words, _ = store(words_of(docs), "words")
    pairs, pairs_at = store(near_words(words), "near")
    known = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = known.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    is_form = -F.col("best.less") >= RATIO * F.col("n")
    forms, forms_at = store(joined.select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    drop(spark, pairs_at)
    roots, roots_at = _roots(forms.where("form is not null").select("word", "form"))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> tuple[DataFrame, str]:
    """(word, root) by pointer jumping: n grows tenfold with each form, so chains are short."""
    spark = forms.sparkSession
    roots, path = store(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        above = roots.select(F.col("word").alias("root"), F.col("root").alias("top"))
        new, new_path = store(roots.join(above, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "roots")
        drop(spark, path)
        path, roots = new_path, new.select("word", "root")
        if new.where("moved").isEmpty():
            return roots, path


def oracle() -> str:
    """DuckDB SQL of `group_variants`: crc32 bit by bit, near words by shared deletions."""
    accented = "".join(map(chr, range(0xC0, 0x100)))
    # One byte each that no word has, so that edit distances count code points.
    single = " || ".join(f"chr({i})" for i in [*range(1, 32), *range(64, 97)])
    short = lambda w: f"translate({w}, '{accented}', {single})"
    return f"""
WITH RECURSIVE run AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{SHORTEST},}}')) AS r FROM documents)
  GROUP BY ALL
), coded AS (
  SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS x FROM run
), crc AS (
  SELECT r, n, xor(list_reduce(flatten(list_transform(range(len(x) // 2), lambda i: list_transform(range(8), lambda b: (('0x' || substr(x, 2 * i + 1, 2))::BIGINT >> b) & 1))),
    lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM coded
), word AS (
  SELECT CASE WHEN h % {SLIPS} = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, sum(n)::BIGINT AS n
  FROM crc GROUP BY 1 HAVING sum(n) >= {FEWEST} AND length(word) >= {SHORTEST}
), cut AS (
  SELECT word, n, word AS part FROM word
  UNION SELECT word, n, substr(word, 1, i) || substr(word, i + 2) FROM (SELECT word, n, unnest(range(length(word))) AS i FROM word)
), pair AS (
  SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.part = b.part AND a.word <> b.word
  WHERE levenshtein({short("a.word")}, {short("b.word")}) = 1
), best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS form, max(near_n) AS form_n FROM pair GROUP BY word
), form AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {RATIO} * n THEN form END AS form, CASE WHEN form_n >= {RATIO} * n THEN form_n END AS form_n
  FROM word LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root FROM word
  UNION ALL SELECT c.word, f.form FROM chain c JOIN form f ON f.word = c.root WHERE f.form IS NOT NULL
), ended AS (
  SELECT c.word, c.root FROM chain c JOIN form f ON f.word = c.root WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM form JOIN ended USING (word)
"""

