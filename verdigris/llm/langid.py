"""Language ID by prediction by partial matching (PPM).

For each language a variable-order byte context tree is counted on a bounded
sample of labelled texts and then frozen.  A text's code length under a language
is the sum over its bytes of ``-log2 P(byte | deepest known context)``, where an
unseen byte pays the context's escape probability (method C: distinct / (total +
distinct)) and is then coded in the next shorter context.  The language with the
shortest code wins.

Frozen trees of all languages are merged into one automaton, so a batch of texts
is scored by table look-ups for all languages at once.  Of the deepest contexts, which
are many, only the symbols met are kept, under sorted keys.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.llm._shared import BYTES_PER_STEP, bounded_batches, byte_slices, drop, held_out, store

#: Bytes of context at most.
ORDER = 3
#: Labelled texts per language that the trees are counted on, and the largest of them.
SAMPLE_DOCS, SAMPLE_BYTES = 256, 1 << 16
#: Bytes of a language's texts in all, and the most languages that are learned, those of most
#: labelled rows (None: all).
SAMPLE_TOTAL, MOST_LANGS = 1 << 21, None
#: Languages whose trees share one set of tables.  A table has a row for every context of
#: any of its languages, so one table of all would grow with their square.
LANGS_PER_TABLE = 8
#: Bytes that count as evidence in the score: the posterior of a longer text is
#: that of its mean over so many bytes.
EVIDENCE_BYTES = 64
#: Places of a table that spares the search among sorted keys.
DENSE = 1 << 23
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
RESULT = "lang_pred string, score double, bits_per_byte double"


@dataclass
class PpmModel:
    """Frozen statistics: bits of a symbol in each language, in all contexts that were counted.

    A code length depends on its own language's trees alone, so further languages stand in
    models of their own (`more`), and the least code of all of them counts.
    """

    langs: list[str]
    symbol: np.ndarray  # byte -> symbol; 0 stands for every byte not in the sample
    state: np.ndarray  # two symbols, as a number -> context of at most two
    cost: np.ndarray  # (state, symbol, language)
    deep: np.ndarray  # three symbols, as a number -> deepest context, or -1
    keys: np.ndarray  # deepest context and symbol that any language has, as a number, sorted
    met: np.ndarray  # (key, language): bits of the symbol
    escape: np.ndarray  # (deepest context, language): bits to add to the shorter context's
    dense: np.ndarray | None = None  # `rows` of all keys, made where it is used
    more: list[PpmModel] = field(default_factory=list)

    @property
    def width(self) -> int:
        return int(self.symbol.max()) + 1

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Row of each deepest context and symbol in `met`, or -1."""
        if len(self.escape) * self.width > DENSE:
            return _rank(self.keys, keys)
        if self.dense is None:
            self.dense = np.full(len(self.escape) * self.width, -1, np.int32)
            self.dense[self.keys] = np.arange(len(self.keys))
        return self.dense[keys]


def _folded(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def train(texts: dict[str, list[str]]) -> PpmModel:
    """Count the trees of {language: texts} and freeze them."""
    langs = sorted(texts)
    padding = b"\n" * ORDER
    raw = {lang: np.frombuffer(padding + padding.join(map(_folded, texts[lang])), np.uint8) for lang in langs}
    symbol = np.zeros(256, np.int64)
    seen = np.unique(np.concatenate([*raw.values(), np.frombuffer(padding, np.uint8)]))
    symbol[seen] = np.arange(1, len(seen) + 1)
    k = len(seen) + 1
    streams = {lang: symbol[data] for lang, data in raw.items()}

    every = np.concatenate([(s[:-3] * k + s[1:-2]) * k + s[2:-1] for s in streams.values()] or [np.zeros(0, np.int64)])
    deep = np.unique(every)
    pairs = {lang: _rank(deep, (s[:-3] * k + s[1:-2]) * k + s[2:-1]) * k + s[ORDER:] for lang, s in streams.items()}
    keys = np.unique(np.concatenate([*pairs.values(), np.zeros(0, np.int64)]))
    owner = keys // k
    middle = np.unique(np.concatenate([s[:-2] * k + s[1:-1] for s in streams.values()] or [np.zeros(0, np.int64)]))
    row = {1: 1 + np.arange(k), 2: 1 + k + np.arange(len(middle))}
    n_states = 1 + k + len(middle)

    cost = np.empty((n_states, k, len(langs)), np.float32)
    met, escape = np.empty((len(keys), len(langs)), np.float32), np.empty((len(deep), len(langs)), np.float32)
    for column, lang in enumerate(langs):
        s = streams[lang]
        counts = np.bincount(s[ORDER:], minlength=k).astype(np.float64)
        total, distinct = counts.sum(), np.count_nonzero(counts)
        p0 = np.where(counts > 0, counts / (total + distinct), distinct / (total + distinct) / 256) if total else np.full(k, 1 / 256)
        p1 = _blend(s[2:-1], s[ORDER:], k, np.broadcast_to(p0, (k, k)))
        m = _rank(middle, s[1:-2] * k + s[2:-1])
        p2 = _blend(m, s[ORDER:], k, p1[middle % k])
        cost[:, :, column] = -np.log2(np.concatenate([p0[None], p1, p2]))
        counts = np.bincount(_rank(keys, pairs[lang]), minlength=len(keys)).astype(np.float64)
        total, distinct = np.bincount(owner, counts, len(deep)), np.bincount(owner, counts > 0, len(deep))
        whole = np.maximum(total + distinct, 1)
        free = np.where(total > 0, distinct / whole, 1.0)
        shorter = p2[_rank(middle, deep[owner] % (k * k)), keys % k]
        met[:, column] = -np.log2(np.where(counts > 0, counts / whole[owner], free[owner] * shorter))
        escape[:, column] = -np.log2(free)

    state = np.tile(row[1], k).astype(np.int32)  # by the last symbol
    state[middle] = row[2]
    place = np.full(k**3, -1, np.int32)
    place[deep] = np.arange(len(deep))
    return PpmModel(langs, symbol.astype(np.int32), state, cost, place, keys, met, escape)


def _rank(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Row of each value in sorted keys, or -1."""
    at = np.minimum(np.searchsorted(keys, values), max(len(keys) - 1, 0))
    return np.where(keys[at] == values, at, -1) if len(keys) else np.full(len(values), -1)


def _blend(context: np.ndarray, nxt: np.ndarray, k: int, shorter: np.ndarray) -> np.ndarray:
    """PPM-C probabilities of each context over the distribution of the shorter one."""
    known = context >= 0
    counts = np.bincount(context[known] * k + nxt[known], minlength=len(shorter) * k).reshape(-1, k).astype(np.float64)
    total, distinct = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    whole = np.maximum(total + distinct, 1)
    return np.where(total > 0, np.where(counts > 0, counts / whole, distinct / whole * shorter), shorter)


def code_lengths(model: PpmModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each text under each language, and each text's folded bytes."""
    folded = [_folded(t) for t in texts]
    sizes = np.array([len(b) for b in folded], np.int64)
    bits = np.zeros((len(texts), len(model.langs)))
    k = model.width
    padding = b"\n" * ORDER
    for a, b in byte_slices(sizes):
        data = np.frombuffer(padding + padding.join(folded[a:b]), np.uint8)
        starts = ORDER + np.cumsum(np.concatenate([[0], sizes[a:b] + ORDER]))[:-1]
        for w in range(ORDER, len(data), BYTES_PER_STEP):
            s = model.symbol[data[w - ORDER : w + BYTES_PER_STEP]]
            two = s[1:-2] * k + s[2:-1]
            cost = model.cost[model.state[two], s[3:]]
            deep = model.deep[s[:-3] * (k * k) + two].astype(np.int64)
            at = np.where(deep >= 0, model.rows(np.maximum(deep, 0) * k + s[3:]), -1)
            met, left = np.flatnonzero((deep >= 0) & (at >= 0)), np.flatnonzero((deep >= 0) & (at < 0))
            cost[met] = model.met[at[met]]
            cost[left] += model.escape[deep[left]]
            lo = np.clip(starts - w, 0, len(cost))
            hi = np.clip(starts + sizes[a:b] - w, 0, len(cost))
            own = np.flatnonzero(hi > lo)
            cuts = np.stack([lo[own], hi[own]], 1).reshape(-1)
            padded = np.concatenate([cost, np.zeros((1, cost.shape[1]), np.float32)])
            if len(own):
                bits[a + own] += np.add.reduceat(padded, cuts, axis=0, dtype=np.float64)[::2]
    return bits, sizes


def predict(model: PpmModel, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, posterior in [0, 1] and bits per byte of each text."""
    known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model.langs else []
    pred, score, rate = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    if known:
        parts = [code_lengths(m, [texts[i] for i in known]) for m in (model, *model.more)]
        langs, sizes = [lang for m in (model, *model.more) for lang in m.langs], parts[0][1]
        bits = np.concatenate([b for b, _ in parts], 1)
        best = bits.argmin(1)
        evidence = (bits - bits.min(1, keepdims=True)) * (np.minimum(sizes, EVIDENCE_BYTES) / sizes)[:, None]
        score[known] = 1 / np.exp2(-evidence).sum(1)
        rate[known] = bits.min(1) / sizes
        for i, at in zip(known, best, strict=True):
            pred[i] = langs[at]
    return pred, score, rate


def fit(docs: DataFrame, modulus: int = 5, remainder: int = 0, sample_docs: int = SAMPLE_DOCS) -> PpmModel:
    """Count the trees on a sample of `docs` (doc_id, text, lang).

    Only rows with a lang, a text of at most SAMPLE_BYTES and crc32(doc_id) mod
    `modulus` other than `remainder` are learned from, `sample_docs` per language and
    SAMPLE_TOTAL bytes at most, those of least hash; so the same rows give the same model.
    All values of lang are learned, unless MOST_LANGS says how many (those with the most
    rows, of equal ones the first in order of code points).  Texts of LANGS_PER_TABLE
    languages are in the driver at once (16 MB); the model has a table for each such group.
    """
    mine = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES) & ~held_out(F.col("doc_id"), modulus, remainder)).select("doc_id", "lang", "text")
    draw = F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid")).bitwiseAND(F.lit((1 << 31) - 1))
    # One narrow pass counts the rows of each language; then few texts leave the scan.
    counts, counts_at = store(mine.groupBy("lang").count(), "langs")
    common = counts.orderBy(F.desc("count"), "lang").limit(MOST_LANGS) if MOST_LANGS else counts
    share = common.select("lang", (F.lit(4.0 * sample_docs) / F.col("count") * (1 << 31)).alias("below"))
    picked = mine.join(share, "lang").where(draw <= F.col("below"))
    line = Window.partitionBy("lang").orderBy(draw, "doc_id", F.sha2("text", 256))
    ranked = picked.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= sample_docs)
    ranked = ranked.withColumn("bytes", F.sum(F.octet_length("text")).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sample, sample_at = store(ranked.where((F.col("bytes") <= SAMPLE_TOTAL) | (F.col("rank") == 1)).select("lang", "rank", "text"), "sample")
    langs = sorted(row.lang for row in share.select("lang").collect())
    models = []
    for i in range(0, max(len(langs), 1), LANGS_PER_TABLE):
        texts: dict[str, list[str]] = {}
        for row in sample.where(F.col("lang").isin(langs[i : i + LANGS_PER_TABLE])).orderBy("lang", "rank").collect():
            texts.setdefault(row.lang, []).append(row.text)
        models.append(train(texts))
    for path in (counts_at, sample_at):
        drop(docs.sparkSession, path)
    models[0].more = models[1:]
    return models[0]


def language_of(spark: SparkSession, model: PpmModel) -> Column:
    """A function of a text column: struct<lang_pred, score, bits_per_byte>.

    Of equal code lengths the language first in order of code points wins.  The score is
    the winner's posterior for the mean code of EVIDENCE_BYTES of the text (all of a
    shorter one).  Null texts and texts without a letter give ('und', 0, 0); so does every
    text if the model knows no language.  Equal texts have equal results.
    """
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def score(text: pa.Array) -> pa.Array:
        pred, sure, rate = predict(shared.value, text.to_pylist())
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(sure), pa.array(rate)], ["lang_pred", "score", "bits_per_byte"])

    return score


def identify(docs: DataFrame, model: PpmModel) -> DataFrame:
    """`docs` with a struct column `language`; a column of that name is replaced."""
    return docs.withColumn("language", language_of(docs.sparkSession, model)("text"))
