"""Quality classifier: random-indexing word vectors and a two-layer network.

Every word and every word shape (``Oning.!!`` has shape ``Aa.!``) has a sparse
ternary index vector drawn from a fixed seed.  A word's context vector is the sum
of the index vectors around it over all documents; a document is the mean of
its words' and its shapes' unit context vectors, with the share of words whose
neighbours carry their own index vector (a text that repeats itself).  A network with one hidden layer,
trained in numpy, gives a logit, and a temperature fitted on held-back sample rows
turns it into a calibrated probability.

Words are hashed into a fixed number of rows, so the model has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm._shared import bounded_batches, byte_slices, held_out

#: Rows of the word table, dimensions of a vector, non-zero entries of an index vector.
BUCKETS, DIMS, NONZERO = 1 << 15, 48, 6
#: Words on either side that count as context.
WINDOW = 2
#: Words whose contexts are added up at once (bounds memory).
STREAM_STEP = 1 << 16
HIDDEN, STEPS, RATE, DECAY, SEED = 32, 400, 0.02, 1e-3, 42
FEATURES = 2 * DIMS + WINDOW
#: Labelled documents per class that the model is fitted on, and the largest of them.
SAMPLE_PER_CLASS, SAMPLE_BYTES = 2500, 1 << 15
#: Probability of label 1 from which a document counts as good.
GOOD = 0.7


@dataclass
class QualityModel:
    words: np.ndarray  # bucket -> unit context vector
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float


@cache
def index_vectors() -> np.ndarray:
    """Sparse ternary vectors of all buckets, the same in every process."""
    rng = np.random.default_rng(SEED)
    vectors = np.zeros((BUCKETS, DIMS), np.float32)
    at = rng.integers(0, DIMS, (BUCKETS, NONZERO))
    np.put_along_axis(vectors, at, rng.choice(np.array([-1, 1], np.float32), (BUCKETS, NONZERO)), 1)
    return vectors


@cache
def _small_vectors() -> np.ndarray:
    """The index vectors in bytes: sums of a window's entries stay under 10."""
    return index_vectors().astype(np.int8)


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets and shape buckets of all texts in order, and words per text."""
    text = pc.fill_null(text, "")
    lists = pc.utf8_split_whitespace(text)
    flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    # Splitting leaves an empty string before leading and after trailing white space.
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes)), sizes)[full]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
    shape = words
    for pattern, sign in ((r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lo}\p{M}]+", "a"), (r"\p{N}+", "0"), (r"([^Aa0])[^Aa0]+", r"\1+")):
        shape = pc.replace_substring_regex(shape, pattern, sign)
    bucket = [(pd.util.hash_array(x.to_numpy(zero_copy_only=False), categorize=False) % BUCKETS).astype(np.int64) for x in (pc.utf8_lower(words), pc.binary_join_element_wise("#", shape, ""))]
    return bucket[0][codes], bucket[1][codes], np.bincount(owner, minlength=len(sizes))


def _segment_mean(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sizes), rows.shape[1]), np.float32)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        out[full] = np.add.reduceat(rows, starts, axis=0) / sizes[full][:, None]
    return out


def context_sums(words: np.ndarray, shapes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of context of all buckets (whole numbers), from documents laid end to end."""
    index = _small_vectors()
    out = np.zeros((BUCKETS, DIMS), np.float64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    for a in range(0, len(words), STREAM_STEP):  # windows of the stream, with their neighbours
        lo, hi = max(0, a - WINDOW), min(len(words), a + STREAM_STEP + WINDOW)
        own = index[words[lo:hi]] + index[shapes[lo:hi]]
        around = index[shapes[lo:hi]].copy()
        for step in range(1, WINDOW + 1):
            same = (doc[lo : hi - step] == doc[lo + step : hi])[:, None]
            around[:-step] += own[step:] * same
            around[step:] += own[:-step] * same
        inner = slice(a - lo, min(a + STREAM_STEP, len(words)) - lo)
        for key in (words, shapes):
            k = key[lo:hi][inner]
            order = np.argsort(k, kind="stable")
            heads, starts = np.unique(k[order], return_index=True)
            out[heads] += np.add.reduceat(around[inner][order], starts, axis=0, dtype=np.int32)
    return out


def _unit(sums: np.ndarray) -> np.ndarray:
    return (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def context_vectors(words: np.ndarray, shapes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Unit context vectors of all buckets, from documents laid end to end."""
    return _unit(context_sums(words, shapes, sizes))


def corpus_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of all buckets, from the text of every row of `docs`.

    Each task adds up its rows and hands on one row a bucket; the driver gets BUCKETS
    rows of DIMS whole numbers, however many documents there are.
    """
    bounded_batches(docs.sparkSession)
    names = [f"d{i}" for i in range(DIMS)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, DIMS), np.float64)
        for batch in batches:
            text = batch.column(0)
            for a, b in byte_slices(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)):
                total += context_sums(*tokens(text[a:b]))
        used = np.flatnonzero(total.any(axis=1))
        for a in range(0, len(used), 4096):
            rows = used[a : a + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), *[pa.array(x) for x in total[rows].T.astype(np.int64)]], names=["bucket", *names])

    parts = docs.select("text").mapInArrow(sums, ", ".join(["bucket int", *[f"{n} long" for n in names]]))
    table = parts.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = np.zeros((BUCKETS, DIMS), np.float64)
    if table.num_rows:
        out[table["bucket"].to_numpy()] = np.stack([table[n].to_numpy() for n in names], 1)
    return _unit(out)


def _echo(words: np.ndarray, sizes: np.ndarray, lag: int) -> np.ndarray:
    """Share of each text's words whose neighbour `lag` words on has the same index vector."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    same = (words[:-lag] == words[lag:]) & (doc[:-lag] == doc[lag:])
    return np.bincount(doc[:-lag][same], minlength=len(sizes)) / np.maximum(sizes, 1)


def pooled(vectors: np.ndarray, text: pa.Array) -> np.ndarray:
    """Mean word vector, mean shape vector and echoes of every text."""
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    parts = []
    for a, b in byte_slices(sizes):
        words, shapes, n = tokens(text[a:b])
        echoes = [_echo(words, n, lag) for lag in range(1, WINDOW + 1)]
        parts.append(np.hstack([_segment_mean(vectors[words], n), _segment_mean(vectors[shapes], n), np.stack(echoes, 1)]))
    return np.concatenate(parts).astype(np.float32) if parts else np.zeros((0, FEATURES), np.float32)


def logits(model: QualityModel, features: np.ndarray) -> np.ndarray:
    hidden = np.tanh((features - model.mean) / model.scale @ model.w1 + model.b1)
    return hidden @ model.w2 + model.b2


def probability(model: QualityModel, text: pa.Array) -> np.ndarray:
    z = logits(model, pooled(model.words, text)) / model.temperature
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def train(text: pa.Array, label: np.ndarray, weight: np.ndarray, vectors: np.ndarray) -> QualityModel:
    """Fit network and temperature; every fifth row only sets the temperature."""
    rng = np.random.default_rng(SEED)
    x = pooled(vectors, text)
    y, weight = label.astype(np.float64), weight / max(weight.mean(), 1e-12) if len(weight) else weight
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    model = QualityModel(vectors, mean, scale, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0, 1.0)
    fit_rows, check_rows = (np.arange(len(y)) % 5 != 4), (np.arange(len(y)) % 5 == 4)
    if not fit_rows.any():
        model.w2[:] = 0  # nothing is known: every score is 0.5
        return model
    xs, ys, ws = ((x - mean) / scale)[fit_rows], y[fit_rows], weight[fit_rows]
    params = [model.w1, model.b1, model.w2, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):  # Adam on the whole sample
        h = np.tanh(xs @ params[0] + params[1])
        p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -50, 50)))
        d = ws * (p - ys) / len(ys)
        dh = d[:, None] * params[2] * (1 - h * h)
        for i, g in enumerate((xs.T @ dh + DECAY * params[0], dh.sum(0), h.T @ d + DECAY * params[2], d.sum(keepdims=True))):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] -= RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    model.b2 = float(params[3][0])
    if check_rows.any():
        z, yc, wc = logits(model, x[check_rows]), y[check_rows], weight[check_rows]
        grid = np.geomspace(1, 8, 41)
        loss = [float((wc * np.logaddexp(0, np.where(yc > 0, -z, z) / t)).mean()) for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, per_class: int = SAMPLE_PER_CLASS) -> QualityModel:
    """Word vectors of all rows of `docs` (doc_id, text), the rest from a sample of labelled ones.

    Only label rows with quality 0 or 1 and crc32(doc_id) mod `modulus` other than
    `remainder` are learned from: `per_class` of each at most, those of least hash
    among texts of up to SAMPLE_BYTES.  Classes weigh as much as they have rows.  A label
    row that is repeated counts once; an id with both labels is an example of each class.
    """
    key = F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality"))
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder)).select("doc_id", F.col("quality").cast("int").alias("quality"), key.alias("draw")).distinct()
    # The rows of least hash of each class: a distributed top-k, with no task per class.
    drawn = [known.where(F.col("quality") == c).orderBy("draw", "doc_id").limit(per_class) for c in (0, 1)]
    ids = drawn[0].unionAll(drawn[1]).join(F.broadcast(known.groupBy("quality").count()), "quality")
    texts = docs.where(F.col("text").isNull() | (F.octet_length("text") <= SAMPLE_BYTES)).select("doc_id", "text")
    # At most 2 x per_class ids: a proven bound for the broadcast.
    rows = texts.join(F.broadcast(ids), "doc_id").orderBy("draw", "quality", F.sha2("text", 256)).select("text", "quality", "count").limit(4 * per_class).collect()
    label = np.array([r.quality for r in rows], np.int64)
    drawn_of = np.bincount(label, minlength=2)
    weight = np.array([r["count"] / drawn_of[r.quality] for r in rows], np.float64)
    return train(pa.array([r.text or "" for r in rows], pa.string()), label, weight, corpus_vectors(docs))


def quality_of(spark: SparkSession, model: QualityModel) -> Column:
    """A function of a text column: the probability that its label is 1.

    Null and empty texts are documents without words and get the network's score of
    one; with no labelled rows at all every text gets 0.5.
    """
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(probability(shared.value, text))

    return score


def grade(docs: DataFrame, model: QualityModel) -> DataFrame:
    """`docs` with a column `quality_score`; a column of that name is replaced."""
    return docs.withColumn("quality_score", quality_of(docs.sparkSession, model)("text"))
