import math

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from verdigris.llm import quality


def corpus(n=400):
    rng = np.random.default_rng(0)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("an", "or", "es", "ing", "ti")]
    docs, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words, 40)).capitalize() + "."
        good = i % 4 != 0
        if not good:
            text = [text.upper() + "!!", text.replace(" ", " | "), " ".join([text.split()[0]] * 40)][i % 3]
        docs.append((i, text, "en", "s"))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark, documents):
    rows, labels = corpus()
    docs = documents(*rows, (9000, None), (9001, ""), (9002, "word " * 20000), (None, "text")).withColumnRenamed("n_chars", "quality_score")
    marks = spark.createDataFrame([*labels, (9000, None, 0), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, marks)
    got = quality.grade(docs, model)
    judged = got.join(marks.where("quality is not null").distinct(), "doc_id").where(quality.held_out(F.col("doc_id"), 4, 2))
    wrong = judged.where((F.col("quality_score") >= quality.GOOD) != (F.col("quality") == 1)).count()
    assert judged.count() > 60 and wrong <= 3
    assert got.where("quality_score < 0 or quality_score > 1 or quality_score is null").count() == 0
    assert quality.grade(docs.limit(0), model).count() == 0
    again = quality.fit(docs.repartition(5), marks.repartition(3))
    assert np.allclose(again.w1, model.w1) and again.temperature == model.temperature


def test_labels_of_held_out_rows_are_not_used(spark, documents):
    rows, labels = corpus(200)
    docs = documents(*rows)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    turned = marks.withColumn("quality", F.when(quality.held_out(F.col("doc_id"), 4, 2), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.fit(docs, marks).w1, quality.fit(docs, turned).w1)


def test_without_labels_every_score_is_even(spark, documents):
    docs = documents("a", None)
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.grade(docs, model).select("quality_score").distinct().collect()[0][0] == 0.5


def test_pooling_is_the_mean_of_the_words_vectors():
    text = pa.array(["one two two", None, "", "Three!! four"])
    vectors = quality.index_vectors()
    words, shapes, sizes = quality.tokens(text)
    assert sizes.tolist() == [3, 0, 0, 2]
    got = quality.pooled(vectors, text)
    assert np.allclose(got[0, : quality.DIMS], vectors[words[:3]].mean(0))
    assert np.allclose(got[3, quality.DIMS : 2 * quality.DIMS], vectors[shapes[3:]].mean(0))
    assert not got[1].any() and got[0, 2 * quality.DIMS] == np.float32(1 / 3)


def test_context_vectors_do_not_depend_on_the_step(monkeypatch):
    words, shapes, sizes = quality.tokens(pa.array(["a b c d e f g", "b a c", "", "d e d e"] * 5))
    want = quality.context_vectors(words, shapes, sizes)
    monkeypatch.setattr(quality, "STREAM_STEP", 4)
    assert np.allclose(quality.context_vectors(words, shapes, sizes), want, atol=1e-5)


def test_word_vectors_cover_all_documents(spark, documents):
    rows, labels = corpus(60)
    more = [(1000 + i, f"quokka{i % 3} jumps over wombat{i % 5} again") for i in range(40)]
    docs = documents(*rows, *more, (2000, None))
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), per_class=5)
    words, _, _ = quality.tokens(pa.array(["quokka0 quokka1 quokka2 wombat4"]))
    assert model.words[words].any(axis=1).all()
    want = quality.context_vectors(*quality.tokens(pa.array([r[1] for r in [*rows, *more]])))
    assert np.array_equal(model.words, want)


def plain_scores(model, corpus, texts):
    """Scores by the definition, one word at a time; the network's weights are the model's."""
    index = quality.index_vectors().astype(float)
    bucket = lambda w: int(pd.util.hash_array(np.array([w], object), categorize=False)[0] % quality.BUCKETS)

    def shape(word):
        for pattern, sign in ((r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lo}\p{M}]+", "a"), (r"\p{N}+", "0"), (r"([^Aa0])[^Aa0]+", r"\1+")):
            word = regex.sub(pattern, sign, word)
        return word

    read = lambda text: [(bucket(w.lower()), bucket("#" + shape(w))) for w in (text or "").split()]
    sums = {}
    for text in corpus:
        words = read(text)
        for i, (w, s) in enumerate(words):
            around = index[s].copy()
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(words):
                    around += index[words[j][0]] + index[words[j][1]]
            for key in (w, s):
                sums[key] = sums.get(key, 0) + around
    zero = np.zeros(quality.DIMS)
    unit = lambda key: sums.get(key, zero) / max(np.linalg.norm(sums.get(key, zero)), 1e-9)
    out = []
    for text in texts:
        words = read(text)
        n = max(len(words), 1)
        echoes = [sum(a[0] == b[0] for a, b in zip(words, words[lag:])) / n for lag in (1, 2)]
        x = np.concatenate([sum((unit(w) for w, _ in words), zero) / n, sum((unit(s) for _, s in words), zero) / n, echoes])
        hidden = [math.tanh(sum((x[i] - model.mean[i]) / model.scale[i] * model.w1[i, h] for i in range(len(x))) + model.b1[h]) for h in range(quality.HIDDEN)]
        z = sum(hidden[h] * model.w2[h] for h in range(quality.HIDDEN)) + model.b2
        out.append(1 / (1 + math.exp(-z / model.temperature)))
    return out


def test_scores_are_those_of_the_definition(spark, documents):
    rows, labels = corpus(120)
    odd = [(9000, None), (9001, ""), (9002, "Ünï 漢字漢 x1y2 --!! a"), (9003, "word " * 70)]
    docs = documents(*rows, *odd)
    model = quality.fit(docs, spark.createDataFrame([*labels, (3, 0, 0), (3, 0, 0), (5, 0, 0)], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.quality_score for r in quality.grade(docs, model).collect()}
    texts = {r[0]: r[1] for r in [*rows[:25], *odd]}
    want = plain_scores(model, [r[1] for r in [*rows, *odd]], texts.values())
    assert np.allclose([got[i] for i in texts], want, atol=2e-4)
