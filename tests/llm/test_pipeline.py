import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from verdigris.llm import langid, quality, queries, simhash  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(7)
    words = {"en": "the of and house garden river with from that this".split(), "es": "el de y casa jardín río con desde que esta".split()}
    rows, labels = [], []
    for i in range(360):
        lang = ("en", "es")[i % 3 == 0]
        text = " ".join(rng.choice(words[lang], 30)) + f" n{i} m{i} k{i}."
        good = i % 6 != 5
        rows.append((i, text if good else text.upper().replace(" ", "!! "), lang, f"s{i % 4 if i % 2 else 0}"))
        labels.append((i, int(good), 0))
    rows += [(1000 + i, rows[i][1], rows[i][2], "s9") for i in range(20)]  # copies
    rows += [(2000, None, None, "s1"), (2001, "", "en", None), (2002, "123 456", "en", "s1"), (2003, "12 — 13 %", None, None)]
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def rows_of(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_dedup", "mixing", "sentencepiece"]
    stages = dict(corpus_pipeline.STAGES)

    out = stages["language_id"](spark, docs, folder)
    assert out.columns == COLUMNS
    before = docs.toPandas()
    pred, score, _ = langid.predict(langid.fit(docs), [t if isinstance(t, str) else None for t in before.text])
    keep = [p != "und" and s >= corpus_pipeline.SURE for p, s in zip(pred, score)]
    assert sorted(r.doc_id for r in out.collect()) == sorted(before.doc_id[keep])
    assert not set(range(2000, 2004)) & {r.doc_id for r in out.collect()}

    before = out.toPandas()
    docs2 = spark.createDataFrame(before)
    out = stages["quality"](spark, docs2, folder)
    p = quality.probability(quality.fit(docs2, labels), pa.array(before.text.tolist()))
    assert sorted(r.doc_id for r in out.collect()) == sorted(before.doc_id[p >= quality.GOOD])
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    kept = {r.doc_id for r in out.collect()} & set(range(360))
    assert len(kept & good) >= 0.98 * len(good & set(before.doc_id)) and len(kept - good) <= 2

    before = out.toPandas()
    out = stages["near_dedup"](spark, spark.createDataFrame(before), folder)
    prints = np.array([simhash.fingerprint(t) for t in before.text], np.uint64)
    root = np.arange(len(prints))
    close = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    for _ in range(len(prints)):
        new = np.array([root[c].min() for c in close])
        if (new == root).all():
            break
        root = new
    first = before.groupby(root).doc_id.min()
    assert out.columns == COLUMNS and sorted(r.doc_id for r in out.collect()) == sorted(first)

    before = spark.createDataFrame(out.toPandas())
    out = stages["mixing"](spark, before, folder)
    assert out.columns == COLUMNS
    assert set(rows_of(out)) <= set(rows_of(before)) and out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert rows_of(out) == rows_of(stages["mixing"](spark, before.repartition(3), folder))

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(queries.PIECE_MODEL))
    final = stages["sentencepiece"](spark, out, folder)
    texts = {r.doc_id: r.text for r in before.collect()}
    assert all(r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in final.collect())

    ran = corpus_pipeline.run(spark, folder)
    assert ran.columns == final.columns
    assert sorted((r.doc_id, r.n_tokens) for r in ran.collect()) == sorted((r.doc_id, r.n_tokens) for r in final.collect())


def test_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_clashing_columns_and_repeated_ids(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 200").withColumns({n: F.lit(i) for i, n in enumerate(("verdict", "row", "mark", "print", "__language", "size"))})
    other = docs.where("doc_id = 7").withColumn("text", F.lit("una casa en el jardín y el río de la casa"))
    docs = docs.unionByName(other).unionByName(other)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, folder)
        assert docs.columns == before.columns
        assert set(rows_of(docs)) <= set(rows_of(before))
        if name == "near_dedup":
            assert len({r.text for r in before.where("doc_id = 7").collect()}) == docs.where("doc_id = 7").count()
