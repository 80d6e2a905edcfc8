"""The queries of the training-data operators, over whole tables.

Each function takes (spark, sf_dir).  ORACLES has DuckDB SQL where SQL can express
the operator; the others are tested against brute force in tests/llm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import collocations, htmltext, jaccard, langid, licences, media, mixture, pieces, quality, rans, simhash, topk, variants
from verdigris.llm._shared import held_out

PIECE_MODEL, WORD_TOKENIZER = "piece_bpe_32k.model", "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file on the driver; executors get its content."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "language.lang_pred", "language.score", "language.bits_per_byte")


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """doc_id, ids, n_tokens and whether decoding the ids gives the text again."""
    model = pieces.load(model_path or tokenizer_path(PIECE_MODEL))
    coded = table(spark, sf_dir, "documents").select("doc_id", "text", pieces.coder(spark, model)("text").alias("coded"))
    same = F.col("coded.back") == F.replace(F.coalesce("text", F.lit("")), F.lit(pieces.SPACE), F.lit(" "))
    return coded.select("doc_id", F.size("coded.ids").alias("n_tokens"), same.alias("round_trip"), F.col("coded.ids").alias("ids"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    graded = quality.grade(docs.select("doc_id", "text"), model)
    return graded.select(
        "doc_id",
        held_out(F.col("doc_id"), 4, 2).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= quality.GOOD).cast("int").alias("predicted"),
    )


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op9_rans(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    with open(tokenizer or tokenizer_path(WORD_TOKENIZER), encoding="utf-8") as file:
        definition = file.read()
    return rans.token_files(spark, table(spark, sf_dir, "documents"), definition)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_texts(table(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_media": op3_media,
    "op4_licences": op4_licences,
    "op5_mixing": op5_mixing,
    "op6_simhash": op6_simhash,
    "op7_topk": op7_topk,
    "op8_quality": op8_quality,
    "op9_rans": op9_rans,
    "op10_html": op10_html,
    "op11_collocations": op11_collocations,
    "op12_jaccard": op12_jaccard,
    "op13_variants": op13_variants,
}

ORACLES: dict[str, str] = {
    "op4_licences": licences.oracle(),
    "op11_collocations": collocations.oracle(),
    "op12_jaccard": jaccard.oracle(),
    "op13_variants": variants.oracle(),
    "op7_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}
