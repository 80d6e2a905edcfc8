"""A training corpus from `documents`: five stages of the llm operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.  All but the last return the columns
of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import langid, mixture, pieces, quality, queries, simhash
from verdigris.storage import collected, drop, store

#: Language ID rejects a text below this posterior of its language.
SURE = 0.4


def _judged(docs: DataFrame, verdict: Column) -> DataFrame:
    """(row, verdict) of every document: its columns as one struct, so that none can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), verdict.alias("verdict"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; null texts and texts without a letter go.

    Every row is judged by its text alone, so repeated rows stay or go together; other
    columns may have any name.
    """
    judged = _judged(docs, langid.language_of(spark, langid.fit(docs))("text"))
    return judged.where((F.col("verdict.lang_pred") != langid.UNKNOWN) & (F.col("verdict.score") >= SURE)).select("row.*")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of these documents, calls good.

    Every row is judged by its text alone, so repeated rows stay or go together; other
    columns may have any name.
    """
    model = quality.fit(docs, queries.table(spark, sf_dir, "labels"))
    return _judged(docs, quality.quality_of(spark, model)("text")).where(F.col("verdict") >= quality.GOOD).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates.

    Documents of one id with unlike texts are of different groups.
    """
    return simhash.keep_first(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it (0 to 3 times)."""
    return mixture.repeat_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, piece ids and their number of every document of the mix."""
    model = pieces.load(queries.tokenizer_path(queries.PIECE_MODEL))
    encoded = docs.select("doc_id", "source", "lang", pieces.encoder(spark, model)("text").alias("ids"))
    return encoded.withColumn("n_tokens", F.size("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: The first two stages apply trained models and the last one a tokenizer, which SQL
#: cannot express; tests/llm holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage's result written to the shared folder and
    deleted when the next one has read it."""
    docs = queries.table(spark, sf_dir, "documents")
    with collected() as own:
        for name, stage in STAGES[:-1]:
            docs, path = store(stage(spark, docs, sf_dir), f"stage-{name}")
            # What the stage wrote on its way, and its predecessor's result, have been used.
            for done in own - {path}:
                drop(spark, done)
    return STAGES[-1][1](spark, docs, sf_dir)
