"""Label spaces: lexicons, document frequency, lexical matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import concept_to_text, to_concept, token_set
from verdigris.functions.vocabulary import DEFAULT, Vocabulary


def anchors(labels: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """(task, label_id, concept) of every anchor."""
    exploded = labels.select("task", "label_id", F.explode("anchors").alias("anchor"))
    return exploded.select("task", "label_id", to_concept(F.col("anchor"), vocabulary).alias("concept")).where("concept <> ''").distinct()


def anchor_vocabulary(labels: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Every anchor concept of any task."""
    return anchors(labels, vocabulary).select("concept").distinct()


def lexicon(labels: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """(task, label_id, word, df): base words of id, keywords and anchors; df counts the
    task's labels that share the word."""
    texts = F.concat(F.array(concept_to_text(F.col("label_id"))), "keywords", F.transform("anchors", concept_to_text))
    words = labels.select("task", "label_id", F.explode(texts).alias("text")).select("task", "label_id", F.explode(token_set(F.col("text"), vocabulary)).alias("word")).distinct()
    df = words.groupBy("task", "word").agg(F.count("*").alias("df"))
    return words.join(df, ["task", "word"]).select("task", "label_id", "word", "df")


def lexical_match(texts: DataFrame, words: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """(item_id, task, label_id, score) for texts (item_id, task, text) and a lexicon.

    The lexicon is broadcast, never the texts.  Each shared word counts 1 / df; the sum over at most three of the text's words,
    1 at most.  Labels that share no word have no row.
    """
    tokens = texts.withColumn("tokens", token_set(F.col("text"), vocabulary)).withColumn("n", F.size("tokens"))
    hits = tokens.select("item_id", "task", "n", F.explode("tokens").alias("word")).join(F.broadcast(words), ["task", "word"])
    return hits.groupBy("item_id", "task", "label_id").agg(F.least(F.lit(1.0), F.sum(1.0 / F.col("df")) / F.least(F.first("n"), F.lit(3))).alias("score"))


def default_zero(column: str) -> Column:
    """The value of a left join, 0 where it found nothing."""
    return F.coalesce(F.col(column), F.lit(0.0))
