"""Readers: graph dumps, label files, annotations, logs, media paths."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, VariantType

EDGE_SCHEMA = "rel string, start string, end string, weight double, surface string"
LABEL_SCHEMA = "task string, label_id string, ord int, description string, anchors array<string>, keywords array<string>"
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".gif", ".heic")
VIDEO_SUFFIXES = (".mp4", ".mov", ".avi", ".mkv", ".webm")


def term_of(uri: Column, language: str = "en") -> Column:
    """Term of a node URI /c/<language>/<term>[/sense]; null for any other."""
    parts = F.split(uri, "/")
    return F.when((F.size(parts) >= 4) & (F.get(parts, F.lit(1)) == "c") & (F.get(parts, F.lit(2)) == language), F.get(parts, F.lit(3)))


def parse_dump(lines: DataFrame, skip: tuple[str, ...] = ("ExternalURL", "dbpedia"), language: str = "en") -> DataFrame:
    """Edges of tab-separated dump lines (column `value`): assertion, relation, start, end, JSON.

    Lines with fewer columns, other languages, empty terms, self-loops and relations of
    `skip` go.  Invalid JSON or a missing weight means 1.0, a missing surface "".
    """
    columns = F.split("value", "\t")
    info = F.from_json(F.get(columns, F.lit(4)), "weight double, surfaceText string")
    edges = lines.where(F.size(columns) >= 5).select(
        F.get(F.split(F.get(columns, F.lit(1)), "/"), F.lit(2)).alias("rel"),
        term_of(F.get(columns, F.lit(2)), language).alias("start"),
        term_of(F.get(columns, F.lit(3)), language).alias("end"),
        F.coalesce(info["weight"], F.lit(1.0)).alias("weight"),
        F.coalesce(info["surfaceText"], F.lit("")).alias("surface"),
    )
    return edges.where((F.length("start") > 0) & (F.length("end") > 0) & (F.col("start") != F.col("end")) & ~F.coalesce(F.col("rel"), F.lit("")).isin(*skip))


def read_dump(spark: SparkSession, path: str, partitions: int | None = None, **options: str) -> DataFrame:
    """`parse_dump` of a text or .gz dump; a .gz is one split, so it is spread at once."""
    lines = spark.read.text(path)
    if path.endswith(".gz"):
        lines = lines.repartition(partitions or spark.sparkContext.defaultParallelism)
    return parse_dump(lines, **options)


def empty_edges(spark: SparkSession) -> DataFrame:
    """The offline graph: no edges."""
    return spark.createDataFrame([], EDGE_SCHEMA)


def read_labels(spark: SparkSession, path: str | Path, tasks: tuple[str, ...] = ()) -> DataFrame:
    """Label space of a YAML file {task: [{id, description, anchors, keywords}]}.

    A missing description is the id; missing lists are empty; a missing or empty task of
    `tasks` raises ValueError.
    """
    data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    missing = [t for t in tasks if not data.get(t)]
    if missing:
        raise ValueError(f"tasks without labels: {missing}")
    rows = [(task, item["id"], i, item.get("description", item["id"]), item.get("anchors", []), item.get("keywords", [])) for task, items in data.items() for i, item in enumerate(items or [])]
    return spark.createDataFrame(rows, LABEL_SCHEMA)


def is_video(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^.]+$", 0)).isin(*VIDEO_SUFFIXES)


def read_media(spark: SparkSession, path: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """Files of a folder with their bytes (path, modificationTime, length, content)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.lower(F.regexp_extract("path", r"\.[^.]+$", 0)).isin(*suffixes))


def read_epoch_metrics(spark: SparkSession, path: str, artefacts: DataFrame | None = None) -> DataFrame:
    """Epoch metrics of a CSV log: the last row of each epoch, of epochs with an artefact."""
    schema = "epoch int, step int, train_loss double, q_a double, qa_r double, q_ar double"
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return last_per_epoch(rows.withColumn("ord", F.monotonically_increasing_id()), artefacts)


def last_per_epoch(rows: DataFrame, artefacts: DataFrame | None = None) -> DataFrame:
    names = [c for c in rows.columns if c not in ("epoch", "ord")]
    last = rows.groupBy("epoch").agg(F.max_by(F.struct(*names), "ord").alias("m")).select("epoch", "m.*")
    return last.join(artefacts, "epoch", "left_semi") if artefacts is not None else last


def latest_checkpoint(paths: DataFrame) -> DataFrame:
    """The path (path, ord) of the highest checkpoint-<step>; the first one of equals."""
    step = F.regexp_extract("path", r"checkpoint-(\d+)", 1)
    found = paths.where(step != "").withColumn("step", step.cast("long"))
    return found.groupBy().agg(F.max_by("path", F.struct(F.col("step"), -F.col("ord"))).alias("path"), F.max("step").alias("step")).where("path is not null")


def newest(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """An upserted cache on read: of each key the row of the highest `ts` (null is lowest); of
    rows of one time that whose plain columns come last, compared in order."""
    plain = [F.col(f"`{f.name}`") for f in rows.schema.fields if isinstance(f.dataType, AtomicType) and not isinstance(f.dataType, VariantType)]
    whole = F.struct(*[F.col(f"`{name}`") for name in rows.columns])
    last = rows.groupBy(F.col(f"`{key}`").alias("key")).agg(F.max_by(whole, F.struct(F.col(f"`{ts}`").alias("time"), *plain)).alias("row"))
    return last.select("row.*")


_PACKED = ("rel", "start", "end", "weight", "surface")


def packed(edges: DataFrame, key: str) -> DataFrame:
    """(key, edges): the edges of each key as JSON arrays of their fields, heaviest first."""
    fields = F.array(*[F.col(c).cast("string") for c in _PACKED])
    listed = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("minus"), "rel", "start", "end", fields.alias("f"))))
    return edges.groupBy(key).agg(F.to_json(F.transform(listed, lambda x: x["f"])).alias("edges"))


def unpacked(rows: DataFrame, key: str) -> DataFrame:
    """The edges that `packed` stored."""
    each = rows.select(key, F.explode(F.from_json("edges", "array<array<string>>")).alias("f"))
    return each.select(key, *[F.get("f", F.lit(i)).cast("double" if c == "weight" else "string").alias(c) for i, c in enumerate(_PACKED)])


def valid_cache(rows: DataFrame, manifest_key: str) -> DataFrame:
    """Cached rows (cache_key, ...) that were written under the current settings' key."""
    return rows.where(F.col("cache_key") == manifest_key)


def valid_uploads(files: DataFrame, most_bytes: int, suffixes: tuple[str, ...]) -> DataFrame:
    """`files` (path, length) with a reason for each one that is refused, else null."""
    suffix = F.lower(F.regexp_extract("path", r"\.[^.]+$", 0))
    reason = F.when(~suffix.isin(*suffixes), "type").when(F.col("length") > most_bytes, "too large").when(F.col("length") == 0, "empty")
    return files.withColumn("refused", reason)
