"""Question annotations: JSON lines with mixed token lists, and nested Parquet shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions.text import render_tokens
from verdigris.storage import drop

_LABELS = ("answer_label", "rationale_label")
_INDICES = "array<int>"
TOKENS = "array<struct<text:string,indices:array<int>>>"


def _token(value: Column) -> Column:
    """A token of VARIANT type, a string or a list of object indices, as struct<text, indices>."""
    indices = F.try_variant_get(value, "$", _INDICES)
    text = F.when(indices.isNull(), F.try_variant_get(value, "$", "string"))
    return F.struct(F.coalesce(text, F.lit("")).alias("text"), F.coalesce(indices, F.array().cast(_INDICES)).alias("indices"))


def _tokens(values: Column) -> Column:
    return F.transform(values, _token)


def parse_annotations(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """(annot_id, objects, question, answers, answer_label, rationales, rationale_label,
    img_fn, metadata_fn) of JSON lines (value, line), the first `limit` of them.

    A token is a string or a list of object indices, so lines are read as VARIANT; tokens
    come out as struct<text, indices>.  annot_id defaults to the line number; missing
    lists are empty, missing rationale fields null.  Lines that are not JSON objects are
    left out, but count in `limit`.
    """
    some = lines.orderBy("line").limit(limit) if limit is not None else lines
    row = some.select("line", F.try_parse_json("value").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    listed = lambda name: F.coalesce(_tokens(get(name, "array<variant>")), F.array().cast(TOKENS))
    choices = lambda name: F.transform(get(name, "array<array<variant>>"), _tokens)
    return row.select(
        F.coalesce(get("annot_id", "string"), F.col("line").cast("string")).alias("annot_id"),
        F.coalesce(get("objects", "array<string>"), F.array().cast("array<string>")).alias("objects"),
        listed("question").alias("question"),
        F.coalesce(choices("answer_choices"), F.array().cast(f"array<{TOKENS}>")).alias("answers"),
        choices("rationale_choices").alias("rationales"),
        *[get(name, "int").alias(name) for name in _LABELS],
        *[get(name, "string").alias(name) for name in ("img_fn", "metadata_fn")],
    )


def with_boxes(annotations: DataFrame, metadata: DataFrame) -> DataFrame:
    """Annotations with the boxes of their metadata (metadata_fn, boxes); none is empty."""
    joined = annotations.join(metadata.select("metadata_fn", "boxes"), "metadata_fn", "left")
    return joined.withColumn("boxes", F.coalesce("boxes", F.array().cast("array<array<double>>")))


def questions_of(shards: DataFrame, readable: Callable[[Column], Column] | None = None) -> DataFrame:
    """(image_id, annot_id, question, answers, answer_label, rationales, rationale_label): the
    annotations of shards (image_id, image, objects, annotations) as rows of text.

    An annotation's own objects come before its image's.  Images that `readable` (a
    function of their bytes) refuses have no questions.  Only the fields named here are
    read from the shards: each is taken out of the array before that is exploded.
    """
    kept = shards.where(readable(F.col("image.bytes"))) if readable else shards
    names = ("annot_id", "objects", "question_tokens", "answer_choice_tokens", "answer_label", "rationale_choice_tokens", "rationale_label")
    each = kept.select("image_id", "objects", F.explode(F.arrays_zip(*[F.col(f"annotations.{n}").alias(n) for n in names])).alias("a"))
    objects = F.coalesce("a.objects", "objects")
    told = lambda tokens: render_tokens(F.transform(tokens, lambda t: F.struct(t["text"].alias("text"), t["object_indices"].alias("indices"))), objects)
    choices = lambda name: F.transform(f"a.{name}", told)
    return each.select(
        "image_id", "a.annot_id", told(F.col("a.question_tokens")).alias("question"), choices("answer_choice_tokens").alias("answers"), "a.answer_label",
        choices("rationale_choice_tokens").alias("rationales"), "a.rationale_label",
    )


class Shards:
    """Parquet shards that are worked off image by image, over as many runs as it takes.

    Rows are numbered by file and place.  A run takes the first ones that no finished run
    has had; its rows stand in `out`/run=<n>, its keys in the ledger's run=<n>, written
    last, so a run that broke off is done again in its own folder.
    """

    def __init__(self, spark: SparkSession, path: str, out: str, ledger: str) -> None:
        self.spark, self.path, self.out, self.ledger = spark, path, out, ledger

    _KEY = ("file", "place")
    _SCHEMA = "file string, place long, run int"

    def _rows(self, *columns: str) -> DataFrame:
        found = self.spark.read.parquet(self.path)
        return found.select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))

    def _runs(self) -> list[int]:
        """Numbers of the finished runs: those whose part of the ledger was committed."""
        base = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.ledger)
        files = base.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = files.globStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.ledger}/run=*/_SUCCESS"))
        return sorted(int(f.getPath().getParent().getName().removeprefix("run=")) for f in done or [])

    def finished(self) -> DataFrame:
        """(file, place, run) of all rows of finished runs."""
        runs = self._runs()
        if not runs:
            return self.spark.createDataFrame([], self._SCHEMA)
        return self.spark.read.schema(self._SCHEMA).option("basePath", self.ledger).parquet(*[f"{self.ledger}/run={n}" for n in runs])

    def pending(self, most: int | None = None) -> DataFrame:
        """(file, place) of the rows to come, the first `most`; reads no column of the data."""
        rows = self._rows().join(self.finished().select(*self._KEY), list(self._KEY), "left_anti")
        return rows.orderBy(*self._KEY).limit(most) if most is not None else rows

    def run(self, made: Callable[[DataFrame], DataFrame], columns: list[str], most: int | None = None) -> int:
        """`made` of `columns` of the next `most` rows, appended to `out`; the run's number."""
        number = len(self._runs())
        keys_at = f"{self.ledger}/next-{number}"
        self.pending(most).write.mode("overwrite").parquet(keys_at)
        keys = self.spark.read.parquet(keys_at)
        rows = self._rows(*columns).join(keys, list(self._KEY), "left_semi").select(*columns)
        made(rows).write.mode("overwrite").parquet(f"{self.out}/run={number}")
        keys.write.mode("overwrite").parquet(f"{self.ledger}/run={number}")
        drop(self.spark, keys_at)
        return number

    def results(self) -> DataFrame:
        """The rows of finished runs."""
        return self.spark.read.option("basePath", self.out).parquet(*[f"{self.out}/run={n}" for n in self._runs()])
