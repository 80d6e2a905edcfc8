"""Annotations, nested shards, resumed runs and the prediction log."""

import json

import pytest
from pyspark.sql import functions as F

from verdigris import prediction_log
from verdigris.plans import shards as plans
from verdigris.sources import annotations
from verdigris.storage import shared_dir

SF = "/root/testdata/sf0.001"


def lines(spark, *rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r), i) for i, r in enumerate(rows)], "value string, line long")


def test_mixed_tokens_defaults_and_broken_lines(spark):
    full = {
        "annot_id": "x", "objects": ["man", "dog"], "question": ["Is", [0], "with", [1, 5], "?", "7"], "answer_choices": [["yes"], [[0], "is"], []],
        "answer_label": 1, "rationale_choices": [["so"]], "rationale_label": 0, "img_fn": "a.jpg", "metadata_fn": "a.json", "more": {"x": [1]},
    }
    found = annotations.parse_annotations(lines(spark, full, {"question": ["why"]}, "no JSON", "[1]", "null", {"annot_id": None}))
    rows = {r.annot_id: r for r in found.collect()}
    assert set(rows) == {"x", "1", "5"}
    x = rows["x"]
    assert [(t.text, t.indices) for t in x.question] == [("Is", []), ("", [0]), ("with", []), ("", [1, 5]), ("?", []), ("7", [])]
    assert [[t.text or t.indices for t in c] for c in x.answers] == [["yes"], [[0], "is"], []] and (x.answer_label, x.rationale_label, x.img_fn) == (1, 0, "a.jpg")
    assert rows["1"].objects == [] and rows["1"].answers == [] and rows["1"].rationales is None and rows["1"].answer_label is None
    assert rows["5"].question == []
    told = found.select("annot_id", annotations.render_tokens(F.col("question"), F.col("objects")).alias("q"))
    assert dict(map(tuple, told.collect()))["x"] == "Is man1 with dog2 and object6? 7"


def test_limit_counts_lines(spark):
    rows = lines(spark, {"annot_id": "a"}, "broken", {"annot_id": "b"}, {"annot_id": "c"})
    assert sorted(r.annot_id for r in annotations.parse_annotations(rows, 3).collect()) == ["a", "b"]


def test_boxes_of_missing_metadata_are_empty(spark):
    parsed = annotations.parse_annotations(lines(spark, {"metadata_fn": "m"}, {"metadata_fn": "n"}, {}))
    metadata = spark.createDataFrame([("m", [[1.0, 2.0]])], "metadata_fn string, boxes array<array<double>>")
    assert {r.annot_id: r.boxes for r in annotations.with_boxes(parsed, metadata).collect()} == {"0": [[1.0, 2.0]], "1": [], "2": []}


def test_only_the_fields_used_are_read(spark, capsys):
    path = shared_dir(spark, "nested")
    plans._nested(spark, SF).write.parquet(path)
    for readable in (None, plans.png):
        annotations.questions_of(spark.read.parquet(path), readable).explain("formatted")
        schema = next(line for line in capsys.readouterr().out.splitlines() if line.startswith("ReadSchema"))
        assert "question_tokens" in schema and "objects" in schema and ("bytes" in schema) == bool(readable)
        for unused in ("boxes", "width", "height", "path", "comment"):
            assert unused not in schema


def test_runs_go_on_after_one_that_broke_off(spark):
    path = shared_dir(spark, "shards")
    spark.range(40).select("id", F.lit("wide").alias("unused")).repartition(3).write.parquet(path)
    work = annotations.Shards(spark, path, shared_dir(spark, "out"), shared_dir(spark, "ledger"))
    keep = lambda rows: rows
    assert work.run(keep, ["id"], 7) == 0

    def broken(rows):
        rows.write.mode("overwrite").parquet(f"{work.out}/run=1")  # its output is there, its ledger is not
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        work.run(broken, ["id"], 9)
    assert work.results().count() == 7
    assert work.run(keep, ["id"], 9) == 1 and work.results().count() == 16
    assert work.run(keep, ["id"]) == 2
    assert sorted(r.id for r in work.results().collect()) == list(range(40))
    assert work.pending().isEmpty() and work.run(keep, ["id"], 5) == 3 and work.results().count() == 40
    # The first rows of a run are those that come first by file and place.
    first = work.finished().where("run = 0").select("file", "place").collect()
    every = sorted((r.file, r.place) for r in work.finished().collect())
    assert sorted(map(tuple, first)) == every[:7]


PREDICTED = "id long, p double, tags array<double>"


def files(spark, path):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in found.listStatus(hadoop)) if found.exists(hadoop) else []


def test_log_is_rounded_and_summed_up(spark):
    log = shared_dir(spark, "log")
    rows = spark.createDataFrame([(i, i / 7, [1 / 3]) for i in range(10)], PREDICTED).repartition(4)
    prediction_log.write_predictions(rows, log, {"right": F.col("id") < 3, "never": F.lit(None).cast("boolean")})
    prediction_log.write_predictions(rows.where("id > 6"), log, {"right": F.col("id") == 7})
    got = sorted(tuple(r) for r in prediction_log.read_predictions(PREDICTED, log, spark).collect())
    assert got == sorted((i, round(i / 7, 4), [0.3333]) for i in [*range(10), 7, 8, 9])
    told = sorted(tuple(r) for r in prediction_log.read_summaries(log, "n long, right double, never double", spark).collect())
    assert told == [(3, 0.3333, None), (10, 0.3, 0.0)]
    prediction_log.write_predictions(rows.where("id = 0"), log, {}, "overwrite")
    assert prediction_log.read_predictions(PREDICTED, log, spark).count() == 1


def test_nothing_to_log(spark):
    log = shared_dir(spark, "log")
    prediction_log.write_predictions(spark.createDataFrame([], PREDICTED), log, {"right": F.lit(True)})
    assert files(spark, log) == []


def test_a_failing_task_leaves_nothing(spark):
    log = shared_dir(spark, "log")
    good = spark.createDataFrame([(1, 0.5, [])], PREDICTED)
    prediction_log.write_predictions(good, log, {})
    before = files(spark, log)
    bad = spark.range(0, 400, 1, 4).select("id", F.when(F.col("id") == 399, F.raise_error(F.lit("late"))).otherwise(F.lit(0.5)).cast("double").alias("p"), F.array(F.lit(1.0)).alias("tags"))
    with pytest.raises(Exception, match="late"):
        prediction_log.write_predictions(bad, log, {})
    assert files(spark, log) == before
