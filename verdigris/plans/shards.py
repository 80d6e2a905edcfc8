"""Queries of annotations, nested shards, resumed runs and the prediction log."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris import prediction_log, sinks
from verdigris.operators import qa
from verdigris.plans import bindings as B
from verdigris.plans import catalogue as C
from verdigris.sources import annotations
from verdigris.storage import shared_dir

query = C.query

_SAID_SQL = """said AS (SELECT conv_id, turn, role, text, regexp_extract(text, '[A-Za-z]+', 0) AS w, row_number() OVER (ORDER BY conv_id, turn) AS line FROM conversations)"""


def _said(spark, d):
    turns = B.table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    # Numbers by ranges, not in one task.
    return qa.numbered(turns, "conv_id", "turn").withColumns({"w": F.regexp_extract("text", "[A-Za-z]+", 0), "line": F.col("i") + 1})


@query(f"""WITH {_SAID_SQL}
SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN line::VARCHAR ELSE 'a' || conv_id || '-' || turn END AS annot_id,
  w || ' ' || role || '1 says ' || role || '1 and thing2?' AS question, w || '|No object7.|' || role || '1' AS answers, turn % 3 AS answer_label,
  CASE WHEN turn % 3 > 0 THEN (turn % 2)::INTEGER END AS rationale_label, CASE WHEN conv_id % 7 < 6 THEN 1 ELSE 0 END AS boxes
FROM said WHERE turn % 11 <> 10""")
def annotation_tokens(spark, d):
    """Questions and answers of JSON lines whose tokens are strings or lists of objects, with
    the boxes of their metadata; broken lines are left out."""
    said = _said(spark, d)
    quoted = lambda c: F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.lit(1 << 30))
    text = lambda c: F.regexp_replace(quoted(c), r"\}$", "")
    line = F.concat(
        F.lit('{"objects": ['), text(F.col("role")), F.lit(', "thing"], "question": ['), text(F.col("w")), F.lit(', [0], "says", [0, 1], "?"], "answer_choices": [['),
        text(F.col("w")), F.lit('], ["No", [6], "."], [[0]]], "answer_label": '), (F.col("turn") % 3).cast("string"),
        F.when(F.col("turn") % 3 > 0, F.concat(F.lit(', "rationale_choices": [["so"], [[1]]], "rationale_label": '), (F.col("turn") % 2).cast("string"))).otherwise(""),
        F.when(F.col("turn") % 4 != 0, F.concat(F.lit(', "annot_id": "a'), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit('"'))).otherwise(""),
        F.lit(', "img_fn": "'), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit('", "metadata_fn": "m'), (F.col("conv_id") % 7).cast("string"), F.lit('"'),
        F.when(F.col("turn") % 11 == 10, "").otherwise("}"),
    )
    parsed = annotations.parse_annotations(said.select(line.alias("value"), "line"))
    metadata = spark.range(6).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("metadata_fn"), F.array(F.array(*[F.lit(float(i)) for i in range(5)])).alias("boxes"))
    boxed = annotations.with_boxes(parsed, metadata)
    told = lambda tokens: annotations.render_tokens(tokens, F.col("objects"))
    place = F.split("img_fn", "/")
    return boxed.select(
        F.get(place, F.lit(0)).cast("long").alias("conv_id"), F.get(place, F.lit(1)).cast("long").alias("turn"), "annot_id", told(F.col("question")).alias("question"),
        F.array_join(F.transform("answers", told), "|").alias("answers"), "answer_label", "rationale_label", F.size("boxes").alias("boxes"),
    )


def _nested(spark, d):
    """One row a conversation: each turn is an annotation, every third with its own objects."""
    token = lambda kind, text, *at: F.struct(F.lit(kind).alias("kind"), text.alias("text"), F.array(*map(F.lit, at)).cast("array<int>").alias("object_indices"))
    word = lambda c: token("word", c)
    own = F.when(F.col("turn") % 3 == 0, F.array(F.col("role"), F.lit("own")))
    answers = F.array(F.array(word(F.col("w"))), F.array(token("tag", F.lit(""), 1), word(F.lit("waits"))))
    annotation = F.struct(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("annot_id"), own.alias("objects"),
        F.array(word(F.lit("Why is")), token("tag", F.lit(""), 0), word(F.lit("here")), word(F.lit("?"))).alias("question_tokens"),
        answers.alias("answer_choice_tokens"), F.when(F.col("turn") % 5 != 4, F.lit(1)).alias("answer_label"),
        F.slice(answers, 1, F.when(F.col("turn") % 7 == 6, 1).otherwise(2)).alias("rationale_choice_tokens"), F.lit(0).alias("rationale_label"), F.col("text").alias("comment"),
    )
    said = B.table(spark, d, "conversations").withColumn("w", F.regexp_extract("text", "[A-Za-z]+", 0))
    image = F.struct(F.when(F.col("conv_id") % 9 == 0, F.lit("broken").cast("binary")).otherwise(F.lit(b"\x89PNG....")).alias("bytes"), F.concat(F.col("conv_id").cast("string"), F.lit(".png")).alias("path"))
    rows = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", annotation.alias("a")))).alias("s"))
    return rows.select(
        F.col("conv_id").alias("image_id"), image.alias("image"), F.array(F.lit("man"), F.lit("dog")).alias("objects"), F.array(F.array(*[F.lit(float(i)) for i in range(5)])).alias("boxes"),
        F.lit(640).alias("width"), F.lit(480).alias("height"), F.col("s.a").alias("annotations"),
    )


def png(content):
    """Whether bytes begin as a PNG file does."""
    return F.substring(content, 1, 4) == F.lit(b"\x89PNG")


@query("""WITH said AS (SELECT *, regexp_extract(text, '[A-Za-z]+', 0) AS w, CASE WHEN turn % 3 = 0 THEN role ELSE 'man' END AS first, CASE WHEN turn % 3 = 0 THEN 'own' ELSE 'dog' END AS second FROM conversations WHERE conv_id % 9 <> 0)
SELECT conv_id AS image_id, conv_id || '-' || turn AS annot_id, 'Why is ' || first || '1 here?' AS question, w || '|' || second || '2 waits' AS answers, w || '|' || second || '2 waits' AS rationales
FROM said WHERE turn % 5 <> 4 AND turn % 7 <> 6""")
def shard_questions(spark, d):
    """Valid questions of nested shards: annotations with their own objects or their image's;
    unreadable images have none."""
    path = shared_dir(spark, "shards")
    _nested(spark, d).write.parquet(path)
    asked = annotations.questions_of(spark.read.parquet(path), png)
    return qa.valid_questions(asked).select("image_id", "annot_id", "question", F.array_join("answers", "|").alias("answers"), F.array_join("rationales", "|").alias("rationales"))


@query("SELECT conv_id AS image_id, count(*) AS annotations FROM conversations GROUP BY conv_id")
def resumed_shards(spark, d):
    """All images of the shards, once each, worked off in runs that go on where the last one
    ended: two limited ones and the rest."""
    path = shared_dir(spark, "shards")
    _nested(spark, d).repartition(3).write.parquet(path)
    work = annotations.Shards(spark, path, shared_dir(spark, "worked"), shared_dir(spark, "ledger"))
    counted = lambda rows: rows.select("image_id", F.size("annotations").cast("long").alias("annotations"))
    for most in (20, 25, None):
        work.run(counted, ["image_id", "annotations"], most)
    return work.results().select("image_id", "annotations")


@query("""WITH p AS (SELECT event_id AS item_id, event_type AS label, value / 100.0 AS p, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'view' END AS gold FROM events), l AS (SELECT item_id, label, round(p, 4) AS probability, label = gold AS hit FROM p)
SELECT item_id, label, probability, NULL::BIGINT AS n, NULL::DOUBLE AS share FROM l UNION ALL SELECT NULL, NULL, NULL, count(*), round(avg(hit::INTEGER), 4) FROM l""")
def prediction_log_rows(spark, d):
    """A log of predictions read again, and the summary that its commit wrote."""
    rows = B.table(spark, d, "events").select(F.col("event_id").alias("item_id"), F.col("event_type").alias("label"), (F.col("value") / 100).alias("probability"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise("view").alias("gold"))
    log = shared_dir(spark, "log")
    prediction_log.write_predictions(rows, log, {"share": F.col("label") == F.col("gold")})
    prediction_log.write_predictions(rows.limit(0), log, {"share": F.lit(True)})  # nothing to tell
    told = prediction_log.read_predictions("item_id long, label string, probability double", log, spark)
    total = prediction_log.read_summaries(log, "n long, share double", spark)
    return told.unionByName(total, allowMissingColumns=True)


@query("""WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM e),
f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
l AS (SELECT user_id, 0 AS g, r, CASE WHEN r = 1 THEN 'user ' || user_id || ': ' ELSE '  or ' END || event_type || ' (' || round_even(100 * p, 0)::INTEGER || '%)' AS line, 100 * p AS c FROM p WHERE r <= 3
  UNION ALL SELECT user_id, 1, r, '  - event ' || event_id, NULL FROM f WHERE r <= 6)
SELECT user_id, string_agg(line, '|' ORDER BY g, r) AS report FROM l GROUP BY user_id HAVING max(CASE WHEN abs(c - floor(c) - 0.5) < 1e-6 THEN 1 ELSE 0 END) = 0""")
def item_reports(spark, d):
    """Reports of users: the most frequent type of event, the next two, and six events;
    those with a half per cent, which formats round either way, are left out."""
    events = B.table(spark, d, "events").select("user_id", "event_type", "event_id")
    kinds = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "event_type"))).alias("k"))
    facts = events.groupBy("user_id").agg(F.slice(F.array_sort(F.collect_list("event_id")), 1, 6).alias("ids"))
    total = F.aggregate("k", F.lit(0).cast("long"), lambda s, x: s - x["less"])
    ranked = kinds.withColumn("ranked", F.transform("k", lambda x: F.struct(x["event_type"].alias("label"), (-x["less"] / total).alias("probability"))))
    half = F.exists(F.slice("ranked", 1, 3), lambda x: F.abs(100 * x["probability"] - F.floor(100 * x["probability"]) - 0.5) < 1e-6)
    lines = sinks.report(F.concat(F.lit("user "), F.col("user_id").cast("string")), F.get("ranked", F.lit(0))["label"], F.get("ranked", F.lit(0))["probability"], F.col("ranked"), F.transform("ids", lambda i: F.concat(F.lit("event "), i.cast("string"))))
    return ranked.where(~half).join(facts, "user_id").select("user_id", F.array_join(lines, "|").alias("report"))
