"""Queries of single operators over the shared tables, registered with the catalogue's.

They stand for readers, sinks, prompts, frames and training labels, each with its SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris import sinks
from verdigris.functions import frame
from verdigris.functions import text as T
from verdigris.functions.vectors import clamp
from verdigris.functions.vocabulary import DEFAULT
from verdigris.operators import evidence, fusion, graph, metrics, moments, qa
from verdigris.plans import bindings as B
from verdigris.plans import catalogue as C
from verdigris.plans import pipeline
from verdigris.sources import dump
from verdigris.storage import cut, shared_dir
from verdigris.streaming import sampler

query = C.query


# -------------------------------------------------------------------------- readers


@query("""WITH raw AS (
  SELECT p_partkey AS k, ['IsA', 'RelatedTo', 'ExternalURL', 'dbpedia', 'UsedFor'][p_partkey % 5 + 1] AS rel,
         CASE WHEN p_partkey % 17 = 0 THEN '' ELSE 'part_' || p_partkey END AS start, CASE WHEN p_partkey % 7 = 0 THEN 'fr' ELSE 'en' END AS lang,
         CASE WHEN p_partkey % 11 = 0 THEN 'part_' || p_partkey ELSE 'size_' || p_size END AS "end" FROM part)
SELECT rel, start, "end", CASE k % 3 WHEN 0 THEN 2.5::DOUBLE ELSE 1.0::DOUBLE END AS weight, CASE k % 3 WHEN 0 THEN '[[a]] b' ELSE '' END AS surface
FROM raw WHERE k % 13 <> 0 AND lang = 'en' AND start <> '' AND start <> "end" AND rel NOT IN ('ExternalURL', 'dbpedia')""")
def dump_edges(spark, d):
    """A dump's lines, good and bad ones, through the reader's parser."""
    k = F.col("p_partkey")
    key = k.cast("string")
    rel = F.concat(F.lit("/r/"), F.get(F.array(*map(F.lit, ("IsA", "RelatedTo", "ExternalURL", "dbpedia/genre", "UsedFor"))), (k % 5).cast("int")))
    start = F.concat(F.lit("/c/en/"), F.when(k % 17 == 0, "").otherwise(F.concat(F.lit("part_"), key)), F.when(k % 2 == 0, "/n").otherwise(""))
    end = F.concat(F.lit("/c/"), F.when(k % 7 == 0, "fr").otherwise("en"), F.lit("/"), F.when(k % 11 == 0, F.concat(F.lit("part_"), key)).otherwise(F.concat(F.lit("size_"), F.col("p_size").cast("string"))))
    info = F.when(k % 3 == 0, '{"weight": 2.5, "surfaceText": "[[a]] b"}').when(k % 3 == 1, '{"surfaceText": null}').otherwise("no JSON")
    line = F.concat_ws("\t", F.concat(F.lit("/a/"), key), rel, start, end, F.when(k % 13 != 0, info))
    return dump.parse_dump(B.table(spark, d, "part").select(line.alias("value")))


@query("SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id")
def newest_cached(spark, d):
    return dump.newest(B.table(spark, d, "events"), "user_id", "ts").select("user_id", "ts")


@query(f"WITH {B.EDGES_SQL} SELECT start AS term, rel, start, \"end\", weight FROM edges WHERE rel <> 'SoldIn'")
def cached_edges(spark, d):
    """Edges as they come back from a cache of JSON arrays."""
    edges = B.graph(spark, d).where("rel <> 'SoldIn'").withColumn("term", F.col("start"))
    return dump.unpacked(dump.packed(edges, "term"), "term").select("term", "rel", "start", "end", "weight")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN 'type' WHEN n_chars % 3000 > 2500 THEN 'too large' WHEN n_chars % 3000 = 0 THEN 'empty' END AS refused, doc_id % 5 <> 2 AS video FROM documents""")
def uploads_checked(spark, d):
    suffix = F.get(F.array(*map(F.lit, (".MP4", ".mov", ".txt", ".avi", ".webm"))), (F.col("doc_id") % 5).cast("int"))
    files = B.table(spark, d, "documents").select("doc_id", F.concat(F.lit("dir.x/file"), F.col("doc_id").cast("string"), suffix).alias("path"), (F.col("n_chars") % 3000).alias("length"))
    return dump.valid_uploads(files, 2500, dump.VIDEO_SUFFIXES).select("doc_id", "refused", dump.is_video(F.col("path")).alias("video"))


@query("SELECT (user_id % 20)::INTEGER AS epoch, arg_max(value, event_id) AS q_ar FROM events WHERE user_id % 20 < 15 GROUP BY 1")
def last_of_epochs(spark, d):
    rows = B.table(spark, d, "events").select((F.col("user_id") % 20).cast("int").alias("epoch"), F.col("value").alias("q_ar"), F.col("event_id").alias("ord"))
    return dump.last_per_epoch(rows, spark.range(15).select(F.col("id").cast("int").alias("epoch")))


@query("SELECT 'run/checkpoint-' || s || '/x' AS path, s AS step FROM (SELECT max(event_id * 7919 % 10007) AS s FROM events WHERE event_id % 3 <> 0)")
def latest_checkpoint(spark, d):
    step = (F.col("event_id") * 7919 % 10007).cast("string")
    path = F.when(F.col("event_id") % 3 == 0, "run/other").otherwise(F.concat(F.lit("run/checkpoint-"), step, F.lit("/x")))
    return dump.latest_checkpoint(B.table(spark, d, "events").select(path.alias("path"), F.col("event_id").alias("ord")))


# ---------------------------------------------------------------------------- sinks


@query("SELECT user_id AS id, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 ORDER BY ts DESC, user_id LIMIT 8")
def history(spark, d):
    rows = B.table(spark, d, "events").select(F.col("user_id").alias("id"), "ts", F.lpad(F.col("event_id").cast("string"), 12, "0").alias("key"))
    return sinks.history(rows, 8).select("id", "ts", F.col("key").cast("long").alias("event_id"))


@query("""WITH p AS (SELECT event_id, event_type, (event_id % 101) / 100.0 AS p, event_id % 7 = 0 AS a FROM events)
SELECT event_id, CASE WHEN a THEN 'warn' WHEN p >= 0.6 THEN 'high' WHEN p >= 0.35 THEN 'warn' ELSE 'low' END AS tier, event_type || ' (' || (event_id % 101) || '%)' AS line FROM p""")
def report_lines(spark, d):
    rows = B.table(spark, d, "events").select("event_id", "event_type", (F.col("event_id") % 101 / 100).alias("p"), (F.col("event_id") % 7 == 0).alias("a"))
    return rows.select("event_id", sinks.tier(F.col("p"), F.col("a")).alias("tier"), sinks.report_line(F.col("event_type"), F.col("p")).alias("line"))


@query("""SELECT -2 AS place, '| r_regionkey | r_name |' AS line UNION ALL SELECT -1, '|---|---|'
UNION ALL SELECT row_number() OVER (ORDER BY r_regionkey, r_name)::INTEGER, '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region""")
def markdown_lines(spark, d):
    return sinks.markdown_table(B.table(spark, d, "region"), ["r_regionkey", "r_name"])


@query(C._RANKED + """ SELECT item_id, max(rank)::INTEGER AS alternatives, arg_min(label_id, rank) AS best, round(max(probability), 6) AS probability FROM ranked_p GROUP BY item_id""")
def result_json_fields(spark, d):
    """The fields of `result_json`'s lines, read from the JSON again."""
    lines = C.result_json(spark, d)
    schema = "item_id bigint, margin double, alternatives array<struct<rank:int,label_id:string,probability:double,p_support:double,support:double>>"
    read = lines.select(F.from_json("json", schema).alias("r")).select("r.*")
    return read.select("item_id", F.size("alternatives").alias("alternatives"), F.get("alternatives.label_id", F.lit(0)).alias("best"), F.array_max("alternatives.probability").alias("probability"))


# ---------------------------------------------------------------- answers and metrics


@query("SELECT user_id AS item_id, arg_max(event_type, (value, -event_id)) AS option, max(value) AS p FROM events GROUP BY user_id")
def best_answers(spark, d):
    rows = B.table(spark, d, "events").select(F.col("user_id").alias("item_id"), F.col("event_type").alias("option"), F.col("value").alias("p"), F.col("event_id").alias("ord"))
    return fusion.answer(rows)


@query("""WITH o AS (SELECT n_nationkey AS item_id, unnest([0, 1, 2]) AS order_id FROM nation), s AS (SELECT *, unnest([0, 1, 2, 3]) AS slot FROM o), m AS (
  SELECT *, CASE order_id WHEN 0 THEN slot WHEN 1 THEN 3 - slot ELSE (slot + 1) % 4 END AS place FROM s), v AS (
  SELECT *, (item_id % 5) * place / 4.0 - slot / 2.0 AS v FROM m), p AS (SELECT *, exp(v) / sum(exp(v)) OVER (PARTITION BY item_id, order_id) AS p FROM v)
SELECT item_id, 'option ' || place AS option, round(avg(p), 6) AS p FROM p GROUP BY item_id, place""")
def permuted_answers(spark, d):
    """A scorer that likes early slots sees three orders of the options; its probabilities
    are led back to the options and averaged."""
    options = B.table(spark, d, "nation").select(F.col("n_nationkey").alias("item_id"), F.array(*[F.lit(f"option {i}") for i in range(4)]).alias("options"))
    orders = qa.debiased(options, 3)
    value = F.col("item_id") % 5 * F.col("place") / 4 - F.col("slot") / 2
    scored = orders.withColumn("v", value).withColumn("p", C.softmax(F.col("v"), Window.partitionBy("item_id", "order_id")))
    return fusion.permuted_scores(scored).select("item_id", "option", F.round("p", 6).alias("p"))


@query("SELECT n AS event_type, count(e.event_id) AS n FROM (SELECT DISTINCT event_type AS n FROM events UNION SELECT 'never') LEFT JOIN events e ON e.event_type = n GROUP BY n")
def counts_of_names(spark, d):
    events = B.table(spark, d, "events")
    names = events.select("event_type").distinct().unionByName(spark.range(1).select(F.lit("never").alias("event_type")))
    return metrics.counts_by(events, names, "event_type")


@query("SELECT event_id, CASE WHEN e >= 0.5 AND abs(e - round_even(e, 0)) <= 0.001 THEN round_even(e, 0)::INTEGER END AS epoch FROM (SELECT event_id, event_id / 50.0 AS e FROM events)")
def completed_epochs(spark, d):
    return B.table(spark, d, "events").select("event_id", metrics.completed_epoch(F.col("event_id") / 50).alias("epoch"))


@query("SELECT event_id, round(value + value / 2, 6) AS seconds FROM events")
def stage_seconds(spark, d):
    timings = F.create_map(F.lit("a"), F.col("value"), F.lit("total"), F.lit(99.0), F.lit("b"), F.col("value") / 2)
    return B.table(spark, d, "events").select("event_id", F.round(metrics.total_seconds(timings), 6).alias("seconds"))


@query("""WITH e AS (SELECT user_id AS item_id, CASE WHEN event_id % 3 = 0 AND user_id % 4 <> 0 THEN 'graph' ELSE 'fact' END AS kind, event_type || ' ' || event_id % 4 AS text, event_id AS ord FROM events),
u AS (SELECT item_id, kind, text, min(ord) AS ord FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id, kind ORDER BY ord) AS n FROM u),
l AS (SELECT item_id, string_agg(text, '|' ORDER BY ord) FILTER (kind = 'graph' AND n <= 8) AS g, string_agg(text, '|' ORDER BY ord) FILTER (kind = 'fact' AND n <= 5) AS f FROM r GROUP BY item_id)
SELECT item_id, coalesce(g, f) AS evidence FROM l""")
def evidence_shown(spark, d):
    kind = F.when((F.col("event_id") % 3 == 0) & (F.col("user_id") % 4 != 0), "graph").otherwise("fact")
    rows = B.table(spark, d, "events").select(F.col("user_id").alias("item_id"), kind.alias("kind"), F.concat_ws(" ", "event_type", (F.col("event_id") % 4).cast("string")).alias("text"), F.col("event_id").alias("ord"))
    return fusion.final_evidence(rows).select("item_id", F.array_join("evidence", "|").alias("evidence"))


# ------------------------------------------------------------------ training examples

_IDS = "x AS (SELECT l_orderkey AS item_id, list(floor(l_quantity % 4)::INTEGER ORDER BY l_linenumber, floor(l_quantity % 4)) AS ids FROM lineitem GROUP BY l_orderkey), marked AS (SELECT *, coalesce(list_max(list_filter(range(1, len(ids)), lambda i: ids[i] = 1 AND ids[i + 1] = 2)) - 1, -1) AS start FROM x)"


def _ids(spark, d):
    rows = B.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("item_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.floor(F.col("l_quantity") % 4).cast("int").alias("id")))).alias("s"))
    return rows.select("item_id", F.col("s.id").alias("ids"))


@query(f"WITH {_IDS} SELECT item_id, start::INTEGER AS start FROM marked")
def last_marks(spark, d):
    return _ids(spark, d).select("item_id", qa.find_last(F.col("ids"), F.array(F.lit(1), F.lit(2))).cast("int").alias("start"))


@query(f"WITH {_IDS} SELECT item_id, array_to_string(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN start < 0 OR i - 1 < start + 2 OR ids[i] = 0 THEN -100 ELSE ids[i] END), ',') AS labels FROM marked")
def training_labels(spark, d):
    masked = qa.masked_labels(F.col("ids"), F.array(F.lit(1), F.lit(2)), 0)
    return _ids(spark, d).select("item_id", F.array_join(F.transform(masked, lambda x: x.cast("string")), ",").alias("labels"))


@query("SELECT p_partkey, p_size::DOUBLE * 0.5 AS x1, p_partkey::DOUBLE * 2.0 AS y1, (p_size + 10)::DOUBLE * 0.5 AS x2, (p_partkey + 7)::DOUBLE * 2.0 AS y2, 0.9::DOUBLE AS confidence FROM part")
def scaled_boxes(spark, d):
    box = F.array(F.col("p_size"), F.col("p_partkey"), F.col("p_size") + 10, F.col("p_partkey") + 7, F.lit(0.9)).cast("array<double>")
    scaled = qa.scaled_boxes(F.array(F.lit(None).cast("array<double>"), box, F.array(F.lit(1.0))), F.lit(0.5), F.lit(2.0))
    one = F.get(scaled, F.lit(0))
    return B.table(spark, d, "part").select("p_partkey", *[F.get(one, F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2", "confidence"))])


@query("SELECT p_partkey FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 3 <> 0 AND p_size >= 2")
def valid_questions(spark, d):
    k = F.col("p_partkey")
    lists = F.slice(F.array(*map(F.lit, "abcd")), 1, F.least(F.col("p_size"), F.lit(4)))
    rows = B.table(spark, d, "part").select("p_partkey", F.when(k % 5 != 0, 1).alias("answer_label"), F.when(k % 7 != 0, 0).alias("rationale_label"), F.when(k % 3 == 0, "").otherwise("why?").alias("question"), lists.alias("answers"), lists.alias("rationales"))
    return qa.valid_questions(rows).select("p_partkey")


@query("SELECT doc_id FROM documents ORDER BY md5('shuffle|' || doc_id), doc_id LIMIT 25")
def first_documents(spark, d):
    return qa.first_of_shuffle(B.table(spark, d, "documents").select("doc_id"), ["doc_id"], 25)


@query("""WITH t AS (SELECT event_id, event_type || '| ' || user_id || ' ||' || CASE WHEN event_id % 3 = 0 THEN ' ' ELSE 'x ' || event_id % 7 END AS text FROM events),
o AS (SELECT event_id, list_filter(list_transform(string_split(text, '|'), lambda x: trim(x)), lambda x: x <> '') AS o FROM t)
SELECT event_id, len(o)::INTEGER AS n, array_to_string(o, ';') AS options FROM o""")
def split_choices(spark, d):
    """Options of texts such as "a| b ||c"."""
    last = F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.concat(F.lit("x "), (F.col("event_id") % 7).cast("string")))
    rows = B.table(spark, d, "events").select("event_id", T.choices(F.concat("event_type", F.lit("| "), F.col("user_id").cast("string"), F.lit(" ||"), last)).alias("o"))
    return rows.select("event_id", F.size("o").alias("n"), F.array_join("o", ";").alias("options"))


@query(f"""WITH {C._PAIRS} SELECT conv_id, turn, question || ' The answer is: ' || gold || ' Why is this answer correct?' || chr(10) || 'A. ' || gold || chr(10) || 'B. no' AS prompt
FROM pairs WHERE role = 'user' AND next_role = 'assistant'""")
def reason_prompts(spark, d):
    """The question for the reason of every given answer, with two options."""
    pairs = qa.turn_pairs(B.table(spark, d, "conversations"))
    asked = T.choice_prompt(qa.why(F.col("question"), F.col("gold")), F.array(F.col("gold"), F.lit("no")))
    return pairs.select("conv_id", "turn", asked.alias("prompt"))


@query("SELECT event_id, least(greatest(value - 20, -5.0), 30.0)::DOUBLE AS clamped FROM events")
def clamped_values(spark, d):
    return B.table(spark, d, "events").select("event_id", clamp(F.col("value") - 20, -5.0, 30.0).alias("clamped"))


# ----------------------------------------------------------------- frames and prompts


@query("""WITH source AS (SELECT conv_id, turn, text FROM conversations
  UNION ALL SELECT item_id, -1, 'Here is the text. ' || text || chr(10) || '- "Quoted."' || chr(10) || '2. An item' FROM benchmark
  UNION ALL SELECT item_id, -2, 'Let''s see it. ' || text || ' 3. An item:' FROM benchmark
  UNION ALL SELECT item_id, -3, '## It is cut' FROM benchmark),
line AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(replace(l, '**', ''), '^\\s*(#+\\s*|([-*•]|[0-9]+[.)])\\s+)', ''))), lambda l: l <> '') AS l FROM source),
word AS (SELECT conv_id, turn, string_split(array_to_string(l, ' '), ' ') AS w FROM line),
mark AS (SELECT *, list_max(list_filter(range(1, len(w) + 1), lambda i: regexp_matches(w[i], '^[0-9]+[.)]$'))) AS m FROM word),
head AS (SELECT *, array_to_string(w[m + 1 : ], ' ') AS h FROM mark),
whole AS (SELECT conv_id, turn, array_to_string(CASE WHEN m IS NOT NULL AND (h = '' OR (length(h) <= 41 AND right(h, 1) = ':' AND NOT regexp_matches(h, '[.!?]'))) THEN w[ : m - 1] ELSE w END, ' ') AS t FROM head),
part AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '' AND len(list_filter(['given the description', 'let''s', 'lets', 'here is', 'in summary', 'to summarize', 'overall, the image', 'overall the image'], lambda r: starts_with(lower(s), r))) = 0) AS p FROM whole),
done AS (SELECT *, CASE WHEN len(p) = 0 OR right(p[-1], 1) IN ('.', '!', '?', '"', '''') THEN p WHEN len(p) > 1 THEN p[:-2] ELSE [p[1] || '…'] END AS e FROM part)
SELECT conv_id, turn::INTEGER AS turn, array_to_string(e[1:3], ' ') AS said FROM done""")
def told_sentences(spark, d):
    """Turns, and texts with remarks about themselves, quotes and cut-off ends."""
    made = {
        -1: F.concat(F.lit("Here is the text. "), F.col("text"), F.lit('\n- "Quoted."\n2. An item')),
        -2: F.concat(F.lit("Let's see it. "), F.col("text"), F.lit(" 3. An item:")),
        -3: F.lit("## It is cut"),
    }
    rows = B.table(spark, d, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), "text")
    for turn, text in made.items():
        rows = rows.unionByName(B.table(spark, d, "benchmark").select(F.col("item_id").alias("conv_id"), F.lit(turn).alias("turn"), text.alias("text")))
    return rows.select("conv_id", "turn", T.complete_sentences(F.col("text")).alias("said"))


_TEMPLATES = {"IsA": "{s} is a kind of {e}", "PartOf": "{s} is part of {e}", "LocatedIn": "{s} lies in {e}"}


@query(f"""WITH {B.EDGES_SQL} SELECT rel, start, "end", CASE rel WHEN 'IsA' THEN replace(start, '_', ' ') || ' is a kind of ' || replace("end", '_', ' ') WHEN 'PartOf' THEN replace(start, '_', ' ') || ' is part of ' || replace("end", '_', ' ')
  WHEN 'LocatedIn' THEN replace(start, '_', ' ') || ' lies in ' || replace("end", '_', ' ') WHEN 'SoldIn' THEN start || ' sells in ' || "end" ELSE replace(start, '_', ' ') || ' ' || lower(rel) || ' ' || replace("end", '_', ' ') END AS sentence,
  start || ' --' || rel || '--> ' || "end" AS triple FROM edges""")
def fact_sentences(spark, d):
    edges = B.graph(spark, d).withColumn("surface", F.when(F.col("rel") == "SoldIn", F.concat(F.lit(" [["), "start", F.lit("]] sells in [["), "end", F.lit("]]"))).otherwise(""))
    one = [F.col(c) for c in ("start", "rel", "end")]
    return edges.select("rel", "start", "end", T.fact_to_sentence(*one, F.col("surface"), _TEMPLATES).alias("sentence"), T.fact_to_triple(*one).alias("triple"))


@query("""SELECT p_partkey, concat_ws(chr(10), 'Scene: ' || p_name, 'People counted: ' || p_size % 3, CASE WHEN p_size % 3 > 0 THEN 'People: ' || array_to_string(['man', 'girl'][1:p_size % 3], ', ') END,
  'Objects: ' || array_to_string(string_split(p_name, ' ')[1:8], ', '), CASE WHEN p_size % 2 = 0 THEN 'Setting: shop' END, 'Known facts:' || chr(10) || '- it is.', 'Question: why?') AS context FROM part""")
def scorer_contexts(spark, d):
    none = F.array().cast("array<string>")
    people = F.slice(F.array(F.lit("man"), F.lit("girl")), 1, (F.col("p_size") % 3).cast("int"))
    setting = F.when(F.col("p_size") % 2 == 0, " shop ").otherwise(" ")
    lines = T.context_lines(F.col("p_name"), F.col("p_size") % 3, people, none, none, F.split("p_name", " "), setting, F.array(F.lit("it is")), F.lit("why? "))
    return B.table(spark, d, "part").select("p_partkey", lines.alias("context"))


@query("SELECT 'region_' || r_regionkey AS label_id, CASE WHEN r_regionkey % 2 = 0 THEN 'Region ' || r_regionkey ELSE upper(r_name[1]) || lower(r_name[2:]) END AS title FROM region")
def label_titles(spark, d):
    rows = B.labels(spark, d).withColumn("description", F.concat(F.lit("a "), "description"))
    return rows.select("label_id", T.display_name(F.col("label_id"), F.col("description"), F.col("ord") % 2 == 0).alias("title"))


_FINAL = "regexp_replace(trim(text), '[.]+$', '')"


@query(f"""WITH c AS (SELECT conv_id, turn, text, turn % 3 AS n, {_FINAL} AS bare FROM conversations)
SELECT conv_id, turn, CASE WHEN n >= 2 THEN bare WHEN n = 1 THEN 'no relationship (single person)' ELSE 'no people' END AS relationship,
       CASE WHEN turn % 5 = 0 THEN 'interacting' ELSE lower(bare[1]) || bare[2:] END AS activity, text AS answer FROM c""")
def draft_texts(spark, d):
    rows = B.table(spark, d, "conversations")
    reply, n = F.col("text"), F.col("turn") % 3
    activity = frame.activity_phrase(F.when(F.col("turn") % 5 == 0, " .. ").otherwise(reply))
    answer = T.model_answer(F.concat(F.lit("Assistant: "), reply, F.lit("\n")))
    return rows.select("conv_id", "turn", frame.relationship(reply, n).alias("relationship"), activity.alias("activity"), answer.alias("answer"))


@query("""WITH n AS (SELECT n_nationkey AS item_id, n_nationkey % 3 AS n, lower(n_name) AS act FROM nation), c AS (
  SELECT *, CASE WHEN n >= 2 THEN 'The people in this image are ' || act || '. They are most likely friends, and their intention is trade.' ELSE 'The person in this image is involved in: ' || act || '. Their likely goal is trade.' END AS claim FROM n)
SELECT item_id, claim || CASE WHEN n > 0 THEN chr(10) || 'Relevant commonsense knowledge:' || chr(10) || CASE WHEN n = 1 THEN '- one fact.' ELSE '- one fact.' || chr(10) || '- two facts.' END ELSE '' END || chr(10) ||
       'In two or three sentences, explain which visible evidence in the image (people, gestures, facial expressions, objects and setting) supports this interpretation.' AS explanation,
       'Scene' || chr(10) || 'The people are ' || act || '.' || CASE WHEN n >= 2 THEN ' They are most likely friends.' ELSE '' END AS context,
       CASE WHEN n > 0 THEN act || chr(10) || chr(10) ELSE '' END || 'Question: why?' || chr(10) || 'Answer briefly and give the visual reason.' AS question FROM c""")
def reasoning_prompts(spark, d):
    n, act = F.col("n_nationkey") % 3, F.lower("n_name")
    facts = F.slice(F.array(F.lit("one fact"), F.lit("two facts")), 1, n.cast("int"))
    friends = F.when(n >= 2, "friends")
    return B.table(spark, d, "nation").select(
        F.col("n_nationkey").alias("item_id"),
        frame.explanation_prompt(frame.claim(n, act, F.lit("friends"), F.lit("trade")), facts).alias("explanation"),
        frame.conditioned(F.lit("Scene"), act, friends).alias("context"),
        frame.question_prompt(F.when(n > 0, act).otherwise(""), F.lit("why?")).alias("question"),
    )


@query(f"""WITH {B.EDGES_SQL}, told AS (
  SELECT start, rel, "end", CASE rel WHEN 'IsA' THEN '“' || replace(start, '_', ' ') || '” is closely associated with ' || replace("end", '_', ' ') || '.' WHEN 'LocatedIn' THEN '“' || replace(start, '_', ' ') || '” is an indicator of ' || replace("end", '_', ' ') || '.'
    WHEN 'SuppliedBy' THEN '“' || replace(start, '_', ' ') || '” and ' || replace("end", '_', ' ') || ' are linked through trade route, harbour.' WHEN 'RejectedIn' THEN '“' || replace(start, '_', ' ') || '” argues against ' || replace("end", '_', ' ') || '.'
    WHEN 'SoldIn' THEN 'Sold in ' || replace("end", '_', ' ') || '!' END AS sentence FROM edges)
SELECT start, string_agg(sentence, '|' ORDER BY rel, "end") AS told FROM told GROUP BY start""")
def told_evidence(spark, d):
    """What is known of every node, told from its signals: edges stand for signals by
    relation; PartOf ones reword, ReturnedTo ones name their own phrase."""
    rel, end = F.col("rel"), F.col("end")
    reason = F.when(rel == "IsA", "anchor").when(rel.isin("LocatedIn", "ReturnedTo"), "keyword").when(rel == "SuppliedBy", "neighbourhood").when(rel == "RejectedIn", "contrast").otherwise("edge")
    signal = F.struct(
        rel.alias("key"), end.alias("end"), reason.alias("reason"), F.col("start").alias("phrase"),
        F.when(rel == "ReturnedTo", F.concat(F.upper("start"), F.lit("s"))).otherwise(end).alias("label"),
        F.array(F.lit("trade_route"), F.lit("harbour")).alias("shared"), F.when(rel == "PartOf", "Synonym").otherwise(rel).alias("relation"), F.concat(F.lit("sold in "), end, F.lit("!")).alias("fact"),
    )
    grouped = B.graph(spark, d).groupBy("start").agg(F.array_sort(F.collect_list(signal)).alias("signals"))
    return grouped.select("start", F.nullif(F.array_join(frame.signal_sentences(F.col("signals")), "|"), F.lit("")).alias("told"))


_PERSONS = "(" + ", ".join(f"'{w}'" for w in DEFAULT.people) + ")"


@query(f"""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w, p_size FROM part), o AS (
  SELECT p_partkey, p_size, list_concat(['Man', 'cup', w[1], 'cup ', 'crowd'], w) AS o FROM w), e AS (SELECT p_partkey, p_size, unnest(o) AS x, generate_subscripts(o, 1) AS i FROM o), t AS (
  SELECT p_partkey, trim(x) AS x, i, row_number() OVER (PARTITION BY p_partkey, lower(trim(x)) ORDER BY i) AS r FROM e WHERE trim(x) <> ''), u AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS n FROM t WHERE r = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS m FROM u WHERE x NOT IN {_PERSONS}), l AS (SELECT p_partkey, string_agg(x, '|' ORDER BY i) FILTER (n <= 6) AS terms FROM u GROUP BY 1), q AS (SELECT p_partkey, string_agg(x, '|' ORDER BY i) FILTER (m <= 15) AS things FROM k GROUP BY 1),
c AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 70 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE 0 END AS given, CASE p_size % 5 WHEN 1 THEN 'three men' WHEN 2 THEN 'three cups' ELSE 'x' END AS caption, p_size % 3 AS people FROM part)
SELECT p_partkey, terms, things, terms AS shown, (CASE WHEN given = 70 THEN 50 WHEN given = 0 THEN least(people, 1) WHEN caption = 'three men' THEN 3 WHEN people > 1 THEN 2 ELSE people END)::INTEGER AS people
FROM l JOIN q USING (p_partkey) JOIN c USING (p_partkey)""")
def frame_parts(spark, d):
    """People, things and terms of a frame, with their guards."""
    words, size = F.split("p_name", " "), F.col("p_size")
    direct = F.array(F.lit("Man"), F.lit("cup"), F.get(words, F.lit(0)), F.lit("cup "), F.lit("crowd"))
    given = F.when(size % 5 == 0, 70).when(size % 5 == 4, 0)
    caption = F.when(size % 5 == 1, "three men").when(size % 5 == 2, "three cups").otherwise("x")
    people = F.slice(F.array(F.lit("man"), F.lit("boy")), 1, (size % 3).cast("int"))
    listed = frame.joined(direct, words, 6)
    return B.table(spark, d, "part").select(
        "p_partkey", F.array_join(listed, "|").alias("terms"), F.array_join(frame.things(F.concat(direct, words)), "|").alias("things"),
        F.array_join(frame.shown(F.slice(words, 1, 0), listed), "|").alias("shown"), frame.people_count(given, caption, people).cast("int").alias("people"),
    )


@query("SELECT n_nationkey AS item_id, CASE WHEN n_regionkey = 0 THEN '0,1,2' ELSE '0,1,' || (n_regionkey + 2) END AS objects FROM nation")
def objects_named(spark, d):
    token = lambda *at: F.struct(F.lit("").alias("text"), F.array(*at).cast("array<int>").alias("indices"))
    tokens = F.array(token(F.lit(1)), token(), token(F.lit(0), F.lit(1), F.col("n_regionkey") + 2))
    return B.table(spark, d, "nation").select(F.col("n_nationkey").alias("item_id"), F.array_join(F.transform(frame.referenced(tokens), lambda i: i.cast("string")), ",").alias("objects"))


@query("""WITH l AS (SELECT event_id, CAST(ts AS TIMESTAMP) + INTERVAL 9 HOUR AS l FROM events), s AS (SELECT *, date_trunc('day', l) + INTERVAL 570 MINUTE AS s FROM l), n AS (SELECT event_id, l, CASE WHEN s <= l THEN s + INTERVAL 1 DAY ELSE s END AS s FROM s)
SELECT event_id, strftime(s, '%Y-%m-%d %H:%M') AS stop, round(least(12.0, (epoch_us(s) - epoch_us(l)) / 3.6e9), 6) AS hours FROM n""")
def next_stops(spark, d):
    now = F.col("ts").cast("timestamp")
    return B.table(spark, d, "events").select("event_id", F.date_format(frame.next_stop(now, "09:30", "Asia/Tokyo"), "yyyy-MM-dd HH:mm").alias("stop"), F.round(frame.hours_left(now, "09:30", "Asia/Tokyo", 12.0), 6).alias("hours"))


@query(C.ORACLES["resolve_backoff"].replace("phrases AS (", "sized AS (SELECT p_size, phrase FROM (SELECT p_size, " + C._PHRASES.split("SELECT ", 1)[1].split(" AS phrase")[0] + f" AS phrase FROM (SELECT p_partkey, p_size, {B.spelt_sql('p_partkey')} AS key FROM part))), phrases AS (").rsplit("SELECT phrase, CASE", 1)[0] + """
SELECT p_size, count(*) FILTER (hit IN (SELECT name FROM known)) AS grounded FROM sized JOIN named USING (phrase) GROUP BY p_size""")
def grounded_terms(spark, d):
    """How many phrases of each size of part are in the graph."""
    k, key = F.col("p_partkey"), B.spelt(F.col("p_partkey"))
    phrase = F.when(k % 4 == 0, F.concat(F.lit("the part "), key)).when(k % 4 == 1, F.concat(F.lit("an old part "), key)).when(k % 4 == 2, F.concat(F.lit("part "), key, F.lit(" missing"))).otherwise("The ")
    phrases = cut(B.table(spark, d, "part").select("p_size", phrase.alias("phrase")))
    known = graph.resolve(phrases.select("phrase"), B.graph(spark, d))
    return phrases.join(known, "phrase").groupBy("p_size").agg(F.count_if("found").alias("grounded"))


# -------------------------------------------------------------------------- streams


@query(C.ORACLES["sampled_frames"].replace("SELECT clip_id, k::INTEGER AS k FROM walk WHERE take", "SELECT clip_id, k::INTEGER AS k FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY k) AS n FROM walk WHERE take) WHERE n <= 20"))
def sampled_stream(spark, d):
    """The sampler on a stream of frames, the first twenty of each clip."""
    path = shared_dir(spark, "frames")
    frames = B.samples(spark, d).select("clip_id", "k", "time_s", "value", "blurry")
    frames.write.parquet(path)
    stream = spark.readStream.schema(frames.schema).parquet(path)
    return C._run(spark, sampler.sampled_stream(stream, most=20, idle=None), "sampled_stream", "append").select("clip_id", "k")


def _analysed(value: float) -> float:
    if value < 5:
        raise ValueError("too small")
    return value * 2


@query("SELECT event_id, value >= 5 AS ok, CASE WHEN value < 5 THEN 'ValueError: too small' END AS error, CASE WHEN value >= 5 THEN value * 2 END AS value FROM events")
def failures_apart(spark, d):
    """Items whose analysis fails stay with their error beside those that succeed."""
    rows = B.table(spark, d, "events").select("event_id", sampler.guarded(_analysed)("value").alias("r"))
    return rows.select("event_id", "r.ok", "r.error", "r.value")


@query("SELECT user_id AS source, max(ts) AS ts FROM events GROUP BY user_id")
def latest_frames(spark, d):
    return sampler.latest_frames(B.table(spark, d, "events").select(F.col("user_id").alias("source"), "ts", "event_id")).select("source", "ts")


@query("""WITH f AS (SELECT p_partkey, unnest(range(0, p_size)) AS frame_index, p_size / 2.0 AS fps, CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE p_partkey * 10.0 END AS duration FROM part)
SELECT p_partkey, count(*) AS n FROM f WHERE frame_index % greatest(1, round_even(fps / CASE WHEN duration > 0 THEN least(4.0, 900 / duration) ELSE 4.0 END, 0)::INTEGER) = 0 GROUP BY p_partkey""")
def scanned_frames(spark, d):
    few = B.table(spark, d, "part").where("p_size > 0")
    frames = few.select("p_partkey", F.explode(F.sequence(F.lit(0), F.col("p_size") - 1)).alias("frame_index"), (F.col("p_size") / 2).alias("fps"), F.when(F.col("p_partkey") % 5 == 0, 0.0).otherwise(F.col("p_partkey") * 10.0).alias("duration"))
    return moments.scan(frames).groupBy("p_partkey").agg(F.count("*").alias("n"))


# --------------------------------------------------------------- whole analyses of items


def _items(spark, d):
    """Orders as items: their parts are objects, the first line's supplier is the setting."""
    part, supplier = F.concat(F.lit("part "), B.spelt(F.col("l_partkey"))), F.concat(F.lit("supp "), B.spelt(F.min(F.when(F.col("l_linenumber") == 1, F.col("l_suppkey")))))
    orders = B.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(part)).alias("objects"), supplier.alias("setting"))
    none, text = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    draft = F.struct(*[text.alias(t) for t in pipeline.TASKS])
    return orders.select(
        F.col("l_orderkey").cast("string").alias("item_id"), F.lit("").alias("caption"), (F.col("l_orderkey") % 3).cast("int").alias("people_count"),
        none.alias("people"), "objects", none.alias("actions"), none.alias("gestures"), "setting", draft.alias("draft"), text.alias("question"),
    )


def _space(spark, d):
    return B.labels(spark, d).withColumn("task", F.explode(F.array(*map(F.lit, pipeline.TASKS))))


def _enriched(spark, d, items):
    weights = spark.createDataFrame([(t, k, w) for t in pipeline.TASKS for k, w in (("object", 0.6), ("setting", 0.3))], "task string, kind string, weight double")
    return pipeline.enrich(items, B.graph(spark, d), cut(_space(spark, d)), B.RELATIONS, weights)


_ITEM_TERMS = f"""item AS (SELECT l_orderkey AS item_id, {B.spelt_sql("min(l_suppkey) FILTER (l_linenumber = 1)")} AS code FROM lineitem GROUP BY l_orderkey), told AS (
  SELECT l_orderkey AS item_id, 'part ' || {B.spelt_sql("l_partkey")} AS phrase, 'object' AS kind, 0.7::DOUBLE AS salience FROM lineitem
  UNION ALL SELECT item_id, 'supp ' || code, 'setting', 0.6 FROM item WHERE code IS NOT NULL UNION ALL SELECT item_id, 'supp', 'setting', 0.6 FROM item WHERE code IS NOT NULL
  UNION ALL SELECT item_id, code, 'setting', 0.6 FROM item WHERE length(code) >= 3
), term AS (SELECT item_id, phrase, max(salience) AS salience, list(DISTINCT kind) AS kinds FROM told GROUP BY item_id, phrase
), top_term AS (SELECT * FROM term QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY salience DESC, length(phrase) DESC) <= 20)"""


# An anchor without edges is still its own neighbour.
_BARE = "FROM anchor JOIN (SELECT term, other, strength FROM profile UNION ALL SELECT DISTINCT concept, concept, 1.0 FROM anchor WHERE concept NOT IN (SELECT term FROM near)) ON concept = term"


@query("WITH " + B.SUPPORT_SQL.replace(B.TERMS_SQL, _ITEM_TERMS).replace("FROM anchor JOIN profile ON concept = term", _BARE) + """
SELECT item_id::VARCHAR AS item_id, task, label_id, round(raw / greatest(max(raw) OVER (PARTITION BY item_id), 0.3), 4) AS support FROM raw_support, (SELECT unnest(['activity', 'relationship', 'intention']) AS task)""")
def enrich_support(spark, d):
    """The whole enrichment of items: mentions, terms, resolution, profiles, support."""
    return _enriched(spark, d, _items(spark, d)).support.select("item_id", "task", "label_id", "support")


_LEXICAL_ITEMS = f"""word_of AS (SELECT DISTINCT item_id, unnest(string_split(phrase, ' ')) AS word FROM (
  SELECT l_orderkey AS item_id, 'part ' || {B.spelt_sql("l_partkey")} AS phrase FROM lineitem UNION ALL SELECT item_id, 'supp ' || code FROM item WHERE code IS NOT NULL)
), token AS (SELECT * FROM word_of WHERE length(word) > 1), token_n AS (SELECT item_id, count(*) AS n FROM token GROUP BY item_id
), lexical AS (SELECT item_id, label_id, least(1.0, sum(1.0 / df) / least(any_value(n), 3)) AS lexical FROM token JOIN token_n USING (item_id) JOIN lexicon USING (word) GROUP BY item_id, label_id)"""


@query("WITH " + C._LEXICON + ", " + B.SUPPORT_SQL.replace(B.TERMS_SQL, _ITEM_TERMS).replace("FROM anchor JOIN profile ON concept = term", _BARE) + f""", {_LEXICAL_ITEMS}
, said AS (SELECT item_id, label_id, ord, round(raw / greatest(max(raw) OVER (PARTITION BY item_id), 0.3), 4) AS support FROM raw_support
), every AS (SELECT i.item_id, 'region_' || r_regionkey AS label_id, r_regionkey AS ord, lower(r_name) AS option, coalesce(support, 0.0) AS support, coalesce(lexical, 0.0) AS lexical
  FROM item i CROSS JOIN region LEFT JOIN said s ON s.item_id = i.item_id AND s.label_id = 'region_' || r_regionkey LEFT JOIN lexical x ON x.item_id = i.item_id AND x.label_id = 'region_' || r_regionkey
), placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY support + 0.3 * lexical DESC, ord) AS place, count(*) FILTER (support + 0.3 * lexical > 0.05) OVER (PARTITION BY item_id) >= 3 AS informative FROM every
), liked AS (SELECT *, CASE WHEN informative THEN place ELSE ord + 1 END AS slot, CASE WHEN contains(option, 'asia') THEN 2.0 ELSE 0.0 END AS v FROM placed
), scored AS (SELECT *, exp(v) / sum(exp(v)) OVER (PARTITION BY item_id) AS p_scorer, CASE WHEN max(support) OVER (PARTITION BY item_id) < 0.001 THEN 1.0 / count(*) OVER (PARTITION BY item_id)
  ELSE exp(support / 0.2) / sum(exp(support / 0.2)) OVER (PARTITION BY item_id) END AS p_support FROM liked
), fused AS (SELECT *, ln(p_scorer + 1e-9) + 0.5 * ln(p_support + 1e-9) AS logit FROM scored
), prob AS (SELECT *, exp(logit) / sum(exp(logit)) OVER (PARTITION BY item_id) AS probability FROM fused
), ranks AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(probability, 9) DESC, slot) AS rank, lead(probability, 1, 0.0) OVER (PARTITION BY item_id ORDER BY round(probability, 9) DESC, slot) AS next FROM prob
), task AS (SELECT unnest(['activity', 'relationship', 'intention']) AS task)
SELECT item_id::VARCHAR AS item_id, task, label_id, rank::INTEGER AS rank, round(probability, 6) AS probability, CASE WHEN rank = 1 THEN probability - next < 0.15 END AS ambiguous
FROM ranks, task WHERE item_id % 3 = 2 OR (item_id % 3 = 1 AND task <> 'relationship')
UNION ALL SELECT item_id::VARCHAR, task, CASE task WHEN 'activity' THEN 'no_interaction' WHEN 'relationship' THEN 'none_single' ELSE 'none' END, 1, CASE item_id % 3 WHEN 1 THEN 1.0 ELSE 0.0 END, item_id % 3 = 0
FROM item, task WHERE item_id % 3 = 0 OR (item_id % 3 = 1 AND task = 'relationship')""")
def reason_predictions(spark, d):
    """Ranked predictions of all items with a scorer that prefers one label; items of one
    person or none have fixed labels."""
    items = cut(_items(spark, d))
    space = cut(_space(spark, d))
    questions = {t: f"Which {t}?" for t in pipeline.TASKS}
    found = pipeline.reason(items, _enriched(spark, d, items), space, fusion.prefer("asia"), questions)
    return found.select("item_id", "task", "label_id", "rank", F.round("probability", 6).alias("probability"), "ambiguous")


@query(C._SUPPORT + """, given AS (SELECT item_id, label_id, ord, round(support, 5) AS support, ((item_id * 7 + ord * 3) % 11) / 20.0 AS draft, CASE WHEN (item_id + ord) % 4 = 0 THEN 0.5 ELSE 0.0 END AS lexical,
  item_id % 5 = 0 AS alone, item_id % 2 = 0 AND ord = item_id % 5 AS named, item_id % 13 = 0 AS silent FROM support
), told AS (SELECT item_id, label_id, ord, CASE WHEN silent THEN 0.0 ELSE support END AS support, CASE WHEN silent THEN 0.0 ELSE draft END AS draft, CASE WHEN silent THEN 0.0 ELSE lexical END AS lexical, alone, named FROM given
), placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY support + 1.5 * draft + 0.3 * lexical DESC, ord) AS place, count(*) FILTER (support + 1.5 * draft + 0.3 * lexical > 0.05) OVER (PARTITION BY item_id) >= 3 AS informative FROM told
), forced AS (SELECT *, bool_or(named AND place > 2) OVER (PARTITION BY item_id) AS pushed FROM placed
), second AS (SELECT *, CASE WHEN named AND place > 2 THEN 2 WHEN place = 1 OR (place = 2 AND NOT pushed) THEN place END AS slot FROM forced
), third AS (SELECT *, label_id = 'region_3' AND alone AND slot IS NULL AS late FROM second
), last AS (SELECT *, bool_or(late) OVER (PARTITION BY item_id) AS late_any FROM third
), slots AS (SELECT *, CASE WHEN late THEN 2 WHEN NOT (late_any AND slot = 2) THEN slot END AS final FROM last
), kept AS (SELECT *, CASE WHEN informative THEN final ELSE ord + 1 END AS s FROM slots WHERE NOT informative OR final IS NOT NULL
), scored AS (SELECT *, exp(-abs(ord - item_id % 5)) / sum(exp(-abs(ord - item_id % 5))) OVER (PARTITION BY item_id) AS p_scorer,
  CASE WHEN max(support) OVER (PARTITION BY item_id) < 0.001 THEN 1.0 / count(*) OVER (PARTITION BY item_id) ELSE exp(support / 0.2) / sum(exp(support / 0.2)) OVER (PARTITION BY item_id) END AS p_support FROM kept
), fused AS (SELECT *, ln(p_scorer + 1e-9) + 0.5 * ln(p_support + 1e-9) + draft AS logit FROM scored)
SELECT item_id, label_id, s::BIGINT AS slot, round(exp(logit) / sum(exp(logit)) OVER (PARTITION BY item_id), 5) AS probability FROM fused""")
def forced_shortlist(spark, d):
    """Predictions from shortlists of two in which drafts, texts, a required label and the
    fall-back of lone items all have a say; items that say nothing see every label."""
    n, o = F.col("item_id"), F.col("ord")
    silent = n % 13 == 0
    said = lambda c: F.when(silent, 0.0).otherwise(c)
    rows = C._support(spark, d).withColumns({
        "support": said(F.round("support", 5)), "draft": said((n * 7 + o * 3) % 11 / 20), "lexical": said(F.when((n + o) % 4 == 0, 0.5).otherwise(0.0)), "alone": n % 5 == 0,
    })
    rows = cut(rows)
    required = rows.where((n % 2 == 0) & (o == n % 5)).select("item_id", "task", "label_id")
    chosen = fusion.shortlist(rows, 2, required, "region_3")
    p = C.softmax(-F.abs(o - F.pmod("item_id", F.lit(5))).cast("double"), Window.partitionBy("item_id", "task"))
    fused = fusion.fuse(chosen.withColumn("p_scorer", p))
    return fused.select("item_id", "label_id", F.col("slot").cast("long").alias("slot"), F.round("probability", 5).alias("probability"))


@query("WITH found AS (" + C.ORACLES["resolve_backoff"] + """)
SELECT phrase, concept, round(0.7::DOUBLE * CASE WHEN backed_off THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END, 6) AS salience FROM found WHERE length(phrase) > 4""")
def halved_salience(spark, d):
    """The salience of objects: half where a phrase had to back off to a shorter concept."""
    k, key = F.col("p_partkey"), B.spelt(F.col("p_partkey"))
    phrase = F.when(k % 4 == 0, F.concat(F.lit("the part "), key)).when(k % 4 == 1, F.concat(F.lit("an old part "), key)).when(k % 4 == 2, F.concat(F.lit("part "), key, F.lit(" missing")))
    terms = cut(B.table(spark, d, "part").select(phrase.alias("phrase"), F.lit(0.7).alias("salience")).where("phrase is not null"))
    known = evidence.grounded(terms, graph.resolve(terms.select("phrase"), B.graph(spark, d)))
    return known.select("phrase", "concept", F.round("salience", 6).alias("salience"))
