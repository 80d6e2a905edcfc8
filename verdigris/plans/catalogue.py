"""Queries of the evidence engine over whole tables, with the DuckDB SQL of each one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.functions import text as T
from verdigris.functions.vectors import bhattacharyya, fitted_size, softmax
from verdigris.functions.vocabulary import DEFAULT
from verdigris.operators import evidence, fusion, graph, labels, metrics, moments, qa
from verdigris.plans import bindings as B
from verdigris.storage import cut, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


# ---------------------------------------------------------------------------- graph


@query(f"WITH {B.EDGES_SQL} SELECT rel, start, \"end\", weight, surface FROM edges")
def edges_dedup(spark, d):
    return B.graph(spark, d)


@query(f"WITH {B.EDGES_SQL} SELECT rel, count(*) AS edges, count(*) FILTER (weight >= 1.0) AS strong FROM edges GROUP BY rel")
def edges_counts_by_rel(spark, d):
    return B.graph(spark, d).groupBy("rel").agg(F.count("*").alias("edges"), F.count_if(F.col("weight") >= 1.0).alias("strong"))


@query(f'WITH {B.NEAR_SQL} SELECT term, other, rel, weight, edge_rank::INTEGER AS edge_rank FROM near WHERE edge_rank <= 10')
def neighbors_topk_per_term(spark, d):
    return graph.neighbours(B.graph(spark, d), limit=10).select("term", "other", "rel", "weight", "edge_rank")


@query(f"WITH {B.NEAR_SQL} SELECT term, count(*) AS n, round(sum(weight), 6) AS weight, max(edge_rank)::INTEGER AS last FROM near GROUP BY term")
def neighbors_both_dirs(spark, d):
    near = graph.neighbours(B.graph(spark, d))
    return near.groupBy("term").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"), F.max("edge_rank").alias("last"))


_PHRASES = f"SELECT CASE p_partkey % 4 WHEN 0 THEN 'the part ' || key WHEN 1 THEN 'an old part ' || key WHEN 2 THEN 'part ' || key || ' missing' ELSE 'The ' END AS phrase FROM (SELECT p_partkey, {B.spelt_sql('p_partkey')} AS key FROM part)"


@query(f"""WITH {B.EDGES_SQL}, known AS (SELECT DISTINCT start AS name FROM edges UNION SELECT "end" FROM edges),
phrases AS (SELECT DISTINCT phrase FROM ({_PHRASES})), shaped AS (
  SELECT phrase, regexp_extract(phrase, '(part [b-m]+)', 1) AS core, phrase LIKE 'the part%' AS plain, phrase LIKE 'an old%' AS old, phrase LIKE '%missing' AS missing FROM phrases
), named AS (
  SELECT *, CASE WHEN plain OR old THEN replace(core, ' ', '_') END AS hit,
         CASE WHEN plain THEN replace(core, ' ', '_') WHEN old THEN 'old_' || replace(core, ' ', '_') WHEN missing THEN replace(core, ' ', '_') || '_missing' END AS first
  FROM shaped
)
SELECT phrase, CASE WHEN hit IN (SELECT name FROM known) THEN hit ELSE first END AS concept, coalesce(hit IN (SELECT name FROM known), false) AS found,
       coalesce(old AND hit IN (SELECT name FROM known), false) AS backed_off
FROM named""")
def resolve_backoff(spark, d):
    """Phrases such as "an old part k" back off to the node part_k."""
    key = B.spelt(F.col("p_partkey"))
    phrase = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("the part "), key))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("an old part "), key))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("part "), key, F.lit(" missing")))
        .otherwise("The ")
    )
    return graph.resolve(B.table(spark, d, "part").select(phrase.alias("phrase")), B.graph(spark, d))


def _near(spark, d):
    return graph.neighbours(B.graph(spark, d))


@query(f"WITH {B.PROFILE_SQL} SELECT term, other, round(strength, 6) AS strength FROM profile")
def profile_strength(spark, d):
    return graph.profile(_near(spark, d), B.RELATIONS).select("term", "other", F.round("strength", 6).alias("strength"))


@query(f"WITH {B.NEAR_SQL} SELECT DISTINCT term, other FROM near WHERE rel = 'RejectedIn'")
def negative_links(spark, d):
    return graph.negatives(_near(spark, d), B.RELATIONS)


def _label_profiles(spark, d):
    profiles = cut(graph.profile(_near(spark, d), B.RELATIONS))
    return profiles, graph.label_profiles(labels.anchors(B.labels(spark, d)), profiles)


@query(f"WITH {B.LABEL_SQL} SELECT label_id, count(*) AS n, round(any_value(norm), 6) AS norm FROM merged JOIN norms USING (label_id) GROUP BY label_id")
def label_profile_norm(spark, d):
    return _label_profiles(spark, d)[1].groupBy("label_id").agg(F.count("*").alias("n"), F.round(F.first("norm"), 6).alias("norm"))


# All edges of a term count, not only its heaviest.
_ALL_COSINE_SQL = B.COSINE_SQL.replace("edge_rank <= 400 AND ", "")


@query(f"WITH {_ALL_COSINE_SQL} SELECT term, label_id, round(cosine, 6) AS cosine FROM cosines")
def two_hop_cosine(spark, d):
    profiles = cut(graph.strengths(B.graph(spark, d), B.RELATIONS))
    return graph.two_hop(profiles, graph.label_profiles(labels.anchors(B.labels(spark, d)), profiles).hint("merge")).select("term", "label_id", F.round("cosine", 6).alias("cosine"))


# ------------------------------------------------------------------------- evidence


@query(f"WITH {B.TERMS_SQL} SELECT item_id, phrase, round(salience, 6) AS salience, array_to_string(kinds, ',') AS kinds, rank::INTEGER AS rank FROM top_term")
def key_terms_ranked(spark, d):
    terms = evidence.key_terms(B.mentions(spark, d))
    return terms.select("item_id", "phrase", F.round("salience", 6).alias("salience"), F.array_join("kinds", ",").alias("kinds"), "rank")


def _support(spark, d):
    space = cut(B.labels(spark, d))
    anchored = labels.anchors(space)
    terms = cut(evidence.key_terms(B.mentions(spark, d)).select("item_id", "phrase", "salience", "kinds")).withColumn("concept", F.translate("phrase", " ", "_"))
    # Only what items or labels name is looked up, each concept once.
    wanted = terms.select(F.col("concept").alias("term")).unionByName(anchored.select(F.col("concept").alias("term"))).distinct()
    links = cut(graph.links(graph.neighbours(B.graph(spark, d), wanted), B.RELATIONS))
    profiles, negative = links.where("strength IS NOT NULL"), links.where("negative")
    merged = cut(graph.label_profiles(anchored, profiles))
    words = evidence.keyword_hits(terms.select(F.col("concept").alias("term"), "phrase").distinct(), labels.lexicon(space))
    scores = cut(evidence.signals(profiles, anchored, graph.two_hop(profiles, merged), words, negative, B.RELATIONS))
    weights = spark.createDataFrame(B.KIND_WEIGHTS, "task string, kind string, weight double")
    return evidence.label_support(terms, scores, space, weights)


_SUPPORT = f"""WITH {B.SUPPORT_SQL}, support AS (
  SELECT item_id, label_id, ord, raw / greatest(max(raw) OVER (PARTITION BY item_id), 0.3) AS support FROM raw_support
)"""


@query(_SUPPORT + " SELECT item_id, label_id, round(support, 5) AS support FROM support")
def label_support(spark, d):
    return _support(spark, d).select("item_id", "label_id", F.round("support", 5).alias("support"))


@query(_SUPPORT + ", top_label AS (SELECT item_id, arg_max(label_id, (round(support, 5), -ord)) AS label_id, max(support) AS top FROM support GROUP BY item_id) SELECT item_id, CASE WHEN top > 0 THEN label_id END AS label_id FROM top_label")
def disambiguate(spark, d):
    support = _support(spark, d).withColumn("support", F.round("support", 5))
    none = support.select("item_id", "task", "label_id", F.lit(0.0).alias("draft")).limit(0)
    return evidence.disambiguate(support, none).select("item_id", "label_id")


def _predictions(spark, d):
    rows = _support(spark, d).withColumns({"support": F.round("support", 5), "draft": F.lit(0.0), "lexical": F.lit(0.0), "alone": F.lit(False)})
    chosen = fusion.shortlist(rows, size=3)
    p = softmax(-F.abs(F.col("ord") - F.pmod("item_id", F.lit(5))).cast("double"), Window.partitionBy("item_id", "task"))
    return fusion.rank(fusion.fuse(chosen.withColumn("p_scorer", p)))


_RANKED = _SUPPORT + """, r5 AS (SELECT item_id, label_id, ord, round(support, 5) AS support FROM support), pri AS (
  SELECT *, count(*) FILTER (support > 0.05) OVER (PARTITION BY item_id) >= 3 AS informative,
         row_number() OVER (PARTITION BY item_id ORDER BY support DESC, ord) AS place FROM r5
), short AS (
  SELECT *, CASE WHEN informative THEN place ELSE ord + 1 END AS slot FROM pri WHERE NOT informative OR place <= 3
), scored AS (
  SELECT *, exp(-abs(ord - item_id % 5)) / sum(exp(-abs(ord - item_id % 5))) OVER (PARTITION BY item_id) AS p_scorer,
         CASE WHEN max(support) OVER (PARTITION BY item_id) < 0.001 THEN 1.0 / count(*) OVER (PARTITION BY item_id)
              ELSE exp(support / 0.2) / sum(exp(support / 0.2)) OVER (PARTITION BY item_id) END AS p_support FROM short
), fused AS (
  SELECT *, ln(p_scorer + 1e-9) + 0.5 * ln(p_support + 1e-9) AS logit FROM scored
), prob AS (
  SELECT *, exp(logit) / sum(exp(logit)) OVER (PARTITION BY item_id) AS probability FROM fused
), ranked_p AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(probability, 9) DESC, slot) AS rank FROM prob
)"""


@query(_RANKED + " SELECT item_id, label_id, slot::BIGINT AS slot FROM short")
def shortlist(spark, d):
    rows = _support(spark, d).withColumns({"support": F.round("support", 5), "draft": F.lit(0.0), "lexical": F.lit(0.0)})
    return fusion.shortlist(rows, size=3).select("item_id", "label_id", "slot")


@query(_RANKED + " SELECT item_id, label_id, round(p_support, 5) AS p_support, round(probability, 5) AS probability FROM prob")
def softmax_fusion(spark, d):
    return _predictions(spark, d).select("item_id", "label_id", F.round("p_support", 5).alias("p_support"), F.round("probability", 5).alias("probability"))


@query(_RANKED + " SELECT item_id, round(max(probability) FILTER (rank = 1) - coalesce(max(probability) FILTER (rank = 2), 0), 4) AS margin FROM ranked_p GROUP BY item_id")
def ambiguity_margin(spark, d):
    return _predictions(spark, d).where("rank = 1").select("item_id", F.round("margin", 4).alias("margin"))


@query(_RANKED + " SELECT item_id, rank::INTEGER AS rank, label_id FROM ranked_p")
def ranked_alternatives(spark, d):
    return _predictions(spark, d).select("item_id", "rank", "label_id")


@query()
def result_json(spark, d):
    """Nested results of all items as JSON lines."""
    from verdigris.sinks import result_json as as_json

    one = F.struct("rank", "label_id", "probability", "p_support", "support")
    nested = _predictions(spark, d).groupBy("item_id").agg(F.array_sort(F.collect_list(one)).alias("alternatives"), F.max("margin").alias("margin"))
    return as_json(nested)


@query(f"""WITH {B.NEAR_SQL}, relation(rel, rel_weight) AS (VALUES {B._WEIGHTS_SQL}), {B.TERMS_SQL}, best AS (
  SELECT term, other, rel, start, "end", weight, rel_weight FROM near JOIN relation USING (rel) WHERE weight >= 1.0 AND other <> 'nation_b' AND term <> other
  QUALIFY row_number() OVER (PARTITION BY term, other ORDER BY rel_weight * (1 - exp(-weight)) DESC, edge_rank) = 1
), own AS (
  SELECT item_id, rank, replace(phrase, ' ', '_') AS term, salience FROM top_term
), anchor AS (SELECT 'nation_' || {B.spelt_sql("n_nationkey")} AS concept FROM nation UNION ALL SELECT replace(lower(r_name), ' ', '_') FROM region
), scored AS (
  SELECT o.item_id, o.rank, rel, start, "end", weight, round(rel_weight * (1 - exp(-weight)) * CASE WHEN a.concept IS NOT NULL THEN 2.0 WHEN s.term IS NOT NULL THEN 1.5 ELSE 0.5 END * o.salience, 4) AS relevance
  FROM own o JOIN best b ON b.term = o.term LEFT JOIN anchor a ON a.concept = b.other LEFT JOIN own s ON s.item_id = o.item_id AND s.term = b.other
  WHERE regexp_full_match(b.other, '[a-z]+(_[a-z]+){{0,2}}')
), few AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, rank ORDER BY relevance DESC, weight DESC, rel, start, "end") AS n FROM scored
), once AS (
  SELECT * FROM few WHERE n <= 6 QUALIFY row_number() OVER (PARTITION BY item_id, rel, start, "end" ORDER BY rank, n) = 1
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY relevance DESC, rank, n) AS place FROM once
) SELECT item_id, place::INTEGER AS place, rel, start, "end", relevance FROM placed WHERE place <= 40""")
def facts_topk(spark, d):
    """The most relevant graph facts of every order."""
    terms = cut(evidence.key_terms(B.mentions(spark, d)).select("item_id", "phrase", "salience", "rank")).withColumns({"concept": F.translate("phrase", " ", "_"), "backed_off": F.lit(False)})
    wanted = terms.select(F.col("concept").alias("term")).distinct()
    profiles = cut(graph.profile(graph.neighbours(B.graph(spark, d), wanted), B.RELATIONS))
    words = labels.anchor_vocabulary(B.labels(spark, d))
    return evidence.facts(terms, profiles, words, B.RELATIONS)


# ----------------------------------------------------------------------------- text

_STOP = "(" + ", ".join(f"'{w}'" for w in DEFAULT.stop) + ")"
_NON_CONTENT = "(" + ", ".join(f"'{w}'" for w in DEFAULT.non_content) + ")"
_PEOPLE = "(" + ", ".join(f"'{w}'" for w in DEFAULT.people) + ")"
_LIGHT = "(" + ", ".join(f"'{w}'" for w in DEFAULT.light_verbs) + ")"
_SPATIAL = f"""'\\b([a-z]+)\\s+({"|".join(sorted(DEFAULT.prepositions, key=lambda x: -len(x)))})\\s+(?:(?:{"|".join(DEFAULT.determiners)}) )?([a-z]+)'"""
_WORDS = f"""words0 AS (
  SELECT *, list_filter(string_split(regexp_replace(regexp_replace(lower(text), '^[\\s\\-*•\\d.)]+', ''), '[^a-z0-9'']+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM source
), words1 AS (
  SELECT *, list_filter(range(1, len(w) + 1), lambda i: w[i] NOT IN {_STOP}) AS kept FROM words0
), words AS (
  SELECT * EXCLUDE (w, kept), CASE WHEN len(kept) = 0 THEN [] ELSE w[kept[1]:kept[-1]] END AS w FROM words1
)"""
_LEMMA = (
    "CASE " + " ".join(f"WHEN x = '{a}' THEN '{b}'" for a, b in DEFAULT.irregular) + """
 WHEN length(x) > 4 AND x LIKE '%ies' THEN x[:-4] || 'y'
 WHEN length(x) > 5 AND x LIKE '%ing' THEN CASE WHEN length(x) > 5 AND x[-4:-4] = x[-5:-5] AND x[-4:-4] NOT IN ('l', 's', 'z') THEN x[:-5] ELSE x[:-4] END
 WHEN length(x) > 4 AND x LIKE '%ied' THEN x[:-4] || 'y'
 WHEN length(x) > 4 AND x LIKE '%ed' AND x NOT LIKE '%eed' THEN x[:-3]
 WHEN length(x) > 3 AND x LIKE '%s' AND NOT regexp_matches(x, '(ss|us|is)$') THEN x[:-2] ELSE x END"""
)


def _documents(spark, d):
    return B.table(spark, d, "documents").select("doc_id", "text")


@query(f"WITH source AS (SELECT doc_id, text FROM documents), {_WORDS} SELECT doc_id, array_to_string(w, ' ') AS phrase FROM words")
def clean_phrase(spark, d):
    return _documents(spark, d).select("doc_id", T.clean_phrase(F.col("text")).alias("phrase"))


@query(f"WITH source AS (SELECT item_id, text FROM benchmark), {_WORDS} SELECT item_id, array_to_string(w, '_') AS concept FROM words")
def to_concept(spark, d):
    return B.table(spark, d, "benchmark").select("item_id", T.to_concept(F.col("text")).alias("concept"))


@query(f"""WITH raw AS (
  SELECT conv_id, turn, unnest(regexp_split_to_array(regexp_replace(replace(text, chr(10), ','), '\\s+and\\s+', ',', 'gi'), '[,;/]')) AS text, generate_subscripts(regexp_split_to_array(regexp_replace(replace(text, chr(10), ','), '\\s+and\\s+', ',', 'gi'), '[,;/]'), 1) AS pos FROM conversations
), source AS (SELECT * FROM raw), {_WORDS}, item AS (
  SELECT conv_id, turn, pos, regexp_replace(array_to_string(w, ' '), '^(\\d+|{"|".join(DEFAULT.leading_counts)})\\s+', '') AS item FROM words
), kept AS (
  SELECT conv_id, turn, item, min(pos) AS pos FROM item WHERE item <> '' AND len(string_split(item, ' ')) <= 5 AND item NOT IN ({", ".join(f"'{w}'" for w in DEFAULT.non_content)}) GROUP BY conv_id, turn, item
)
SELECT c.conv_id, c.turn, coalesce(string_agg(item, '|' ORDER BY pos), '') AS items FROM conversations c LEFT JOIN kept k ON c.conv_id = k.conv_id AND c.turn = k.turn GROUP BY c.conv_id, c.turn""")
def split_list(spark, d):
    return B.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.split_list(F.col("text")), "|").alias("items"))


@query(f"""WITH hit AS (SELECT doc_id, regexp_extract(text, '\\b(\\d{{1,3}})\\b', 1) AS digits, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: w IN ({", ".join(f"'{w}'" for w, _ in DEFAULT.counts)})) AS words FROM documents)
SELECT doc_id, CASE WHEN digits <> '' THEN CAST(digits AS INTEGER) ELSE CASE words[1] {" ".join(f"WHEN '{w}' THEN {n}" for w, n in DEFAULT.counts)} END END AS n FROM hit""")
def parse_count(spark, d):
    return _documents(spark, d).select("doc_id", T.parse_count(F.col("text")).alias("n"))


@query(f"WITH word AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS x FROM documents) SELECT x AS word, {_LEMMA} AS lemma FROM word")
def rule_lemma(spark, d):
    words = _documents(spark, d).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", T.lemma(F.col("word")).alias("lemma"))


@query(f"""WITH source AS (SELECT doc_id, text FROM documents), {_WORDS}, lemma AS (SELECT doc_id, unnest(list_transform(w, lambda x: {_LEMMA})) AS word FROM words),
tokens AS (SELECT DISTINCT doc_id, word FROM lemma WHERE word NOT IN {_STOP} AND length(word) > 1)
SELECT d.doc_id, count(word) AS n, coalesce(max(word), '') AS last FROM documents d LEFT JOIN tokens USING (doc_id) GROUP BY d.doc_id""")
def token_set(spark, d):
    tokens = _documents(spark, d).select("doc_id", T.token_set(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").cast("long").alias("n"), F.coalesce(F.array_max("t"), F.lit("")).alias("last"))


@query(f"""WITH word AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS x FROM documents), kept AS (
  SELECT DISTINCT doc_id, x FROM word WHERE x NOT IN {_STOP} AND x NOT IN {_NON_CONTENT}
), based AS (SELECT doc_id, x, {_LEMMA} AS base FROM kept), classed AS (
  SELECT doc_id, base, CASE WHEN x IN {_PEOPLE} OR base IN {_PEOPLE} THEN 'people' WHEN x LIKE '%ing' THEN CASE WHEN base NOT IN {_LIGHT} THEN 'verbs' END WHEN length(x) > 2 THEN 'nouns' END AS kind FROM based
)
SELECT d.doc_id, (count(DISTINCT base) FILTER (kind = 'people'))::INTEGER AS people, (count(DISTINCT base) FILTER (kind = 'verbs'))::INTEGER AS verbs, (count(DISTINCT base) FILTER (kind = 'nouns'))::INTEGER AS nouns
FROM documents d LEFT JOIN classed USING (doc_id) GROUP BY d.doc_id""")
def extract_terms(spark, d):
    terms = _documents(spark, d).select("doc_id", T.extract_terms(F.col("text")).alias("t"))
    return terms.select("doc_id", F.size("t.people").alias("people"), F.size("t.verbs").alias("verbs"), F.size("t.nouns").alias("nouns"))


@query(f"""WITH p AS (SELECT doc_id, lower(text) AS low FROM documents),
r AS (SELECT doc_id, unnest(regexp_extract_all(low, {_SPATIAL}, 1)) AS a, unnest(regexp_extract_all(low, {_SPATIAL}, 2)) AS b, unnest(regexp_extract_all(low, {_SPATIAL}, 3)) AS c, unnest(range(len(regexp_extract_all(low, {_SPATIAL}, 1)))) AS i FROM p),
k AS (SELECT doc_id, a || ' ' || b || ' ' || c AS rel, min(i) AS i FROM r WHERE c NOT IN {_NON_CONTENT} GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM k)
SELECT d.doc_id, coalesce(string_agg(rel, '|' ORDER BY i) FILTER (n <= 6), '') AS relations FROM documents d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id""")
def spatial_relations(spark, d):
    return _documents(spark, d).select("doc_id", F.array_join(T.spatial_relations(F.col("text")), "|").alias("relations"))


@query("WITH w AS (SELECT doc_id, lower(trim(l)) AS k, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(l) <> '') SELECT doc_id, count(DISTINCT k) AS lines FROM w GROUP BY doc_id")
def dedupe_ordered(spark, d):
    lines = _documents(spark, d).select("doc_id", F.size(T.dedupe(F.split("text", "\n"))).cast("long").alias("lines"))
    return lines.where("lines > 0")


@query(f"""WITH word AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS x, generate_subscripts(string_split(lower(p_name), ' '), 1) AS i FROM part
  UNION ALL SELECT p_partkey, string_split(lower(p_name), ' ')[-1] || 's', 100 FROM part),
head AS (SELECT p_partkey, CASE WHEN i = 100 THEN 'two ' || x ELSE 'a ' || x END AS person, i, {_LEMMA} AS base FROM word),
first AS (SELECT * FROM head QUALIFY row_number() OVER (PARTITION BY p_partkey, base ORDER BY i) = 1)
SELECT p_partkey, string_agg(person, '|' ORDER BY i) AS people FROM first GROUP BY p_partkey""")
def unique_people(spark, d):
    words = F.split(F.lower("p_name"), " ")
    people = F.concat(F.transform(words, lambda w: F.concat(F.lit("a "), w)), F.array(F.concat(F.lit("two "), F.element_at(words, -1), F.lit("s"))))
    return B.table(spark, d, "part").select("p_partkey", F.array_join(T.unique_people(people), "|").alias("people"))


@query("""SELECT n_nationkey AS item_id, 'Is ' || lower(n_name) || '1 near ' || lower(n_name) || '1, region' || '2 and object' || (n_regionkey + 3) || '?' AS text FROM nation""")
def token_render(spark, d):
    """Indices beyond the objects are rendered by their number."""
    token = lambda text, *at: F.struct(F.lit(text).alias("text"), F.array(*at).cast("array<int>").alias("indices"))
    tokens = F.array(token("Is"), token("", F.lit(0)), token("near"), token("", F.lit(0), F.lit(1), F.col("n_regionkey") + 2), token("?"))
    return B.table(spark, d, "nation").select(F.col("n_nationkey").alias("item_id"), T.render_tokens(tokens, F.array(F.lower("n_name"), F.lit("region"))).alias("text"))


_LEXICON = f"""source AS (
  SELECT 'region_' || r_regionkey AS label_id, 'region ' || r_regionkey AS text FROM region
  UNION ALL SELECT 'region_' || r_regionkey, lower(r_name) FROM region UNION ALL SELECT 'region_' || n_regionkey, 'nation ' || {B.spelt_sql("n_nationkey")} FROM nation
), {_WORDS}, base AS (SELECT label_id, unnest(list_transform(w, lambda x: {_LEMMA})) AS word FROM words),
pair AS (SELECT DISTINCT label_id, word FROM base WHERE word NOT IN {_STOP} AND length(word) > 1),
lexicon AS (SELECT label_id, word, count(*) OVER (PARTITION BY word) AS df FROM pair)"""


@query(f"WITH {_LEXICON} SELECT 'region' AS task, label_id, word, df FROM lexicon")
def lexicon_df(spark, d):
    return labels.lexicon(B.labels(spark, d))


@query(f"""WITH {_LEXICON}, asked AS (SELECT n_nationkey AS item_id, unnest(['nation', {B.spelt_sql("n_nationkey")}, 'region', n_regionkey::VARCHAR]) AS word FROM nation),
token AS (SELECT DISTINCT item_id, word FROM asked WHERE length(word) > 1), n AS (SELECT item_id, count(*) AS n FROM token GROUP BY item_id)
SELECT item_id, label_id, round(least(1.0, sum(1.0 / df) / least(any_value(n), 3)), 6) AS score FROM token JOIN n USING (item_id) JOIN lexicon USING (word) GROUP BY item_id, label_id""")
def lexical_match(spark, d):
    texts = B.table(spark, d, "nation").select(F.col("n_nationkey").alias("item_id"), F.lit(B.TASK).alias("task"), F.concat(F.lit("nation "), B.spelt(F.col("n_nationkey")), F.lit(" of region "), F.col("n_regionkey").cast("string")).alias("text"))
    return labels.lexical_match(texts, labels.lexicon(B.labels(spark, d))).select("item_id", "label_id", F.round("score", 6).alias("score"))


_LEXICAL = f"""WITH {_LEXICON}, asked AS (SELECT n_nationkey AS item_id, unnest(['nation', {B.spelt_sql("n_nationkey")}, 'region', n_regionkey::VARCHAR]) AS word FROM nation),
token AS (SELECT DISTINCT item_id, word FROM asked WHERE length(word) > 1), n AS (SELECT item_id, count(*) AS n FROM token GROUP BY item_id),
lexical AS (SELECT item_id, label_id, least(1.0, sum(1.0 / df) / least(any_value(n), 3)) AS score FROM token JOIN n USING (item_id) JOIN lexicon USING (word) GROUP BY item_id, label_id)"""


@query(_LEXICAL + """, draft AS (SELECT n_nationkey AS item_id, 'region_' || n_regionkey AS label_id, n_nationkey / 25.0 AS best FROM nation)
SELECT item_id, label_id, round(greatest(coalesce(score, 0.0), 0.8 * coalesce(best, 0.0)), 3) AS draft FROM lexical FULL JOIN draft USING (item_id, label_id)""")
def draft_match(spark, d):
    nations = B.table(spark, d, "nation").select(F.col("n_nationkey").alias("item_id"), F.lit(B.TASK).alias("task"), "n_regionkey")
    texts = nations.select("item_id", "task", F.concat(F.lit("nation "), B.spelt(F.col("item_id")), F.lit(" of region "), F.col("n_regionkey").cast("string")).alias("text"))
    drafted = nations.select("item_id", "task", F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")).alias("label_id"), (F.col("item_id") / 25.0).alias("score"))
    matched = evidence.draft_match(labels.lexical_match(texts, labels.lexicon(B.labels(spark, d))), drafted)
    return matched.select("item_id", "label_id", F.round("draft", 3).alias("draft"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, sum(value) AS total FROM events GROUP BY 1")
def json_props(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return B.table(spark, d, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


# -------------------------------------------------------------------------- metrics


@query("""WITH v AS (SELECT user_id, event_type, sum(value) AS w, count(*) AS c, min(event_id) AS f FROM events GROUP BY ALL), r AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(w, 9) DESC, c DESC, f) AS n, sum(c) OVER (PARTITION BY user_id) AS all_ FROM v)
SELECT user_id, event_type AS label_id, c AS moments, round(c / all_, 3) AS share, round(w / c, 4) AS mean_confidence FROM r WHERE n = 1""")
def weighted_vote(spark, d):
    votes = B.table(spark, d, "events").select("user_id", F.col("event_type").alias("label_id"), F.col("value").alias("confidence"), F.col("event_id").alias("ord"))
    return metrics.weighted_vote(votes, "user_id")


_EVAL = "CASE WHEN n_chars > 600 THEN 1 ELSE 0 END AS answer, quality AS answer_label, CASE WHEN n_chars % 7 = 0 THEN 1 ELSE 0 END AS rationale, toxic AS rationale_label"


@query(f"""WITH e AS (SELECT source, {_EVAL} FROM documents JOIN labels USING (doc_id))
SELECT source, count(*) AS n, round(avg((answer IS NOT DISTINCT FROM answer_label)::INT), 6) AS q_a, round(avg((rationale IS NOT DISTINCT FROM rationale_label)::INT), 6) AS qa_r,
       round(avg((answer IS NOT DISTINCT FROM answer_label AND rationale IS NOT DISTINCT FROM rationale_label)::INT), 6) AS q_ar
FROM e WHERE answer_label IS NOT NULL GROUP BY source""")
def eval_joint_accuracy(spark, d):
    both = B.table(spark, d, "documents").select("doc_id", "source", "n_chars").join(B.table(spark, d, "labels"), "doc_id")
    rows = both.select("source", (F.col("n_chars") > 600).cast("int").alias("answer"), F.col("quality").alias("answer_label"), (F.col("n_chars") % 7 == 0).cast("int").alias("rationale"), F.col("toxic").alias("rationale_label"))
    return metrics.joint_accuracy(rows, "source").select("source", "n", *[F.round(c, 6).alias(c) for c in ("q_a", "qa_r", "q_ar")])


@query("SELECT event_id, round(avg((value > 10)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS running FROM events")
def running_accuracy(spark, d):
    mean = metrics.running_mean((F.col("value") > 10).cast("double"), ["event_id"], ["user_id"])
    return B.table(spark, d, "events").select("event_id", F.round(mean, 6).alias("running"))


@query("""WITH s AS (SELECT user_id, event_id, value, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), w AS (
  SELECT *, greatest(3, n // 15) AS w FROM s WHERE n >= 5)
SELECT a.event_id, round(avg(b.value), 4) AS moving_average FROM w a JOIN w b ON a.user_id = b.user_id AND b.i BETWEEN a.i - a.w + 1 AND a.i GROUP BY a.event_id""")
def moving_average(spark, d):
    rows = B.table(spark, d, "events").select("user_id", "event_id", "value")
    return metrics.moving_average(rows, "value", ["event_id"], ["user_id"]).select("event_id", F.round("moving_average", 4).alias("moving_average"))


@query("SELECT CAST(ceil(event_id / 100.0) AS INTEGER) AS epoch, round(avg(value), 6) AS mean_loss FROM events WHERE event_id > 0 GROUP BY 1")
def epoch_loss(spark, d):
    log = B.table(spark, d, "events").select((F.col("event_id") / 100.0).alias("epoch"), F.col("value").alias("loss"))
    return metrics.epoch_loss(log).select("epoch", F.round("mean_loss", 6).alias("mean_loss"))


@query("WITH m AS (SELECT user_id AS epoch, round(avg(value), 6) AS q_ar, count(*) AS q_a FROM events GROUP BY 1) SELECT epoch, q_ar, q_a FROM m ORDER BY q_ar DESC, q_a DESC, epoch LIMIT 1")
def best_epoch(spark, d):
    m = B.table(spark, d, "events").groupBy(F.col("user_id").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("q_ar"), F.count("*").alias("q_a"))
    return metrics.best_epoch(m)


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_per_key(spark, d):
    return B.table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT event_id, value < 60 AS is_blurry, value * 2 < 60 AS is_dark, value * 3 < 25 AS is_flat FROM events")
def quality_flags(spark, d):
    rows = B.table(spark, d, "events").select("event_id", "value", (F.col("value") * 2).alias("b"), (F.col("value") * 3).alias("c"))
    return metrics.quality_flags(rows, "value", "b", "c").select("event_id", "is_blurry", "is_dark", "is_flat")


@query("SELECT p_partkey, greatest(1, round_even(p_size * 10 * least(1.0, 384.0 / greatest(p_size * 10, p_partkey % 700 + 1)), 0)::INTEGER) AS width, greatest(1, round_even((p_partkey % 700 + 1) * least(1.0, 384.0 / greatest(p_size * 10, p_partkey % 700 + 1)), 0)::INTEGER) AS height FROM part")
def resize_dims(spark, d):
    size = fitted_size((F.col("p_size") * 10).cast("double"), (F.col("p_partkey") % 700 + 1).cast("double"), 384)
    return B.table(spark, d, "part").select("p_partkey", size.alias("s")).select("p_partkey", "s.width", "s.height")


# --------------------------------------------------------------------------- clips


_SCENES = f"""WITH RECURSIVE {B.SAMPLES_SQL}, look AS (
  SELECT clip_id, k, value, lead(value) OVER (PARTITION BY clip_id ORDER BY k) AS next_value FROM samples
), walk AS (
  SELECT clip_id, 0 AS k, 0 AS segment, value AS anchor FROM look WHERE k = 0
  UNION ALL
  SELECT l.clip_id, l.k, CASE WHEN c.cut THEN w.segment + 1 ELSE w.segment END, CASE WHEN c.cut THEN l.value ELSE w.anchor END
  FROM walk w JOIN look l ON l.clip_id = w.clip_id AND l.k = w.k + 1,
  LATERAL (SELECT CASE WHEN w.anchor + l.value = 0 THEN 0 ELSE abs(w.anchor - l.value) / (w.anchor + l.value) END > 0.35
     AND (l.next_value IS NULL OR CASE WHEN w.anchor + l.next_value = 0 THEN 0 ELSE abs(w.anchor - l.next_value) / (w.anchor + l.next_value) END > 0.35) AS cut) c
)"""


@query(_SCENES + " SELECT clip_id, k::INTEGER AS k, segment::INTEGER AS segment FROM walk")
def scene_segments(spark, d):
    return moments.scene_segments(B.samples(spark, d).select("clip_id", "k", "value"))


@query(f"""WITH RECURSIVE {B.SAMPLES_SQL}, walk AS (
  SELECT clip_id, 0 AS k, CASE WHEN value < 2 THEN -1e9 ELSE 0.0 END AS looked, CASE WHEN value < 2 THEN -1e9 ELSE 0.0 END AS kept, CASE WHEN value < 2 THEN NULL ELSE value END AS v, value >= 2 AS take FROM samples WHERE k = 0
  UNION ALL
  SELECT s.clip_id, s.k, CASE WHEN c.skip THEN w.looked ELSE s.time_s END, CASE WHEN c.skip OR c.same THEN w.kept ELSE s.time_s END, CASE WHEN c.skip OR c.same THEN w.v ELSE s.value END, NOT c.skip AND NOT c.same
  FROM walk w JOIN samples s ON s.clip_id = w.clip_id AND s.k = w.k + 1,
  LATERAL (SELECT s.time_s - w.looked < 2.0 OR s.value < 2 AS skip,
     w.v IS NOT NULL AND s.time_s - w.kept < 6.0 AND CASE WHEN w.v + s.value = 0 THEN 0 ELSE abs(w.v - s.value) / (w.v + s.value) END < 0.25 AS same) c
) SELECT clip_id, k::INTEGER AS k FROM walk WHERE take""")
def sampled_frames(spark, d):
    return moments.sampled(B.samples(spark, d).select("clip_id", "k", "time_s", "value", "blurry"))


@query(_SCENES + """, clip AS (
  SELECT clip_id, list(time_s ORDER BY k) AS t, list(value ORDER BY k) AS sharp, greatest(max(duration), max(time_s) + 1 / any_value(fps)) AS stop FROM samples GROUP BY clip_id
), scene AS (SELECT clip_id, segment, min(k)::BIGINT AS lo, max(k)::BIGINT AS hi FROM walk GROUP BY clip_id, segment
), fit AS (
  SELECT clip_id, list({'lo': lo, 'hi': hi} ORDER BY lo) AS parts FROM scene GROUP BY clip_id
  UNION ALL
  SELECT clip_id, CASE WHEN n > 7 THEN parts[:a - 1] || [{'lo': parts[a].lo, 'hi': parts[a + 1].hi}] || parts[a + 2:]
                  ELSE parts[:b - 1] || [{'lo': parts[b].lo, 'hi': (parts[b].lo + parts[b].hi) // 2}, {'lo': (parts[b].lo + parts[b].hi) // 2 + 1, 'hi': parts[b].hi}] || parts[b + 1:] END
  FROM (SELECT *, CASE WHEN j = 1 OR (j < n AND size[j + 1] < size[j - 1]) THEN j ELSE j - 1 END AS a FROM (
    SELECT *, len(parts) AS n, list_position(size, list_min(size)) AS j, list_position(size, list_max(size)) AS b FROM (
      SELECT clip_id, parts, list_transform(parts, lambda p: list_append(t, stop)[p.hi + 2] - t[p.lo + 1]) AS size FROM fit JOIN clip USING (clip_id))))
  WHERE n > 7 OR (n < 7 AND size[b] >= 6.0 AND parts[b].hi - parts[b].lo >= 3)
), settled AS (
  SELECT clip_id, parts FROM fit QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY CASE WHEN len(parts) >= 7 THEN len(parts) - 7 ELSE 7 - len(parts) END) = 1
), moment AS (SELECT clip_id, unnest(parts) AS p, generate_subscripts(parts, 1) - 1 AS moment FROM settled
), trimmed AS (SELECT clip_id, moment, p.lo AS lo, p.hi AS hi, p.lo + CASE WHEN p.hi - p.lo >= 4 THEN (p.hi - p.lo) // 10 ELSE 0 END AS first, p.hi - CASE WHEN p.hi - p.lo >= 4 THEN (p.hi - p.lo) // 10 ELSE 0 END AS last FROM moment
), best AS (SELECT *, first + list_position(sharp[first + 1:last + 1], list_max(sharp[first + 1:last + 1])) - 1 AS k FROM trimmed JOIN clip USING (clip_id))
SELECT clip_id, moment::INTEGER AS moment, k::INTEGER AS k, t[k + 1] AS time_s, t[lo + 1] AS begin_s, list_append(t, stop)[hi + 2] AS end_s, sharp[k + 1] AS sharpness FROM best""")
def key_moments(spark, d):
    samples = B.samples(spark, d)
    return moments.key_moments(samples, moments.scene_segments(samples.select("clip_id", "k", "value")))


@query("""WITH h AS (SELECT user_id, event_type, count(*) FILTER (event_id % 2 = 0) AS a, count(*) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY ALL)
SELECT user_id, round(sqrt(greatest(0.0, 1 - CASE WHEN sum(a) * sum(b) = 0 THEN 1.0 ELSE sum(sqrt(a * b)) / sqrt(sum(a) * sum(b)) END)), 5) AS distance FROM h GROUP BY user_id""")
def bhattacharyya_pairs(spark, d):
    h = B.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count_if(F.col("event_id") % 2 == 0).alias("a"), F.count_if(F.col("event_id") % 2 == 1).alias("b"))
    lists = h.groupBy("user_id").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    return lists.select("user_id", F.round(bhattacharyya(F.col("a"), F.col("b")), 5).alias("distance"))


# ------------------------------------------------------------------------------- QA

_PAIRS = "pairs AS (SELECT conv_id, turn, text AS question, lead(text) OVER w AS gold, role, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"


@query(f"WITH {_PAIRS} SELECT conv_id, turn, question, gold FROM pairs WHERE role = 'user' AND next_role = 'assistant'")
def qa_pairs(spark, d):
    return qa.turn_pairs(B.table(spark, d, "conversations"))


_OPTIONS = f"""WITH {_PAIRS}, asked AS (SELECT conv_id, turn, question, gold, md5('distract|' || conv_id || '|' || turn) AS key FROM pairs WHERE role = 'user' AND next_role = 'assistant'),
ring AS (SELECT gold, row_number() OVER (ORDER BY md5(gold), gold) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT gold FROM asked WHERE gold IS NOT NULL)),
drawn AS (SELECT a.conv_id, a.turn, a.key, a.gold, (r.i + 1 + (('0x' || key[1:8])::BIGINT + j) % (m - 1)) % m AS i FROM asked a JOIN ring r USING (gold), (SELECT unnest([0, 1, 2]) AS j) WHERE j < m - 1),
option AS (SELECT conv_id, turn, key, gold AS option, true AS right_ FROM asked UNION ALL SELECT d.conv_id, d.turn, d.key, r.gold, false FROM drawn d JOIN ring r USING (i)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY md5(key || '|' || option), option) AS place FROM option),
listed AS (SELECT conv_id, turn, string_agg(chr((64 + place)::INTEGER) || '. ' || option, chr(10) ORDER BY place) AS lines, chr((64 + max(place) FILTER (right_))::INTEGER) AS target FROM placed GROUP BY conv_id, turn)"""


@query(_OPTIONS + """
SELECT a.conv_id, a.turn, 'qa' AS task, question || chr(10) || lines AS prompt, target FROM asked a JOIN listed USING (conv_id, turn)
UNION ALL SELECT conv_id, turn, 'qar', question || ' The answer is: ' || gold || ' Why is this answer correct?' || chr(10) || 'A. ' || gold || chr(10) || 'B. ' || question, 'A' FROM asked
UNION ALL SELECT conv_id, turn, 'explain', question, CASE WHEN regexp_matches(gold, '[.!?]\\s*$') THEN trim(gold) ELSE trim(gold) || '.' END || ' ' || gold FROM asked""")
def qa_examples(spark, d):
    asked = qa.with_distractors(qa.turn_pairs(B.table(spark, d, "conversations")))
    reasons = asked.withColumns({"rationales": F.array("gold", "question"), "rationale_label": F.lit(0)})
    return qa.examples(reasons, ("qa", "qar", "explain"))


@query(f"""WITH {_PAIRS}, u AS (SELECT ('0x' || md5('split|' || conv_id || '|' || turn)[1:8])::BIGINT % 1000000 / 1e6 AS u FROM pairs WHERE role = 'user' AND next_role = 'assistant')
SELECT CASE WHEN u < 0.1 THEN 'test' WHEN u < 0.1 + 0.05 THEN 'select' ELSE 'train' END AS part, count(*) AS n FROM u GROUP BY 1""")
def qa_split(spark, d):
    return qa.split(qa.turn_pairs(B.table(spark, d, "conversations")), ["conv_id", "turn"]).groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT item_id, text || chr(10) || 'A. yes' || chr(10) || 'B. no' AS prompt FROM benchmark")
def mc_prompt(spark, d):
    return B.table(spark, d, "benchmark").select("item_id", T.choice_prompt(F.col("text"), F.array(F.lit("yes"), F.lit("no"))).alias("prompt"))


@query("""WITH o AS (SELECT n_nationkey AS item_id, [n_name, 'x', 'y', 'z'] AS options FROM nation), p AS (
  SELECT item_id, options, unnest([0, 1, 2]) AS order_id FROM o), s AS (SELECT *, unnest([0, 1, 2, 3]) AS slot FROM p)
SELECT item_id, order_id::INTEGER AS order_id, slot::INTEGER AS slot, options[CASE order_id WHEN 0 THEN slot WHEN 1 THEN 3 - slot ELSE (slot + 1) % 4 END + 1] AS option FROM s""")
def option_debias(spark, d):
    options = B.table(spark, d, "nation").select(F.col("n_nationkey").alias("item_id"), F.array("n_name", F.lit("x"), F.lit("y"), F.lit("z")).alias("options"))
    return qa.debiased(options, 3).select("item_id", "order_id", "slot", "option")


# ------------------------------------------------------------------------- streams


def _run(spark: SparkSession, stream: DataFrame, name: str, mode: str) -> DataFrame:
    """The result of a stream that takes what is there and ends, as a table in the shared
    folder; in complete mode that of the last batch."""
    out, log = shared_dir(spark, name), shared_dir(spark, f"{name}-log")
    writer = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True)
    if mode == "complete":
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    else:
        writer = writer.format("parquet").option("path", out)
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = B.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, d):
    from verdigris.streaming.sampler import tumbling_counts as counts

    windows = _run(spark, counts(_event_stream(spark, d)), "tumbling_counts", "complete")
    return windows.withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS session_start, count(*) AS n FROM s GROUP BY user_id, session""")
def session_counts(spark, d):
    from verdigris.streaming.sampler import session_counts as counts

    return _run(spark, counts(_event_stream(spark, d)), "session_counts", "complete")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_counts(spark, d):
    """A complete-mode streaming aggregation over the events."""
    counted = _event_stream(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))
    return _run(spark, counted, "stream_counts", "complete")


@query("SELECT DISTINCT user_id AS job_id, event_type AS state FROM events")
def dedup_stream(spark, d):
    """The states that each job reached, once each, from a stream of repeated reports."""
    from verdigris.streaming.sampler import job_states

    reports = _event_stream(spark, d).select(F.col("user_id").alias("job_id"), F.col("event_type").alias("state"), F.col("ts").cast("timestamp").alias("ts"))
    return _run(spark, job_states(reports, "400 days").select("job_id", "state"), "dedup_stream", "append")
