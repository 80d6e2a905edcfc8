"""Plans that must not shuffle more than they do, and ties and bounds that rounding decides."""

import duckdb
from pyspark.sql import functions as F

from verdigris.operators import evidence, fusion, graph, labels, moments, qa
from verdigris.plans import bindings, catalogue
from verdigris.storage import cut

REL = graph.Relations({"A": 0.8, "B": 0.5}, ("Not",), ("A",), ("hub",))
EDGE = "rel string, start string, end string, weight double, surface string"


def shuffles(df):
    """Keys of the shuffles in a plan that is not adapted yet."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("Exchange ", 1)[1] for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def edges(spark):
    return spark.createDataFrame([("A", "x", "y", 2.0, ""), ("A", "x", "y", 1.0, ""), ("B", "y", "x", 3.0, ""), ("Not", "x", "z", 4.0, ""), ("B", "z", "hub", 2.0, ""), ("B", "q", "q", 9.0, "")], EDGE)


def test_links_are_made_where_neighbours_are(spark):
    made = graph.build_edges(edges(spark))
    terms = spark.createDataFrame([("x",), ("z",), ("q",)], "term string").hint("merge")
    found = graph.links(graph.neighbours(made, terms), REL)
    keys = shuffles(found)
    assert sum(k.startswith("hashpartitioning(rel") for k in keys) == 1, "edges are merged once for both directions"
    assert sum(k.startswith("hashpartitioning(term") for k in keys) == 2, "edges and terms, and nothing afterwards"
    rows = {(r.term, r.other): (r.strength, r.edge and r.edge.rel, r.negative) for r in found.collect()}
    assert rows["x", "z"] == (None, None, True) and rows["z", "x"] == (None, None, True)
    assert rows["x", "x"] == (1.0, None, False) and rows["z", "z"] == (1.0, None, False)
    assert rows["x", "y"][1:] == ("A", False) and set(rows) == {("x", "z"), ("z", "x"), ("x", "x"), ("z", "z"), ("x", "y")}


def test_an_item_is_dealt_once_each_way(spark):
    terms = spark.range(40).select((F.col("id") % 8).alias("item_id"), F.concat(F.lit("p"), "id").alias("phrase"), F.concat(F.lit("c"), "id").alias("concept"), F.lit(0.5).alias("salience"), F.array(F.lit("action")).alias("kinds"), F.lit(1).alias("rank"), F.lit(False).alias("backed_off"))
    scores = spark.range(40).select(F.concat(F.lit("c"), "id").alias("term"), F.explode(F.array(F.lit("t"), F.lit("u"))).alias("task"), F.lit("l").alias("label_id"), (F.col("id") / 40).alias("score"))
    space = spark.createDataFrame([("t", "l", 0), ("u", "l", 0), ("u", "m", 1)], "task string, label_id string, ord int")
    weights = spark.createDataFrame([("t", "action", 1.0), ("u", "action", 0.5), ("u", "other", 9.0)], "task string, kind string, weight double")
    support = evidence.label_support(terms, scores, space, weights)
    assert sum(k.startswith("hashpartitioning(item_id") for k in shuffles(support)) == 1
    rows = {(r.item_id, r.task, r.label_id): r.support for r in support.collect()}
    assert len(rows) == 8 * 3 and rows[3, "u", "m"] == 0.0 and rows[3, "t", "l"] == 1.0
    assert abs(rows[0, "u", "l"] - 1.0) < 1e-12 and abs(rows[0, "t", "l"] - 1.0) < 1e-12
    profiles = graph.profile(graph.neighbours(edges(spark)), REL)
    facts = evidence.facts(terms, profiles, spark.createDataFrame([("y",)], "concept string"), REL)
    assert sum(k.startswith("hashpartitioning(item_id") for k in shuffles(facts)) == 2


def test_own_concepts_and_slight_terms_have_their_facts(spark):
    near = [("A", "x", f"n_{c}", 1.0 + i / 10, "") for i, c in enumerate("abcdefghijkl")]
    profiles = graph.profile(graph.neighbours(spark.createDataFrame(near, EDGE)), REL)
    terms = spark.createDataFrame([(1, 1, "x", 1.0, False), (1, 2, "n_a", 0.5, True), (2, 1, "x", 1e-5, False)], "item_id int, rank int, concept string, salience double, backed_off boolean")
    got = evidence.facts(terms, profiles, spark.createDataFrame([], "concept string"), REL, per_term=2).orderBy("item_id", "place").collect()
    # The lightest edge counts most, since it leads to another concept of the item.
    assert [(r.item_id, r.place, r.end) for r in got] == [(1, 1, "n_a"), (1, 2, "n_l"), (2, 1, "n_l"), (2, 2, "n_k")]


def test_equal_but_for_rounding_go_by_slot(spark):
    rows = spark.createDataFrame([(1, "t", "b", 2, 0.4 + 1e-12), (1, "t", "a", 1, 0.4), (1, "t", "c", 3, 0.2)], "item_id int, task string, label_id string, slot int, probability double")
    assert {r.label_id: r["rank"] for r in fusion.rank(rows).collect()} == {"a": 1, "b": 2, "c": 3}


def test_bounds_of_a_split_are_decimal(spark):
    # The key's number is 150000 of a million: not under 0.1 + 0.05.
    rows = spark.createDataFrame([(1107030,)], "conv_id long")
    assert qa.split(rows, ["conv_id"]).first().part == "train"


def test_loops_hide_an_edge_only_where_they_fill_the_limit(spark):
    rows = spark.createDataFrame([("A", "x", "x", 5.0, ""), ("A", "x", "y", 1.0, ""), ("A", "z", "z", 1.0, ""), ("A", "z", "y", 5.0, "")], EDGE)
    phrases = spark.createDataFrame([("x",), ("z",), ("y",)], "phrase string")
    found = lambda limit: {r.phrase for r in graph.resolve(phrases, rows, limit).where("found").collect()}
    assert found(2) == {"z", "y"} and found(3) == {"x", "z", "y"}


def test_a_stored_graph_is_made_once(spark, tmp_path):
    # Surfaces differ each time that the edges are made.
    made = spark.range(50).select(F.lit("A").alias("rel"), F.concat(F.lit("s"), "id").alias("start"), F.concat(F.lit("e"), "id").alias("end"), F.lit(1.0).alias("weight"), F.uuid().alias("surface"))
    graph.save_graph(made, "made_once", buckets=2, folder=str(tmp_path))
    stored = graph.load_graph(spark, "made_once")
    assert stored.by_start.exceptAll(stored.by_end).isEmpty() and stored.by_end.count() == 50
    assert spark.table("made_once_meta").first().edges == 50


def test_pictures_come_in_bounded_batches(spark):
    from verdigris.plans import media

    names = ("maxRecordsPerBatch", "maxBytesPerBatch")
    for name in names:
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    media.picture_stats(spark, "/root/testdata/sf0.001")
    assert [int(spark.conf.get(f"spark.sql.execution.arrow.{name}")) for name in names] == [512, 16 << 20]


def test_only_configuration_is_broadcast(spark):
    def broadcasts(df):
        return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastExchange" in line]

    # Rows of few different values, whose files are far smaller than what a broadcast of them takes.
    grid = lambda n: cut(spark.range(n).select((F.col("id") % 100).alias("item_id"), F.lit("t").alias("task"), F.lit("l").alias("label_id"), F.lit(0).alias("ord"), *[F.lit(0.5).alias(c) for c in ("support", "draft", "lexical")]))
    rows, keys = grid(200), ["item_id", "task", "label_id"]
    assert not broadcasts(evidence.disambiguate(rows.drop("draft"), grid(100).select(*keys, "draft")))
    assert not broadcasts(fusion.shortlist(rows, 2, grid(100).select(*keys)))
    terms = cut(spark.range(50).select("id", F.lit("p").alias("phrase"), F.lit(1.0).alias("salience")))
    resolved = cut(spark.createDataFrame([("p", "c", False)], "phrase string, concept string, backed_off boolean"))
    assert not broadcasts(evidence.grounded(terms, resolved))
    texts = rows.select("item_id", "task", F.lit("some words").alias("text"))
    lexicon = cut(spark.range(1000).select(F.lit("t").alias("task"), F.lit("l").alias("label_id"), F.sha2(F.col("id").cast("string"), 256).alias("word"), F.lit(1).alias("df")))
    found = broadcasts(labels.lexical_match(texts, lexicon))
    assert len(found) == 1 and labels.lexical_match(texts, lexicon)._jdf.queryExecution().executedPlan().toString().count("BuildRight") == 1
    assert not broadcasts(bindings.sold_edges(spark, "/root/testdata/sf0.001"))


def test_clips_are_sorted_once_and_wide_frames_not_at_all(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    made = bindings.samples(spark, "/root/testdata/sf0.001")
    assert plan(made).count(" Sort [") == 1
    by_clip = {}
    for r in made.collect():
        by_clip.setdefault(r.clip_id, []).append((r.time_s, r.k))
    assert all([k for _, k in sorted(rows)] == list(range(len(rows))) for rows in by_clip.values())
    samples = cut(made)
    chosen = moments.key_moments(samples, moments.scene_segments(samples.select("clip_id", "k", "value")))
    assert "BroadcastExchange" not in plan(chosen)
    frames = cut(samples.select("clip_id", "k", F.lit("ok").alias("content")))
    found = moments.moment_frames(cut(chosen), frames, lambda c: c == "ok")
    assert "ShuffledHashJoin" in plan(found) and "BroadcastExchange" not in plan(found)
    assert found.count() == chosen.count()


def test_two_hops_go_over_all_edges_of_a_hub(spark, tmp_path):
    # A nation that buys 450 parts; the heaviest 400 edges of it are not all.
    n = spark.range(450)
    tables = {
        "region": spark.createDataFrame([(0, "ASIA")], "r_regionkey long, r_name string"), "nation": spark.createDataFrame([(1, 0)], "n_nationkey long, n_regionkey long"),
        "customer": spark.createDataFrame([(1, 1)], "c_custkey long, c_nationkey long"), "supplier": spark.createDataFrame([(1, 1)], "s_suppkey long, s_nationkey long"),
        "orders": spark.createDataFrame([(1, 1)], "o_orderkey long, o_custkey long"), "part": n.select(F.col("id").alias("p_partkey"), F.lit("Brand#1").alias("p_brand")),
        "lineitem": n.select(F.lit(1).cast("long").alias("l_orderkey"), F.col("id").alias("l_partkey"), F.lit(1).cast("long").alias("l_suppkey"), (10.0 + F.col("id") % 40).alias("l_quantity"), F.lit("N").alias("l_returnflag")),
    }
    c = duckdb.connect()
    for name, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = {(r.term, r.label_id): r.cosine for r in catalogue.two_hop_cosine(spark, str(tmp_path)).collect()}
    want = {(t, label): x for t, label, x in c.sql(catalogue.ORACLES["two_hop_cosine"]).fetchall()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    # The nation is next to itself, 450 parts, its supplier and its region.
    profiles = graph.strengths(bindings.graph(spark, str(tmp_path)), bindings.RELATIONS)
    assert profiles.where("term = 'nation_c'").count() == 453
    assert "400" not in catalogue.ORACLES["two_hop_cosine"]


def test_support_adds_up_by_number_and_kinds_are_bits(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = [(1, "red cup", "object", 1.0, 2), (1, "The red cup", "action", 0.5, 1), (1, "hall", "setting", 1.0, 3)]
    terms = evidence.key_terms(spark.createDataFrame(rows, "item_id int, phrase string, kind string, factor double, ord int"))
    assert "ObjectHashAggregate" not in plan(terms) and "SortAggregate" not in plan(terms)
    assert [(r.phrase, r.salience, r.kinds, r.ord, r["rank"]) for r in terms.orderBy("rank").collect()] == [("red cup", 0.7, ["action", "object"], 1, 1), ("hall", 0.6, ["setting"], 3, 2)]
    linked = graph.links(graph.neighbours(cut(edges(spark))), REL)
    assert "Join" not in plan(linked), "relations are a map"
    told = cut(spark.createDataFrame([(1, "c", 0.5, ["action"]), (1, "d", 0.5, ["action"]), (2, "e", 0.5, ["none"])], "item_id int, concept string, salience double, kinds array<string>"))
    scores = spark.createDataFrame([("c", "t", "l", 0.4), ("c", "u", "l", 0.2), ("d", "t", "m", 0.8), ("d", "t", "other", 9.0)], "term string, task string, label_id string, score double")
    space = spark.createDataFrame([("t", "l", 0), ("t", "m", 1), ("u", "l", 0), ("v", "l", 0)], "task string, label_id string, ord int")
    weights = spark.createDataFrame([("t", "action", 1.0), ("u", "action", 0.0), ("w", "action", 1.0)], "task string, kind string, weight double")
    support = evidence.label_support(told, scores, space, weights)
    assert "slot" in plan(support) and not [k for k in shuffles(support) if k.startswith("hashpartitioning(item_id") and "label_id" in k]
    # A label that the space has not counts nowhere; a task without weights or labels has no rows.
    assert {(r.item_id, r.task, r.label_id): round(r.support, 6) for r in support.collect()} == {(1, "t", "l"): 0.5, (1, "t", "m"): 1.0, (1, "u", "l"): 0.0}


def test_a_named_row_is_a_required_label(spark):
    rows = cut(spark.createDataFrame([(1, "t", x, i, 1.0 - i / 10, 0.0, 0.0, x == "d") for i, x in enumerate("abcd")], "item_id int, task string, label_id string, ord int, support double, draft double, lexical double, named boolean"))
    required = rows.where("named").select("item_id", "task", "label_id")
    found = lambda df: {(r.label_id, r.slot) for r in df.collect()}
    assert found(fusion.shortlist(rows, 2)) == found(fusion.shortlist(rows.drop("named"), 2, required)) == {("a", 1), ("d", 2)}
