import math

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris import config, sinks
from verdigris.functions import vectors as V
from verdigris.operators import evidence, fusion, graph, images, labels, metrics, moments, qa
from verdigris.sources import dump, rest
from verdigris.streaming.sampler import sampled_stream

EDGES = "rel string, start string, end string, weight double, surface string"
REL = graph.Relations({"RelatedTo": 0.5, "IsA": 1.0, "UsedFor": 0.8}, ("Antonym",), ("IsA",), ("thing",))


@pytest.fixture(scope="module")
def toy(spark):
    rows = [
        ("UsedFor", "shake_hand", "greeting", 2.0, ""), ("IsA", "greeting", "form_of_welcome", 1.5, ""), ("RelatedTo", "hand", "arm", 1.0, ""),
        ("RelatedTo", "arm", "body", 3.0, ""), ("Antonym", "fight", "greeting", 2.0, ""), ("RelatedTo", "hand", "thing", 3.0, ""),
        ("RelatedTo", "hand", "hand", 9.0, ""), ("RelatedTo", "greeting", "hello", 2.0, ""), ("RelatedTo", "hello", "welcome", 2.0, ""), ("RelatedTo", "hand", "glove", 0.5, ""),
    ]
    return spark.createDataFrame(rows, EDGES)


def test_dump(spark):
    line = lambda *c: ("\t".join(c),)
    lines = spark.createDataFrame(
        [
            line("/a", "/r/IsA", "/c/en/cat/n", "/c/en/animal", '{"weight": 2.5, "surfaceText": "a [[cat]] \\"q\\""}'),
            line("/a", "/r/IsA", "/c/fr/chat", "/c/en/animal", "{}"),
            line("/a", "/r/IsA", "/c/en/cat", "/c/en/cat", "{}"),
            line("/a", "/r/ExternalURL", "/c/en/cat", "/c/en/x", "{}"),
            line("/a", "/r/IsA", "/c/en/cat", "/c/en/pet", "no json"),
            line("/a", "/r/IsA", "/c/en/cat", "/c/en/pet", '{"weight": null}'),
            line("/a", "/r/IsA", "/c/en//x", "/c/en/pet", "{}"),
            line("/a", "/r/IsA", "/c/en/cat"),
        ],
        "value string",
    )
    rows = sorted(map(tuple, dump.parse_dump(lines).collect()))
    assert rows == [("IsA", "cat", "animal", 2.5, 'a [[cat]] "q"'), ("IsA", "cat", "pet", 1.0, ""), ("IsA", "cat", "pet", 1.0, "")]
    built = graph.build_edges(dump.parse_dump(lines)).collect()
    assert len(built) == 2
    assert dump.empty_edges(spark).count() == 0


def test_neighbours(toy, spark):
    near = graph.neighbours(toy, spark.createDataFrame([("hand",)], "term string"), limit=2).collect()
    # The two heaviest edges are the self-loop (seen from both ends), which goes afterwards.
    assert near == []
    near = graph.neighbours(toy).where("term = 'greeting'").orderBy("edge_rank").collect()
    assert [(r.other, r.rel) for r in near] == [("fight", "Antonym"), ("hello", "RelatedTo"), ("shake_hand", "UsedFor"), ("form_of_welcome", "IsA")]


def test_resolve(toy, spark):
    phrases = spark.createDataFrame([("the shaking hands",), ("crossed arms",), ("a greeting",), ("unknown thingy",), ("the",)], "phrase string")
    got = {r.phrase: (r.concept, r.found, r.backed_off) for r in graph.resolve(phrases, toy).collect()}
    assert got["the shaking hands"] == ("shake_hand", True, False)
    assert got["crossed arms"] == ("arm", True, True)
    assert got["a greeting"] == ("greeting", True, False)
    assert got["unknown thingy"] == ("unknown_thingy", False, False)
    assert got["the"] == (None, False, False)


def test_signals_and_support(toy, spark):
    near = graph.neighbours(toy)
    profiles = graph.profile(near, REL)
    strengths = {(r.term, r.other): r.strength for r in profiles.collect()}
    assert strengths["hand", "hand"] == 1.0 and ("hand", "thing") not in strengths and ("hand", "glove") not in strengths
    assert strengths["shake_hand", "greeting"] == pytest.approx(0.8 * (1 - math.exp(-2)))
    space = spark.createDataFrame([("t", "greet", 0, "d", ["greeting"], ["hello"]), ("t", "welcome", 1, "d", ["welcome"], []), ("t", "far", 2, "d", ["moon"], ["arm"])], dump.LABEL_SCHEMA)
    anchored = labels.anchors(space)
    merged = graph.label_profiles(anchored, profiles)
    words = labels.lexicon(space)
    concepts = profiles.select(F.col("term"), F.translate("term", "_", " ").alias("phrase")).distinct()
    scores = evidence.signals(profiles, anchored, graph.two_hop(profiles, merged), evidence.keyword_hits(concepts, words), graph.negatives(near, REL), REL)
    got = {(r.term, r.label_id): (round(r.score, 4), r.reason) for r in scores.collect()}
    assert got["greeting", "greet"] == (1.0, "anchor")
    assert got["shake_hand", "greet"][1] in ("edge", "neighbourhood", "keyword")
    assert got["fight", "greet"] == (-0.5, "contrast")
    assert got["greeting", "welcome"][1] in ("phrase", "neighbourhood")
    assert got["arm", "far"] == (0.6, "keyword")

    mentions = spark.createDataFrame([(1, "Shake hand", "action", 1.0, 0), (1, "shake hand", "object", 1.0, 1), (1, "arm", "caption", 1.0, 2), (1, "of", "action", 1.0, 3), (2, "moonless", "action", 1.0, 0)], "item_id int, phrase string, kind string, factor double, ord int")
    terms = evidence.key_terms(mentions)
    assert [(r.phrase, r.salience, r.kinds) for r in terms.where("item_id = 1").orderBy("rank").collect()] == [("shake hand", 1.0, ["action", "object"]), ("arm", 0.5, ["caption"])]
    found = evidence.grounded(terms, graph.resolve(terms.select("phrase"), toy))
    weights = spark.createDataFrame([("t", k, 1.0) for k in evidence.SALIENCE], "task string, kind string, weight double")
    support = evidence.label_support(found, scores, space, weights)
    rows = {(r.item_id, r.label_id): r.support for r in support.collect()}
    assert rows[1, "greet"] == 1.0 and rows[2, "greet"] == 0.0 and all(0 <= v <= 1 for v in rows.values())
    best = evidence.disambiguate(support, support.select("item_id", "task", "label_id", F.lit(0.0).alias("draft")))
    assert {r.item_id: r.label_id for r in best.collect()} == {1: "greet", 2: None}
    shown = evidence.facts(found, profiles, labels.anchor_vocabulary(space), REL).where("item_id = 1").orderBy("place").collect()
    assert shown[0].end == "greeting" and shown[0].relevance == pytest.approx(round(0.8 * (1 - math.exp(-2)) * 2, 4))


def test_lexical_match(spark):
    space = spark.createDataFrame([("t", "shake_hands", 0, "d", [], ["hand"]), ("t", "hold", 1, "d", [], ["hand", "cup"])], dump.LABEL_SCHEMA)
    texts = spark.createDataFrame([(1, "t", "shaking hands"), (2, "t", "cup of tea for me"), (3, "t", "")], "item_id int, task string, text string")
    got = {(r.item_id, r.label_id): r.score for r in labels.lexical_match(texts, labels.lexicon(space)).collect()}
    assert got == {(1, "shake_hands"): 0.75, (1, "hold"): 0.25, (2, "hold"): pytest.approx(1 / 3)}


def scored(spark, supports, **more):
    rows = [(1, "t", f"l{i}", i, float(s), 0.0, 0.0, False) for i, s in enumerate(supports)]
    return spark.createDataFrame(rows, "item_id int, task string, label_id string, ord int, support double, draft double, lexical double, alone boolean")


def test_shortlist(spark):
    chosen = lambda df: [r.label_id for r in df.orderBy("slot").collect()]
    rows = scored(spark, [0.1, 0.9, 0.5, 0.2, 0.0])
    assert chosen(fusion.shortlist(rows, 3)) == ["l1", "l2", "l3"]
    must = spark.createDataFrame([(1, "t", "l4")], "item_id int, task string, label_id string")
    assert chosen(fusion.shortlist(rows, 3, must)) == ["l1", "l2", "l4"]
    alone = rows.withColumn("alone", F.lit(True))
    assert chosen(fusion.shortlist(alone, 3, must, "l0")) == ["l1", "l2", "l0"]
    assert chosen(fusion.shortlist(scored(spark, [0.9, 0.01, 0.0, 0.0]), 2)) == ["l0", "l1", "l2", "l3"]


def test_fusion(spark):
    rows = scored(spark, [1.0, 0.0]).withColumn("slot", F.col("ord") + 1).withColumn("p_scorer", F.lit(0.5))
    got = fusion.rank(fusion.fuse(rows)).orderBy("rank").collect()
    p_support = 1 / (1 + math.exp(-5))
    logits = [0.5 * math.log(p_support + 1e-9), 0.5 * math.log(1 - p_support + 1e-9)]
    p = math.exp(logits[0]) / sum(map(math.exp, logits))
    assert got[0].probability == pytest.approx(p) and sum(r.probability for r in got) == pytest.approx(1)
    assert got[0].margin == pytest.approx(2 * p - 1) and not got[0].ambiguous and got[1].margin is None
    even = fusion.rank(fusion.fuse(scored(spark, [0.0, 0.0]).withColumn("slot", F.col("ord")).withColumn("p_scorer", F.lit(0.5)))).where("rank = 1").first()
    assert even.p_support == 0.5 and even.ambiguous and even.label_id == "l0"
    one = fusion.rank(fusion.fuse(scored(spark, [0.0]).withColumn("slot", F.col("ord")).withColumn("p_scorer", F.lit(1.0)))).first()
    assert one.margin == 1.0
    options = spark.createDataFrame([(1, "t", "q", "a red cup", ""), (1, "t", "q", "a blue cup", "")], "item_id int, task string, question string, option string, context string")
    p = {r.option: r.p_scorer for r in fusion.score_options(options, fusion.prefer("red")).collect()}
    assert p["a red cup"] == pytest.approx(math.exp(2) / (math.exp(2) + 1))


def test_final_evidence(spark):
    rows = spark.createDataFrame([(1, "graph", "b", 2), (1, "graph", "a", 1), (1, "graph", "b", 3), (1, "fact", "f", 1), (2, "fact", "g", 1)], "item_id int, kind string, text string, ord int")
    assert {r.item_id: r.evidence for r in fusion.final_evidence(rows).collect()} == {1: ["a", "b"], 2: ["g"]}


def test_metrics(spark):
    votes = spark.createDataFrame([(1, "x", 0.9, 0), (1, "x", 0.8, 1), (1, "y", 0.95, 2)], "clip int, label_id string, confidence double, ord int")
    best = metrics.weighted_vote(votes, "clip").first()
    assert (best.label_id, best.moments, best.share, best.mean_confidence) == ("x", 2, 0.667, 0.85)
    rows = spark.createDataFrame([(1, 1, None, None), (0, 1, 2, 2), (1, 1, 2, 3), (1, None, 1, 1)], "answer int, answer_label int, rationale int, rationale_label int")
    r = metrics.joint_accuracy(rows).first()
    assert (r.n, round(r.q_a, 3), round(r.qa_r, 3), round(r.q_ar, 3)) == (3, 0.667, 0.667, 0.333)
    log = spark.createDataFrame([(0.5, 1.0), (1.0, 3.0), (1.5, float("nan")), (2.0, 5.0)], "epoch double, loss double")
    assert {r.epoch: r.mean_loss for r in metrics.epoch_loss(log).collect()} == {1: 2.0, 2: 5.0}
    best = metrics.best_epoch(spark.createDataFrame([(1, 0.5, 0.6), (2, 0.5, 0.7), (3, 0.5, 0.7)], "epoch int, q_ar double, q_a double")).first()
    assert best.epoch == 2
    last = dump.last_per_epoch(spark.createDataFrame([(1, 0.1, 0), (1, 0.2, 1)], "epoch int, q double, ord int"))
    assert last.first().q == 0.2
    assert dump.latest_checkpoint(spark.createDataFrame([("a/checkpoint-5", 0), ("b/checkpoint-12", 1), ("c/checkpoint-12", 2), ("x", 3)], "path string, ord int")).first().path == "b/checkpoint-12"


def clip(spark, values, fps=4.0, sharp=None):
    rows = [(1, k, k / fps, float(v), float(sharp[k] if sharp else 100 + k % 3), False, len(values) / fps) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "clip_id int, k int, time_s double, value double, sharpness double, blurry boolean, duration double")


def test_segments_and_moments(spark):
    scenes = [10.0] * 16 + [60.0] * 40 + [300.0] * 80
    scenes[5] = 90.0  # one odd sample is no cut
    samples = clip(spark, scenes)
    cuts = moments.scene_segments(samples.select("clip_id", "k", "value"))
    starts = [r.k for r in cuts.groupBy("segment").agg(F.min("k").alias("k")).orderBy("segment").collect()]
    assert starts == [0, 16, 56]
    picked = moments.key_moments(samples, cuts).orderBy("moment").collect()
    assert len(picked) == 7 and {4.0, 14.0} <= {r.begin_s for r in picked} and picked[-1].time_s > 25
    two = moments.key_moments(samples, cuts, config.MomentSettings(most=2)).collect()
    assert len(two) == 2
    still = clip(spark, [5.0] * 40)
    assert 1 <= moments.key_moments(still, moments.scene_segments(still.select("clip_id", "k", "value"))).count() <= 2


def test_sampling(spark):
    values = [10.0] * 30 + [90.0] * 30
    frames = clip(spark, values, fps=10.0)
    ks = sorted(r.k for r in moments.sampled(frames, config.SamplingSettings(interval_s=1.0)).collect())
    assert ks[0] == 0 and 2 <= len(ks) <= 6 and any(k >= 30 for k in ks)
    assert moments.sampled(frames.withColumn("blurry", F.lit(True))).count() == 0


def test_streaming_sampler_agrees_with_the_batch_one(spark, tmp_path):
    from verdigris.streaming.sampler import sampled_stream

    frames = clip(spark, [10.0] * 25 + [90.0, 10.0] * 10 + [55.0] * 30, fps=3.0).unionByName(clip(spark, [1.0] * 30).withColumn("clip_id", F.lit(2)))
    for i in range(3):
        frames.where(F.col("k") % 75 >= 25 * i).where(F.col("k") % 75 < 25 * (i + 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
    query = sampled_stream(stream.select("clip_id", "k", "time_s", "value", "blurry"), idle=None).writeStream.format("memory").queryName("sampled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.clip_id, r.k) for r in spark.table("sampled").collect())
    assert got == sorted((r.clip_id, r.k) for r in moments.sampled(frames).collect())


def test_streams(spark, tmp_path):
    from verdigris.streaming import sampler

    events = spark.createDataFrame([("a", "queued", "2024-01-01 00:00:00"), ("a", "queued", "2024-01-01 00:10:00"), ("a", "done", "2024-01-01 00:20:00")], "job_id string, state string, ts string").withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "jobs"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "jobs"))
    query = sampler.job_states(stream).writeStream.format("memory").queryName("jobs").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.job_id, r.state) for r in spark.table("jobs").collect()) == [("a", "done"), ("a", "queued")]
    newest = sampler.latest_frames(spark.createDataFrame([("c", 1, 5), ("c", 3, 6), ("d", 2, 7)], "source string, ts int, frame int"))
    assert {r.source: r.frame for r in newest.collect()} == {"c": 6, "d": 7}


def test_qa(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "user", "q3"), (1, 4, "assistant", "a3."), (2, 0, "user", "q4"), (2, 1, "assistant", "a4")], "conv_id int, turn int, role string, text string")
    pairs = qa.turn_pairs(turns)
    assert sorted((r.question, r.gold) for r in pairs.collect()) == [("q1", "a1"), ("q3", "a3."), ("q4", "a4")]
    asked = qa.with_distractors(pairs).collect()
    assert all(r.options[r.answer_label] == r.gold and len(set(r.options)) == len(r.options) == 3 for r in asked)
    made = qa.examples(qa.with_distractors(pairs)).collect()
    assert len(made) == 6 and {r.target for r in made if r.task == "explain"} == {"a1.", "a3.", "a4."}
    parts = qa.split(spark.range(2000).withColumnRenamed("id", "conv_id"), ["conv_id"]).groupBy("part").count().collect()
    assert {r.part for r in parts} == {"test", "select", "train"} and sum(r["count"] for r in parts) == 2000
    x = spark.range(1).select(qa.find_last(F.array(*map(F.lit, [1, 2, 1, 2, 3])), F.array(F.lit(1), F.lit(2))).alias("at"), qa.masked_labels(F.array(*map(F.lit, [5, 9, 7, 0])), F.array(F.lit(9)), 0).alias("m"), qa.masked_labels(F.array(*map(F.lit, [5, 7])), F.array(F.lit(9)), 0).alias("none")).first()
    assert x.at == 2 and x.m == [-100, -100, 7, -100] and x.none == [-100, -100]


def test_vectors(spark):
    row = spark.range(1).select(
        V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("cos"),
        V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("zero"),
        V.bhattacharyya(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("far"),
        V.bhattacharyya(F.array(F.lit(2.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("same"),
        V.fitted_size(F.lit(900.0), F.lit(600.0), 384).alias("size"),
        V.fitted_size(F.lit(150.0), F.lit(100.0), 384).alias("small"),
    ).first()
    assert row.cos == pytest.approx(0.5**0.5) and row.zero == 0 and row.far == 1 and row.same == pytest.approx(0, abs=1e-7)
    assert tuple(row.size) == (384, 256) and tuple(row.small) == (150, 100)
    p = spark.range(3).select(V.softmax(F.col("id").cast("double"), Window.partitionBy()).alias("p")).collect()
    assert sum(r.p for r in p) == pytest.approx(1)


def test_images(spark):
    import numpy as np

    noise = np.random.default_rng(0).integers(0, 256, (60, 90, 3), dtype=np.uint8)
    flat = np.full((60, 90, 3), 20, np.uint8)
    rows = spark.createDataFrame([(1, noise.tobytes(), 60, 90, 3), (2, flat.tobytes(), 60, 90, 3), (3, None, 60, 90, 3)], "id int, pixels binary, height int, width int, channels int")
    got = {r.id: r for r in images.assess(rows).collect()}
    assert not got[1].is_blurry and not got[1].is_dark and got[2].is_blurry and got[2].is_dark and got[2].is_flat and got[3].brightness is None


def test_sinks(spark):
    rows = spark.createDataFrame([(1, [0.123456789], {"a": 1.00000049}, bytearray(b"x"))], "id int, p array<double>, m map<string,double>, image binary")
    assert sinks.result_json(rows).first().json == '{"id":1,"p":[0.123457],"m":{"a":1.0}}'
    kept = sinks.history(spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "id string, ts int"), 2).collect()
    assert [(r.id, r.ts) for r in kept] == [("a", 3), ("b", 2)]


def test_config(tmp_path):
    file = tmp_path / "s.yaml"
    file.write_text("graph:\n  facts: 7\nsampling:\n  blur: 5.0\n")
    s = config.load(file, ["graph.facts=9", "reasoning.margin=0.5"])
    assert (s.graph.facts, s.sampling.blur, s.reasoning.margin, s.graph.terms) == (9, 5.0, 0.5, 20)
    assert config.load().graph.facts == 40
    with pytest.raises(KeyError):
        config.load(None, ["graph.none=1"])
    with pytest.raises(FileNotFoundError):
        config.load(tmp_path / "none.yaml")


def test_labels_file(spark, tmp_path):
    file = tmp_path / "labels.yaml"
    file.write_text("activity:\n- id: talk\n  anchors: [talking]\n- id: wave\n  description: waving\n")
    rows = dump.read_labels(spark, file, ("activity",)).collect()
    assert [(r.label_id, r.description, r.anchors, r.keywords) for r in rows] == [("talk", "talk", ["talking"], []), ("wave", "waving", [], [])]
    with pytest.raises(ValueError):
        dump.read_labels(spark, file, ("relationship",))


def test_rest(monkeypatch):
    import io
    import json
    import urllib.error

    calls = []

    def answer(url, timeout):
        calls.append(url)
        if len(calls) == 1:
            raise urllib.error.HTTPError(url, 503, "busy", {}, None)
        edge = lambda a, b: {"start": {"@id": f"/c/en/{a}"}, "end": {"@id": f"/c/{'fr' if b == 'x' else 'en'}/{b}"}, "rel": {"label": "IsA"}, "weight": len(calls)}
        page = {"edges": [edge("cat", "x"), edge("cat", f"n{len(calls)}")]}
        if len(calls) == 2:
            page["view"] = {"nextPage": "/more"}
        return io.StringIO(json.dumps(page))

    monkeypatch.setattr(rest, "fetch", lambda url: _fetch(url, backoff=0.0, open_url=answer))
    reader = rest.GraphReader({"url": "http://api", "terms": "cat", "limit": "5"})
    rows = list(reader.read(reader.partitions()[0]))
    assert [(r[0], r[3]) for r in rows] == [("cat", "n3"), ("cat", "n2")] and calls[-1] == "http://api/more"
    assert rest.choose("auto", True, lambda: False) == "local" and rest.choose("auto", False, lambda: False) == "offline" and rest.choose("api", False, lambda: False) == "api"
    with pytest.raises(ValueError):
        rest.choose("x", True, lambda: True)


_fetch = rest.fetch


def test_graph_tables(toy, spark):
    graph.save_graph(toy, "toy_graph", buckets=2)
    assert spark.table("toy_graph_by_start").count() == spark.table("toy_graph_by_end").count() == 10
    plan = spark.table("toy_graph_by_start").groupBy("start").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    for name in ("by_start", "by_end", "meta"):
        spark.sql(f"DROP TABLE toy_graph_{name}")


def test_pandas_is_only_where_it_is_needed(toy):
    assert isinstance(pd.DataFrame(), pd.DataFrame)
    plan = graph.profile(graph.neighbours(toy), REL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("pairs, answers", [(40, 40), (40, 3), (5, 1), (3, 2)])
def test_every_question_has_its_distractors(spark, pairs, answers):
    rows = spark.createDataFrame([(f"c{i}", i, f"q{i}", f"answer {i % answers}") for i in range(pairs)], "conv_id string, turn int, question string, gold string").repartition(7)
    got = qa.with_distractors(rows).collect()
    assert len(got) == pairs
    for r in got:
        assert len(set(r.options)) == len(r.options) == min(4, answers)
        assert r.options[r.answer_label] == r.gold
    assert {r.turn: r.options for r in got} == {r.turn: r.options for r in qa.with_distractors(rows.coalesce(1)).collect()}
    none = spark.createDataFrame([("c", 1, "q", None)], rows.schema)
    assert [(r.options, r.answer_label) for r in qa.with_distractors(none).collect()] == [([], None)]


def test_resolve_looks_at_the_heaviest_edges_only(spark):
    loops = [(f"r{i}", "cat", "cat", 9.0, "") for i in range(3)]
    edges = spark.createDataFrame([*loops, ("isa", "cat", "animal", 2.0, ""), ("isa", "dog", "animal", 1.0, "")], "rel string, start string, end string, weight double, surface string")
    phrases = spark.createDataFrame([("cat",), ("dog",), ("the animal",)], "phrase string")
    found = lambda limit: {r.phrase: r.found for r in graph.resolve(phrases, edges, limit).collect()}
    # Each self-loop is there once per direction, so six edges come before the cat's other one.
    assert found(7) == {"cat": True, "dog": True, "the animal": True}
    assert found(6) == {"cat": False, "dog": True, "the animal": True}


def test_repeated_pairs_have_their_distractors_once(spark):
    rows = [("c", 1, "q", "a1"), ("c", 1, "q", "a1"), ("c", 1, "q", "b"), ("d", 1, "q", "a2"), ("d", 2, "q", "a3"), ("d", 3, "q", "a4"), ("d", 4, "q", "a5")]
    got = qa.with_distractors(spark.createDataFrame(rows, "conv_id string, turn int, question string, gold string")).collect()
    assert len(got) == len(rows) and all(len(set(r.options)) == len(r.options) == 4 and r.options[r.answer_label] == r.gold for r in got)
    twice = [r.options for r in got if r.gold == "a1"]
    assert twice[0] == twice[1]


def test_a_stream_forgets_idle_clips(spark, tmp_path):
    import time

    frames = clip(spark, [10.0] * 9 + [90.0] * 9, fps=1.0).select("clip_id", "k", "time_s", "value", "blurry")
    frames.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
    query = sampled_stream(stream, most=2, idle="1 second").writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "log")).start()
    until = time.time() + 60
    while time.time() < until and not (query.recentProgress and query.recentProgress[-1]["stateOperators"] and query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 0 and spark.table("idle").count()):
        time.sleep(0.5)
    query.stop()
    assert spark.table("idle").count() == 2 and query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 0


def test_frames_of_colour(spark):
    from verdigris.operators import images

    red, gray = bytes([200, 0, 0] * 4), bytes([9, 9, 9] * 2 + [0, 0, 255] * 2)
    rows = spark.createDataFrame([(1, bytearray(red), 2, 2, 3), (2, bytearray(gray), 2, 2, 3), (3, None, 2, 2, 3), (4, bytearray(b"x"), 1, 1, 1)], "id int, pixels binary, height int, width int, channels int")
    got = {r.id: r.h for r in rows.select("id", images.colour_histogram(4)("pixels", "height", "width", "channels").alias("h")).collect()}
    assert got[1] == [0, 0, 0, 1] + [0] * 12 and got[3] is None and got[4] is None
    assert got[2][0] == 0.5 and got[2][2 * 4 + 3] == 0.5  # blue is two thirds of the circle
    assert sum(got[2]) == 1


def test_settings_from_the_environment(tmp_path):
    file = tmp_path / "s.yaml"
    file.write_text("graph:\n  facts: 7\n")
    s = config.from_environment({"VERDIGRIS_SET": " graph.terms=3 ,,", "VERDIGRIS_CONFIG": str(file)})
    assert (s.graph.facts, s.graph.terms) == (7, 3)
    assert config.from_environment({}) == config.load()


def test_missing_weights_and_failed_connections():
    import urllib.error

    page = {"edges": [{"rel": {"label": "IsA"}, "start": {"@id": "/c/en/a"}, "end": {"@id": "/c/en/b"}, "weight": None, "surfaceText": None}]}
    assert list(rest.edges_of(page)) == [("IsA", "a", "b", 1.0, "")]
    calls = []

    class Reply:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def read(self, *_):
            return b'{"edges": []}'

    def flaky(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.URLError("refused")
        return Reply()

    assert rest.fetch("http://x", backoff=0, open_url=flaky) == {"edges": []} and len(calls) == 3
