import pytest

from verdigris.operators import evidence, fusion, graph
from verdigris.plans import pipeline
from verdigris.sources import dump

REL = graph.Relations({"UsedFor": 0.9, "IsA": 0.8, "RelatedTo": 0.6}, ("Antonym",), ("IsA",))
QUESTIONS = {t: f"Which {t}?" for t in pipeline.TASKS}


@pytest.fixture(scope="module")
def world(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # a few rows through many small joins
    edges = spark.createDataFrame(
        [("UsedFor", "shake_hand", "greeting", 3.0, ""), ("RelatedTo", "suit", "business", 2.0, ""), ("RelatedTo", "cake", "party", 2.0, ""), ("Antonym", "fight", "greeting", 2.0, ""), ("RelatedTo", "office", "business", 3.0, "")],
        "rel string, start string, end string, weight double, surface string",
    )
    space = spark.createDataFrame(
        [
            ("activity", "greeting_someone", 0, "people greet", ["greeting"], ["greet"]), ("activity", "celebrating", 1, "people celebrate", ["party"], ["cake"]), ("activity", "no_interaction", 2, "no interaction", [], []),
            ("relationship", "colleagues", 0, "they work together", ["business"], ["office"]), ("relationship", "friends", 1, "they are friends", ["friend"], []), ("relationship", "none_single", 2, "one person", [], []),
            ("intention", "to_meet", 0, "to meet", ["greeting"], ["meet"]), ("intention", "to_eat", 1, "to eat", ["food"], ["eat"]),
        ],
        dump.LABEL_SCHEMA,
    )
    weights = spark.createDataFrame([(t, k, 1.0) for t in pipeline.TASKS for k in evidence.SALIENCE], "task string, kind string, weight double")
    items = spark.createDataFrame(
        [
            ("two", "Two men shaking hands in an office", 2, ["man in suit", "young man"], ["suit"], ["shaking hands"], [], "office", ("greeting each other", "colleagues", "to meet"), None),
            ("one", "A woman with a cake", 1, ["woman"], ["cake"], [], [], "kitchen", ("", "", ""), "What does she eat?"),
            ("none", None, 0, None, None, None, None, None, None, None),
        ],
        pipeline.ITEM,
    )
    yield items, edges, space, weights
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_mentions_and_enrichment(world):
    items, edges, space, weights = world
    rows = {(r.item_id, r.phrase, r.kind) for r in pipeline.mentions(items).collect()}
    assert ("two", "shaking hands", "action") in rows and ("two", "man", "person") in rows and ("one", "woman", "person") in rows
    assert ("two", "man in suit", "role") in rows and ("two", "suit", "role") in rows
    made = pipeline.enrich(items, edges, space, REL, weights)
    support = {(r.item_id, r.task, r.label_id): r.support for r in made.support.collect()}
    assert support["two", "activity", "greeting_someone"] > support["two", "activity", "celebrating"]
    assert support["two", "relationship", "colleagues"] > support["two", "relationship", "friends"] and 0 < support["one", "activity", "celebrating"] < 1
    assert all(0 <= v <= 1 for v in support.values())
    best = {(r.item_id, r.task): r.label_id for r in made.best.collect()}
    assert best["two", "activity"] == "greeting_someone" and best["two", "relationship"] == "colleagues"
    assert made.facts.where("item_id = 'two' and end = 'greeting'").count() == 1


def test_predictions(world):
    items, edges, space, weights = world
    got = pipeline.run(items, edges, space, REL, weights, fusion.prefer("friends"), QUESTIONS).collect()
    top = {(r.item_id, r.task): r for r in got if r.rank == 1}
    assert top["two", "activity"].label_id == "greeting_someone"
    assert (top["one", "relationship"].label_id, top["one", "relationship"].probability) == ("none_single", 1.0)
    assert top["none", "activity"].probability == 0.0 and top["none", "intention"].ambiguous
    sums = {}
    for r in got:
        sums[r.item_id, r.task] = sums.get((r.item_id, r.task), 0.0) + r.probability
    assert all(abs(s - 1) < 1e-6 for (item, _), s in sums.items() if item != "none")
    assert not any(r.label_id == "none_single" for r in got if r.item_id == "two")
