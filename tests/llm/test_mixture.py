import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verdigris.llm import mixture


def highest_quotients(votes, seats, most):
    got = [0] * len(votes)
    for _ in range(seats):
        able = [(votes[i] / (2 * got[i] + 1), -i) for i in range(len(votes)) if got[i] < most[i] and votes[i] > 0]
        if not able:
            break
        got[-max(able)[1]] += 1
    return got


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 30)), min_size=1, max_size=9), st.integers(0, 60))
def test_apportionment(parties, seats):
    votes, most = np.array(parties).T
    assert mixture.sainte_lague(votes, seats, most).tolist() == highest_quotients(votes.tolist(), seats, most.tolist())


def test_targets_are_capped_and_reshared():
    sizes = np.array([10, 100, 1000])
    target = mixture.targets(sizes, np.array([5.0, 2.0, 1.0]))
    assert target.tolist() == [30.0, 300.0, 780.0] and target.sum() == sizes.sum()
    assert mixture.targets(np.array([0, 0]), np.array([5.0, 2.0])).tolist() == [0.0, 0.0]


def taken_by_blocks(sizes, block, quota, turn):
    """Each document's taken words, block by block and word by word."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    n = max(1, -(-len(owner) // block))
    out = np.zeros(len(sizes), int)
    for j in range(n):
        times = ((j + 1) * quota + turn) // n - (j * quota + turn) // n
        for o in owner[j * block : (j + 1) * block]:
            out[o] += times
    return out.tolist()


def test_mix(spark, documents):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(0, 40)), "en", [None, "a", "b", "ä", "hot"][min(4, int(rng.integers(0, 9)))]) for i in range(700)]
    rows += [(700, None, "en", "a"), (701, "", "en", "only empty"), (None, "x y z", "en", "a"), (5, "again here", "en", "b"), (5, "again here", "en", "b")]
    docs = documents(*rows).withColumnRenamed("lang", "size")
    got = mixture.mix(docs).toPandas()
    assert len(got) == len(rows) and got["size"].sum() == sum(len((r[1] or "").split()) for r in rows)
    assert (got.taken >= 0).all() and (got.taken <= 3 * got["size"]).all()
    by = got.groupby(["source_size", "target"]).agg(taken=("taken", "sum")).reset_index("source_size")
    assert (abs(by.taken - by.index) <= 0.02 * by.index + 2).all()
    again = mixture.mix(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "source_size", "target", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert mixture.mix(docs.limit(0)).count() == 0


def test_places_in_the_stream_are_those_of_the_blocks(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    for _ in range(12):
        sizes = rng.integers(0, 12, 9)
        block, quota = int(rng.integers(1, 7)), 0
        n = max(1, -(-int(sizes.sum()) // block))
        quota, turn = int(rng.integers(0, 3 * n + 1)), int(rng.integers(0, n))
        want = taken_by_blocks(sizes, block, quota, turn)
        ends = np.cumsum(sizes)
        before = lambda j: (j * quota + turn) // n
        upto = lambda x: block * before(x // block) + x % block * (before(x // block + 1) - before(x // block))
        assert [int(upto(e) - upto(e - s)) for e, s in zip(ends, sizes)] == want
    assert F is not None


def test_repeated_documents(spark, documents):
    docs = documents(*[(i, "w " * (i % 9), "en", "abc"[i % 3]) for i in range(300)], (None, "x y", "en", "a"))
    docs = docs.withColumnRenamed("n_chars", "mix_copies")
    out = mixture.repeat_documents(docs)
    assert out.columns == docs.columns
    times = out.groupBy("doc_id").count().toPandas()["count"]
    assert times.max() <= 3
    assert out.where("text = ''").count() == 0
    assert mixture.repeat_documents(docs.limit(0)).count() == 0


def emitted(docs):
    out = mixture.repeat_documents(docs)
    assert out.columns == docs.columns
    return sum(len((r.text or "").split()) for r in out.collect()), sum(r.taken for r in mixture.mix(docs).collect())


@pytest.mark.parametrize("ids", ["plain", "none", "one", "pairs"])
def test_as_many_words_as_the_mix(spark, documents, ids):
    """Whatever the ids, and with a column whose name has a dot."""
    rng = np.random.default_rng(7)
    id_of = {"plain": lambda i: i, "none": lambda i: None, "one": lambda i: 5, "pairs": lambda i: i // 2}[ids]
    rows = [(id_of(i), " ".join(f"w{i}" for _ in range(int(rng.integers(20, 90)))), "en", "abcd"[min(3, int(rng.integers(0, 6)))]) for i in range(900)]
    docs = documents(*rows).withColumnRenamed("lang", "a.b")
    got, want = emitted(docs)
    assert abs(got - want) <= 0.01 * want


def test_equal_rows_share_their_copies(spark, documents):
    rows = [(1, "a b c", "en", "s")] * 6 + [(2, "d e f g", "en", "s")] * 5 + [(3, "h i", "en", "t")]
    got, want = emitted(documents(*rows))
    assert abs(got - want) <= 4


@pytest.mark.parametrize("text, n", [(None, 0), ("", 0), (" a\tb\nc\x0bd  ", 4), ("é\xa0ñ", 1)])
def test_words(spark, documents, text, n):
    from pyspark.sql import functions as F

    assert documents(text).select(mixture.words(F.col("text"))).first()[0] == n
