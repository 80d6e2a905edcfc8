import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from verdigris.llm import queries, topk


def brute(rows):
    """Results of (vec_id, vector) rows by the definition, in whole numbers of any size."""
    ints = [(i, [256 * int(c) if abs(c) >= 2**53 else int(np.floor(256 * c)) for c in map(float, v)]) for i, v in rows]
    out = []
    for q in sorted({i for i, _ in ints if i % 50 == 0}):
        scores = [(-sum(a * b for a, b in zip(x, y)), i) for p, x in ints if p == q for i, y in ints if i != q and len(y) == len(x)]
        out += [(q, rank + 1, i, -s if abs(s) < 2**63 else None) for rank, (s, i) in enumerate(sorted(scores)[:5])]
    return out


def rows_of(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def by_sql(df):
    c = duckdb.connect()
    c.register("embeddings", df.select("vec_id", "embedding").toPandas())
    return sorted(c.sql(f"SELECT query_id, rank, vec_id, score FROM ({queries.ORACLES['op7_topk']})").fetchall())


def test_search(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, rng.normal(0, 1, 64).astype(np.float32).tolist()) for i in range(260)]
    vectors[7] = (7, vectors[50][1])
    vectors[8] = (8, vectors[9][1])  # ties
    again = [(9, vectors[9][1]), (50, vectors[50][1]), (50, vectors[3][1]), (60, vectors[50][1])]  # repeated rows and ids
    odd = [(300, [1.0] * 3), (301, [2.0] * 3), (350, [])]
    bad = [(400, None), (450, [float("nan")] * 64), (451, [None] * 64), (500, [float("inf")] + [0.0] * 63), (None, [1.0] * 64)]
    df = spark.createDataFrame([(i, v, 1) for i, v in [*vectors, *again, *odd, *bad]], "vec_id long, embedding array<float>, score int")
    got = rows_of(topk.search(df, "vec_id % 50 = 0"))
    assert got == brute([*vectors, *again, *odd])
    full = df.where("size(embedding) = 64")
    assert rows_of(topk.search(full, "vec_id % 50 = 0")) == by_sql(full)
    assert topk.search(df.limit(0), "true").count() == 0


def test_large_components(spark):
    rows = [(50, [1.0, 1.0]), (1, [1e7, 0.0]), (2, [1e9, 0.0]), (3, [3e9, 1.0]), (4, [-1e9, 0.5]), (5, [2.5, 1e9]), (6, [2.5, 1e9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = rows_of(topk.search(df, "vec_id % 50 = 0"))
    assert got == brute(rows) == by_sql(df)
    assert got[0] == (50, 1, 3, 256 * 256 * 3_000_000_001)
    huge = [*rows, (7, [1e300, 1.0]), (8, [1e300, 2.0]), (9, [1.7e308, 0.0]), (10, [-1e300, 0.0]), (100, [-1e300, 1e5])]
    assert rows_of(topk.search(spark.createDataFrame(huge, df.schema), "vec_id % 50 = 0")) == brute(huge)


@pytest.mark.parametrize("dim", [1, 3, 64])
def test_bounds_hold(dim):
    rng = np.random.default_rng(dim)
    q, x = topk.scaled(rng.normal(0, 1, (20, dim))), topk.scaled(rng.normal(0, 1, (30, dim)))
    exact = q @ x.T
    for segments in topk.LEVELS:
        bound = topk.features(q, segments) @ topk.features(x, segments).T
        assert (bound >= exact - 1e-6 * np.abs(exact) - 1e-6).all()


def share_of_exact_scores(ids, x, q_ids, q):
    """Runs all blocks of candidates past the queries; checks every result."""
    floor, found, computed = np.full(len(q), -np.inf), [], 0
    for a in range(0, len(ids), topk.CANDIDATES):
        part = slice(a, a + topk.CANDIDATES)
        r, c, s, n = topk.best_of_block(q_ids, q, ids[part], x[part], 5, floor)
        found += zip(r.tolist(), (-s).tolist(), ids[part][c].tolist(), strict=True)
        computed += n
    exact = (topk.scaled(q) @ topk.scaled(x).T).astype(np.int64)
    for i in range(len(q)):
        want = sorted((-exact[i, j], ids[j]) for j in range(len(ids)) if ids[j] != q_ids[i])[:5]
        assert sorted((s, j) for r, s, j in found if r == i)[:5] == want
    return computed / exact.size


def test_bounds_prune_clusters_without_loss():
    rng = np.random.default_rng(4)
    centre = rng.normal(0, 1, (40, 64))
    x = centre[rng.integers(0, 40, 5000)] + rng.normal(0, 0.05, (5000, 64))
    share = share_of_exact_scores(np.arange(5000), x, np.arange(9000, 9040), centre[rng.integers(0, 40, 40)])
    assert share < 0.1


def test_bounds_prune_the_shared_table():
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"].to_numpy(zero_copy_only=False)).astype(np.float64)
    asked = ids % 50 == 0
    assert share_of_exact_scores(ids, x, ids[asked], x[asked]) < 0.6
