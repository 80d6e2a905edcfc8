import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from verdigris.llm import graph, simhash


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c d", "A b C d e f É É é", "x " * 999, "tab\tand\x0bvt é\xa0x"])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_golay_code_is_perfect():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 2000)
    index = simhash.decode(words)
    for flips in range(4):
        base = simhash.decode(words)
        # The codeword of an index: decode again from the word itself.
        error = np.zeros(len(words), np.int64)
        for _ in range(flips):
            error ^= 1 << rng.integers(0, 23, len(words))
        by_byte, table = simhash._tables()
        code = words ^ table[by_byte[0][words & 255] ^ by_byte[1][words >> 8 & 255] ^ by_byte[2][words >> 16]]
        assert np.array_equal(simhash.decode(code ^ error), base)
    assert index.min() >= 0 and index.max() < 4096


def test_links_share_a_key():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(a)):
        for bit in rng.choice(64, i % 5, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    rows_a, keys_a = simhash.keys(a)
    rows_b, keys_b = simhash.keys(b)
    mine = set(zip(rows_a.tolist(), keys_a.tolist()))
    assert len(mine) == len(keys_a)
    assert len({r for r, k in zip(rows_b.tolist(), keys_b.tolist()) if (r, k) in mine}) == len(a)


def brute_components(prints):
    u = np.unique(np.array(prints, np.uint64))
    root = np.arange(len(u))
    close = np.bitwise_count(u[:, None] ^ u[None, :]) <= 4
    while True:
        new = np.array([root[close[i]].min() for i in range(len(u))])
        if np.array_equal(new, root):
            return {int(x): int(r) for x, r in zip(u, root)}
        root = new


def grown(n, seed=2):
    """Fingerprints in chains of small steps, and strangers."""
    rng = np.random.default_rng(seed)
    out = []
    x = int(rng.integers(0, 1 << 63))
    for i in range(n):
        if i % 40 == 0:
            x = int(rng.integers(0, 1 << 63))
        for bit in rng.choice(64, int(rng.integers(1, 7)), replace=False):
            x ^= 1 << int(bit)
        out.append(x & ((1 << 64) - 1))
    return out


@pytest.mark.parametrize("large", [2048, 3])
def test_components_are_those_of_all_links(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE_GROUP", large)
    prints = grown(200)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in sorted(set(prints))], "print long")
    # The workers import the module afresh, so the small limit is passed by a closure here.
    roots = {r.node: r.root for r in graph.components(simhash.links(df)).collect()}
    want = brute_components(prints)
    groups = {}
    for p, r in want.items():
        node = int(np.uint64(p).view(np.int64))
        groups.setdefault(r, set()).add(roots.get(node, node))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_groups_beyond_the_limit_are_passed_on(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(simhash, "LARGE_GROUP", 3)
    key = np.array([1] * 2 + [5] * 9 + [7] * 3, np.int64)
    value = np.arange(len(key), dtype=np.int64) * 3
    batches = [pa.record_batch([pa.array(key[a : a + 2]), pa.array(value[a : a + 2])], names=["key", "print"]) for a in range(0, len(key), 2)]
    rows = [r for b in simhash._compare(iter(batches)) for r in b.to_pylist()]
    assert {r["a"] for r in rows if r["b"] is None} == set(value[key == 5].tolist())
    words = simhash.halfway(np.array([0, 0b1111, 0b11111], np.uint64))
    assert words.shape == (3, 2081) and len(set(words[0]) & set(words[1])) > 0 and not set(words[0]) & set(words[2])


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    roots = {r.node: r.root for r in graph.components(links).collect()}
    assert all(roots[i] == 0 for i in range(301)) and roots[1001] == 1000
    assert graph.components(links.limit(0)).count() == 0


def test_near_duplicates(spark, documents):
    base = " ".join(f"word{i}" for i in range(400))
    texts = ["other words entirely here now", base, base, base.replace("word17 ", "changed "), None, "", "  ", base.upper()]
    docs = documents(*texts, (None, base, "en", "s"), (1, base, "en", "s")).withColumnRenamed("source", "print")
    got = simhash.near_duplicates(docs).collect()
    want = brute_components([simhash.fingerprint(t) for t in texts])
    assert len(got) == len(texts) + 2
    by_id = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if want[simhash.fingerprint(u)] == want[simhash.fingerprint(t)]]
        assert by_id[i].component_id == min(same)
        assert by_id[i].fingerprint == f"{simhash.fingerprint(t):016x}"
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({r.component_id for r in got})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark, documents):
    base, other = " ".join(f"word{i}" for i in range(60)), " ".join(f"thing{i}" for i in range(60))
    rows = [(1, base, "en", "a"), (1, other, "en", "b"), (1, other, "en", "b"), (2, base, "de", "c"), (None, base), (None, "no id and no copy at all"), (None, "no id and no copy at all"), (3, None), (4, "")]
    docs = documents(*rows).withColumn("mark", F.lit(1)).withColumn("row", F.array(F.lit(2))).withColumn("id", F.create_map(F.lit(1), F.lit(2)))
    for frame in (docs, docs.repartition(5, "text")):
        kept = simhash.keep_first(frame)
        assert kept.columns == docs.columns
        got = sorted(((r.doc_id, r.text, r.source) for r in kept.collect()), key=str)
        assert got == sorted([(1, base, "a"), (1, other, "b"), (None, "no id and no copy at all", None), (3, None, None)], key=str)
