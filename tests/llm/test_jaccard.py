"""Jaccard components against a brute force over all pairs of documents."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from verdigris.llm import jaccard
from verdigris.llm.words import WordHashes

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute(rows, percent=85):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None and sets[i]:
            ids.setdefault(find(i), []).append(doc_id)
    return sorted(((d, len(s), min(ids.get(find(i), [None])) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def joined(spark, rows, percent=85):
    df = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), percent)
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(map(tuple, df.collect()), key=repr)


def copies(r, n=120):
    """Texts with near copies at all distances, shared passages and repeated rows."""
    word = lambda: r.choice("abcdefghij") + str(r.randrange(400))
    passage = [word() for _ in range(30)]
    rows, texts = [], []
    for i in range(n):
        if texts and r.random() < 0.6:
            words = list(r.choice(texts))
            for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
                words[r.randrange(len(words))] = word()
            if r.random() < 0.3:
                words = words[r.randrange(3) :]
        else:
            words = [word() for _ in range(r.choice([1, 3, 4, 8, 9, 12, 40, 90, 300]))] + passage * (r.random() < 0.4)
        texts.append(words)
        rows.append((r.randrange(10_000), " ".join(words)))
    return rows


def test_equals_brute_force(spark):
    rows = copies(random.Random(3))
    want = brute(rows)
    assert 20 < sum(a != c for a, _, c in want) < 110
    assert joined(spark, rows) == want


@pytest.mark.parametrize("percent", [60, 100])
def test_other_thresholds(spark, percent):
    rows = copies(random.Random(percent), 60)
    assert joined(spark, rows, percent) == brute(rows, percent)


def test_blocks_of_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_SETS", 4)
    r = random.Random(8)
    base = [f"w{i}" for i in range(70)]
    rows = []
    for i in range(60):  # a hub of copies, and copies of copies at the border of the threshold
        words = list(base if i % 3 else r.choice([w for _, w in rows] or [" ".join(base)]).split())
        for _ in range(r.choice([1, 2, 3])):
            words[r.randrange(70)] = f"x{i}-{r.randrange(99)}"
        rows.append((100 - i, " ".join(words)))
    assert joined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(None, None), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (None, "one"), (6, long), (7, long + " end"), (8, "É é"), (9, "é é"), (9, "one"), (None, "alone here")]
    assert joined(spark, rows) == brute(rows)
    assert joined(spark, []) == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e", "x", 3), (2, "A b c d e", "y", 4)], "doc_id long, text string, node string, `id.mark` long")
    assert sorted(map(tuple, jaccard.jaccard_components(df).collect())) == [(1, 2, 1), (2, 2, 1)]


def test_linked_sets_share_a_signature(monkeypatch):
    """With all classes of shingles in play, whatever their frequencies."""
    monkeypatch.setattr(jaccard, "RARE", 2)
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    r = np.random.default_rng(5)
    join = jaccard.Join()
    met = 0
    for _ in range(400):
        n = int(r.choice([6, 7, 8, 13, 20, 50, 130, 400]))
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        y = x.copy()
        gone = int(r.integers(0, join.missing(len(x)) + 1))
        y = np.delete(y, r.choice(len(y), gone, replace=False))
        y = np.unique(np.concatenate([y, r.integers(0, 1 << 63, int(r.integers(0, 4))).astype(np.uint64)]))
        common = len(np.intersect1d(x, y))
        if not join.links(common, len(x), len(y)) or len(y) == common == len(x):
            continue
        met += 1
        df = {int(t): int(r.choice([1, 2, 3, 5])) for t in np.union1d(x, y)}
        for t in np.intersect1d(x, y):
            df[int(t)] = max(2, df[int(t)])
        signed = []
        for s in (x, y):
            front, first = jaccard.prefix_tokens(s, join)
            own = np.array([df[int(t)] for t in front])
            keep = (own > 1) | (front >= jaccard.FIRST)
            signed.append(set(jaccard.set_signatures(len(s), first, front[keep], own[keep], join)))
        assert signed[0] & signed[1]
    assert met > 100


def test_frequencies_over_batches(monkeypatch):
    monkeypatch.setattr(jaccard, "SATURATED", 5)
    rows = sorted((t, d) for t in range(1, 40) for d in range(t % 13))
    rows += rows[::7]
    rows.sort()
    batches = []
    for a in range(0, len(rows), 3):
        part = rows[a : a + 3]
        batches.append(pa.record_batch([pa.array([t for t, _ in part]), pa.array([d for _, d in part]), pa.array([1] * len(part), pa.int32()), pa.array([1] * len(part), pa.int32())], names=["token", "node", "n", "first"]))
    got = sorted((t, d, f) for b in jaccard._frequencies(iter(batches)) for d, t, f in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True))
    assert got == sorted((t, d, min(5, t % 13)) for t in range(1, 40) for d in range(t % 13) if t % 13 > 1)


def test_hashes_forget_words_when_full():
    hashes = WordHashes()
    a = hashes.of([b"one", b"two"])
    hashes.clear()
    assert (a == hashes.of([b"one", b"two"])).all()
