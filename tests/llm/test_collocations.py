"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np

from verdigris.llm import collocations as C


def brute(rows, fewest, most=2000, absorbed=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = {}
    kept = {p: a for p, a in f.items() if a >= fewest}
    for (lang, w), a in kept.items():
        if len(w) < 2:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        inside = [b for (other, v), b in kept.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if not any(100 * b >= absorbed * a for b in inside):
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:most]))


def mined(spark, rows, **more):
    df = C.collocations(spark.createDataFrame(rows, "lang string, text string"), **more)
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


def texts(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(8)] + ["É", "Ab", "x y"]
    fixed = [["new", "york", "city"], ["in", "order", "to", "be", "sure"], ["Of", "Course"]]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(r.randrange(30)):
            parts += r.choice(fixed) if r.random() < 0.4 else [r.choice(words)]
            if r.random() < 0.2:
                parts.append(r.choice([".", ", ", "!\n", "\x0b", "\t"]))
        rows.append((r.choice(["en", "fr", None]), " ".join(parts)))
    return rows


def test_equals_brute_force(spark):
    rows = texts(1, 150)
    want = brute(rows, 8)
    assert len(want) > 50 and {x[0] for x in want} == {"en", "fr", "und"} and any(x[2].count(" ") == 4 for x in want)
    assert mined(spark, rows, fewest=8) == want


def test_limit_and_absorption(spark):
    rows = texts(2, 80)
    assert mined(spark, rows, fewest=5, most=7, absorbed=60) == brute(rows, 5, 7, 60)


def test_odd_rows(spark):
    rows = [(None, None), ("en", None), ("en", ""), ("", "a b. " * 6), ("en", "a b. " * 3), ("en", "a b. " * 3), ("fr", " ".join(f"w{i % 3}" for i in range(20_000)))]
    assert mined(spark, rows, fewest=6) == brute(rows, 6)
    assert mined(spark, []) == []


def test_summaries_keep_what_is_frequent():
    """However the stream is cut, and whatever the order of merging."""
    r = np.random.default_rng(3)
    stream = np.concatenate([r.integers(0, 1 << 60, 20_000), np.repeat(r.integers(0, 1 << 60, 9), 210)]).astype(np.uint64)
    r.shuffle(stream)
    fewest = 200
    capacity = len(stream) // fewest + 1
    for parts in (2, 7, 40):
        total, error = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 0
        for part in np.array_split(stream, parts):
            *own, off = C.reduced(*np.unique(part, return_counts=True), capacity)
            *total, more = C.reduced(*C.merged(total, own), capacity)
            error += off + more
            assert len(total[0]) <= capacity
        keys, counts = np.unique(stream, return_counts=True)
        true = dict(zip(keys.tolist(), counts.tolist(), strict=True))
        assert error < fewest and set(keys[counts >= fewest]) <= set(total[0])
        # Counters bound true counts from both sides.
        assert all(c <= true[k] <= c + error for k, c in zip(total[0].tolist(), total[1].tolist(), strict=True))


def test_large_products(spark):
    """Counts whose products need more than 64 bits."""
    big = 3_000_000_000_001
    row = spark.sql(f"SELECT CAST((1000 * CAST({big} AS DECIMAL(17,0)) * CAST({7 * big} AS DECIMAL(17,0))) DIV (CAST({2 * big} AS DECIMAL(17,0)) * CAST({3 * big} AS DECIMAL(17,0))) AS BIGINT) AS s").first()
    assert row.s == 1000 * big * 7 * big // (6 * big * big)


def test_packed_keys():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 50).astype(np.uint64) * np.uint64(2)
    assert len(C.packed(keys)) == 300 and (C.unpacked(C.packed(keys)) == keys >> np.uint64(16) << np.uint64(16)).all()
    assert len(C.unpacked(C.packed(keys[:0]))) == 0
