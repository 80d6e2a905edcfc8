"""Spelling variants against a brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from verdigris.llm import variants

LETTERS = "abeélnorst"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if v != w and one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()), key=repr)


def grouped(spark, rows):
    df = variants.group_variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_equals_brute_force(spark):
    r = random.Random(4)
    base = ["".join(r.choices(LETTERS, k=r.randint(7, 11))) for _ in range(11)] + ["".join(r.choices(LETTERS, k=17))]

    def slip(w):
        i, c = r.randrange(len(w)), r.choice(LETTERS)
        return r.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])

    pool = base * 60 + [v for w in base for v in [slip(w)] * 4 + [slip(slip(w))] * 2]
    rows = [(i % 40 or None, " ".join(r.choice([w, w.upper(), w.title()]) for w in r.choices(pool, k=80))) for i in range(60)]
    want = brute(rows)
    assert any(x[1] for x in want) and any(x[4] > 1 for x in want)
    assert grouped(spark, rows) == want


def test_chains_lead_to_one_root(spark):
    rows = [(1, " ".join(["abcdefgh"] * 2 + ["abcdefgx"] * 25 + ["abcdefyx"] * 260))]
    assert zlib.crc32(b"1:abcdefgh") % 31 and zlib.crc32(b"1:abcdefgx") % 31 and zlib.crc32(b"1:abcdefyx") % 31
    assert grouped(spark, rows) == [
        ("abcdefgh", "abcdefgx", "abcdefyx", 2, 1, 25),
        ("abcdefgx", "abcdefyx", "abcdefyx", 25, 2, 260),
        ("abcdefyx", None, "abcdefyx", 260, 1, None),
    ]


def test_ties_go_to_the_first_word(spark):
    rows = [(2, " ".join(["zbcdefgh"] * 30 + ["abcdefgh"] * 30 + ["mbcdefgh"] * 3))]
    assert ("mbcdefgh", "abcdefgh", "abcdefgh", 3, 2, 30) in grouped(spark, rows)


def test_odd_rows(spark):
    long = "é" * 5000
    rows = [(None, None), (1, ""), (2, "12 345"), (3, f"{long} {long}"), (3, f"{long}e {long}e"), (4, "×÷×÷×÷×÷ ×÷×÷×÷×÷")]
    assert grouped(spark, rows) == brute(rows)
    assert grouped(spark, []) == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "letters letters", 5, "x", 2)], "doc_id long, text string, n long, word string, `a.key` long")
    assert [r.word for r in variants.group_variants(df).collect()] == ["letters"]


def test_near_words_share_a_signature():
    r = random.Random(1)
    for _ in range(300):
        w = "".join(r.choices("abcde", k=r.randint(7, 12)))
        i, c = r.randrange(len(w)), r.choice("abcde")
        for v in (w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]):
            a, b = variants.signatures(pa.array([w, v]))
            assert np.any(a == b)


def test_packed_comparison():
    r = random.Random(2)
    words = [("".join(r.choices("ab", k=r.randint(1, 18)))) for _ in range(400)]
    letters, starts, lengths = variants._letters(pa.array(words))
    packed = variants._packed(letters, starts, lengths)
    i, j = (x.reshape(-1) for x in np.meshgrid(np.arange(400), np.arange(400)))
    short = (lengths[i] <= variants.PACKED) & (lengths[j] <= variants.PACKED)
    got = variants._one_edit(packed, lengths, i, j)
    for p in range(0, len(i), 7):
        a, b = words[i[p]], words[j[p]]
        want = one_edit(a, b)
        assert variants._one_edit_long(a.encode(), b.encode()) == want
        if short[p]:
            assert got[p] == want, (a, b)
