import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from verdigris.llm import queries, rans

with open(queries.tokenizer_path(queries.WORD_TOKENIZER), encoding="utf-8") as file:
    DEFINITION = file.read()
LIBRARY = Tokenizer.from_str(DEFINITION)
TEXTS = ["", None, "It's don't WE'LL x's", "<|endoftext|> a<|startoftext|>b", "İstanbul ŉ ſ ﬁ", "a b c\x1cd", "é ñ .̸", "A1b2 3.14 10,000", "\n\t  ", "漢字 かな 😀", "x" * 5000, "ÀÉÎ.,!? || |", "ΣΑΣ", "the cat, The CAT. the"]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 16384, 16385, 50000])
def test_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 49000) if n else np.zeros(0, np.int64)
    segment = rans.Segment(np.array([5, 6]), np.array([True, False]), np.array([n // 2, n - n // 2]), ids)
    back = rans.unpack(rans.pack(segment))
    assert np.array_equal(back.ids, ids) and back.counts.tolist() == segment.counts.tolist()
    assert back.known.tolist() == [True, False]


def test_one_symbol_and_size():
    ids = np.full(100000, 7)
    assert len(rans.pack(rans.Segment(np.zeros(1), np.ones(1), np.array([100000]), ids))) < 6000
    skewed = np.random.default_rng(0).choice(4, 200000, p=[0.9, 0.08, 0.015, 0.005])
    entropy = -sum(p * np.log2(p) for p in (0.9, 0.08, 0.015, 0.005)) * 200000 / 8
    assert len(rans.pack(rans.Segment(np.zeros(1), np.ones(1), np.array([200000]), skewed))) < 1.1 * entropy + 10000


def test_damage_is_found():
    image = bytearray(rans.pack(rans.Segment(np.zeros(1), np.ones(1), np.array([5000]), np.arange(5000) % 300)))
    for at in (20, len(image) // 2, len(image) - 3):
        bad = bytearray(image)
        bad[at] ^= 1
        with pytest.raises(rans.CorruptSegment):
            rans.unpack(bytes(bad))
    with pytest.raises(rans.CorruptSegment):
        rans.unpack(bytes(image[:-5]))


def test_frequencies_fill_the_scale():
    for counts in ([1], [1, 10**9], list(range(1, 40000)), [5] * 3):
        f = rans.frequencies(np.array(counts))
        assert f.sum() == 1 << rans.PRECISION and f.min() >= 1


def test_words_encode_like_whole_texts():
    encoder = rans.WordEncoder(DEFINITION)
    for texts in (TEXTS, TEXTS[::-1], TEXTS[:1], []):
        flat, counts = encoder.encode(pa.array(texts, pa.string()), 1)
        got = [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] if texts else []
        assert got == [[*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_files(spark, documents, monkeypatch):
    docs = documents(*[(100 - i, t, "en", "s") for i, t in enumerate(TEXTS)], (None, "no id"), (3, "x"), (3, "x")).withColumnRenamed("lang", "start")
    rows = rans.token_files(spark, docs.repartition(3), DEFINITION).collect()
    by_start = sorted(rows, key=lambda r: r.start)
    order = sorted([(100 - i, t) for i, t in enumerate(TEXTS)] + [(3, "x"), (3, "x")])
    assert [r.doc_id for r in by_start] == [None, *(i for i, _ in order)]
    at = 0
    for r, text in zip(by_start, ["no id", *(t for _, t in order)]):
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert rans.token_files(spark, docs.limit(0), DEFINITION).count() == 0
