import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from verdigris.llm import pieces, queries

PATH = queries.tokenizer_path(queries.PIECE_MODEL)
MODEL, LIBRARY = pieces.load(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = ["", "a", " ", "  x  y ", "漢字😀 é\n\t", "x" * 300, " " * 40 + "x", "a" + " " * 33 + "漢  b", "aé" * 100, "the the theThe", "\x00\x01"]


def parts(model, texts):
    flat, counts = pieces.encode(model, texts)
    return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]


def test_ids_are_the_librarys():
    assert parts(MODEL, ODD) == [LIBRARY.encode(t) for t in ODD]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="theandirTHE .,\n éß漢", max_size=60), min_size=1, max_size=8))
def test_random_texts(texts):
    assert parts(MODEL, texts) == [LIBRARY.encode(t) for t in texts]
    flat, counts = pieces.encode(MODEL, texts)
    assert pieces.decode(MODEL, flat, counts) == texts


def test_words_remembered_from_earlier_batches_do_not_matter():
    first = parts(MODEL, ["some words that come again and again"])
    assert parts(MODEL, ["some words that come again and again"]) == first
    pieces._MEMORY.clear()
    assert parts(MODEL, ["some words that come again and again"]) == first


def brute(table, text, unknown):
    """Best total score of a unigram segmentation, by trying every one."""
    best = {0: 0.0}
    for end in range(1, len(text) + 1):
        options = [best[a] + table[text[a:end]] for a in range(end) if text[a:end] in table]
        if text[end - 1] not in table:
            options.append(best[end - 1] + unknown)
        best[end] = max(options)
    return best[len(text)]


def test_unigram_scores_are_the_best(monkeypatch):
    rng = np.random.default_rng(0)
    names = sorted({"".join(rng.choice(list("abc"), rng.integers(1, 5))) for _ in range(30)} | set("ab") | {"▁", "▁a", "▁ab"})
    table = {n: -float(rng.uniform(1, 9)) for n in names}
    rows = [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] + [(n, s, 1) for n, s in table.items()]
    model = pieces.from_pieces(rows, bpe=False)
    for _ in range(50):
        text = "".join(rng.choice(list("abcd "), rng.integers(1, 80)))
        marked = "▁" + text.replace(" ", "▁")
        flat, _ = pieces.encode(model, [text])
        score = sum(model.unknown if i < 256 else table[rows[i][0]] for i in flat.tolist())
        assert score == pytest.approx(brute(table, marked, model.unknown))
        assert pieces.decode(model, flat, np.array([len(flat)])) == [text]


def test_columns(spark, documents):
    docs = documents("a cat", None, "", "x" * 5000, "tail  spaces  ")
    got = docs.select("doc_id", pieces.encoder(spark, MODEL)("text").alias("ids"))
    back = got.select("doc_id", "ids", pieces.decoder(spark, MODEL)("ids").alias("text")).orderBy("doc_id").collect()
    assert [r.text for r in back] == ["a cat", "", "", "x" * 5000, "tail  spaces  "]
    assert [r.ids for r in back] == [LIBRARY.encode(t) for t in ["a cat", "", "", "x" * 5000, "tail  spaces  "]]
    assert docs.limit(0).select(pieces.encoder(spark, MODEL)("text")).count() == 0


def test_a_memory_belongs_to_its_model():
    rows = [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    one = pieces.from_pieces([*rows, ("▁", -1.0, 1), ("a", -2.0, 1), ("b", -3.0, 1)], bpe=False)
    two = pieces.from_pieces([*rows, ("b", -3.0, 1), ("a", -2.0, 1), ("▁", -1.0, 1)], bpe=False)
    for model, ids in ((one, [256, 257, 258]), (two, [258, 257, 256])):
        assert parts(model, ["ab"]) == [ids] and parts(model, ["ab"]) == [ids]
    count = len(pieces._MEMORY)
    del model, one, two
    assert len(pieces._MEMORY) == count - 2


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="日本語の文章は空白なしで続く。ไทยภาษา", min_size=40, max_size=200), min_size=1, max_size=4))
def test_scripts_without_spaces(texts):
    assert parts(MODEL, texts) == [LIBRARY.encode(t) for t in texts]


@pytest.mark.parametrize("bpe", [False, True])
def test_equal_hashes_do_no_harm(monkeypatch, bpe):
    rows = [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] + [(p, -float(i), 1) for i, p in enumerate(("▁", "a", "b", "c", "ab", "bc", "▁a"))]
    model = pieces.from_pieces(rows, bpe)
    texts = ["abc", "ab c", "cab", "dab abd", "d" * 60, "bca" * 30]
    want = parts(model, texts)
    pieces._MEMORY.clear()
    real = pieces._mixed
    # From now on "c" and "d" hash like "b": other words and pieces answer to their hashes.
    monkeypatch.setattr(pieces, "_mixed", lambda codes: real(np.where(np.isin(codes, [ord("c"), ord("d")]), ord("b"), codes)))
    assert parts(model, texts) == want and parts(model, texts[::-1]) == want[::-1]
