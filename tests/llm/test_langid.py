import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import langid

EN = ["the cat sat on the mat and the dog ran to the house", "this is the thing that they were looking for in the garden"]
ES = ["el gato se sentó en la mesa y el perro corrió a la casa", "esta es la cosa que ellos estaban buscando en el jardín"]


def brute_bits(texts: list[str], text: str) -> float:
    """Code length of `text` by the definition, one byte at a time."""
    pad, ORDER = b"\n" * langid.ORDER, langid.ORDER
    stream = pad + pad.join(map(langid._folded, texts))
    table: dict[bytes, dict[int, int]] = {}
    for i in range(ORDER, len(stream)):
        for n in range(ORDER + 1):
            seen = table.setdefault(stream[i - n : i], {})
            seen[stream[i]] = seen.get(stream[i], 0) + 1
    data, bits = pad + langid._folded(text), 0.0
    for i in range(ORDER, len(data)):
        p = 1.0
        for n in range(ORDER, -1, -1):
            seen = table.get(data[i - n : i])
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if data[i] in seen:
                p *= seen[data[i]] / whole
                break
            p *= len(seen) / whole
        else:
            p /= 256
        bits -= np.log2(p)
    return bits


@pytest.mark.parametrize("text", ["the dogs", "El Gato ñ 漢", "q", "zzzz" * 50, "a\nb"])
def test_code_lengths_are_those_of_the_definition(text):
    model = langid.train({"en": EN, "es": ES})
    bits, _ = langid.code_lengths(model, [text])
    want = [brute_bits(EN, text), brute_bits(ES, text)]
    assert np.allclose(bits[0], want, rtol=1e-5)


def test_long_texts_cross_the_steps(monkeypatch):
    model = langid.train({"en": EN, "es": ES})
    text = "the cat sat on the mesa " * 40
    want, _ = langid.code_lengths(model, [text, "x", text])
    monkeypatch.setattr(langid, "BYTES_PER_STEP", 64)
    got, _ = langid.code_lengths(model, [text, "x", text])
    assert np.allclose(got, want)


def test_predictions_and_odd_rows():
    model = langid.train({"en": EN, "es": ES})
    pred, score, _ = langid.predict(model, ["the house", "la mesa en el jardín", None, "", "12 !! 3", "THE DOG"])
    assert pred == ["en", "es", "und", "und", "und", "en"]
    assert ((score >= 0) & (score <= 1)).all() and score[2] == 0


def test_fit_learns_from_the_training_part_only(spark, documents):
    rows = [(i, (EN if i % 2 else ES)[i % 3 % 2], "en" if i % 2 else "es", "s") for i in range(60)] + [(None, "x", "en"), (61, None, "en"), (62, "hello there", None)]
    docs = documents(*rows)
    model = langid.fit(docs)
    assert model.langs == ["en", "es"]
    part = docs.where(~langid.held_out(F.col("doc_id"), 5, 0))
    assert np.allclose(langid.fit(part).cost, model.cost)
    got = langid.identify(docs.withColumn("language", F.lit(1)), model)
    assert got.columns[-1] == "language" and got.count() == len(rows)
    assert langid.identify(docs.limit(0), model).count() == 0
    assert langid.fit(docs.limit(0)).langs == []
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(docs.limit(0))).select("language.lang_pred").collect()} == {"und"}


def test_held_out_accuracy_on_generated_text(spark, documents):
    rng = np.random.default_rng(1)
    words = {"a": ["uno", "dos", "tres", "cuatro"], "b": ["one", "two", "three", "four"]}
    rows = [(i, " ".join(rng.choice(words["ab"[i % 2]], 12)), "ab"[i % 2], "s") for i in range(200)]
    docs = documents(*rows)
    got = langid.identify(docs, langid.fit(docs)).where(langid.held_out(F.col("doc_id"), 5, 0))
    assert got.where(F.col("language.lang_pred") != F.col("lang")).count() == 0


def test_all_contexts_of_all_languages_count():
    rng = np.random.default_rng(3)
    texts = {lang: ["".join(map(chr, rng.integers(first, first + 26, n)))] for lang, first, n in (("common", 97, 20000), ("rare", 1072, 150))}
    model = langid.train(texts)
    assert len(model.escape) > 9000
    probes = [texts["rare"][0][:60], texts["common"][0][:60], "qzj аб", "漢"]
    bits, _ = langid.code_lengths(model, probes)
    want = [[brute_bits(texts[lang], p) for lang in model.langs] for p in probes]
    assert np.allclose(bits, want, rtol=1e-5)


def test_ties_and_many_languages(spark, documents, monkeypatch):
    model = langid.train({"b": EN, "a": EN, "c": EN})
    assert langid.predict(model, ["the house", "qqq"])[0] == ["a", "a"]
    monkeypatch.setattr(langid, "MOST_LANGS", 2)
    rows = [(i, EN[i % 2], ("x", "y", f"z{i}")[i % 3], "s") for i in range(90)] + [(i, ES[0], "y", "s") for i in range(100, 110)]
    assert langid.fit(documents(*rows)).langs == ["x", "y"]
    monkeypatch.setattr(langid, "SAMPLE_TOTAL", 10)
    assert langid.fit(documents(*rows)).langs == ["x", "y"]


def test_two_hundred_languages(spark, documents):
    """Every language is learned, and tables grow with their number, not its square."""
    rng = np.random.default_rng(4)
    name = lambda i: f"l{i:03d}"

    def text(i):
        letters = [chr(0x100 + 40 * (i % 50) + j) for j in range(18)] + [chr(97 + (i // 50 * 7 + j) % 26) for j in range(4)]
        return " ".join("".join(rng.choice(letters, rng.integers(3, 8))) for _ in range(60))

    rows = [(9 * i + j, text(i), name(i), "s") for i in range(200) for j in range(6)]
    model = langid.fit(documents(*rows))
    tables = [model, *model.more]
    assert [lang for m in tables for lang in m.langs] == [name(i) for i in range(200)]
    size = lambda m: sum(x.nbytes for x in (m.cost, m.met, m.escape, m.state, m.deep))
    assert max(map(size, tables)) < 24 << 20 and sum(map(size, tables)) < 400 << 20
    probes = [text(i) for i in range(0, 200, 7)]
    pred, score, _ = langid.predict(model, probes)
    assert sum(p == name(i) for p, i in zip(pred, range(0, 200, 7), strict=True)) >= 0.9 * len(probes)
    # Groups of languages give the same codes as one table.
    few = {name(i): [r[1] for r in rows if r[2] == name(i)] for i in range(12)}
    one, two, three = langid.train(few), langid.train({k: few[k] for k in list(few)[:7]}), langid.train({k: few[k] for k in list(few)[7:]})
    two.more = [three]
    for a, b in zip(langid.predict(one, probes), langid.predict(two, probes), strict=True):
        assert np.allclose(a, b) if isinstance(a, np.ndarray) else a == b
