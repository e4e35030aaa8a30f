from __future__ import annotations

import numpy as np

from tests.llm.conftest import ODD
from tidemark.llm import langid, queries


def test_held_out_accuracy(spark, small):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    got = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out and lang is not null")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count() > 100
    assert got.where("score < 0 or score > 1 or lang_pred is null").count() == 0


def test_odd_rows(spark, odd, none):
    train = spark.createDataFrame([("the cat sat on the mat and then", "en"), ("der hund und die katze sind nicht", "de"), (None, "de"), ("???", "en"), ("quoi", None)], "text string, lang string")
    model = langid.learn(train)
    assert sorted(model) == ["de", "en"]
    got = langid.predict(odd, model, keep=["doc_id", "n_words", "rep"]).collect()
    und = {r["rep"] for r in got if r["lang_pred"] == "und"}
    assert und == {k for k, (_, t) in enumerate(ODD) if not any(c.isalpha() for c in t or "")} and all(r["score"] == 0 for r in got if r["rep"] in und)
    assert langid.keep(odd, model).count() == len(ODD) - len(und)
    assert langid.predict(none, model, keep=["doc_id"]).count() == 0
    nothing = langid.learn(train.where("false"))
    assert {r["lang_pred"] for r in langid.predict(odd, nothing, keep=["doc_id"]).collect()} == {"und"}


MASK = (1 << 64) - 1


def vector(point, place):
    """+1 and -1 by the bits of the letter's hashes, rotated."""
    out = []
    for d in range(langid.DIMENSIONS // 64):
        x = (point * 0x9E3779B97F4A7C15 + d + 1) & MASK
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
        x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
        x ^= x >> 31
        out += [1 if byte >> (7 - b) & 1 else -1 for byte in x.to_bytes(8, "little") for b in range(8)]
    return np.roll(np.array(out, float), place)


def bundle(text):
    symbols = [0]
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split(" "):
        symbols += [*map(ord, word), 0] if word else []
    total, g = np.zeros(langid.DIMENSIONS), langid.GRAM
    for i in range(len(symbols) - g + 1):
        gram = symbols[i : i + g]
        if 0 not in gram[1:-1]:
            total += np.prod([vector(p, g - 1 - j) for j, p in enumerate(gram)], axis=0)
    return total


def unit(x):
    n = np.linalg.norm(x)
    return x / n if n else x


TAUGHT = [("the cat sat on the mat and then it went", "en"), ("der hund und die katze sind nicht im haus", "de"), ("le chat est dans la maison avec nous", "fr"), ("and this is the end of it", "en"), (None, "fr"), ("42 !", "de")]


def test_predictions_are_brute_force(spark):
    texts = ["the end", "die katze", "maison", "", None, "!!", "a", "Ünï 東京 x", "the the the der", "THE END", "the\nend."] + [t for t, _ in TAUGHT]
    sums = {}
    for t, lang in TAUGHT:
        sums[lang] = sums.get(lang, 0) + unit(bundle(t))
    names = sorted(sums)
    profiles = np.array([unit(sums[n]) for n in names])
    centre = profiles.mean(0)
    profiles = np.array([unit(p - centre) for p in profiles])
    model = langid.learn(spark.createDataFrame(TAUGHT, "text string, lang string"))
    assert np.abs(np.array([model[n] for n in names]) - np.array([sums[n] for n in names])).max() < 1e-5
    got = {r["i"]: r for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model, keep=["i"]).collect()}
    for i, t in enumerate(texts):
        b = bundle(t)
        if not b.any():
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        cosine = profiles @ unit(unit(b) - centre)
        assert got[i]["lang_pred"] == names[int(cosine.argmax())] and abs(got[i]["score"] - max(0, cosine.max())) < 1e-4, t


def test_equal_profiles_go_to_the_first_name(spark):
    model = langid.learn(spark.createDataFrame([("abc def", "y"), ("abc def", "x"), ("ghi jkl", "z")], "text string, lang string"))
    rows = langid.predict(spark.createDataFrame([(1, "abc", "kept")], "i int, text string, _text string"), model, keep=["i", "_text"]).collect()
    assert rows[0]["lang_pred"] == "x" and rows[0]["_text"] == "kept"
