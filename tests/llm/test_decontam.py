from __future__ import annotations

import hashlib
import random
import re
import time

import pytest

from tests.llm.conftest import ODD, words
from tidemark.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    windows = {}
    for name, text in items:
        w = split(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(name))
    out = []
    for key, text in docs:
        w, hit, names = split(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if found := windows.get(tuple(w[i : i + k])):
                    names |= found
                    hit |= set(range(i, i + k))
        out.append((key, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


ITEMS = [(1, words(1, 60)[20:300]), (10, "one two"), (2, None), (3, ""), (4, words(9, 30_000)[5000:5400]), (5, "東京 тест"), (6, words(77, 40)), (7, words(77, 40))]


@pytest.mark.parametrize("block", [1, 8 << 20])
def test_report_is_brute_force(spark, odd, block):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.report(odd, bench, block_chars=block).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got), key=repr) == brute(ODD, ITEMS)


def test_random_texts_of_few_words(spark):
    r = random.Random(4)
    text = lambda n: " ".join(r.choice("abc") for _ in range(n))
    docs = [(i, text(r.randrange(60))) for i in range(80)]
    items = [(i, text(r.randrange(14))) for i in range(12)]
    got = decontam.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=5)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr) == brute(docs, items, 5)


def test_longest_match_and_place(spark):
    docs = spark.createDataFrame([(1, "z z a b c d e f z"), (2, "b c d e")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "q a b c d e f g")], "item_id long, text string")
    got = {r["doc_id"]: (r["longest_match"], r["longest_item"], r["longest_at"]) for r in decontam.report(docs, bench, window=3).collect()}
    assert got == {1: (6, "7", 2), 2: (4, "7", 0)}


def test_clean_keeps_the_others_whole(spark, odd, none):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    bad = [r[5] for r in brute(ODD, ITEMS)]
    kept = decontam.clean(odd, bench)
    assert kept.schema == odd.schema and kept.count() == len(ODD) - sum(bad)
    assert decontam.clean(odd, bench.where("false")).count() == len(ODD)
    assert decontam.report(none, bench).count() == 0


def longest(docs, items, window):
    """(length, item, place) by trying all pairs of places."""
    out = {}
    for key, text in docs:
        w, best = split(text), (0, None, None)
        for name, t in items:
            v = split(t)
            k = min(window, len(v))
            for i in range(len(w)):
                for j in range(len(v)):
                    if k and (i == 0 or j == 0 or w[i - 1] != v[j - 1]):
                        n = 0
                        while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                            n += 1
                        if n >= k and (-n, i, int(name)) < (-best[0], best[2] if best[2] is not None else 10**9, int(best[1] or 10**9)):
                            best = (n, str(name), i)
        out[key] = best
    return out


@pytest.mark.parametrize("block", [40, 8 << 20])
def test_longest_match_is_brute_force(spark, block):
    r = random.Random(14)
    text = lambda n: " ".join(r.choice("ab") for _ in range(n))
    docs = [(i, text(r.randrange(40))) for i in range(60)]
    items = [(i % 9, text(r.randrange(30))) for i in range(14)]
    got = decontam.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=5, block_chars=block)
    assert {r["doc_id"]: (r["longest_match"], r["longest_item"], r["longest_at"]) for r in got.collect()} == longest(docs, items, 5)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr) == brute(docs, items, 5)


def test_rows_of_one_item_id_are_one_item(spark):
    docs = [(1, "a b c d e f"), (2, "x y z u v w"), (3, "a b c x y z")]
    items = [(1, "a b c"), (1, "x y z"), (2, "b c")]
    got = decontam.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=1)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr) == brute(docs, items)


def test_one_word_over_and_over_is_quick(spark):
    docs = [(1, "word " * 20_000), (2, "word " * 500 + "other " + "word " * 30), (3, "other")]
    items = [(1, "word " * 1000), (2, "word word other")]
    start = time.time()
    got = {r["doc_id"]: r for r in decontam.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert time.time() - start < 30
    assert (got[1]["n_hit"], got[1]["n_items"], got[1]["longest_match"], got[1]["longest_at"]) == (20_000, 1, 1000, 0)
    assert (got[2]["n_hit"], got[2]["n_items"], got[2]["longest_match"], got[2]["longest_at"]) == (531, 2, 500, 0)
    assert got[3]["n_hit"] == 0
