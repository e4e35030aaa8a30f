from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tests.llm.conftest import ODD
from tidemark.llm import packing
from tidemark.llm.queries import tokenizer_path


def best(items, capacity):
    items = sorted(items, reverse=True)
    found = [len(items)]

    def go(i, bins):
        if len(bins) >= found[0]:
            return
        if i == len(items):
            found[0] = len(bins)
            return
        for room in {b for b in bins if b + items[i] <= capacity}:
            k = bins.index(room)
            bins[k] += items[i]
            go(i + 1, bins)
            bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return found[0]


def test_reduction_never_costs_a_bin():
    r = random.Random(5)
    for _ in range(150):
        capacity = r.randint(8, 24)
        items = [r.randint(1, capacity) for _ in range(r.randint(1, 9))]
        counts = {s: items.count(s) for s in items}
        fixed, left = packing.reduce_dominated(counts, capacity)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + (best(rest, capacity) if rest else 0) == best(items, capacity)


def test_plan_places_every_piece_once():
    r = random.Random(6)
    counts = {r.randint(1, 1024): r.randint(1, 500) for _ in range(300)}
    patterns = packing.plan(counts, 1024)
    total = {}
    for p, n in patterns:
        assert sum(p) <= 1024
        for s in p:
            total[s] = total.get(s, 0) + n
    assert total == counts
    bound = packing.lower_bound(counts, 1024)
    plain = sum(n for _, n in packing.best_fit(counts, 1024))
    assert bound <= sum(n for _, n in patterns) <= min(plain, 1.02 * bound + 1)


@pytest.fixture(scope="module")
def cache():
    return packing.TokenCache(tokenizer_path())


def test_tokens_are_the_librarys(cache):
    r = random.Random(7)
    bits = [" ", "  ", "\n", "a", "word", "é", ".", ",", "'s", "1", "\t", "\xa0", "東京", "😀", "don't", "<|endoftext|>", "\x1c"]
    for _ in range(2000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(14)))
        assert np.frombuffer(cache.encode(text), "<u4").tolist() == cache.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_sequences_are_gapless_and_exact(spark, odd, none, cache):
    rows = packing.pack(odd, tokenizer_path()).collect()
    places = {}
    for r in rows:
        assert 1 <= r["length"] <= 1024
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    want = []
    for key, text in ODD:
        ids = cache.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(key, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr) == sorted(want, key=repr)
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_added_tokens_are_the_librarys():
    """Against a tokenizer of our own, with the library's defaults."""
    from tokenizers import Tokenizer

    plain, cache = Tokenizer.from_file(tokenizer_path()), packing.TokenCache(tokenizer_path())
    assert plain.encode("hello <|endoftext|> world", add_special_tokens=False).ids == [31373, 220, 50256, 995]
    for text in ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b", " <|endoftext|>  x\n", "<|endoftext|><|endoftext|>", "<|endoftext", "plain words, here.\n\nand there", ""]:
        assert np.frombuffer(cache.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_many_pieces_of_one_size_are_ranked_in_runs(spark, monkeypatch):
    monkeypatch.setattr(packing, "RUN_ROWS", 7)
    docs = spark.createDataFrame([(1, "one two three")] * 60 + [(2, "word " * 3000), (2, "word " * 3000), (3, None)], "doc_id long, text string")
    places = {}
    rows = packing.pack(docs, tokenizer_path(), capacity=16).collect()
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        assert [o for o, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= 16
    assert sum(r["doc_id"] == 1 for r in rows) == 60 and len(places) < len(rows)
