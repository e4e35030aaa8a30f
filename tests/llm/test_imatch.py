"""I-Match fingerprints against the same method written in Python."""

from __future__ import annotations

import hashlib
import struct

import pytest
import regex
import xxhash

from tests.llm.conftest import ODD, words
from tidemark.llm import imatch


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def hashed(*values, seed=42):
    """Spark's xxhash64: the hash of each value seeds the next."""
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<i", v.value) if isinstance(v, Int) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return signed(seed)


class Int:
    def __init__(self, value):
        self.value = value


def terms(text):
    return list(dict.fromkeys(hashed(w) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w))


def print_of(text, lexicon):
    every = terms(text)
    known = [t for t in every if t in lexicon]
    used = sorted(known if len(known) >= imatch.FEW else every or [hashed("text", text)])
    out = []
    for i, d in enumerate(imatch.DENSITIES):
        width = max(d, imatch.EACH)
        for e in range(imatch.EACH):
            mine = [t for t in used if hashed(t, Int(i)) % width == e]
            out.append(hashed(*mine) if mine else None)
    return out


def shown(p):
    return ".".join("-" if h is None else f"{h % (1 << 32):08x}" for h in p)


def alike(a, b):
    some = [(x, y) for x, y in zip(a, b) if x is not None or y is not None]
    return sum(x == y for x, y in some) / len(some) if some else 1.0


def brute(docs, low, high):
    texts = [(k, t or "") for k, t in docs]
    count = {}
    for _, t in texts:
        for w in terms(t):
            count[w] = count.get(w, 0) + 1
    lexicon = {w for w, n in count.items() if low * len(docs) <= n <= high * len(docs)}
    some = [(k, t) for k, t in texts if k is not None]
    order = [*sorted(sorted(some, key=lambda x: (-hashed(x[1]), x[1])), key=lambda x: x[0], reverse=True), *sorted((x for x in texts if x[0] is None), key=lambda x: (-hashed(x[1]), x[1]))]
    out = []
    for i, (k, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        p, q = print_of(t, lexicon), print_of(edited, lexicon)
        out.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(p), shown(q), round(alike(p, q), 9), round(alike(p, print_of(after, lexicon)), 9)))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((*tuple(r)[:5], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("kind", ["long", "string", "double", "date"])
def test_compare_is_brute_force(spark, monkeypatch, kind):
    keys = {"long": lambda i: i * i * 10**12 - 7, "string": lambda i: f"doc-{i:09d}-x", "double": lambda i: i / 7, "date": lambda i: __import__("datetime").date(2000, 1, 1) + __import__("datetime").timedelta(i)}[kind]
    docs = [(keys(i), words(i, 5 + i % 40)) for i in range(60)] + [(keys(3), words(3, 20)), (keys(9), None), (keys(61), ""), (keys(70), "...")]
    docs += [(keys(30), words(200 + i % 25, 12)) for i in range(50)] + [(None, words(300 + i, 10)) for i in range(12)]
    whole = imatch.neighbours
    monkeypatch.setattr(imatch, "neighbours", lambda d: whole(d, bucket_rows=5))
    df = spark.createDataFrame(docs, f"doc_id {kind}, text string")
    assert rows(imatch.compare(df, low=0.02, high=0.5)) == brute(docs, 0.02, 0.5)


def test_odd_rows_and_small_tables(spark, odd, none):
    assert rows(imatch.compare(odd)) == brute(ODD, imatch.LOW, imatch.HIGH)
    one = spark.createDataFrame([(5, "abcdefghi")], "doc_id long, text string")
    assert rows(imatch.compare(one)) == brute([(5, "abcdefghi")], imatch.LOW, imatch.HIGH)
    assert imatch.compare(none).count() == 0
    with pytest.raises(TypeError):
        imatch.compare(spark.createDataFrame([(b"x", "a")], "doc_id binary, text string"))


@pytest.mark.parametrize("names", [["ftp://x", "zeta", "it's", "back\\slash", "Ü"], []])
def test_ranges_of_keys_that_begin_alike(spark, names):
    keys = [f"https://site.example/{i}" for i in range(1000)] + names
    df = spark.createDataFrame([(k, f"text {k}") for k in keys], "k string, t string")
    sizes = [r["count"] for r in imatch.neighbours(df, bucket_rows=201).where("not _ghost").groupBy("_bucket").count().collect()]
    assert len(sizes) == 5 and sum(sizes) == len(keys) and max(sizes) < 1.5 * min(sizes)


def test_ranges_of_one_key(spark):
    df = spark.createDataFrame([("same", f"text {i}") for i in range(1000)] + [(None, f"other {i}") for i in range(500)], "k string, t string")
    sizes = [r["count"] for r in imatch.neighbours(df, bucket_rows=150).where("not _ghost").groupBy("_bucket").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 2 * min(sizes)


@pytest.mark.parametrize("kind", ["timestamp", "decimal(20,3)", "int"])
def test_other_kinds_of_keys(spark, monkeypatch, kind):
    whole = imatch.neighbours
    monkeypatch.setattr(imatch, "neighbours", lambda d: whole(d, bucket_rows=7))
    docs = spark.range(60).selectExpr(f"cast(id * 7 % 61 as {'timestamp' if kind == 'timestamp' else kind}) as doc_id", "concat('a word ', id, ' and ', id % 7, ' more of them') as text")
    got = imatch.compare(docs, low=0.02, high=0.5)
    plain = imatch.compare(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), low=0.02, high=0.5)
    drop = lambda df: sorted(tuple(r)[1:] for r in df.collect())
    assert drop(got) == drop(plain)
