from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from tidemark.llm import queries, resample

from .conftest import words


def listed(text, n=1):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, n=1, m=10_000, percent=10, least=20, seed="2024"):
    """(key, features, weight, score, rank) of rows (key, text); keys are different."""
    hashed = lambda f: zlib.crc32(f.encode()) % m
    mine = [(k, *listed(t, n)) for k, t in docs]
    s = Counter(hashed(f) for _, _, fs in mine for f in fs)
    t = Counter(hashed(f) for x in target for f in listed(x, n)[1])
    cs, ct = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (cs + m) / ((s[b] + 1.0) * (ct + m)))) for b in range(m)]
    rows = []
    for k, w, fs in mine:
        weight = sum(gain[hashed(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{k}".encode()).hexdigest()[:8], 16)
        rows.append((k, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), w))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0]))
    rank = {r[0]: i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return sorted((*r[:4], rank.get(r[0])) for r in rows)


def test_query_against_brute_force_and_sql(spark, small):
    docs = queries.table(spark, small, "documents").select("doc_id", "text").collect()
    target = [r.text for r in queries.table(spark, small, "benchmark").collect()]
    got = queries.op12_importance_resampling(spark, small)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and all(t == "bigint" for _, t in got.dtypes)
    got = sorted(map(tuple, got.collect()))
    assert got == brute(docs, target) and sum(r[4] is not None for r in got) > 10
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    assert sorted(db.execute(queries.SQL["op12_importance_resampling"]).fetchall()) == got


@pytest.mark.parametrize("options", [{"n": 2, "buckets": 70_000}, {"percent": 100, "least_words": 0}, {"percent": 1, "least_words": 100}])
def test_options_against_brute_force(spark, options):
    docs = [(i, words(i % 40, 10 + i)) for i in range(90)]
    target = [words(3, 80), words(5, 90), None]
    got = resample.draw(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), **options)
    assert sorted(map(tuple, got.collect())) == brute(docs, target, options.get("n", 1), options.get("buckets", 10_000), options.get("percent", 10), options.get("least_words", 20))


def test_odd_rows(spark, odd, none):
    target = spark.createDataFrame([(words(1, 50),), (words(1, 50),)], "text string")
    got = resample.draw(odd, target, percent=50).collect()
    assert len(got) == odd.count()
    known = {}
    for r in got:
        known.setdefault(r.doc_id, set()).add((r.n_features, r.weight, r.score))
    assert all(len(v) == 1 for k, v in known.items() if k is not None)
    assert known[3] == known[3] and {(x[0], x[1]) for x in known[3] | known[4] | known[5] | known[8]} == {(0, 0)}
    assert next(iter(known[9]))[0] == 30_000 and next(iter(known[10]))[0] == 1
    able = [r for r in got if r.n_features >= 20]
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert ranks == list(range(1, len(able) // 2 + 1))
    chosen = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r.score for r in chosen] == sorted((r.score for r in able), reverse=True)[: len(chosen)]
    rows = resample.drawn(odd, target, percent=50)
    assert rows.columns == odd.columns and rows.count() == len(ranks)
    assert resample.draw(none, target).count() == 0
    assert resample.draw(odd, target.where("false")).count() == odd.count()


def test_many_copies_and_ties(spark):
    rows = [(7, words(1, 30))] * 300 + [(i, words(1, 30)) for i in range(1000, 1300)] + [(i, words(i, 30)) for i in range(100)]
    docs = spark.createDataFrame(rows, "n_words long, text string")
    got = resample.draw(docs, docs.limit(3), key="n_words", percent=100).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, len(rows) + 1))
    by_rank = sorted(got, key=lambda r: r["rank"])
    assert [(-r.score, r["n_words"]) for r in by_rank] == sorted((-r.score, r["n_words"]) for r in got)
    assert len({r.weight for r in got if r["n_words"] >= 1000 or r["n_words"] == 7}) <= 2  # 7 is also the key of another text
