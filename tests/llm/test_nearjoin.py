from __future__ import annotations

import random

import pyarrow as pa

from tests.llm.conftest import ODD, words
from tidemark.llm import nearjoin, textarrays


def brute(docs, k=5, least=0.8):
    """{row: (class, links, copies)} by comparing all pairs of sets."""
    tokens, first = textarrays.shingles(*textarrays.words(*textarrays.utf8(pa.array([t for _, t in docs], pa.string()))), k)
    sets = [frozenset(tokens[first[i] : first[i + 1]].tolist()) for i in range(len(docs))]
    rows = {}
    for i, s in enumerate(sets):
        if s and docs[i][0] is not None:
            rows.setdefault(s, []).append(i)
    unique = list(rows)
    root, links = list(range(len(unique))), [0] * len(unique)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(unique)):
        for b in range(a):
            both = len(unique[a] & unique[b])
            if both >= least * (len(unique[a]) + len(unique[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    smallest = {}
    for a, s in enumerate(unique):
        smallest[find(a)] = min(smallest.get(find(a), 10**9), min(docs[i][0] for i in rows[s]))
    out = [(docs[i][0], docs[i][0], 0, 1) for i, s in enumerate(sets) if not s or docs[i][0] is None]
    return sorted(out + [(docs[i][0], smallest[find(a)], links[a], len(rows[s])) for a, s in enumerate(unique) for i in rows[s]], key=repr)


def edited(r, base, share):
    w = base.split()
    for _ in range(int(len(w) * share)):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_odd_rows_are_brute_force(spark, odd, none):
    assert sorted(map(tuple, nearjoin.classes(odd).collect()), key=repr) == brute(ODD)
    assert nearjoin.classes(none).count() == 0
    kept = nearjoin.one_of_each(odd)
    assert kept.schema == odd.schema
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([None, *{c for i, c, _, _ in brute(ODD) if i is not None}], key=repr)


def test_recall_with_a_large_group_and_a_shared_passage(spark, monkeypatch):
    r = random.Random(2)
    passage = words(1000, 60)
    docs = [(i, words(i, 40) + " " + passage) for i in range(150)]
    base = words(5000, 120)
    docs += [(1000 + i, edited(r, base, 0.01)) for i in range(320)]
    for i in range(60):
        own = words(7000 + i, 150)
        docs += [(3000 + 2 * i, own), (3001 + 2 * i, edited(r, own, 0.015))]
    monkeypatch.setattr(nearjoin, "SMALL", 64)  # the group is split, then worked through in blocks
    monkeypatch.setattr(nearjoin, "BLOCK", 100)
    got = {row["doc_id"]: (row["class_id"], row["n_links"]) for row in nearjoin.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = {i: (c, n) for i, c, n, _ in brute(docs)}
    assert sum(n for _, n in got.values()) >= 0.99 * sum(n for _, n in want.values()) > 0
    assert all(got[i][1] <= want[i][1] for i in want)
    assert sum(got[i][0] == want[i][0] for i in want) >= 0.99 * len(want)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"{i + 1:03d}".encode(), f"{i:03d}".encode()) for i in range(40)] + [(b"900", b"899")], "sid binary, root binary")
    got = {bytes(r["sid"]): bytes(r["root"]) for r in nearjoin.components(edges).collect()}
    assert got == {f"{i:03d}".encode(): b"000" for i in range(1, 41)} | {b"900": b"899"}


def test_rows_of_equal_keys_are_told_apart_by_text(spark):
    w, v = words(31, 50), words(32, 50)
    docs = [(1, w, "a"), (2, w + " tail", "b"), (2, v, "c"), (2, v, "d"), (3, v + " end", "e"), (None, w, "f"), (4, "", "g"), (4, None, "h"), (2, v.replace(" ", ", "), "i")]
    df = spark.createDataFrame(docs, "doc_id long, text string, mark string")
    kept = sorted((tuple(r) for r in nearjoin.one_of_each(df).collect() if r["doc_id"] is not None), key=repr)
    assert kept[0] == docs[0] and {r[2] for r in kept} >= {"g", "h"}
    assert len(kept) == 4 and kept[1][0] == 2 and kept[1][1] in (v, v.replace(" ", ", "))
    assert sorted(map(tuple, nearjoin.classes(df.select("doc_id", "text")).collect()), key=repr) == brute([d[:2] for d in docs])


def test_a_large_unit_is_compared_in_squares(spark, monkeypatch):
    base = words(77, 60)
    r = random.Random(8)
    docs = [(i, edited(r, base, 0.02)) for i in range(150)] + [(900 + i, words(900 + i, 40)) for i in range(20)]
    monkeypatch.setattr(nearjoin, "SMALL", 16)
    monkeypatch.setattr(nearjoin, "EDGE", 32)
    got = sorted(map(tuple, nearjoin.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    want = sorted(brute(docs))
    assert [x[0] for x in got] == [x[0] for x in want] and sum(x[2] for x in got) >= 0.99 * sum(x[2] for x in want)


def test_repetitions_meet_the_recall():
    for least, recall in ((0.8, 0.99), (0.8, 0.9999), (0.6, 0.95)):
        assert nearjoin.DEPTH * (1 - least) ** nearjoin.repetitions(least, recall) <= 1 - recall
    assert nearjoin.agreeing(0.8) == 15
