from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, repair

from .conftest import words

FIELDS = "conv_id long, turn long, role string, text string"


def broken(rows):
    """The damage of the contract, over (conv, turn, role, text)."""
    out = []
    for c, n, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if n is None else n}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(c, n, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = re.sub("[\x20\x09-\x0d]", "", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def searched(rows, marks):
    """The least (cost, audit, lines) by trying every output form: no dynamic programme over states."""
    best = None
    for lead, pairs in product((False, True), range(len(rows) + 2)):
        if lead and not pairs:
            continue
        form = ["s"] * lead + ["u", "a"] * pairs
        # ways[j]: least (cost, audit, lines) with j places of the form filled
        ways = {0: (0, "", ())}
        for i in range(len(rows) + 1):
            for j in range(len(form)):  # inserts
                if j in ways and form[j] != "s":
                    c, a, t = ways[j]
                    new = (c + 2, a + "I", (*t, {"u": "user:", "a": "assistant:"}[form[j]]))
                    ways[j + 1] = min(ways.get(j + 1, new), new)
            if i == len(rows):
                break
            _, _, role, text = rows[i]
            late = marks[i] == "truncated"
            now = {}

            def offer(j, new, now=now):
                now[j] = min(now.get(j, new), new)

            for j, (c, a, t) in ways.items():
                offer(j, (c + 3, a + "D", t))
                if marks[i] in ("blank", "duplicate") or j == len(form):
                    continue
                if role[:1] == form[j]:
                    offer(j + 1, (c + late, a + "K", (*t, f"{role}:{text}")))
                elif form[j] != "s":
                    offer(j + 1, (c + 2 + late, a + "R", (*t, {"u": "user", "a": "assistant"}[form[j]] + ":" + text)))
            ways = now
        if len(form) in ways and (best is None or ways[len(form)][:2] < best[:2]):
            best = ways[len(form)]
    return best


def brute(rows, damage=True):
    out = []
    after = broken(rows) if damage else [(c, n, " " if r is None else r, " " if t is None else t) for c, n, r, t in rows]
    for c in dict.fromkeys(r[0] for r in rows):
        mine = sorted((r for r in after if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        marks = faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit, lines = searched(mine, marks)
        out.append((c, gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def made_up(seed, many, longest=7):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "usher", "sys"]
    texts = ["Fine.", "Cut", "  ", "", None, "So?", "Done! \n", " ", "?", "a. b"]
    return [(c, r.choice([None, *range(9)]) if r.random() < 0.3 else k, r.choice(roles), r.choice(texts)) for c in [None, *range(many)] for k in range(r.randrange(longest + 1))]


def test_query_against_brute_force_and_sql(spark, small):
    rows = [tuple(r) for r in queries.table(spark, small, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_conversation_repair(spark, small)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == brute(rows)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    assert sorted(db.execute(queries.SQL["op11_conversation_repair"]).fetchall(), key=str) == got


@pytest.mark.parametrize("damage", [True, False])
def test_made_up_rows(spark, damage, monkeypatch):
    rows = made_up(5, 150)
    chats = spark.createDataFrame(rows, FIELDS).withColumn("n", F.lit("x")).withColumn("c", F.lit(1))
    want = brute(rows, damage)
    for limit in (4096, 2):  # whole conversations, and cut ones
        monkeypatch.setattr(repair, "CHUNK_ROWS", limit)
        if damage:
            broken_rows, times = queries.damaged(chats)
            got = repair.report(broken_rows, times=times)
        else:
            got = repair.report(chats)
        assert sorted(map(tuple, got.collect()), key=str) == want
    if damage:
        db = duckdb.connect()
        conversations = spark.createDataFrame(rows, FIELDS).toPandas().astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
        assert sorted(db.execute(queries.SQL["op11_conversation_repair"]).fetchall(), key=str) == want


def test_repaired_turns(spark, monkeypatch):
    rows = made_up(9, 60)
    chats = spark.createDataFrame(rows, FIELDS)
    digests = {r.conv_id: r.repaired_sha256 for r in repair.report(chats).collect()}
    monkeypatch.setattr(repair, "CHUNK_ROWS", 3)
    turns = repair.repaired(chats).orderBy("place").collect()
    for c, digest in digests.items():
        mine = [r for r in turns if r.conv_id == c]
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in mine))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == digest


def test_large_long_and_repeated(spark):
    many = [(1, k, ("user", "assistant")[k % 2], f"Turn {k}.") for k in range(12_001)]
    same = [(2, 0, "user", "Hello.")] * 9000
    long = [(3, 0, "user", words(1, 200_000) + "."), (3, 1, "assistant", words(2, 200_000))]
    unnumbered = [(4, None, "user", f"No {k:05}.") for k in range(9000)]
    got = {r.conv_id: r for r in repair.report(spark.createDataFrame(many + same + long + unnumbered, FIELDS)).collect()}
    assert (got[1].cost, got[1].audit) == (2, "K" * 12_001 + "I")
    want = "\n".join(f"{r}:{t}" for _, _, r, t in many) + "\nassistant:"
    assert got[1].repaired_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert (got[2].duplicate, got[2].illegal, got[2].audit, got[2].cost) == (8999, 8999, "K" + "D" * 8999 + "I", 3 * 8999 + 2)
    assert (got[3].truncated, got[3].cost, got[3].audit) == (1, 1, "KK")
    assert (got[4].gaps, got[4].illegal, got[4].cost, got[4].audit) == (0, 8999, 9000, "KR" * 4500)


def test_empty_and_gone(spark):
    chats = spark.createDataFrame([(1, 0, "user", "Hi."), (None, None, None, None)], FIELDS)
    empty = hashlib.sha256(b"").hexdigest()
    gone = repair.report(chats, times=F.lit(0)).collect()
    assert sorted((tuple(r) for r in gone), key=str) == sorted([(1, 0, 0, 0, 0, 0, 0, "", empty), (None, 0, 0, 0, 0, 0, 0, "", empty)], key=str)
    assert repair.report(chats.where("false")).count() == 0 and repair.repaired(chats.where("false")).count() == 0
