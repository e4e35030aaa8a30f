"""The operators made of DataFrame and SQL functions."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest

from tests.llm.conftest import ODD
from tidemark.llm import chat, imatch, pii, queries, rollup, urlfilter
from tidemark.llm.runtime import shared_dir

URLS = [("http://WWW.Example.NET/en/x?y#z", "www.example.net", "/en/x"), ("https://a.b.com", "a.b.com", ""), ("nothing", "", ""), (None, "", ""), ("", "", ""), ("ftp://h?://x/y", "h", ""), ("x://y://z/w", "y:", "//z/w"), ("http://net/", "net", "/"), ("http://İx.org/fr/1\n2", "İx.org", "/fr/1\n2"), ("http://planet/", "planet", "/")]


def test_urls_rules_and_model(spark):
    weights = urlfilter.train(urlfilter.labelled(spark))
    pages = spark.createDataFrame([(i, u, "x") for i, (u, _, _) in enumerate(URLS)] + [(98, "http://www.free-casino-bets.example.com/en/1", "x"), (99, "http://www.botany.example.com/en/1", "x")], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urlfilter.judge(pages, queries.URL_RULES, weights).collect()}
    assert [(got[i]["host"], got[i]["path"]) for i in range(len(URLS))] == [(h, p) for _, h, p in URLS]
    assert (got[0]["rule"], got[0]["verdict"]) == ("example.net/en/", "allow") and (got[7]["rule"], got[7]["verdict"]) == ("net/", "block")
    assert got[9]["rule"] is None and got[1]["rule"] is None and (got[8]["rule"], got[8]["verdict"]) == ("org/fr/", "allow")
    assert got[98]["verdict"] == "block" and got[99]["verdict"] == "allow"
    assert urlfilter.judge(pages.where("false"), queries.URL_RULES, weights).count() == 0
    labelled = {r["url"]: r["bad"] for r in urlfilter.labelled(spark).collect()}
    fitted = spark.createDataFrame([(u, u) for u in labelled], "page_id string, url string")
    right = sum((r["bad"] >= 0.5) == bool(labelled[r["page_id"]]) for r in urlfilter.judge(fitted, [], weights).collect())
    assert right >= 0.95 * len(labelled)
    with pytest.raises(ValueError):
        urlfilter.train(spark.range(urlfilter.MAX_LABELLED + 1).selectExpr("cast(id as string) as url", "0D as bad"))


def test_fingerprints(spark, odd, none):
    clean = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {i: t or "" for i, t in ODD if i is not None}
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in imatch.compare(clean).collect()}
    assert sorted(got) == sorted(texts)
    for i, key in enumerate(order):
        text, after = texts[key], texts[order[(i + 1) % len(order)]]
        n = len(text) // 3
        assert got[key]["n_chars"] == len(text)
        assert got[key]["edited_sha256"] == hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest(), key
        assert 0 <= got[key]["near_edited"] <= 1 and 0 <= got[key]["near_next"] <= 1
    assert got[1]["fingerprint"] == got[2]["fingerprint"] != got[9]["fingerprint"]
    assert imatch.compare(none).count() == 0 and imatch.compare(odd).count() == len(ODD)


def test_lexicon_is_the_band(spark):
    docs = spark.createDataFrame([("a b c",), ("a b",), ("A d d",), ("a e",)], "text string")
    count = Counter(w for t in ("abc", "ab", "ad", "ae") for w in t)
    words = imatch.lexicon(docs, low=0.5, high=0.9)
    got = sum(map(len, words))
    assert got == sum(2 <= n <= 3 for n in count.values()) == 1


def test_edits_are_nearer_than_other_documents(spark):
    r = imatch.compare(queries.table(spark, "/root/testdata/sf0.01", "documents")).agg({"near_edited": "avg", "near_next": "avg"}).first()
    assert r["avg(near_edited)"] > 0.15 > 0.05 > r["avg(near_next)"]


PRIVATE = ["4111 1111 1111 1111", "4041894974608795", "+1 (743) 555-3824", "743-555-3824", "227.5.221.1", "123-45-6789", "2024-02-29", "31/12/1999"]


def test_pseudonyms_keep_form_and_come_back(spark, odd):
    text = "; ".join(PRIVATE + PRIVATE) + "; a.b@c.example.com"
    df = spark.createDataFrame([(1, text, 5), (2, f"again {PRIVATE[1]}.", 6)], "doc_id long, text string, _new int")
    out = {r["doc_id"]: r["text"] for r in pii.pseudonymize(df, "key").collect()}
    parts = out[1].split("; ")
    assert parts[:8] == parts[8:16] and all(a != b and re.sub(r"\d", "9", a) == re.sub(r"\d", "9", b) or "." in a for a, b in zip(parts, PRIVATE))
    assert out[2] == f"again {parts[1]}." and "a.b@c" not in out[1]
    back = {r["doc_id"]: r["text"] for r in pii.reveal(pii.pseudonymize(df, "key"), "key").collect()}
    assert back[1].split("; ")[:16] == PRIVATE + PRIVATE and back[2] == f"again {PRIVATE[1]}."
    other = {r["doc_id"]: r["text"] for r in pii.pseudonymize(df, "other").collect()}
    assert other[2] != out[2]


def test_invalid_numbers_stay(spark, odd, none):
    text = "4111 1111 1111 1112, 999.1.1.1 666-12-1234 2024-02-30 1.2.3.4.5 abc4041894974608795"
    got = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string"), "key").first()
    assert got["text"] == text and got["n_replaced"] == 0
    rows = {r["doc_id"]: r for r in pii.report(odd.where("doc_id is not null"), "key").collect()}
    assert rows[3]["text"] is None and rows[4]["text"] == "" and rows[9]["text"] == dict(ODD)[9]
    assert pii.pseudonymize(odd, "key").columns == odd.columns and pii.report(none, "key").count() == 0


def test_feistel_is_a_permutation(spark):
    df = spark.range(270 * 27).selectExpr(f"{pii.feistel('id div 27', 'id % 27', '270', '27', 't', 'k')} as f").selectExpr("f.l * 27 + f.r as x")
    assert df.distinct().count() == 270 * 27 and df.selectExpr("max(x)", "min(x)").first() == (270 * 27 - 1, 0)


def test_ledger_is_idempotent(spark, tmp_path):
    docs = spark.createDataFrame([("a", "en", 3), ("a", "en", 4), (None, None, 5)], "source string, lang string, n int")
    ledger = str(tmp_path / "ledger")
    assert rollup.commit(ledger, "b1", rollup.inserted(docs, "v1", "n")) and not rollup.commit(ledger, "b1", rollup.inserted(docs, "v1", "n"))
    state = lambda: {tuple(r) for r in rollup.totals(spark, ledger).collect()}
    assert state() == {("a", "en", "v1", 2, 7), (None, None, "v1", 1, 5)}
    (tmp_path / "ledger/batch=b2").mkdir()
    (tmp_path / "ledger/batch=b2/part-broken").write_text("x")  # an attempt that broke off
    assert rollup.commit(ledger, "b2", rollup.deleted(docs.where("n = 5"), "v1", "n").union(rollup.revised(docs.where("n = 4"), "v1", "n", "v2", "n")))
    assert rollup.commit(ledger, "b3", rollup.inserted(docs.where("false"), "v1", "n"))
    assert state() == {("a", "en", "v1", 1, 3), ("a", "en", "v2", 1, 4)}


def test_snapshots_collapse(spark):
    full = [("user", "hi"), ("assistant", "yes <|x|>"), ("user", None), ("user", "")]
    rows = [(1, t, *full[t], "e") for t in range(2)] + [(2, t, *full[t], "e") for t in range(4)] + [(3, t, *full[t], "e") for t in range(4)] + [(4, 5, "user", "hi", "e"), (4, 9, "assistant", "no", "e"), (5, 0, "user", "", "e"), (None, 0, "user", "lost", "e")]
    rows += [(7, t, "user", f"turn {t}", "e") for t in range(600)] + [(8, t, "user", f"turn {t}", "e") for t in range(599)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, part string")
    got = {}
    for r in chat.render(df).collect():
        got.setdefault(r["conv_id"], []).append(r)
    assert set(got) == {2, 4, 5, None, 7}
    assert got[2][0]["n_copies"] == 2 and got[2][0]["n_turns"] == 4
    assert got[2][0]["rendered"] == "<|user|>\nhi<|end|>\n<|assistant|>\nyes < |x|><|end|>\n<|user|>\n<|end|>\n<|user|>\n<|end|>\n"
    assert "".join(p["rendered"] for p in sorted(got[7], key=lambda p: p["part"])).count("<|end|>") == 600 and len(got[7]) == 3
    assert chat.render(df.where("false")).count() == 0


def test_shared_dir_is_the_sessions(spark):
    assert shared_dir(spark).startswith(("file:", "/"))


def test_very_long_turns_are_rendered_whole(spark):
    long = "word " * 300_000
    chats = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "x" * 500_000), (2, 0, "user", long)], "conv_id long, turn long, role string, text string")
    got = chat.render(chats).collect()  # the second is a prefix of the first
    assert [(r["conv_id"], r["n_turns"]) for r in got] == [(1, 2)]
    assert got[0]["rendered"] == f"<|user|>\n{long}<|end|>\n<|assistant|>\n{'x' * 500_000}<|end|>\n"
