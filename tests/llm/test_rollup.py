"""Token counts and their ledger."""

from __future__ import annotations

import re

import pytest

from tests.llm.conftest import ODD
from tidemark.llm import queries, rollup
from tidemark.llm.queries import tokenizer_path


def test_counts_are_the_tokenizers(spark, odd, none):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    got = rollup.counts(odd, tokenizer_path(), "n")
    assert got.columns == ["doc_id", "n_words", "rep", "n"]
    rows = {r["rep"]: r["n"] for r in got.collect()}
    assert rows == {k: len(plain.encode(t or "", add_special_tokens=False).ids) for k, (_, t) in enumerate(ODD)}
    assert rollup.counts(none, tokenizer_path(), "n").count() == 0


def test_deletions_take_what_was_counted(spark, tmp_path):
    path, ledger = str(tmp_path / "counts"), str(tmp_path / "ledger")
    docs = spark.createDataFrame([(1, "a", "en", "one two three"), (2, "a", None, None), (2, "a", None, "x " * 50_000), (3, None, "en", "")], "doc_id long, source string, lang string, text string")
    assert rollup.totals(spark, ledger).count() == 0
    rollup.counts(docs, tokenizer_path(), "n").write.parquet(path)
    rows = spark.read.parquet(path)
    rollup.commit(ledger, "1", rollup.inserted(rows, "v", "n"))
    state = lambda: {tuple(r) for r in rollup.totals(spark, ledger).collect()}
    n = {r["n"] for r in rows.where("doc_id = 2").collect()}
    assert state() == {("a", "en", "v", 1, 3), ("a", None, "v", 2, sum(n)), (None, "en", "v", 1, 0)}
    rollup.commit(ledger, "2", rollup.deleted(rows.where("doc_id != 1"), "v", "n"))
    assert state() == {("a", "en", "v", 1, 3)}


def test_a_batch_with_other_sums_is_refused_and_a_torn_attempt_unread(spark, tmp_path):
    docs = spark.createDataFrame([("a", "en", 3)], "source string, lang string, n int")
    ledger = str(tmp_path / "ledger")
    torn = rollup.inserted(docs, "v", "n").selectExpr("*", "'b1' as batch", "'00' as attempt")
    torn.write.parquet(f"{ledger}/rows/b1/00")  # written, not marked
    assert rollup.commit(ledger, "b1", rollup.inserted(docs, "v", "n"))
    assert not rollup.commit(ledger, "b1", rollup.inserted(docs, "v", "n"))
    with pytest.raises(ValueError):
        rollup.commit(ledger, "b1", rollup.inserted(docs.union(docs), "v", "n"))
    assert [tuple(r) for r in rollup.totals(spark, ledger).collect()] == [("a", "en", "v", 1, 3)]
    spark.createDataFrame([("b1", "ff", 1, 0)], "batch string, attempt string, n long, digest long").write.mode("append").parquet(f"{ledger}/committed/b1")
    torn.withColumn("attempt", __import__("pyspark").sql.functions.lit("ff")).write.parquet(f"{ledger}/rows/b1/ff")  # a second writer at the same time
    assert [tuple(r) for r in rollup.totals(spark, ledger).collect()] == [("a", "en", "v", 1, 3)]


def test_query_against_the_library(spark, small):
    """Totals of the tokenizer and of the revised documents, counted plainly."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    quality = {}
    for r in queries.table(spark, small, "labels").collect():
        quality[r["doc_id"]] = min(quality.get(r["doc_id"], r["quality"]), r["quality"])
    want = {}
    for r in queries.table(spark, small, "documents").collect():
        q = quality.get(r["doc_id"])
        if q == 0:
            continue
        version = queries.OLD_VERSION if q is None else queries.NEW_VERSION
        n = len(plain.encode(r["text"] or "", add_special_tokens=False).ids) if q is None else len(re.findall("[A-Za-z0-9\x80-\U0010ffff]+|[^A-Za-z0-9\x80-\U0010ffff \t\n\r\f]", r["text"] or ""))
        key = (r["source"], r["lang"], version)
        d, t = want.get(key, (0, 0))
        want[key] = (d + 1, t + n)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in queries.op7_token_rollup(spark, small).collect()}
    assert got == want and {k[2] for k in want} == {queries.OLD_VERSION, queries.NEW_VERSION}


def test_a_folded_ledger_adds_up_the_same_and_commits_once(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    batch = lambda k: rollup.inserted(spark.createDataFrame([("a", "en", k), (None, "en", 1)], "source string, lang string, n int"), "v", "n")
    state = lambda: {tuple(r) for r in rollup.totals(spark, ledger).collect()}
    assert rollup.fold(spark, ledger) == 0
    for k in (1, 2):
        rollup.commit(ledger, f"b{k}", batch(k))
    before = state()
    assert rollup.fold(spark, ledger) == 2 and rollup.fold(spark, ledger) == 0 and state() == before == {("a", "en", "v", 2, 3), (None, "en", "v", 2, 2)}
    rollup.sweep(spark, ledger)
    assert state() == before and not (tmp_path / "ledger/rows/b1").exists()
    assert not rollup.commit(ledger, "b1", batch(1)) and state() == before
    with pytest.raises(ValueError, match="other sums"):
        rollup.commit(ledger, "b2", batch(3))
    assert rollup.commit(ledger, "b3", batch(4)) and rollup.fold(spark, ledger) == 1
    rollup.sweep(spark, ledger)
    assert state() == {("a", "en", "v", 3, 7), (None, "en", "v", 3, 3)} and sorted(p.name for p in (tmp_path / "ledger/folded").iterdir() if p.is_dir()) == ["00000002"]
    torn = tmp_path / "ledger/folded/00000003/totals-x"  # a fold that broke off before its list
    spark.createDataFrame([("x", "x", "x", 9, 9)], "source string, lang string, tokenizer_version string, n_docs long, n_tokens long").write.parquet(str(torn))
    assert state() == {("a", "en", "v", 3, 7), (None, "en", "v", 3, 3)}
    rollup.commit(ledger, "b4", rollup.deleted(spark.createDataFrame([("a", "en", 7)], "source string, lang string, n int"), "v", "n"))
    assert rollup.fold(spark, ledger) == 1 and state() == {("a", "en", "v", 2, 0), (None, "en", "v", 3, 3)}


def test_odd_batches(spark, tmp_path):
    """Long texts, ties and columns that are called like the ledger's own."""
    ledger = str(tmp_path / "ledger")
    docs = spark.createDataFrame([(1, "a", "en", "x " * 300_000, "q", "r", 5)] * 3 + [(2, None, None, None, None, None, None)], "doc_id long, source string, lang string, text string, batch string, attempt string, n_docs int")
    rows = rollup.counts(docs, tokenizer_path(), "n")
    assert rows.columns == ["doc_id", "source", "lang", "batch", "attempt", "n_docs", "n"]
    each = rows.where("doc_id = 1").first()["n"]
    rollup.commit(ledger, "1", rollup.inserted(rows, "v", "n"))
    assert {tuple(r) for r in rollup.totals(spark, ledger).collect()} == {("a", "en", "v", 3, 3 * each), (None, None, "v", 1, 0)}
    rollup.commit(ledger, "empty", rollup.inserted(rows.where("false"), "v", "n"))
    assert rollup.totals(spark, ledger).count() == 2
