"""Parsers, sinks, streams and whole runs."""

from __future__ import annotations

import inspect
import json
import random
import zipfile
from datetime import date, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import errors
from tidemark.operators import events, judge, risk
from tidemark.plans import runs
from tidemark.sources import parsers, tabular
from tidemark.sources.store import Store, differences, write_report
from tidemark.streaming import flow


def payload(spark, *values, symbol="A"):
    return spark.createDataFrame([(symbol, json.dumps(v)) for v in values], "symbol string, payload string")


def test_bars(spark):
    a = {"data": {"symbol": "E", "allBars": [{"date": "2024-11-27T00:00", "close": 1.5}, {"close": 2.0}], "bars": [{"date": "2020-01-01", "close": 9.0}]}}
    b = {"data": {"symbol": "F", "bars": [{"date": "2020-01-01", "close": 9.0, "quantity": 3}]}}
    got = {(r["symbol"], str(r["bar_date"]), r["close"], r["open"], r["knowledge_date"] == r["bar_date"]) for r in parsers.bars(payload(spark, a, b)).collect()}
    assert got == {("E", "2024-11-27", 1.5, None, True), ("F", "2020-01-01", 9.0, None, True)}


def test_corporate_actions_refuse_blank_dates(spark):
    ok, refused = parsers.corporate_actions(payload(spark, {"capital_increases_exdates": ["2023-08-25", "", " "], "dividends": [{"exDate": "2024-05-01"}]}))
    assert {(r["kind"], str(r["ex_date"])) for r in ok.collect()} == {("capital_increase", "2023-08-25"), ("dividend", "2024-05-01")}
    assert refused.first()["n_refused"] == 2


def test_series(spark):
    cpi = parsers.consumer_prices(payload(spark, {"items": [{"Tarih": "2023-12", "TP_FG_J0": "1.5"}, {"Tarih": "2023-2", "TP_FG_J0": "x"}]}))
    assert [(str(r["bar_date"]), str(r["knowledge_date"]), r["value"]) for r in cpi.collect()] == [("2023-12-01", "2024-01-03", 1.5)]
    week = parsers.weekly_series(payload(spark, {"items": [{"Tarih": "03-01-2025", "A_B": "2"}, {"Tarih": "bad", "A_B": "2"}]}), "A.B", "FLOW")
    assert [(str(r["bar_date"]), str(r["knowledge_date"])) for r in week.collect()] == [("2025-01-03", "2025-01-09")]
    vix = parsers.observations(payload(spark, {"observations": [{"date": "2025-03-03", "value": "."}, {"date": "2025-03-04", "value": "19.5"}]}), "VIX")
    assert [r["value"] for r in vix.collect()] == [19.5]
    cds = parsers.quotes(payload(spark, {"result": {"quote": {"1": {"DATA_VAL": "2025-01-01", "CLOSE_VAL": 3.0}, "2": {"DATA_VAL": "2024-01-01", "CLOSE_VAL": 4.0}}}}), "CDS", "2025-01-01")
    assert [r["value"] for r in cds.collect()] == [3.0]


def test_news_lines(spark):
    good = "\t".join(["id", "20250101", "", "s", "d", "", "", "WAR", "", "1#x#TU#", *[""] * 5, "1,2,3,4", *[""] * 11])
    df = spark.createDataFrame([(good,), ("a\tb",)], "value string")
    assert parsers.news(df).count() == 1
    with pytest.raises(errors.Drift):
        parsers.news_or_drift(df.where("value like 'a%'"))


def test_html(spark):
    html = "<style>p{}</style><table><tr><td>Label</td><td>A &amp; <b>B</b>&nbsp;C</td></tr></table><script>x</script>"
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(parsers.cell(F.col("h"), "Label"), parsers.plain(F.col("h"))).first() == ("A & B C", "Label A & B C")


def test_sheets(tmp_path, spark):
    path = str(tmp_path / "a.xlsx")
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>code</t></si><si><r><t>na</t></r><r><t>me</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="C2" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    assert tabular.read_rows(path) == [["code", "", "name"], ["7", "", "x"]]
    (tmp_path / "b.tsv").write_text("a\tb\n1\t2\n")
    assert tabular.frame(spark, str(tmp_path / "b.tsv")).first() == ("1", "2")
    with pytest.raises(ValueError):
        tabular.read_rows("c.pdf")
    parts = tabular.sections([["Sanayi"], ["AAA", "x"], ["BBB"], ["Gıda"], ["AAA"], ["Banka"], ["CCC"]])
    assert tabular.sector_tree(parts) == [("Sanayi", None), ("Gıda", "Sanayi"), ("Banka", None)]
    assert tabular.codes(["Gıda & İçecek", "gida icecek"]) == ["gida-icecek", "gida-icecek-2"]


def test_store_is_idempotent(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("F", date(2024, 1, i), float(i), date(2024, 1, i)) for i in (1, 2)], "factor string, bar_date date, value double, knowledge_date date")
    store.append("factors", rows)
    store.append("factors", rows.unionByName(rows.withColumn("knowledge_date", F.lit(date(2024, 2, 1)))))
    assert store.read("factors").count() == 4 and store.tables() == ["factors"]
    with pytest.raises(errors.Refused):
        store.append("factors", rows.withColumn("knowledge_date", F.lit(None).cast("date")))
    with pytest.raises(errors.Refused):
        store.read("other")
    store.clear("factors")
    assert store.read("factors").count() == 0


def test_reports_and_differences(tmp_path):
    assert json.loads(open(write_report(str(tmp_path), "r", {"x": float("nan"), "d": date(2024, 1, 1)})).read())["d"] == "2024-01-01"
    gold = {"a": [{"id": 1, "v": 2.0}], "b": "x"}
    assert differences(gold, {"a": [{"id": 0}, {"id": 1, "v": 2.0000001}], "b": "x", "c": 1}) == []
    assert len(differences(gold, {"a": [{"id": 1, "v": 3.0}]})) == 2


def test_stream_is_the_batch(spark, small, tmp_path):
    df = spark.read.parquet(f"{small}/events.parquet")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = flow.quarter_hours(stream, late="60 days").writeStream.format("memory").queryName("quarters").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda d: {(r["start"], r["event_type"]): (r["n"], round(r["total"], 6)) for r in d.collect()}
    assert key(spark.table("quarters")) == key(flow.quarter_hours(df))


def test_landing_twice_adds_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([(f"e{i % 5}", date(2024, 1, 1), "pandemic", date(2024, 1, 1)) for i in range(20)], "event_id string, event_date date, event_type string, knowledge_date date")
    rows.write.parquet(str(tmp_path / "in"))
    for k in range(2):
        flow.land(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), store, "events", str(tmp_path / f"ck{k}")).awaitTermination(120)
    assert store.read("events").count() == 5


def test_factor_model_run(spark, tmp_path):
    store, r = Store(spark, str(tmp_path / "m")), np.random.default_rng(0)
    days = [date(2023, 1, 2) + timedelta(i) for i in range(90)]
    mkt, fx = np.exp(np.cumsum(0.01 * r.normal(size=90))), np.exp(np.cumsum(0.005 * r.normal(size=90)))
    store.append("factors", spark.createDataFrame([(f, d, float(v), d) for f, x in (("XU100", mkt), ("USDTRY", fx)) for d, v in zip(days, x)], "factor string, bar_date date, value double, knowledge_date date"))
    closes = {s: 100 * mkt**b for s, b in (("A", 1.0), ("B", 0.5))}
    store.append("prices", spark.createDataFrame([(s, d, float(v), 1.0, d) for s, x in closes.items() for d, v in zip(days, x)], "symbol string, bar_date date, close double, quantity double, knowledge_date date"))
    assert runs.build_returns(store, as_of="2023-12-31").count() == 178
    out = runs.refit(store, as_of="2023-12-31", window=40, least=30, report_dir=str(tmp_path / "reports"))
    assert out["factors"] == ["XU100", "USDTRY"] and out["n_betas"] == 2 * 2 * 50 and out["n_residuals"] == 2 * 50
    assert runs.refit(store, as_of="2023-12-31", window=40, least=30)["n_betas"] == out["n_betas"]
    priced = runs.scenario_analysis(store, as_of="2023-12-31")
    assert {s["scenario"] for s in priced["scenarios"]} >= {"try_depreciation_10", "global_risk_off"} and priced["skipped"] == []
    assert runs.scenario_analysis(store, as_of="2022-01-01")["scenarios"] == []


def test_planted_signal_passes_and_noise_does_not(spark):
    r = np.random.default_rng(1)
    days = [date(2023, 1, 2) + timedelta(i) for i in range(240)]
    good, noise = 0.02 + 0.05 * r.normal(size=240), 0.05 * r.normal(size=240)
    rows = [(v, d, float(x)) for v, s in (("good", good), ("noise", noise)) for d, x in zip(days, s)]
    m = {x["variant"]: x for x in judge.moments(spark.createDataFrame(rows, "variant string, bar_date date, net double"), "variant").collect()}
    dsr = {v: judge.deflated_sharpe(x["sharpe"], x["n"], x["skew"], x["kurtosis"], 12) for v, x in m.items()}
    assert dsr["good"]["passes"] and not dsr["noise"]["passes"]


def test_signals_are_searched_over_the_whole_grids(spark):
    r = random.Random(4)
    days = [date(2023, 1, 2) + timedelta(i) for i in range(72)]
    rows = [(f"S{k}", d, r.gauss(0, 0.02)) for d in days for k in range(10)]
    rets = spark.createDataFrame(rows, "symbol string, bar_date date, ret double")
    betas = rets.selectExpr("symbol", "'fx' as channel", "bar_date", "ret * 10 as beta")
    specs = spark.createDataFrame([(days[i], "fx", 1) for i in (8, 20, 33, 47, 60)], "event_date date, channel string, shock_sign int")
    out = runs.event_signal(betas, rets, specs)
    assert out["n_trials"] == 12 and {"promoted", "best_baseline", "pbo", "dsr"} <= set(out) and out["pbo"] is not None
    grid = inspect.signature(runs.statarb).parameters
    assert len(grid["accums"].default) * len(grid["thresholds"].default) * len(grid["least_corrs"].default) == 12 and grid["lookback"].default == 60


def test_workbook_parts_by_their_relations(spark, tmp_path):
    """The first listed sheet counts, whatever its part is called; runs are joined, readings left out, gaps filled."""
    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    for name in ("a.xlsx", "b.xlsm"):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="one" sheetId="2" r:id="rId9"/><sheet name="two" sheetId="1" r:id="rId1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId9" Target="/xl/worksheets/last.xml"/></Relationships>')
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>co</t></si><si><r><t>na</t></r><r><t>me</t></r><rPh><t>no</t></rPh></si></sst>')
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c r="A1"><v>wrong</v></c></row></sheetData></worksheet>')
            z.writestr("xl/worksheets/last.xml", f'<worksheet xmlns="{ns}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c t="inlineStr"><is><t>x</t></is></c><c><v>7</v></c></row><row r="3"/></sheetData></worksheet>')
    assert tabular.read_rows(str(tmp_path / "a.xlsx")) == [["co", "", "name"], ["x", "7"], []]
    rows = tabular.grids(spark, str(tmp_path / "*.xls*")).collect()
    assert sorted((Path(r["path"]).name, r["row"], r["cells"]) for r in rows)[:2] == [("a.xlsx", 0, ["co", "", "name"]), ("a.xlsx", 1, ["x", "7"])] and len(rows) == 6
    (tmp_path / "c.tab").write_bytes("﻿a\tb\r\n1\t2\r\n3\r\n".encode())
    assert sorted(map(tuple, tabular.frame(spark, str(tmp_path / "c.tab")).collect())) == [("1", "2"), ("3", "")]


def test_store_by_months(spark, tmp_path):
    store = Store(spark, str(tmp_path / "months"))
    days = [date(2024, m, d) for m in (1, 2, 3) for d in (1, 15)]
    rows = spark.createDataFrame([("A", d, 1.0, d) for d in days] + [("B", d, 2.0, d) for d in days], "symbol string, bar_date date, ret_usd double, knowledge_date date")
    assert store.append("total_returns", rows) == 12 and store.append("total_returns", rows) == 12
    assert sorted(p.name for p in (tmp_path / "months/total_returns").glob("month=*")) == ["month=2024-01", "month=2024-02", "month=2024-03"]
    assert store.read("total_returns", months=["2024-02"]).count() == 4
    old = sorted((tmp_path / "months/total_returns/month=2024-03").glob("*.parquet"))
    new = spark.createDataFrame([("A", date(2024, 2, 15), 9.0, date(2024, 5, 1))], "symbol string, bar_date date, ret_usd double, knowledge_date date").withColumn("ret_real_try", F.lit(None).cast("double")).withColumn("ret_nominal_try", F.lit(None).cast("double")).withColumn("limit_lock_adj", F.lit(None).cast("boolean"))
    store.overwrite_span("total_returns", new, new, "2024-02-01", "2024-02-28")
    assert sorted((r["symbol"], r["bar_date"], r["ret_usd"]) for r in store.read("total_returns", months=["2024-02"]).collect()) == [("A", date(2024, 2, 15), 9.0), ("B", date(2024, 2, 1), 2.0), ("B", date(2024, 2, 15), 2.0)]
    assert store.read("total_returns").count() == 11 and sorted((tmp_path / "months/total_returns/month=2024-03").glob("*.parquet")) == old
    store.overwrite_span("total_returns", new.where("false"), rows, "2024-01-01", "2024-01-31")
    assert store.read("total_returns").count() == 7
    store.clear("total_returns")
    assert store.read("total_returns").count() == 0 and store.append("total_returns", rows) == 12 and store.read("total_returns").count() == 12


BARS = "symbol string, bar_date date, close double, quantity double, knowledge_date date"


def _returns(store):
    return {(r["symbol"], r["bar_date"]): round(r["ret_nominal_try"], 9) for r in store.read("total_returns").collect()}


def test_a_corrected_bar_changes_the_stored_return(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "l2"))
    days = [date(2024, m, d) for m in (1, 2, 3) for d in (1, 2, 3)]
    store.append("prices", spark.createDataFrame([(s, d, 100.0 + i, 1.0, d) for s in "AB" for i, d in enumerate(days)], BARS))
    first = runs.build_returns(store, as_of="2024-12-31")
    assert first.count() == 16 and first.where("knowledge_date != bar_date").count() == 0
    before, parts = _returns(store), [p for p in store._manifest("total_returns")["parts"]]
    number = store.number("total_returns")
    # the same run again changes no row, without overwriting adds none
    runs.build_returns(store, as_of="2024-12-31")
    runs.build_returns(store, as_of="2024-12-31", overwrite=False)
    assert _returns(store) == before
    # a later version of one bar changes the returns into and out of it, and nothing else
    store.append("prices", spark.createDataFrame([("A", days[4], 50.0, 1.0, date(2024, 6, 1))], BARS))
    runs.build_returns(store, as_of="2024-05-31")
    assert _returns(store) == before
    runs.build_returns(store, as_of="2024-12-31", symbols=spark.createDataFrame([("A",)], "symbol string"))
    after = _returns(store)
    assert {k for k in before if before[k] != after[k]} == {("A", days[4]), ("A", days[5])} and len(after) == 16
    assert after["A", days[4]] == round(50 / 103 - 1, 9)
    # readers of an earlier manifest still see what was there
    assert {(r["symbol"], r["bar_date"]): round(r["ret_nominal_try"], 9) for r in store.read("total_returns", number=number).collect()} == before and parts


def test_a_killed_write_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "l2"))
    schema = "symbol string, bar_date date, ret_usd double, knowledge_date date"
    days = [date(2024, m, 1) for m in (1, 2, 3)]
    store.append("total_returns", spark.createDataFrame([("A", d, 1.0, d) for d in days], schema))
    new = spark.createDataFrame([("A", d, 2.0, d) for d in days], schema)
    state = lambda: sorted((r["bar_date"], r["ret_usd"]) for r in store.read("total_returns").collect())
    old = state()
    with pytest.raises(Exception, match="stopped"):  # a task fails
        store.overwrite_recomputed("total_returns", new.withColumn("ret_usd", F.when(F.col("bar_date") == days[2], F.raise_error(F.lit("stopped")).cast("double")).otherwise(2.0)))
    assert state() == old
    commit = Store._commit
    monkeypatch.setattr(Store, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))  # the driver dies behind the write
    for change in (lambda: store.overwrite_recomputed("total_returns", new), lambda: store.replace("total_returns", new), lambda: store.overwrite_span("total_returns", new, new, "2024-01-01", "2024-03-31"), lambda: store.clear("total_returns")):
        with pytest.raises(RuntimeError):
            change()
        assert state() == old
    monkeypatch.setattr(Store, "_commit", commit)
    # of two writers that began with one state the second is refused
    begun = store._begin("total_returns")[0]
    store.overwrite_recomputed("total_returns", new)
    with pytest.raises(errors.Refused, match="another writer"):
        store._commit("total_returns", begun, [])
    assert state() == [(d, 2.0) for d in days]
    assert store.sweep("total_returns") > 0 and state() == [(d, 2.0) for d in days]


def test_commits_are_made_one(spark, tmp_path):
    store = Store(spark, str(tmp_path / "l2"))
    schema = "symbol string, bar_date date, ret_usd double, knowledge_date date"
    for k in range(5):
        store.append("total_returns", spark.createDataFrame([(f"S{k}", date(2024, m, 1), float(k), date(2024, m, 1)) for m in (1, 2)], schema))
    rows = sorted(map(tuple, store.read("total_returns").collect()))
    assert store.compact("total_returns", least=6) == 0 and store.compact("total_returns", least=5) == 2
    assert sorted(map(tuple, store.read("total_returns").collect())) == rows and len(store._manifest("total_returns")["parts"]) == 2
    for k in range(3):
        store.append("universe_membership", spark.createDataFrame([(f"S{k}", "listed", date(2024, 1, 1), date(2024, 1, 1))], "symbol string, universe string, valid_from date, knowledge_date date"))
    assert store.compact("universe_membership", least=2) == 1 and store.read("universe_membership").count() == 3


def test_a_store_of_version_1_at_version_2(spark, tmp_path):
    old = Store(spark, str(tmp_path / "g"), version=1)
    securities = spark.createDataFrame([(f"u{i}", f"I{i}", f"T{i}") for i in range(3)], "uuid string, isin string, ticker string")
    old.append("security", securities)
    old.append("issues", spark.createDataFrame([("c", "u0")], "src string, dst string"))
    assert "nominal" not in old.read("security").columns and old.ledger().count() == 0
    new = Store(spark, str(tmp_path / "g"))
    assert new.read("security").where("nominal is null and is_amortizing is null").count() == 3  # read before anything is applied
    new.append("security", spark.createDataFrame([("u3", "I3", 5.0, True)], "uuid string, isin string, nominal double, is_amortizing boolean"))
    assert {(r["uuid"], r["nominal"]) for r in new.read("security").collect()} == {("u0", None), ("u1", None), ("u2", None), ("u3", 5.0)}
    applied = new.migrate()
    assert sorted(applied) == sorted(("issues", 2, c) for c in ("instrument_class", "source", "extraction_method", "confidence"))
    number = new.number("issues")
    assert new.migrate() == [] and new.number("issues") == number and new.ledger().count() == 16
    assert new.read("issues").where("confidence is null").count() == 1
    assert old.read("security").count() == 4  # an old reader takes the columns it knows
    with pytest.raises(errors.Refused, match="version 2"):
        old.append("security", securities)


def test_folders_without_manifests_are_taken_over(spark, tmp_path):
    rows = spark.createDataFrame([("A", date(2024, m, 1), 1.0, date(2024, m, 1)) for m in (1, 2)], "symbol string, bar_date date, ret_usd double, knowledge_date date")
    rows.withColumn("month", F.date_format("bar_date", "yyyy-MM")).write.partitionBy("month").parquet(str(tmp_path / "l2/total_returns"))
    store = Store(spark, str(tmp_path / "l2"))
    assert store.read("total_returns").count() == 2 and store.read("total_returns", months=["2024-01"]).count() == 1
    store.append("total_returns", rows.withColumn("symbol", F.lit("B")))
    assert store.read("total_returns").count() == 4 and store.read("total_returns", months=["2024-02"]).count() == 2


def test_bootstrap_makes_what_is_missing(spark, tmp_path):
    from tidemark.schemas import STORED

    store = Store(spark, str(tmp_path / "s"))
    store.append("person", spark.createDataFrame([("p", "P")], "uuid string, name string"))
    made = store.bootstrap()
    assert set(made) == set(STORED) - {"person"} and store.bootstrap() == [] and set(store.tables()) == set(STORED)
    assert store.read("person").count() == 1 and store.read("prices").count() == 0 and store.migrate() == []


def test_counts_and_relations_of_documents(spark):
    df = spark.createDataFrame([(json.dumps({"relations": [{"parent": "A", "child": "B", "pct": 1.0, "as_of": "2024-01-01T00:00"}, {"parent": "A", "child": "B", "pct": 2.0}, {"parent": None, "child": "C"}]}),), ("{}",)], "payload string")
    rows = parsers.relations(df)
    assert [(r["parent"], r["pct"], str(r["as_of"])) for r in rows.orderBy("row").collect()] == [("A", 1.0, "2024-01-01"), ("A", 2.0, "None")]
    assert parsers.refuse_count_drift(rows, 2, "relations") is None
    with pytest.raises(errors.Drift, match="2 records instead of 3"):
        parsers.refuse_count_drift(rows, 3, "relations")


def test_panels_of_what_was_known(spark, tmp_path):
    store = Store(spark, str(tmp_path / "l2"))
    days = [date(2024, 1, d) for d in range(1, 6)]
    store.append("residuals", spark.createDataFrame([(s, d, 0.1, d) for s in "AB" for d in days if not (s == "B" and d == days[2])] + [("C", days[0], 0.2, days[0])], "symbol string, bar_date date, residual double, knowledge_date date"))
    store.append("total_returns", spark.createDataFrame([("A", days[0], 0.5, True, days[0]), ("A", days[0], 0.7, False, date(2024, 1, 9)), ("A", days[1], 0.9, None, date(2025, 1, 1)), ("Z", days[0], 1.0, False, days[0])], "symbol string, bar_date date, ret_usd double, limit_lock_adj boolean, knowledge_date date"))
    got = {(r["symbol"], r["bar_date"]): (r["x"], r["ret"], r["is_limit_lock"], r["short_eligible"]) for r in runs.statarb_panels(store, as_of="2024-06-01", least=3).collect()}
    assert set(got) == {(s, d) for s in "AB" for d in days}
    assert got["A", days[0]] == (0.1, 0.7, False, None) and got["A", days[1]] == (0.1, None, None, None) and got["B", days[2]] == (None, None, None, None)


def test_reports_in_any_store(spark, tmp_path):
    at = write_report(f"file://{tmp_path}/reports", "r", {"x": float("nan"), "ğ": [date(2024, 1, 1)]})
    assert at.endswith("/reports/r.json") and json.loads((tmp_path / "reports/r.json").read_text(encoding="utf-8"))["ğ"] == ["2024-01-01"]
    write_report(f"file://{tmp_path}/reports", "r", {"x": 2})
    assert json.loads((tmp_path / "reports/r.json").read_text())["x"] == 2


def test_stress_by_type_reads_betas_and_events_once(spark, tmp_path):
    kind, channel = next((k, c) for k, p in events.PRIOR.items() for c in p if c in risk.CHANNEL_FACTOR)
    factor = risk.CHANNEL_FACTOR[channel]
    spark.createDataFrame([("a", factor, date(2024, 1, 1), 2.0), ("b", factor, date(2024, 1, 1), 1.0)], "symbol string, factor string, bar_date date, beta double").write.parquet(str(tmp_path / "betas"))
    spark.createDataFrame([(1, kind, 0.5), (1, kind, 0.5), (2, kind, 1.0)], "event_id long, event_type string, severity double").write.parquet(str(tmp_path / "events"))
    got = risk.type_stress(risk.exposures(spark.read.parquet(str(tmp_path / "betas"))), spark.read.parquet(str(tmp_path / "events")))
    assert not [f for f in got.inputFiles() if str(tmp_path) in f]
    assert [(r["event_type"], r["n_events"], r["mean_severity"], r["n"]) for r in got.where(F.col("event_type") == kind).collect()] == [(kind, 2, 0.75, 2)]
