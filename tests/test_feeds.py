"""Landing, reference tables, entities, probes and the feed source."""

from __future__ import annotations

import io
import json
import zipfile
from datetime import date, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tidemark import errors
from tidemark.operators import entities, factors, graph, monitors, pit, probes, risk
from tidemark.plans import onboarding, runs
from tidemark.sources import adapter, archives, graphload, landing, members, parsers, reference
from tidemark.sources.store import Store


class Fake(adapter.Adapter):
    """Limited at first, then as asked for."""

    name = "fake"

    def __init__(self):
        self.left = 2

    def fetch(self, request):
        if self.left:
            self.left -= 1
            raise adapter.RateLimited("slower")
        if request.get("broken"):
            return "<html>sorry</html>"
        return json.dumps({"data": {"symbol": request["symbol"], "bars": [{"date": "2024-01-02", "close": 2.0}]}})

    def smoke(self):
        return {"a": [{"id": 1, "v": 1.0}]}, {"a": [{"id": 1, "v": 1.5}]}


def test_feed_source(spark, monkeypatch):
    waits = []
    assert json.loads(adapter.patient(Fake(), {"symbol": "A"}, sleep=waits.append))["data"]["symbol"] == "A"
    assert len(waits) == 2 and 1 <= waits[0] <= 1.25 and 2 <= waits[1] <= 2.5
    with pytest.raises(adapter.Unreachable):
        adapter.patient(Fake(), {"symbol": "A"}, tries=2, sleep=waits.append)
    with pytest.raises(adapter.Unreachable):
        adapter.patient(Fake(), {"symbol": "A", "broken": 1}, sleep=waits.append)
    with pytest.raises(errors.Drift):
        adapter.smoke_check(Fake())
    spark.dataSource.register(adapter.FeedSource)
    feed = spark.read.format("tidemark_feed").option("adapter", "tests.test_feeds:Fake").option("requests", json.dumps([{"symbol": s} for s in "AB"])).load()
    rows = landing.level_rows(feed).collect()
    assert sorted((r["factor"], r["value"], str(r["bar_date"])) for r in rows) == [("A", 2.0, "2024-01-02"), ("B", 2.0, "2024-01-02")]


def test_landing_gives_an_account(spark, tmp_path):
    store = Store(spark, str(tmp_path / "l2"))
    bars = [{"date": f"2024-01-0{d}", "close": c, "quantity": q} for d, c, q in ((1, 100.0, 5.0), (2, 110.0, 0.0), (3, None, None))]
    feed = spark.createDataFrame([(json.dumps({"data": {"symbol": "A", "allBars": bars}}),)], "payload string")
    out = landing.land(store, "prices", landing.price_rows(feed), report_dir=str(tmp_path))
    assert (out["n"], str(out["first"]), str(out["last"])) == (3, "2024-01-01", "2024-01-03") and (tmp_path / "land_prices.json").exists()
    assert {(str(r["bar_date"]), r["is_limit_lock"], r["is_stale"]) for r in store.read("prices").collect()} == {("2024-01-01", False, False), ("2024-01-02", True, True), ("2024-01-03", False, True)}
    assert landing.land(store, "factors", landing.level_rows(feed, "USDTRY"))["n"] == 2
    news = spark.createDataFrame([("r1", "20250319", "TERROR", "1#x#TU#", "-5,1,2,3"), ("r2", "20250319", "OTHER", "1#x#TU#", "-5,1,2,3"), ("r3", "20250319", "TERROR", "1#x#US#", "")], "record_id string, date string, themes string, locations string, tone string")
    out = landing.land_news(store, news)
    assert out["n"] == 1 and out["n_targets"] == 3 and out["skipped"] == {"untyped": 1, "other_country": 1}
    verdict = {"n_trials": 12, "dsr": None, "pbo": 0.2, "beats_baselines": False, "promoted": False}
    row = spark.createDataFrame([("s", "h", date(2024, 1, 1))], "signal_id string, hypothesis string, knowledge_date date")
    assert landing.land_registry(store, verdict, row)["n"] == 1
    landing.land_registry(store, verdict, row)
    assert [(r["n_trials"], r["deflated_sharpe"], r["promoted"]) for r in store.read("signal_registry").collect()] == [(12, None, False)]
    with pytest.raises(errors.Refused):
        landing.membership_rows(spark.createDataFrame([('{"universe_membership": []}',)], "payload string"))


def test_sector_references_and_inheritance(spark):
    good = spark.createDataFrame([("M", 1, None), ("L", 2, "M")], "code string, level int, parent string")
    reference.refuse_bad_sectors(good, spark.createDataFrame([("A", "L")], "ticker string, leaf string"))
    with pytest.raises(errors.Refused):
        reference.refuse_bad_sectors(good, spark.createDataFrame([("A", "M")], "ticker string, leaf string"))
    up = reference.rolled_up(spark.createDataFrame([("a", "L"), ("b", "M"), ("c", "X")], "symbol string, sector string"), good)
    assert {tuple(r) for r in up.collect()} == {("a", "M"), ("b", "M"), ("c", "X")}
    companies = spark.createDataFrame([(1, "a", False), (2, "", False), (3, None, True), (4, None, False)], "uuid long, ticker string, external boolean")
    got = reference.backfill_sectors(companies, good, spark.createDataFrame([("A", "L")], "ticker string, leaf string"), spark.createDataFrame([(1, 2), (1, 3)], "parent long, child long"))
    assert {tuple(r) for r in got.collect()} == {(1, "L", "reference", "linked"), (2, "L", "inherited", "linked"), (3, None, None, "no-sector"), (4, None, None, "no-sector")}


def test_record_matching(spark):
    c = spark.createDataFrame([(1, "GARANTİ YATIRIM ORTAKLIĞI A.Ş."), (2, "Q A.Ş."), (3, "Alfa Emeklilik Fonu"), (4, None), (5, "KOÇ HOLDİNG A.Ş.")], "uuid long, name string")
    r = spark.createDataFrame([("L1", "Garanti Yatirim Emeklilik Fonu", "ACTIVE"), ("L2", "GARANTI YATIRIM ORTAKLIGI", "LAPSED"), ("L3", "GARANTI YATIRIM", "ACTIVE"), ("L4", "Q GIDA", "ACTIVE"), ("L5", "ALFA EMEKLILIK FONU", "ACTIVE"), ("L6", "KOC HOLDING AS", None)], "lei string, legal_name string, status string")
    got = {x["key"]: (x["lei"], x["score"], x["status"]) for x in entities.match_records(c, r).collect()}
    assert got == {1: ("L3", 1.0, "matched"), 2: ("L4", 0.4, "below_threshold"), 3: ("L5", 1.0, "matched"), 4: (None, None, "no_candidates"), 5: ("L6", 1.0, "matched")}


def test_record_matching_with_common_words(spark, monkeypatch):
    from tidemark import tables

    used = []

    def few(df, rows, *keys, each=0):
        used.append((keys, rows))
        return tables.dealt(df, rows, *keys, each=5)

    monkeypatch.setattr(entities, "dealt", few)
    c = spark.createDataFrame([(1, "Sanko Tekstil Boya"), (2, "Tekstil"), (3, "Sanko"), (4, "Tekstil Boya"), (5, "Nobody Tekstil"), (6, "Boya Sanko")], "uuid long, name string")
    r = spark.createDataFrame([(f"L{k}", f"TEKSTIL BOYA X{k}", "ACTIVE") for k in range(9)] + [("M1", "SANKO TEKSTIL", "ACTIVE"), ("M2", "SANKO BOYA TEKSTIL", "LAPSED")], "lei string, legal_name string, status string")
    for common in (50_000, 2, 1, 0):
        got = {x["key"]: (x["lei"], x["score"]) for x in entities.match_records(c, r, common=common).collect()}
        assert got == {1: ("M2", 0.95), 2: ("M1", 1.0), 3: ("M1", 1.0), 4: ("L0", 1.0), 5: (None, None), 6: ("M2", 0.95)}, common
    assert min(rows for keys, rows in used if keys == ("one", "two")) < 20  # of 76 pairs of words


def test_lead_lag_is_numpys(spark):
    r = np.random.default_rng(3)
    names, days = ["a", "b", "c"], [date(2024, 1, 1) + timedelta(i) for i in range(90)]
    x = r.normal(size=(90, 3))
    x[1:, 1] += 0.8 * x[:-1, 0]
    holes = r.random((90, 3)) < 0.1
    rows = [(f"{n}{k}", n, days[i], float(x[i, j])) for i in range(90) for j, n in enumerate(names) if not holes[i, j] for k in range(3)]
    df = spark.createDataFrame(rows, "symbol string, sector string, bar_date date, residual double")
    z = probes.blocks(probes.sector_means(df.drop("sector"), df.select("symbol", "sector").distinct(), 3))
    ic = {v["horizon"]: (v["n_test"], v["ic"]) for v in probes.lead_lag_ic(z).collect()}
    pairs = {(v["horizon"], v["supplier"], v["customer"]): (v["train_corr"], v["test_corr"], v["confirmed"]) for v in probes.lead_lag_pairs(z, spark.createDataFrame([("a", "b"), ("b", "c")], "supplier string, customer string")).collect()}
    whole = np.where(holes, 0, x)[~holes.all(1)]
    for h in probes.HORIZONS:
        n = len(whole) // h
        b = whole[: n * h].reshape(n, h, 3).sum(1)
        half = n // 2
        q = (b - b[:half].mean(0)) / (b[:half].std(0) + 1e-9)
        if half - 1 < 6 or n - half - 1 < 5:
            assert h not in ic
            continue
        xt, yt, xe, ye = q[: half - 1], q[1:half], q[half : n - 1], q[half + 1 :]
        beta = np.linalg.solve(xt.T @ xt + 5 * np.eye(3), xt.T @ yt)
        want = np.mean([np.corrcoef(p, y)[0, 1] for p, y in zip(xe @ beta, ye)])
        assert ic[h] == (len(xe), pytest.approx(want, abs=1e-4))
        assert pairs[h, "a", "b"][:2] == (pytest.approx(np.corrcoef(xt[:, 0], yt[:, 1])[0, 1], abs=1e-4), pytest.approx(np.corrcoef(xe[:, 0], ye[:, 1])[0, 1], abs=1e-4))
    assert pairs[1, "a", "b"][2] and not pairs[1, "b", "c"][2]
    assert probes.named_pairs(spark.createDataFrame([("ANA METAL SANAYİ",), ("X İNŞAAT",), (None,)], "sector string")).collect() == [("ANA METAL SANAYİ", "X İNŞAAT")]


def test_scenarios_from_priors_and_spans(spark):
    assert risk.prior_shock("energy_supply_disruption", 0.5) == {"energy": 0.5, "market": -0.5}
    for bad in (("nothing", 1.0), ("pandemic", float("nan"))):
        with pytest.raises(errors.Refused):
            risk.prior_shock(*bad)
    levels = spark.createDataFrame([("USDTRY", date(2025, 3, 18), 10.0), ("USDTRY", date(2025, 3, 25), 11.0)], "factor string, bar_date date, value double")
    assert [(r["channel"], round(r["shock"], 9)) for r in risk.empirical_scenario(levels, factors.specs(), "2025-03-18", "2025-03-25", "s").collect()] == [("fx", 0.1)]
    with pytest.raises(errors.Fabrication):
        risk.empirical_scenario(levels, factors.specs(), "2020-03-18", "2020-03-25", "s")


def test_break_on_the_primary_factors(spark):
    r = np.random.default_rng(4)
    days = [date(2025, 1, 1) + timedelta(i) for i in range(160)]
    mkt, noise = r.normal(size=160), r.normal(size=160)
    rets = spark.createDataFrame([("S", d, float((1.0 if i < 80 else 2.0) * mkt[i] + 0.01 * noise[i])) for i, d in enumerate(days)], "symbol string, bar_date date, ret double")
    panel = spark.createDataFrame([("XU100", d, float(m)) for d, m in zip(days, mkt)] + [("OTHER", d, float(m)) for d, m in zip(days, noise)], "factor string, bar_date date, ret double")
    label = F.when(F.col("bar_date") < F.lit(days[80]), "a").otherwise("b")
    got = factors.regime_break_on(rets, panel, "a", "b", window=20, least=15, label=label).collect()
    assert len(got) == 1 and got[0]["factor"] == "XU100" and abs(got[0]["median_shift"] - 20 / 19) < 0.02  # covariances over n - 1, variances over n
    assert factors.regime_break_on(rets, panel.where("factor = 'OTHER'"), "a", "b").count() == 0


def test_grid_of_gates(spark):
    r = np.random.default_rng(5)
    common = r.normal(size=200)
    days = [date(2024, 1, 1) + timedelta(i) for i in range(200)]
    rows = [(f"S{k}", d, float(common[i] + r.normal())) for k in range(4) for i, d in enumerate(days)]
    leaves = spark.createDataFrame([(f"S{k}", f"L{k % 2}") for k in range(4)], "symbol string, sector string")
    sectors = spark.createDataFrame([("M", 1, None), ("L0", 2, "M"), ("L1", 2, "M")], "code string, level int, parent string")
    cells = runs.robustness_grid(spark.createDataFrame(rows, "symbol string, bar_date date, residual double"), leaves, sectors, windows=(60,), step=40, least=40)
    assert [(c["granularity"], c["n_sectors"], c["window"]) for c in cells] == [("leaf", 2, 60), ("main", 1, 60)]
    assert cells[1]["median_edges"] >= cells[0]["median_edges"] > 0


def test_diagnostics_of_a_landed_fit(spark, tmp_path):
    store = Store(spark, str(tmp_path / "l2"))
    days = [date(2024, 1, 1) + timedelta(i) for i in range(40)]
    store.append("total_returns", spark.createDataFrame([("A", d, float(i % 5), d) for i, d in enumerate(days)], "symbol string, bar_date date, ret_usd double, knowledge_date date"))
    store.append("residuals", spark.createDataFrame([("A", d, float(i % 5) / 2, d) for i, d in enumerate(days)], "symbol string, bar_date date, residual double, knowledge_date date"))
    store.append("betas", spark.createDataFrame([("A", "XU100", d, 1.0 + (i >= 20), "a" if i < 20 else "b", d) for i, d in enumerate(days)], "symbol string, factor string, bar_date date, beta double, regime string, knowledge_date date"))
    store.append("universe_membership", spark.createDataFrame([("A", "listed", "holding", days[0], days[0])], "symbol string, universe string, universe_class string, valid_from date, knowledge_date date"))
    out = runs.gate_diagnostics(store, as_of="2025-01-01", before="a", after="b", report_dir=str(tmp_path))
    assert out["variance_share_by_class"][0]["universe_class"] == "holding" and abs(out["variance_share_by_class"][0]["median"] - 0.75) < 1e-9
    assert out["regime_break"][0]["median_shift"] == 1.0 and out["regime_break_primary"] == [] and (tmp_path / "gate_diagnostics.json").exists()


def test_plans_of_pulls(spark):
    fresh = spark.createDataFrame([("A", None, "missing"), ("B", date(2024, 5, 1), "stale"), ("C", date(2024, 6, 1), "current")], "symbol string, last_bar date, status string")
    got = [(r["symbol"], str(r["start"])) for r in monitors.daily_plan(fresh, "2024-06-01", full_start="2023-01-01").orderBy("symbol").collect()]
    assert got == [("A", "2023-01-01"), ("B", "2024-04-26")] and monitors.daily_plan(fresh, "2024-06-01", limit=1).select("symbol").distinct().count() == 1
    classes = spark.createDataFrame([("A", None, date(2024, 1, 1), date(2024, 2, 1)), ("A", "x", date(2024, 1, 1), date(2024, 1, 1)), ("B", "y", date(2024, 1, 1), date(2025, 1, 1))], "symbol string, universe_class string, valid_from date, knowledge_date date")
    assert [tuple(r) for r in pit.universe_classes(classes, "2024-06-01").collect()] == [("A", "x")]


def test_updates_and_onboarding(spark, tmp_path):
    store = Store(spark, str(tmp_path / "l2"))
    symbols = spark.createDataFrame([("A",), ("B",)], "symbol string")

    def fetch(plan):
        got = [r["symbol"] for r in plan.collect()]
        bars = [{"date": f"2024-01-{d:02d}", "close": 10.0 + d, "quantity": 1.0} for d in range(1, 6)]
        return spark.createDataFrame([(json.dumps({"data": {"symbol": s, "bars": bars}}),) for s in got if s != "B"], "payload string")

    dry = runs.daily_update(store, symbols, as_of="2024-01-06")
    assert (dry["mode"], dry["freshness"], dry["n_to_pull"]) == ("dry-run", {"missing": 2}, 2) and store.read("prices").count() == 0
    done = runs.daily_update(store, symbols, as_of="2024-01-06", fetch=fetch, report_dir=str(tmp_path))
    assert done["landed"]["n"] == 5 and done["n_failed"] == 1
    assert runs.daily_update(store, symbols, as_of="2024-01-06")["freshness"] == {"current": 1, "missing": 1}
    market = monitors.market_data(spark.createDataFrame([("C", ["C"]), ("D", []), ("E", ["E"]), ("F", ["F"])], "symbol string, codes array<string>"))
    bars = [{"date": f"2024-01-0{d}", "close": 1.0 + d, "quantity": 1.0} for d in (2, 3, 4)]
    feed = spark.createDataFrame([(json.dumps({"data": {"symbol": s, "bars": bars}}),) for s in "CE"], "payload string")
    got = runs.onboard(store, market, feed, spark.createDataFrame([("C", "HOLDİNGLER")], "symbol string, sector string"), as_of="2024-01-06", valid_from="2024-01-01")
    assert {tuple(r) for r in got.collect()} == {("C", "quant_started"), ("D", "deferred_vendor_lag"), ("E", "prices_only_no_sector"), ("F", "no_bars")}
    assert [(r["symbol"], r["universe_class"]) for r in store.read("universe_membership").collect()] == [("C", "holding")]
    assert store.read("total_returns").where("symbol = 'C'").count() == 2


def test_event_inputs_from_a_floor(spark, tmp_path):
    store = Store(spark, str(tmp_path / "l2"))
    days = [date(2024, 1, d) for d in range(1, 11)]
    store.append("total_returns", spark.createDataFrame([("A", d, 0.1, d) for d in days], "symbol string, bar_date date, ret_usd double, knowledge_date date"))
    store.append("betas", spark.createDataFrame([("A", f, d, 1.0, d) for d in days for f in ("XU100", "OTHER")], "symbol string, factor string, bar_date date, beta double, knowledge_date date"))
    store.append("events", spark.createDataFrame([("e", days[4], "pandemic", days[4])], "event_id string, event_date date, event_type string, knowledge_date date"))
    store.append("event_targets", spark.createDataFrame([("e", "market", -1, days[4])], "event_id string, channel string, shock_sign int, knowledge_date date"))
    specs, betas, rets = runs.event_inputs(store, as_of="2024-01-08", panel_start="2024-01-05")
    assert [tuple(r) for r in specs.collect()] == [(days[4], "market", -1)] and rets.count() == 4
    assert {(r["channel"], r["bar_date"]) for r in betas.collect()} == {("market", d) for d in days[4:8]}


class Slots(adapter.Adapter):
    """One slot is not there, one comes at the second try, one is an archive."""

    name = "slots"
    tried: dict = {}

    def fetch(self, request):
        k = request["slot"]
        self.tried[k] = self.tried.get(k, 0) + 1
        if k == 1:
            raise adapter.Absent("404")
        if k == 2 and self.tried[k] % 2:
            raise ConnectionError("reset")
        if k == 3:
            raise adapter.Transient("503")
        if k == 4:
            raise ValueError("403")
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            z.writestr("a.csv", f"slot {k}".encode() + b"\xff")
        return packed.getvalue() if k == 0 else f"slot {k}"


class Codes(adapter.Adapter):
    """Five pages of codes; the third one decides for most."""

    name = "codes"
    asked: list = []

    def page(self, request, cursor):
        k = cursor or 0
        self.asked.append(k)
        codes = [f"TRF{request['ticker']}{k}"] + ["TRA" + request["ticker"]] * (k == 2 and request["ticker"] != "ZZ")
        return adapter.Page(json.dumps({"codes": codes}), k + 1 if k < 4 else None)

    def enough(self, request, payload):
        return any(c.startswith("TRA") and request["ticker"] in c for c in json.loads(payload)["codes"])


class Site(adapter.Adapter):
    name, markup = "site", True

    def fetch(self, request):
        return "<table><tr><td>Pay</td><td>12,5</td></tr></table>"


def _feed(spark, name, requests, **options):
    spark.dataSource.register(adapter.FeedSource)
    return spark.read.format("tidemark_feed").option("adapter", f"tests.test_feeds:{name}").option("requests", json.dumps(requests)).options(wait="0", **options).load()


def test_absent_is_not_unreachable(spark):
    found = _feed(spark, "Slots", [{"slot": k} for k in range(3)])
    got = sorted((json.loads(r["request"])["slot"], r["outcome"], r["payload"]) for r in found.collect())
    assert got == [(0, "found", "slot 0�"), (1, "absent", None), (2, "found", "slot 2")]
    assert sorted(r["payload"] for r in adapter.whole(found).collect()) == ["slot 0�", "slot 2"]
    assert tuple(adapter.account(found).first()) == ("slots", 3, 2, 1, 0, 2, 0)
    with pytest.raises(Exception, match="Unreachable"):
        _feed(spark, "Slots", [{"slot": 0}, {"slot": 3}]).collect()
    reported = _feed(spark, "Slots", [{"slot": k} for k in (0, 3, 4)], unreachable="report")
    assert {(json.loads(r["request"])["slot"], r["outcome"]) for r in reported.collect()} == {(0, "found"), (3, "unreachable"), (4, "unreachable")}
    assert tuple(adapter.account(reported).first())[1:5] == (3, 1, 0, 2)
    with pytest.raises(adapter.Unreachable, match="503"):
        adapter.whole(reported.where("request like '%3%' or request like '%0%'"))
    waits = []
    with pytest.raises(adapter.Unreachable, match="after 3 tries"):
        adapter.patient(Slots(), {"slot": 3}, tries=3, sleep=waits.append)
    assert waits == [1.0, 2.0]
    with pytest.raises(adapter.Unreachable, match="403"):
        adapter.patient(Slots(), {"slot": 4}, sleep=waits.append)
    assert len(waits) == 2
    with pytest.raises(errors.Drift):
        adapter.unzipped(b"PK no archive")


def test_pages_until_one_decides(spark):
    Codes.asked.clear()
    got = list(adapter.pages(Codes(), {"ticker": "AB"}))
    assert [g[0] for g in got] == [0, 1, 2] and got[-1][3] == "enough" and Codes.asked == [0, 1, 2]
    assert [g[3] for g in adapter.pages(Codes(), {"ticker": "ZZ"})] == [None] * 4 + ["end"]
    few = Codes()
    few.most_pages = 2
    assert [g[3] for g in adapter.pages(few, {"ticker": "AB"})] == [None, "most"]
    feed = _feed(spark, "Codes", [{"ticker": "AB"}, {"ticker": "ZZ"}])
    rows = feed.groupBy("request").agg(F.count("*").alias("n"), F.max("ended").alias("ended"))
    assert {(json.loads(r["request"])["ticker"], r["n"], r["ended"]) for r in rows.collect()} == {("AB", 3, "enough"), ("ZZ", 5, "end")}
    assert tuple(adapter.account(feed).first())[1:6] == (2, 2, 0, 0, 8)


def test_pages_of_markup_are_read_where_they_are_meant(spark):
    feed = _feed(spark, "Site", [{}])
    assert feed.select(parsers.cell(F.col("payload"), "Pay")).first()[0] == "12,5"


def test_archives_parse_like_plain_lines(spark, tmp_path):
    good = ["\t".join([f"id{k}", "20250101", "", "s", "d", "", "", "WAR", "", "1#x#TU#", *[""] * 5, "1,2,3,4", *[""] * 11]) for k in range(3)]
    for name, text in (("a.zip", "\n".join(good[:2]) + "\nbad\tline\n"), ("b.zip", good[2] + "\r\n"), ("empty.zip", "")):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("x.csv", text)
    whole = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "broken.zip").write_bytes(whole[:40] + b"\x00\x00\x00" + whole[43:])
    (tmp_path / "none.zip").write_bytes(b"<html>sorry</html>")
    (tmp_path / "other.txt").write_text("not asked for")
    found = archives.lines(spark, str(tmp_path))
    said = {r["path"].rsplit("/", 1)[1]: (r["n_lines"], r["problem"]) for r in archives.account(found).collect()}
    assert said["a.zip"] == (3, None) and said["b.zip"] == (1, None) and said["broken.zip"][0] == 0 and said["broken.zip"][1] and "BadZipFile" in said["none.zip"][1]
    plain = parsers.news(spark.createDataFrame([(g,) for g in [*good, "bad\tline"]], "value string"))
    assert sorted(map(str, parsers.news(found.where("problem is null").select("value")).collect())) == sorted(map(str, plain.collect()))
    with pytest.raises(errors.Drift, match="none.zip|broken.zip"):
        archives.whole(found)
    big = [f"line {k}" for k in range(25_000)]
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", "\n".join(big))
    rows = archives.whole(archives.lines(spark, str(tmp_path), "big.zip")).orderBy("k").collect()
    assert [r["value"] for r in rows] == big and [r["k"] for r in rows] == list(range(25_000))


def test_members_are_fetched_weekly(spark, tmp_path):
    store, calls = Store(spark, str(tmp_path / "l2")), []

    def fetch(name="Alfa"):
        calls.append(name)
        return spark.createDataFrame([("o1", "AAA, AAB", name, "IGS"), ("o2", "BBB", "Beta", "IGS"), (None, "X", "no code", "IGS"), ("o3", "BBB ", "Gamma", "DDK")], "code string, ticker string, name string, member_type string")

    with pytest.raises(errors.Refused):
        members.members(store, as_of="2024-03-01")
    first = members.members(store, as_of="2024-03-01", fetch=fetch)
    assert sorted(r["code"] for r in first.collect()) == ["o1", "o2", "o3"] and calls == ["Alfa"]
    assert members.members(store, as_of="2024-03-08", fetch=fetch).count() == 3 and calls == ["Alfa"]
    members.members(store, as_of="2024-03-09", fetch=lambda: fetch("Alfa Yeni"))
    assert calls == ["Alfa", "Alfa Yeni"]
    name = lambda day: members.members(store, as_of=day).where("code = 'o1'").first()["name"]
    assert (name("2024-03-08"), name("2024-03-09"), name("2025-01-01")) == ("Alfa", "Alfa Yeni", "Alfa Yeni")
    members.members(store, as_of="2024-03-09", fetch=lambda: fetch("Alfa Son"), refresh=True)
    assert (name("2024-03-08"), name("2024-03-09")) == ("Alfa", "Alfa Son") and store.read("listed_members").count() == 6

    def fails():
        raise adapter.Unreachable("down")

    with pytest.raises(adapter.Unreachable):
        members.members(store, as_of="2024-06-01", fetch=fails)
    with pytest.raises(errors.Refused, match="empty"):
        members.members(store, as_of="2024-06-01", fetch=lambda: fetch().where("false"))
    assert name("2024-06-01") == "Alfa Son"


def test_isins_by_class_and_by_exclusion(spark):
    common, other, right, debt = "TRAGARAN91N1", "TRAAKBNK91N6", "TREAKBN00011", "TRSAKBN00014"

    def checked(stem):
        digits = "".join(str(int(c, 36)) for c in stem)
        total = sum(sum(divmod(int(d) * (2 if i % 2 == 0 else 1), 10)) for i, d in enumerate(reversed(digits)))
        return stem + str(-total % 10)

    common, other, right, debt, foreign = (checked(x[:11]) for x in (common, other, right, debt, "US037833100"))
    rows = [
        ("one", common, "GARANTİ", 1), ("One ", common.lower(), "GARANTİ", 2),
        ("two", common, "AKBANK ADİ", 1), ("two", other, "Akbank imtiyazlı A grubu", 2),
        ("both", common, "x", 1), ("both", other, "y", 2),
        ("none", common, "İMTİYAZLI", 1), ("none", other, "imtiyazli", 2),
        ("debt", debt, "tahvil", 1), ("far", foreign, "Apple", 1), ("bad", common[:-1] + str((int(common[-1]) + 1) % 10), "z", 1), ("far", "US", "short", 1),
        ("", common, "no ticker", 1), (None, common, None, 1), ("gone", None, None, 1),
        ("last", common, "A", 1), ("last", other, "imtiyazlı", 1), ("last", other, "adi", 2),
    ]
    df = spark.createDataFrame(rows, "ticker string, isin string, description string, row int")
    got, left = reference.imported_isins(df, order="row")
    assert {(r["ticker"], r["isin"], r["status"]) for r in got.collect()} == {("ONE", common, "single"), ("TWO", common, "unique-after-exclude"), ("BOTH", None, "ambiguous"), ("NONE", None, "ambiguous"), ("LAST", None, "ambiguous")}
    assert {(r["ticker"], r["reason"]) for r in left.collect()} == {("DEBT", "non-equity"), ("FAR", "foreign"), ("BAD", "malformed")}
    assert sorted(got.where("ticker = 'BOTH'").first()["candidates"]) == sorted([common, other])
    every, _ = reference.imported_isins(df, order="row", every_class=True)
    assert every.where("ticker = 'DEBT'").first()["status"] == "single"
    off, _ = reference.imported_isins(df, order="row", exclude=None)
    assert off.where("ticker = 'TWO'").first()["status"] == "ambiguous"
    answered = reference.lookup_isins(df.select("ticker"), got.where("isin is not null"), got.where("isin is null"), spark.createDataFrame([], "ticker string, chosen string, confirmed boolean, candidates array<string>"))
    assert {r["ticker"]: r["status"] for r in answered.collect() if r["ticker"] in ("TWO", "BOTH", "GONE")} == {"TWO": "found", "BOTH": "ambiguous", "GONE": "not-in-reference"}


CUSTODY = {"schema_version": 1, "source": "by hand", "fetched_iso": "2026-01-01", "foreign_custody_members": {"codes": {"AAA": "a", "AB1": "b"}}, "foreign_execution_brokers": {"codes": {"XXX": "x"}}, "domestic_despite_foreign_parent": {"codes": {"DDD": "d", "XXX": "x"}}}


def test_custody_reference(spark):
    read = lambda doc: reference.custody(spark.createDataFrame([(json.dumps(doc),)], "payload string"))
    assert {tuple(r) for r in read(CUSTODY).select("bucket", "code", "name").collect()} == {("custody", "AAA", "a"), ("custody", "AB1", "b"), ("execution", "XXX", "x"), ("domestic", "DDD", "d"), ("domestic", "XXX", "x")}
    assert {r["code"] for r in reference.custody_set(read(CUSTODY), "custody").collect()} == {"AAA", "AB1"}
    for change, said in (
        ({"schema_version": 2}, "version 2"), ({"schema_version": None}, "version None"),
        ({"foreign_execution_brokers": {"codes": {"AAA": "a"}}}, "both custody and execution"),
        ({"domestic_despite_foreign_parent": {"codes": {"AB1": "b"}}}, "both custody and domestic"),
        ({"foreign_custody_members": {"codes": {"AAAA": "a"}}}, "malformed"), ({"foreign_custody_members": {"codes": {"aaa": "a"}}}, "malformed"),
        ({"foreign_custody_members": {"codes": {}}}, "no custody"),
    ):
        with pytest.raises(errors.Refused, match=said):
            read(CUSTODY | change)
    with pytest.raises(errors.Refused, match="one document"):
        reference.custody(spark.createDataFrame([("x",), ("y",)], "payload string"))


def test_custody_editions(spark):
    docs = lambda *x: reference.custody(spark.createDataFrame([(e, json.dumps(d)) for e, d in x], "year int, payload string"), "year")
    turned = CUSTODY | {"foreign_custody_members": {"codes": {"XXX": "x2"}}, "foreign_execution_brokers": {"codes": {"AAA": "a2"}}, "domestic_despite_foreign_parent": {"codes": {}}}
    brokers = CUSTODY | {"foreign_custody_members": {"codes": {}}}
    got = {tuple(r) for r in docs((1, CUSTODY), (2, turned), (3, brokers)).select("year", "bucket", "code", "name").where("year > 1").collect()}
    assert got == {(2, "custody", "XXX", "x2"), (2, "execution", "AAA", "a2"), (3, "execution", "XXX", "x"), (3, "domestic", "DDD", "d"), (3, "domestic", "XXX", "x")}
    for x, said in (([(1, CUSTODY), (1, turned)], "one document"), ([(1, CUSTODY), (2, CUSTODY | {"schema_version": 3})], "version 3"), ([(1, CUSTODY), (2, CUSTODY | {"foreign_execution_brokers": {"codes": {"AAA": "a"}}})], "both custody and execution"), ([(1, brokers)], "no custody")):
        with pytest.raises(errors.Refused, match=said):
            docs(*x)


def test_custody_sets_beyond_the_codes(spark, tmp_path):
    keys = [0, 1, 2, 3, 39999, 40000, 40001, 40003, 80003]
    spark.createDataFrame([(k, f"S{k}") for k in keys], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    want = sorted(con.execute(entry_module.oracle_sql()["custody_sets"]).fetchall())
    assert len(want) > len(keys) and sorted(tuple(r) for r in entry_module.queries()["custody_sets"](spark, str(tmp_path)).select("bucket", "code", "name").collect()) == want


def test_interlocks(spark, monkeypatch):
    seats = [("p1", c) for c in "ABC"] + [("p2", c) for c in "AB"] + [("p2", "A"), ("p3", "C"), (None, "A"), ("p4", None)] + [("hub", f"X{k:03}") for k in range(40)]
    df = spark.createDataFrame(seats, "src string, dst string")
    want = {("A", "B", 2), ("A", "C", 1), ("B", "C", 1)} | {(f"X{i:03}", f"X{j:03}", 1) for i in range(40) for j in range(i + 1, 40)}
    for block in (1000, 7, 1):
        assert {tuple(r) for r in graph.interlocks(df, block=block).select("a", "b", "n_people").collect()} == want
    people = graph.interlocks(df, names=True).where("a = 'A' and b = 'B'").first()["people"]
    assert people == ["p1", "p2"]
    assert graph.interlocks(df.where("false")).count() == 0
    roles = spark.createDataFrame([("p1", "A", "chair", date(2020, 1, 1)), ("p1", "B", "member", date(2021, 1, 1)), ("p9", "A", "member", None), ("p1", "Z", "member", None)], "src string, dst string, role string, since date")
    nodes = lambda *x: spark.createDataFrame([(i,) for i in x], "uuid string")
    assert {tuple(r) for r in graph.board_seats(roles, nodes("p1"), nodes("A", "B")).collect()} == {("p1", "A", "chair", date(2020, 1, 1)), ("p1", "B", "member", date(2021, 1, 1))}


def test_interlocks_in_parts_that_grow_with_the_pairs(spark, monkeypatch):
    from tidemark import tables

    used = []

    def few(df, rows, *keys, each=0):
        used.append((keys, rows))
        return tables.dealt(df, rows, *keys, each=3)

    monkeypatch.setattr(graph, "dealt", few)
    seats = [(p, c) for p in range(30) for c in range(12) if (p * 7 + c) % 3] + [(99, c) for c in range(25)]
    want = {}
    for p in {p for p, _ in seats}:
        own = sorted(c for q, c in seats if q == p)
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                want[a, b] = want.get((a, b), 0) + 1
    df = spark.createDataFrame(seats, "src long, dst long")
    for block, busy in ((200, 1000), (4, 1000), (4, 5)):
        got = graph.interlocks(df, block=block, busy=busy)
        assert {(r["a"], r["b"]): r["n_people"] for r in got.collect()} == want
        assert got.rdd.getNumPartitions() > 4  # the session's number
    assert (("a", "part"), sum(want.values())) in used
    assert tables.dealt(spark.range(100), 100, "id", each=30).rdd.getNumPartitions() == spark.range(100).rdd.getNumPartitions()
    assert tables.dealt(spark.range(100), 100, "id", each=10).rdd.getNumPartitions() == 10


def test_links_in_parts_that_grow_with_the_rows(spark, monkeypatch):
    from tidemark import tables

    monkeypatch.setattr(graph, "dealt", lambda df, rows, *keys: tables.dealt(df, rows, *keys, each=10))
    rows = spark.range(100).selectExpr("id % 7 as src", "id % 5 as dst", "id as q")
    ends = spark.range(4).selectExpr("id as uuid")
    got = graph.link(rows, ends, ends, properties=("q",))
    assert got.rdd.getNumPartitions() == 10
    assert {tuple(r) for r in got.collect()} == {(s, d, max(k for k in range(100) if (k % 7, k % 5) == (s, d))) for s in range(4) for d in range(4)}


def test_onboarding_goes_on_where_it_broke(spark, tmp_path):
    store, calls, down = Store(spark, str(tmp_path / "l2")), [], [True]

    def step(name, only=None):
        def run(store, waiting):
            calls.append((name, sorted(r[0] for r in waiting.collect())))
            if name == "prices" and down[0]:
                raise adapter.Unreachable("vendor is down")
            return waiting if only is None else waiting.where(F.col("symbol").isin(only))

        return run

    steps = [("identity", step("identity")), ("prices", step("prices")), ("sector", step("sector", ["A"])), ("refit", step("refit"))]
    entities = spark.createDataFrame([("A",), ("B",), ("B",), (None,)], "symbol string")
    dry = onboarding.run(store, entities, steps, as_of="2024-01-01", execute=False)
    assert calls == [] and {(r["symbol"], r["next_step"], r["complete"]) for r in dry.collect()} == {("A", "identity", False), ("B", "identity", False)}
    broken = {r["symbol"]: r for r in onboarding.run(store, entities, steps, as_of="2024-01-01").collect()}
    assert [c[0] for c in calls] == ["identity", "prices"] and broken["A"]["next_step"] == "prices" and "down" in broken["A"]["detail"]
    down[0] = False
    calls.clear()
    again = {r["symbol"]: r for r in onboarding.run(store, entities.union(spark.createDataFrame([("C",)], "symbol string")), steps, as_of="2024-01-02").collect()}
    assert calls == [("identity", ["C"]), ("prices", ["A", "B", "C"]), ("sector", ["A", "B", "C"]), ("refit", ["A"])]
    assert again["A"]["complete"] and again["A"]["detail"] is None and (again["B"]["next_step"], again["B"]["complete"]) == ("sector", False)
    calls.clear()
    onboarding.run(store, entities, steps, as_of="2024-01-03")
    assert calls == [("sector", ["B"])]
    history = store.read("onboarding").where("symbol = 'A' and step = 'prices'").orderBy("attempt").collect()
    assert [(r["attempt"], r["status"]) for r in history] == [(1, "failed"), (2, "done")]


def test_typed_edges_of_known_nodes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "g"))
    nodes = {"company": spark.createDataFrame([("a", "A"), ("b", "B"), ("c", None), (None, "x")], "uuid string, name string"), "person": spark.createDataFrame([("p", "P")], "uuid string, name string")}
    stakes = spark.createDataFrame([("a", "b", None, 10.0, "2024-01-01", 1), ("a", "b", "Company", 20.0, None, 2), ("p", "b", "Person", 5.0, "2024-01-01", 1), ("p", "c", "Company", 5.0, None, 1), ("a", "zz", "Company", 1.0, None, 1), (None, "b", None, 1.0, None, 1)], "src string, dst string, label string, pct double, as_of string, row int")
    edges = {"board_member_of": spark.createDataFrame([("p", "a", "chair", "2020-01-01", 0.9), ("a", "b", "no person", None, None)], "src string, dst string, role string, since string, confidence double"), "holds_stake": stakes.drop("row")}
    first = {r["kind"]: r for r in graphload.load_all(store, nodes, edges)}
    assert list(first) == ["holds_stake", "board_member_of"]
    assert (first["holds_stake"]["n_pairs"], first["holds_stake"]["n_unknown"], first["holds_stake"]["n_stored"]) == (4, 2, 2)
    assert tuple(store.read("board_member_of").select("src", "dst", "role", "since", "confidence").first()) == ("p", "a", "chair", date(2020, 1, 1), 0.9)
    graphload.load_edges(store, "holds_stake", stakes, order="row")
    kept = {(r["src"], r["dst"]): (r["pct"], r["as_of"]) for r in store.read("holds_stake").collect()}
    assert kept == {("a", "b"): (20.0, None), ("p", "b"): (5.0, date(2024, 1, 1))}  # the last row's properties, NULL and all
    graphload.load_edges(store, "holds_stake", stakes.where("src = 'p' and dst = 'b'").withColumn("pct", F.lit(6.0)))
    assert {(r["src"], r["pct"]) for r in store.read("holds_stake").collect()} == {("a", 20.0), ("p", 6.0)}
    assert graphload.load_nodes(store, "company", spark.createDataFrame([("a", None), ("d", "D")], "uuid string, name string")) == 4
    assert {(r["uuid"], r["name"]) for r in store.read("company").collect()} == {("a", "A"), ("b", "B"), ("c", None), ("d", "D")}
    sectors = spark.createDataFrame([("M", "Main", 1, None), ("L", "Leaf", 2, "M")], "code string, name string, level int, parent string")
    assert graphload.load_sectors(store, sectors)["n_stored"] == 1 and graphload.load_sectors(store, sectors)["n_stored"] == 1
    for bad in (lambda: graphload.load_edges(store, "likes", stakes), lambda: graphload.load_nodes(store, "planet", sectors), lambda: graphload.load_all(store, {}, {"x": stakes}), lambda: graphload.load_sectors(store, sectors.withColumn("parent", F.lit("N")))):
        with pytest.raises(errors.Refused):
            bad()


def test_series_are_landed_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "l2"))
    feed = lambda x: spark.createDataFrame([(json.dumps(x),)], "payload string")
    cpi = landing.cpi_rows(feed({"items": [{"Tarih": "2023-12", "TP_FG_J0": "1.5"}, {"Tarih": "2024-1", "TP_FG_J0": "1.6"}, {"Tarih": "x", "TP_FG_J0": "2"}]}))
    vix = landing.macro_rows(feed({"observations": [{"date": "2024-01-02", "value": "."}, {"date": "2024-01-03", "value": "13.5"}]}), "VIX")
    cds = landing.rate_rows(feed({"result": {"quote": {"1": {"DATA_VAL": "2024-01-05", "CLOSE_VAL": 3.0}, "2": {"DATA_VAL": "2020-01-05", "CLOSE_VAL": 4.0}}}}), "CDS", start="2024-01-01")
    for _ in range(2):
        out = landing.land_series(store, cpi.unionByName(vix).unionByName(cds), report_dir=str(tmp_path))
    assert {f: (s["n"], str(s["last"]), str(s["known"])) for f, s in out["series"].items()} == {"CPI": (2, "2024-01-01", "2024-02-03"), "VIX": (1, "2024-01-03", "2024-01-03"), "CDS": (1, "2024-01-05", "2024-01-05")}
    assert store.read("factors").count() == 4 and (tmp_path / "land_series.json").exists()
