"""Operators against hand-made values."""

from __future__ import annotations

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import errors
from tidemark.functions import identity as I
from tidemark.functions import linalg
from tidemark.functions.planarity import is_planar
from tidemark.operators import books, events, factors, graph, judge, matching, monitors, network, pit, returns, risk

DAY = date(2024, 1, 1)


def bars(spark, closes, symbol="A"):
    return spark.createDataFrame([(symbol, DAY + timedelta(i), float(c) if c is not None else None) for i, c in enumerate(closes)], "symbol string, bar_date date, close double")


def column(df, c, by="bar_date"):
    return [r[c] for r in df.orderBy(by).collect()]


def near(got, want):
    assert len(got) == len(want) and all(g is None if w is None else g == pytest.approx(w, abs=1e-6) for g, w in zip(got, want)), got


def test_limit_locks_and_censoring(spark):
    assert column(returns.limit_locks(bars(spark, [100, 90, 81])), "is_limit_lock") == [False, True, True]
    df = returns.limit_locks(bars(spark, [100, 110, 121, 123.42, 130]))
    out = returns.censor(df.withColumn("ret", returns.change("close")), ["ret"])
    near(column(out, "ret"), [None, None, None, 0.2342, 0.053314])
    assert column(out, "limit_lock_adj") == [False, True, True, True, False]


def test_gaps_make_returns_null(spark):
    near(column(bars(spark, [1, None, 2]).withColumn("ret", returns.change("close")), "ret"), [None, None, None])


def test_total_return_with_dividend(spark):
    b = bars(spark, [100, 102])
    y, refused = returns.dividend_yields(spark.createDataFrame([("A", DAY + timedelta(1), 5.10), ("A", DAY + timedelta(9), 1.0)], "symbol string, bar_date date, cash double"), b)
    near(column(y, "yield"), [0.05])
    assert refused.count() == 1
    near(column(returns.total_returns(b, yields=y), "ret_nominal_try"), [0.07])


def test_accounting_regimes_do_not_mix(spark):
    df = spark.createDataFrame([(2.0, "202403", 1.0, "202303"), (2.0, "202503", 1.0, "202403"), (2.0, "202403", 0.0, "202303"), (1.0, "x", 1.0, "2024")], "a double, p string, b double, q string")
    assert [(r["status"], r["growth"]) for r in returns.guarded_growth(df, "a", "p", "b", "q").collect()][:3] == [("ok", 1.0), ("straddle", None), ("zero_base", None)]
    assert df.select(returns.accounting_regime(F.col("p"))).collect()[3][0] is None


def test_universe_with_a_correction(spark):
    rows = [("S", "listed", date(2015, 1, 1), None, date(2020, 1, 30)), ("S", "listed", date(2015, 1, 1), date(2020, 9, 30), date(2020, 9, 18))]
    df = spark.createDataFrame(rows, "symbol string, universe string, valid_from date, valid_to date, knowledge_date date")
    there = lambda d: pit.PitReader(d, lambda _: df).universe().count()
    assert [there(d) for d in ("2020-01-01", "2020-06-01", "2020-09-30", "2020-10-01")] == [0, 1, 1, 0]
    with pytest.raises(errors.LookAhead):
        pit.PitReader(None, lambda _: df)
    with pytest.raises(errors.Refused):
        pit.PitReader("2020-01-01", lambda _: df).table("nothing")


def test_alignment_sees_the_day_of_release(spark):
    d = lambda n: date(2024, 1, n)
    facts = spark.createDataFrame([(d(1), d(8), 10.0), (d(8), d(16), 20.0)], "bar_date date, knowledge_date date, ret double")
    grid = spark.createDataFrame([(d(n),) for n in (5, 8, 12, 16)], "bar_date date")
    assert column(factors.align_by_knowledge(facts, grid), "ret") == [None, 10.0, 10.0, 20.0]


def test_betas_recover_and_residuals_are_orthogonal(spark):
    r = np.random.default_rng(0)
    f = r.normal(size=(300, 3))
    y = f @ [1.5, -0.5, 0.2] + 1e-6 * r.normal(size=300)
    assert linalg.partial_betas(f, y, "ols") == pytest.approx([1.5, -0.5, 0.2], abs=1e-4)
    assert linalg.partial_betas(f, y)[0] == pytest.approx(1.5, abs=0.1)
    residual, shares = linalg.strip(f @ [1, 2, 3] + r.normal(size=300), f)
    assert abs((f - f.mean(0)).T @ residual).max() < 1e-9
    assert linalg.strip(y, np.column_stack([f[:, 0], f[:, 0]]))[1][1] == 0.0
    days = [DAY + timedelta(i) for i in range(80)]
    rets = spark.createDataFrame([("A", d, float(v)) for d, v in zip(days, y)], "symbol string, bar_date date, ret double")
    panel = spark.createDataFrame([(d, *map(float, v)) for d, v in zip(days, f)], "bar_date date, a double, b double, c double")
    got = factors.rolling_betas(rets, panel, ["a", "b", "c"], window=40, least=40, method="ols", label=F.lit("x"))
    assert got.where("factor = 'a'").count() == 41 and got.where("abs(beta) > 1.6").count() == 0
    assert factors.rolling_betas(rets, panel, ["a"], window=40, least=41, label=F.lit("x")).count() == 0


def test_ledoit_wolf_keeps_the_trace():
    x = np.random.default_rng(1).normal(size=(50, 6))
    s = linalg.ledoit_wolf(x)
    assert np.trace(s) == pytest.approx(np.trace(x.T @ x / 50)) and np.allclose(s, s.T)


def test_student_t():
    assert linalg.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4) and linalg.t_two_sided(0, 5) == pytest.approx(1)
    assert linalg.t_two_sided(12.706, 1) == pytest.approx(0.05, abs=1e-4)


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(0.01,), (0.03,), (0.04,), (None,)], "p_value double")
    out = network.benjamini_hochberg(df).orderBy(F.col("p_value").asc_nulls_last()).collect()
    near([r["q_value"] for r in out], [0.03, 0.04, 0.04, None])
    assert [r["passed"] for r in out] == [True, True, True, False]


def test_planarity():
    full = lambda n: [(i, j) for i in range(n) for j in range(i)]
    three = [(i, j) for i in range(3) for j in range(3, 6)]
    petersen = [(i, (i + 1) % 5) for i in range(5)] + [(5 + i, 5 + (i + 2) % 5) for i in range(5)] + [(i, i + 5) for i in range(5)]
    assert is_planar(full(4)) and not is_planar(full(5)) and is_planar(full(5)[1:])
    assert not is_planar(three) and is_planar(three[1:]) and not is_planar(petersen)
    r, edges, faces = random.Random(0), [(0, 1), (1, 2), (0, 2)], [(0, 1, 2), (0, 1, 2)]
    for n in range(3, 25):
        a, b, c = faces.pop(r.randrange(len(faces)))
        edges += [(n, a), (n, b), (n, c)]
        faces += [(a, b, n), (b, c, n), (a, c, n)]
    r.shuffle(edges)
    assert is_planar(edges)


def test_filters(spark):
    r = random.Random(3)
    names = "abcdefg"
    c = spark.createDataFrame([("s", a, b, r.uniform(-1, 1)) for i, a in enumerate(names) for b in names[i + 1 :]], "sector string, src string, dst string, corr double")
    assert network.spanning_tree(c).count() == 6 and network.planar_filter(c).count() == 15


def test_lock_carry(spark):
    rows = [(0.5, True), (0.3, False), (-0.2, True), (0.1, False)]
    w = spark.createDataFrame([("A", DAY + timedelta(i), x, lock) for i, (x, lock) in enumerate(rows)], "symbol string, bar_date date, weight double, is_limit_lock boolean")
    held = books.constrain(w.join(books.books(spark).where("book = 'venue_feasible'")))
    near(column(held, "held"), [0, 0.3, 0.3, 0.1])


def test_only_an_explicit_ban_cuts_shorts(spark):
    w = spark.createDataFrame([("A", DAY, -1.0, None), ("B", DAY, -1.0, False), ("C", DAY, -1.0, True)], "symbol string, bar_date date, weight double, short_eligible boolean")
    got = {(r["book"], r["symbol"]): r["held"] for r in books.constrain(w.crossJoin(books.books(spark))).collect()}
    assert [got["venue_feasible", s] for s in "ABC"] == [-1, 0, -1] and [got["stress", s] for s in "ABC"] == [0, 0, 0] and [got["research", s] for s in "ABC"] == [-1, -1, -1]


def test_costs_by_hand(spark):
    w = spark.createDataFrame([("A", DAY, 0.5, 0.02), ("B", DAY, -0.5, None)], "symbol string, bar_date date, weight double, fwd double")
    got = {r["book"]: r for r in books.run_books(w, spark).collect()}
    near([got["research"]["net"], got["venue_feasible"]["net"]], [0.01, 0.01 - 0.001 - 0.5 * 0.01 / 252])
    near([got["stress"]["turnover"], got["stress"]["net"]], [0.5, 0.01 - 3 * 0.0005])


def test_walk_forward_is_out_of_sample():
    splits = books.walk_forward(60, 5, 2, 3)
    assert [(s["test_lo"], s["test_hi"]) for s in splits] == [(10, 20), (20, 30), (30, 40), (40, 50), (50, 60)]
    assert all(s["train_end"] == s["test_lo"] - 2 and s["ban_hi"] <= s["train_end"] for s in splits)


def test_deflation():
    assert judge.expected_best(0.01, 1) == 0 and judge.expected_best(0.01, 100) > judge.expected_best(0.01, 10) > 0
    one = judge.deflated_sharpe(0.1, 500, 0.0, 3.0, 1)
    many = judge.deflated_sharpe(0.1, 500, 0.0, 3.0, 100)
    assert one["dsr"] > many["dsr"] and one["passes"] and not many["passes"]
    assert judge.probabilistic_sharpe(0.0, 100, 0.0, 3.0) == pytest.approx(0.5)
    with pytest.raises(errors.Fabrication):
        judge.expected_best(0.01, 0)


def test_overfitting_is_numpys(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(61, 4))
    rows = [(f"v{j}", DAY + timedelta(i), float(x[i, j])) for i in range(61) for j in range(4)]
    got = judge.overfitting(spark.createDataFrame(rows, "variant string, bar_date date, net double"), 6).orderBy("combo").collect()
    from itertools import combinations

    want = []
    for ins in combinations(range(6), 3):
        rows_in = np.concatenate([x[b * 10 : b * 10 + 10] for b in ins])
        rows_out = np.concatenate([x[b * 10 : b * 10 + 10] for b in range(6) if b not in ins])
        s = lambda m: m.mean(0) / m.std(0, ddof=1)
        best = int(s(rows_in).argmax())
        rank = int((s(rows_out) < s(rows_out)[best]).sum()) + 1
        want.append((f"v{best}", math.log(rank / 5 / (1 - rank / 5))))
    assert [g["winner"] for g in got] == [w for w, _ in want]
    near([g["logit"] for g in got], [v for _, v in want])


def test_verdict_needs_every_check():
    good = {"dsr": 0.99, "passes": True}
    assert judge.verdict(1.0, {"a": 0.5, "b": None}, good, 0.1)["promoted"]
    assert judge.verdict(1.0, {"a": 1.5}, good, None)["failed_checks"] == ["beats_baselines", "pbo"]


def test_candidates_are_judged_by_the_deflated_ratio(spark):
    from tidemark.queries.books import _judged

    days = [DAY + timedelta(i) for i in range(240)]
    noise = np.random.default_rng(3).normal(size=(5, 240))
    # one variant is ahead in every block, so choosing it is not overfitting
    variants = spark.createDataFrame([(f"v{j}", d, float(noise[j, i] + (0.5 if j == 0 else 0))) for j in range(4) for i, d in enumerate(days)], "variant string, bar_date date, net double")
    book = lambda mean: spark.createDataFrame([(d, float(noise[4, i] + mean)) for i, d in enumerate(days)], "bar_date date, net double")
    good, bad = _judged(book(1.5), variants), _judged(book(0.0), variants)
    assert good["promoted"] and good["failed_checks"] == [] and good["dsr"] > 0.95
    assert not bad["promoted"] and "dsr" in bad["failed_checks"] and bad["dsr"] is not None


def test_channel_stress_by_hand(spark):
    e = spark.createDataFrame([("AAA", "market", 1.2), ("AAA", "fx", -0.8), ("BBB", "market", 0.5), ("BBB", "fx", 0.3)], "symbol string, channel string, beta double")
    near(column(risk.channel_stress(e, {"market": -0.10, "fx": 0.05}), "pnl", "symbol"), [-0.16, -0.035])
    p = spark.createDataFrame([("AAA", 0.6), ("BBB", 0.4)], "symbol string, weight double")
    s = risk.channel_stress(spark.createDataFrame([("AAA", "market", 1.0), ("BBB", "market", -1.0)], "symbol string, channel string, beta double"), {"market": -0.10})
    near([risk.portfolio_stress(s, p).first()[0]], [-0.02])
    for shock, error in (({}, errors.Fabrication), ({"moon": 1.0}, errors.Refused), ({"energy": 1.0}, errors.Fabrication)):
        with pytest.raises(error):
            risk.channel_stress(e, shock)


def test_linkage_by_hand(spark):
    e = spark.createDataFrame([("K", "A", 0.4853), ("K", "F", 0.3865), ("F", "G", 0.5), ("G", "K", 0.1)], "src string, dst string, fraction double").withColumn("confidence", F.lit(1.0))
    s = spark.createDataFrame([("A", -0.20), ("F", -0.15)], "node string, shock double")
    got, cycles = risk.propagate(e, s)
    assert {r["holder"]: r["shock"] for r in got.collect()}["K"] == pytest.approx(-0.155035)
    assert cycles.count() > 0
    with pytest.raises(errors.Refused):
        risk.propagate(e.withColumn("fraction", F.lit(1.5)), s)


def test_cycles_of_control(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e")], "src string, dst string")
    assert {tuple(r) for r in graph.components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("e", "e")}
    with pytest.raises(errors.ControlCycle):
        graph.refuse_cycles(e)
    graph.refuse_cycles(e.where("src = 'c' and dst = 'd'"))


def test_long_cycles_of_control(spark):
    ring = [(i, i % 100 + 1) for i in range(1, 101)]
    back = [(b + 1000, a + 1000) for a, b in ring]  # the other way round
    e = spark.createDataFrame(ring + back + [(50, 1050), (2000, 1), (2001, 2002), (2002, 2001), (2002, 2003), (2003, 2003)], "src long, dst long")
    want = {(i, 1) for i in range(1, 101)} | {(i, 1001) for i in range(1001, 1101)} | {(2001, 2001), (2002, 2001), (2003, 2003)}
    assert {tuple(r) for r in graph.components(e).collect()} == want


def test_components_are_mutual_reach(spark):
    r = random.Random(11)
    edges = {(r.randrange(40), r.randrange(40)) for _ in range(60)}
    reached = {a: {a} for a in range(40)}
    for _ in range(40):
        for a, b in edges:
            for seen in reached.values():
                if a in seen:
                    seen.add(b)
    mutual = {a: [b for b in reached[a] if a in reached[b]] for a in range(40)}
    want = {(a, min(m)) for a, m in mutual.items() if len(m) > 1 or (a, a) in edges}
    assert {tuple(x) for x in graph.components(spark.createDataFrame(sorted(edges), "src long, dst long")).collect()} == want


def test_inheritance_does_not_chain(spark):
    parents = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c")], "child string, parent string")
    own = spark.createDataFrame([("a", "S1"), ("c", "S2")], "node string, sector string")
    assert {(r["node"], r["sector"], r["hops"]) for r in graph.inherit(own, parents).collect()} == {("b", "S1", 1), ("d", "S2", 1)}


def test_inheritance_climbs_to_the_top(spark):
    parents = spark.createDataFrame([(i, i - 1) for i in range(2, 17)] + [(30, 31), (31, 30), (16, 30)], "child long, parent long")
    own = spark.createDataFrame([(1, "S")], "node long, sector string")
    assert {tuple(r) for r in graph.inherit(own, parents).collect()} == {(i, "S", 1, i - 1) for i in range(2, 17)}


def test_event_types_and_severity(spark):
    rows = [("1", "20250101120000", "TERROR_X;ATTACK;WAR", "1#x#TU#", "-12.5,1,2,3"), ("2", "20250101", "WAR;TERROR", "1#x#TU#;1#y#US#", "3,1,2"), ("3", "20250101", "ECON_TRADE", "1#x#US#", "0,0,0,0"), ("4", "2025", "WAR", "1#x#TU#", ""), ("5", "20250101", "SPORTS", "1#x#TU#", "")]
    got = {r["record_id"]: r for r in events.typed(spark.createDataFrame(rows, "record_id string, date string, themes string, locations string, tone string")).collect()}
    assert [got[k]["status"] for k in "12345"] == ["event", "event", "other_country", "undated", "untyped"]
    assert (got["1"]["event_type"], got["1"]["severity"]) == ("terror_security", 1.0)
    assert (got["2"]["event_type"], got["2"]["severity"], got["2"]["geography"]) == ("terror_security", None, "TU;US")


def test_names(spark):
    df = spark.createDataFrame([("TÜRKİYE İŞ BANKASI A.Ş.",), ("Koç Holding A.Ş.",), ("A.Ş.",), ("ZİRAAT GAYRİMENKUL YATIRIM ORTAKLIĞI A.Ş.",)], "n string")
    got = df.select(F.array_join(I.brand(F.col("n")), " ").alias("b"), I.entity_type(F.col("n")).alias("e"), F.array_join(I.identity_tokens(F.col("n")), " ").alias("i")).collect()
    assert [r["b"] for r in got] == ["İŞ BANKASI", "Koç Holding", "A.Ş.", "ZİRAAT GAYRİMENKUL YATIRIM"]
    assert [r["e"] for r in got] == ["BANK", "HOLDING", None, "REIT"] and [r["i"] for r in got][:2] == ["IS", "KOC"]


def test_isins(spark):
    df = spark.createDataFrame([("TRAGARAN91N1",), ("US0378331005",), ("US0378331006",), ("TRAGARAN91N2",), ("short",)], "i string")
    assert [tuple(r) for r in df.select(I.isin_ok(F.col("i")), I.isin_ok(F.col("i"), None)).collect()] == [(True, True), (False, True), (False, False), (False, False), (False, False)]


def test_matching_is_precision_first(spark):
    c = spark.createDataFrame([("1", "KOÇ HOLDİNG A.Ş."), ("2", "KOÇ METALURJİ A.Ş."), ("3", "ZİRAAT BANKASI A.Ş."), ("4", "ZİRAAT GAYRİMENKUL YATIRIM ORTAKLIĞI")], "uuid string, name string")
    n = spark.createDataFrame([("KOÇ HOLDİNG",), ("ZİRAAT BANKASI",), ("BAŞKA ŞEY",), ("HOLDİNG",)], "name string")
    got = {r["name"]: (r["key"], r["status"]) for r in matching.match(n, c).collect()}
    assert got["KOÇ HOLDİNG"] == ("1", "matched") and got["ZİRAAT BANKASI"] == ("3", "matched")
    assert got["BAŞKA ŞEY"] == (None, "no-confident-match") and got["HOLDİNG"] == (None, "no-identity-tokens")


def test_idempotent_append(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    assert [tuple(r) for r in pit.append_new(old, spark.createDataFrame([("a", 2), ("b", 3), ("b", 2)], "k string, v int"), ["k"]).collect()] == [("b", 2)]


def test_freshness(spark):
    last = spark.createDataFrame([("A", date(2024, 1, 9)), ("B", date(2024, 1, 1))], "symbol string, last_bar date")
    got = monitors.freshness(spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string"), last, "2024-01-10")
    assert {r["symbol"]: r["status"] for r in got.collect()} == {"A": "current", "B": "stale", "C": "missing"}


def test_manifests():
    factors.validate_manifest()
    events.validate()
    assert factors.ladder_order()[:2] == ["XU100", "VIX"] and factors.blocked_factors() == ["MSCIEM"] and factors.weekly_factors() == ["FFLOW"]
    with pytest.raises(errors.Refused):
        factors.validate_manifest((*factors.MANIFEST, factors.MANIFEST[0]))


@pytest.mark.parametrize("method", ["ledoit_wolf", "ols"])
def test_many_windows_are_single_ones(method):
    from tidemark.functions import linalg

    r = np.random.default_rng(9)
    x = r.normal(size=(40, 30, 6))
    x[5, :, 3] = 2.0  # a factor that stands still
    x[6, :, 4] = x[6, :, 2] * 3 + 1  # one that depends on another
    x[7, 3, 1] = np.nan
    mask = r.random((40, 30)) < 0.8
    mask[:, -1] = True
    mask[7, 3] = False
    mask[8] = False
    mask[8, -6:] = True  # hardly more rows than factors
    betas = linalg.partial_betas_of_windows(x, mask, method)
    residual, shares = linalg.strip_of_windows(x, mask)
    for w in range(40):
        own = x[w][mask[w]]
        if method == "ledoit_wolf" or w not in (5, 6, 8):
            assert np.allclose(betas[w], linalg.partial_betas(own[:, 1:], own[:, 0], method), atol=1e-8)
        alone, part = linalg.strip(own[:, 0], own[:, 1:])
        assert abs(residual[w] - alone[-1]) < 1e-7 and np.allclose(shares[w], part, atol=1e-7)


def test_exposures_are_the_last_row(spark):
    """A symbol without a beta on a channel's last day has none, not an older one."""
    d = [date(2024, 1, k) for k in (1, 2, 3)]
    rows = [("A", "XU100", d[0], 1.0), ("A", "XU100", d[1], 2.0), ("B", "XU100", d[0], 5.0), ("C", "XU100", d[1], float("nan")), ("C", "XU100", d[0], 4.0), ("D", "XU100", d[1], None), ("A", "USDTRY", d[2], -1.0), ("B", "USDTRY", d[2], 0.5), ("A", "OTHER", d[2], 9.0)]
    got = {(r["symbol"], r["channel"]): r["beta"] for r in risk.exposures(spark.createDataFrame(rows, "symbol string, factor string, bar_date date, beta double")).collect()}
    assert got == {("A", "market"): 2.0, ("B", "market"): None, ("C", "market"): None, ("D", "market"): None, ("A", "fx"): -1.0, ("B", "fx"): 0.5}


def test_tails_of_arrays(spark):
    t = np.array([0.0, 0.5, -2.0, 31.0, 1e6, np.nan, 1.0, 1.0])
    df = np.array([1, 1, 1, 1, 1, 5, 0, np.nan])
    got = linalg.t_two_sided(t, df)
    want = 1 - 2 / np.pi * np.arctan(np.abs(t[:5]))
    assert np.allclose(got[:5], want, rtol=1e-10, atol=1e-15) and np.isnan(got[5:]).all()
    two = linalg.t_two_sided(t[:5], 2)
    assert np.allclose(two[:4], 1 - np.abs(t[:4]) / np.sqrt(2 + t[:4] ** 2), rtol=1e-10) and 0 < two[4] < 1e-11
    many = np.linspace(-8, 8, 4001)
    assert np.allclose(linalg.t_two_sided(many, 300)[:2000], linalg.t_two_sided(-many, 300)[:2000])
    assert linalg.t_two_sided(1.96, 1e7) == pytest.approx(0.05, abs=1e-4)
    rows = spark.createDataFrame([(1.0, 1.0), (None, 5.0), (1.0, 0.0), (float("nan"), 3.0)], "t double, n double")
    assert [r[0] for r in rows.coalesce(1).select(network.p_value(F.col("t"), F.col("n"))).collect()] == [pytest.approx(0.5), None, None, None]


def test_scores_of_many_choices_are_pandas(spark):
    """Accumulations of 1, 5 and 10 days, with and without a threshold; unknown z-scores fade nothing where there is one."""
    import pandas as pd

    r = np.random.default_rng(8)
    days = pd.date_range("2024-01-01", periods=60)
    wide = pd.DataFrame(r.normal(size=(60, 3)), index=days, columns=list("ABC"))
    wide.iloc[:7, 1] = np.nan
    wide.iloc[20:24, 2] = np.nan
    wide["D"] = 1.0
    long = wide.stack(future_stack=True).rename("spread").rename_axis(["bar_date", "symbol"]).reset_index()
    rows = [(x.symbol, x.bar_date.date(), None if x.spread != x.spread else float(x.spread)) for x in long.itertuples()]
    df = spark.createDataFrame(rows, "symbol string, bar_date date, spread double")
    choices = [(f"{n}|{z}", n, z) for n in (1, 5, 10) for z in (0.0, 1.0)]
    got = {(x["variant"], x["symbol"], x["bar_date"]): x["score"] for x in books.fade_scores(df, choices, lookback=20).collect()}
    for name, n, z in choices:
        level = wide.rolling(n, min_periods=max(2, n // 2)).sum() if n > 1 else wide
        roll = level.rolling(20, min_periods=10)
        score = (level - roll.mean()) / roll.std().where(lambda s: s > 0)
        want = (-score).where(score.abs() >= z, 0.0) if z > 0 else -score
        want = want.shift(1)
        for s in wide:
            for d in days:
                a, b = got[name, s, d.date()], want.loc[d, s]
                if s == "D":  # no spread of its own: rounding decides
                    continue
                assert (a is None) == (b != b) and (a is None or a == pytest.approx(b, abs=1e-9)), (name, s, d)
    one = books.fade_signal(df, accum=5, lookback=20, least_z=1.0)
    assert {(x["symbol"], x["bar_date"]): x["score"] for x in one.collect()} == {(s, d): v for (name, s, d), v in got.items() if name == "5|1.0"}


def test_drifts_of_many_choices_are_each_one(spark):
    r = random.Random(3)
    days = [date(2024, 1, 1) + timedelta(i) for i in range(40)]
    betas = spark.createDataFrame([(f"S{k}", ch, d, r.gauss(0, 1)) for k in range(8) for ch in ("fx", "market") for d in days], "symbol string, channel string, bar_date date, beta double")
    specs = spark.createDataFrame([(days[0], "fx", 1), (days[5], "fx", -1), (days[7], "market", 1), (date(2024, 6, 1), "fx", 1)], "event_date date, channel string, shock_sign int")
    choices = [(f"{q}|{d}|{lag}", q, d, lag) for q in (0.2, 0.3) for d in (3, 10) for lag in (1, 2)]
    rows = lambda df: {(x["symbol"], x["bar_date"]): round(x["weight"], 12) for x in df.collect()}
    every = events.drift_grid(betas, specs, choices).persist()
    for name, q, d, lag in choices:
        own = rows(every.where(F.col("variant") == name))
        assert own == rows(events.drift_weights(betas, specs, quantile=q, drift=d, lag=lag)) and own
        day = {}
        for (_, b), w in own.items():
            day[b] = day.get(b, 0) + abs(w)
        assert all(abs(v - 1) < 1e-9 or v == 0 for v in day.values())
        assert min(b for _, b in own) == days[5]  # no exposure was known before the first day's event
    every.unpersist()


def test_letters_that_fold(spark):
    """Marks go, Turkish letters become plain ones; letters that stand for several stay."""
    text = "ıİŞşĞğÜüÖöÇç éÀñÅ ÿž ﬁ ß Æ œ ½ Ø ł"
    got = spark.createDataFrame([(text,)], "t string").select(I.fold(F.col("t"))).first()[0]
    assert got.split(" ")[0] == "iISsGgUuOoCc" and got.split(" ")[1:3] == ["eAnA", "yz"]
    assert got.split(" ")[3:] == ["ﬁ", "ß", "Æ", "œ", "½", "Ø", "ł"]


def test_companies_that_no_name_tells_apart_are_compared_once(spark):
    c = spark.range(1000, 1400).selectExpr("id as uuid", "concat('Firma O12', id, ' Tekstil') as name")
    known = matching.index(c)
    assert known.count() == 400
    assert {(r["company"], r["key"]) for r in matching.classes(known).collect()} == {(f"Firma O12{k} Tekstil", k) for k in (1000, 1100, 1200, 1300)}
    n = spark.createDataFrame([("Firma O121399 Tekstil",), ("Firma O121234",), ("Firma O129 Tekstil",)], "name string")
    assert {r["name"]: (r["key"], r["score"]) for r in matching.match(n, c).collect()} == {"Firma O121399 Tekstil": (1300, 1.0), "Firma O121234": (1200, 1.0), "Firma O129 Tekstil": (None, None)}
