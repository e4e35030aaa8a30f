"""Signals, backtests and their judgement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import books, judge, network
from ..plans import runs
from ..views import Tables
from .base import Catalog, r
from .panels import _PANEL, _trail, dense_returns

CATALOG = Catalog()
add = CATALOG.add

#: Links with an absolute correlation from here on, as edges.
LEAST = 0.03


def _edges(t: Tables) -> DataFrame:
    c = network.correlations(network.panel(t.returns(), "ret", 60), t.sectors())
    return c.where(f"abs(corr) >= {LEAST}").select("src", "dst", "corr")


_EDGE = f"{_PANEL}, e AS (SELECT src, dst, corr FROM pairs WHERE abs(corr) >= {LEAST}), both_ AS (SELECT src AS symbol, dst AS peer, corr FROM e UNION ALL SELECT dst, src, corr FROM e), wgt AS (SELECT symbol, sum(abs(corr)) AS w FROM both_ GROUP BY symbol), pred AS (SELECT both_.symbol, panel.bar_date, sum(corr * coalesce(panel.ret, 0)) / w AS predicted FROM both_ JOIN panel ON panel.symbol = peer JOIN wgt ON wgt.symbol = both_.symbol GROUP BY both_.symbol, panel.bar_date, w)"


@add("comoved", f"WITH {_EDGE} SELECT symbol, bar_date, {r('predicted')} AS predicted FROM pred", "panel sectors")
def comoved(t: Tables):
    return books.comoved(dense_returns(t), _edges(t), "ret")


_SPREAD = f"{_EDGE}, sp AS (SELECT panel.symbol, panel.bar_date, ret, ret - predicted AS spread FROM panel LEFT JOIN pred USING (symbol, bar_date))"


@add("residual_spread", f"WITH {_SPREAD} SELECT symbol, bar_date, {r('ret')} AS ret, {r('spread')} AS spread FROM sp", "panel sectors")
def residual_spread(t: Tables):
    return books.spread(dense_returns(t), _edges(t), "ret")


_SIGNAL = f"""{_SPREAD}, acc AS (SELECT *, CASE WHEN count(spread) {_trail(5)} >= 2 THEN sum(spread) {_trail(5)} END AS a FROM sp),
    zs AS (SELECT *, CASE WHEN count(a) {_trail(60)} >= 30 THEN (a - avg(a) {_trail(60)}) / nullif(stddev_samp(a) {_trail(60)}, 0) END AS z FROM acc),
    sig AS (SELECT symbol, bar_date, ret, lag(CASE WHEN abs(z) >= 0.5 THEN -z ELSE 0.0 END) OVER (PARTITION BY symbol ORDER BY bar_date) AS score FROM zs),
    cen AS (SELECT *, score - avg(score) OVER (PARTITION BY bar_date) AS c FROM sig),
    wts AS (SELECT symbol, bar_date, ret, CASE WHEN sum(abs(c)) OVER (PARTITION BY bar_date) > 1e-12 THEN coalesce(c / sum(abs(c)) OVER (PARTITION BY bar_date), 0) ELSE 0 END AS weight FROM cen)"""


def _signal(t: Tables) -> DataFrame:
    return books.fade_signal(books.spread(dense_returns(t), _edges(t), "ret"), least_z=0.5)


@add("statarb_signal", f"WITH {_SIGNAL} SELECT symbol, bar_date, {r('score')} AS score FROM sig", "panel sectors")
def statarb_signal(t: Tables):
    return _signal(t).select("symbol", "bar_date", "score")


@add("statarb_weights", f"WITH {_SIGNAL} SELECT symbol, bar_date, {r('weight')} AS weight FROM wts", "panel sectors")
def statarb_weights(t: Tables):
    return books.dollar_neutral(_signal(t), "score").select("symbol", "bar_date", "weight")


@add("edge_schedule", "WITH n AS (SELECT bar_date, d FROM days), e AS (SELECT CAST((d - 120) // 60 AS INTEGER) AS refit, d, bar_date AS effective FROM n WHERE d >= 120 AND (d - 120) % 60 = 0) SELECT refit, a.bar_date AS first, b.bar_date AS last, effective, lead(effective) OVER (ORDER BY refit) AS until FROM e JOIN n a ON a.d = e.d - 120 JOIN n b ON b.d = e.d - 1", "days")
def edge_schedule(t: Tables):
    return books.schedule(t.bars(), 120, 60)


@add("variant_grid", "SELECT accum, z_threshold, least_corr, concat('accum=', accum, '|z_threshold=', z_threshold, '|least_corr=', least_corr) AS variant, greatest(0, (SELECT max(n) FROM days) - CASE accum WHEN 1 THEN 30 WHEN 5 THEN 31 ELSE 34 END) AS n_scored FROM (VALUES (1), (5), (10)) a(accum) CROSS JOIN (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) b(z_threshold) CROSS JOIN (VALUES (0.0::DOUBLE), (0.2::DOUBLE)) c(least_corr)", "days")
def variant_grid(t: Tables):
    """The grid that the stat-arb plan searches, and for how many of the bars' days at most each variant has a score."""
    days = t.bars().agg(F.count_distinct("bar_date").alias("n"))
    return books.grid(t.spark, **runs.STATARB_GRID).join(F.broadcast(days)).withColumn("n_scored", F.greatest(F.lit(0), F.col("n") - 29 - F.when(F.col("accum") > 1, F.greatest(F.lit(2), F.floor(F.col("accum") / 2))).otherwise(1))).drop("n")  # one row


@add("event_variant_grid", "SELECT quantile, drift, lag, concat('quantile=', quantile, '|drift=', drift, '|lag=', lag) AS variant, (SELECT count(DISTINCT date_trunc('day', ts)) FROM events) * drift AS n_held FROM (VALUES (0.2::DOUBLE), (0.3::DOUBLE)) a(quantile) CROSS JOIN (VALUES (3), (5), (10)) b(drift) CROSS JOIN (VALUES (1), (2)) c(lag)")
def event_variant_grid(t: Tables):
    """The grid that the event plan searches, and how many days at most the days with events hold a position."""
    days = t.read("events").agg(F.count_distinct(F.to_date("ts")).alias("n"))
    return books.grid(t.spark, **runs.EVENT_GRID).join(F.broadcast(days)).withColumn("n_held", F.col("n") * F.col("drift")).drop("n")  # one row


_N = "(SELECT max(n) FROM days)"


@add("walk_forward_splits", f"SELECT CAST(i AS INTEGER) AS split, CAST(f * (i + 1) - 5 AS INTEGER) AS train_end, CAST(greatest(0, f * i - 3) AS INTEGER) AS ban_lo, CAST(f * i AS INTEGER) AS ban_hi, CAST(f * (i + 1) AS INTEGER) AS test_lo, CAST(CASE WHEN i = 4 THEN n ELSE f * (i + 2) END AS INTEGER) AS test_hi FROM (SELECT unnest(range(0, 5)) AS i, {_N} // 6 AS f, {_N} AS n)", "days")
def walk_forward_splits(t: Tables):
    n = t.bars().select("bar_date").distinct().count()
    rows = [tuple(s.values()) for s in books.walk_forward(n, 5, 5, 3)]
    return t.spark.createDataFrame(rows, "split int, train_end int, ban_lo int, ban_hi int, test_lo int, test_hi int")


def _weights(t: Tables) -> DataFrame:
    """Faded last returns, with the flags a book may care for and the return of the next day."""
    p = dense_returns(t)
    by = Window.partitionBy("symbol").orderBy("bar_date")
    p = p.withColumn("score", -F.lag("ret").over(by)).withColumn("fwd", F.col("ret"))
    w = books.dollar_neutral(p, "score")
    return w.select("symbol", "bar_date", "weight", "fwd", (F.abs("ret") > 0.12).alias("is_limit_lock"), F.when(F.col("symbol").endswith("3"), F.lit(False)).alias("short_eligible"))


_WEIGHTS = """s AS (SELECT symbol, bar_date, ret, -lag(ret) OVER (PARTITION BY symbol ORDER BY bar_date) AS score FROM panel),
    c AS (SELECT *, score - avg(score) OVER (PARTITION BY bar_date) AS c FROM s),
    wt AS (SELECT symbol, bar_date, ret AS fwd, CASE WHEN sum(abs(c)) OVER (PARTITION BY bar_date) > 1e-12 THEN coalesce(c / sum(abs(c)) OVER (PARTITION BY bar_date), 0) ELSE 0 END AS weight, abs(ret) > 0.12 AS locked, CASE WHEN symbol LIKE '%3' THEN false END AS eligible FROM c),
    bk AS (SELECT * FROM (VALUES ('research', false, false, false, false, 1.0), ('venue_feasible', true, true, false, true, 1.0), ('stress', true, false, true, true, 3.0)) v(book, costs, enforce, ban, block, mult)),
    cut AS (SELECT *, CASE WHEN ban OR (enforce AND coalesce(NOT eligible, false)) THEN greatest(weight, 0) ELSE weight END AS w, block AND coalesce(locked, false) AS l FROM wt CROSS JOIN bk),
    hl AS (SELECT *, coalesce(last_value(CASE WHEN NOT l THEN w END IGNORE NULLS) OVER (PARTITION BY book, symbol ORDER BY bar_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS held FROM cut),
    tr AS (SELECT *, abs(held - lag(held, 1, 0) OVER (PARTITION BY book, symbol ORDER BY bar_date)) AS t FROM hl),
    dy AS (SELECT book, bar_date, sum(held * coalesce(fwd, 0)) AS gross, sum(t) AS turnover, sum(greatest(-held, 0)) AS short, sum(abs(held)) AS exposure, max(CASE WHEN costs THEN mult ELSE 0 END) AS on_ FROM tr GROUP BY book, bar_date),
    pnl AS (SELECT book, bar_date, gross, turnover, turnover * 10 / 1e4 * on_ AS cost, short * 100 / 1e4 / 252 * on_ AS borrow, gross - turnover * 10 / 1e4 * on_ - short * 100 / 1e4 / 252 * on_ AS net, exposure FROM dy)"""
_SHARPE = "CASE WHEN count({0}) >= 2 AND stddev_samp({0}) > 1e-12 THEN avg({0}) / stddev_samp({0}) END"


@add("book_constraints", f"WITH {_WEIGHTS} SELECT book, symbol, bar_date, {r('held')} AS held FROM hl", "panel")
def book_constraints(t: Tables):
    return books.constrain(_weights(t).join(F.broadcast(books.books(t.spark)))).select("book", "symbol", "bar_date", "held")


@add("run_books", f"WITH {_WEIGHTS} SELECT book, bar_date, {', '.join(f'{r(c)} AS {c}' for c in ('gross', 'turnover', 'cost', 'borrow', 'net', 'exposure'))} FROM pnl", "panel")
def run_books(t: Tables):
    return books.run_books(_weights(t), t.spark)


@add("book_performance", f"WITH {_WEIGHTS} SELECT book, count(*) AS n_periods, {r(_SHARPE.format('gross'))} AS gross_sharpe, {r(_SHARPE.format('net'))} AS net_sharpe, {r('sum(net)')} AS total_net, {r('avg(turnover)')} AS avg_turnover, {r('avg(exposure)')} AS avg_exposure FROM pnl GROUP BY book", "panel")
def book_performance(t: Tables):
    return books.performance(books.run_books(_weights(t), t.spark), "book")


@add("capacity_curve", f"WITH {_WEIGHTS} SELECT scale, {r(_SHARPE.format('net * scale'))} AS net_sharpe, {r('sum(net * scale)')} AS total_net FROM pnl CROSS JOIN (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE), (5.0::DOUBLE), (10.0::DOUBLE)) v(scale) WHERE book = 'venue_feasible' GROUP BY scale", "panel")
def capacity_curve(t: Tables):
    return books.capacity(books.run_books(_weights(t), t.spark).where("book = 'venue_feasible'"))


def _variants(t: Tables) -> DataFrame:
    """Daily results of momentum over four lookbacks, as variants."""
    p = dense_returns(t)
    out = None
    for n in (4, 8, 16, 32):
        w = books.dollar_neutral(books.momentum(p, n), "score").groupBy("bar_date").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("net"))
        w = w.select(F.lit(f"m{n:02d}").alias("variant"), "bar_date", "net")
        out = w if out is None else out.unionByName(w)
    return out


def _variant_sql(n: int) -> str:
    return f"SELECT 'm{n:02d}' AS variant, bar_date, sum(w * coalesce(ret, 0)) AS net FROM (SELECT bar_date, ret, CASE WHEN sum(abs(c)) OVER (PARTITION BY bar_date) > 1e-12 THEN coalesce(c / sum(abs(c)) OVER (PARTITION BY bar_date), 0) ELSE 0 END AS w FROM (SELECT bar_date, ret, s - avg(s) OVER (PARTITION BY bar_date) AS c FROM (SELECT symbol, bar_date, ret, lag(x) OVER (PARTITION BY symbol ORDER BY bar_date) AS s FROM (SELECT *, CASE WHEN count(ret) {_trail(n)} >= {n // 2} THEN avg(ret) {_trail(n)} END AS x FROM panel)))) GROUP BY bar_date"


_VARIANTS = f"vp AS ({' UNION ALL '.join(_variant_sql(n) for n in (4, 8, 16, 32))})"
_FOLDS = f"folds AS (SELECT i AS split, f * (i + 1) - 5 AS train_end, greatest(0, f * i - 3) AS ban_lo, f * i AS ban_hi, f * (i + 1) AS test_lo, CASE WHEN i = 4 THEN n ELSE f * (i + 2) END AS test_hi FROM (SELECT unnest(range(0, 5)) AS i, {_N} // 6 AS f, {_N} AS n)), picks AS (SELECT * FROM (SELECT split, variant, sr, row_number() OVER (PARTITION BY split ORDER BY sr DESC NULLS LAST, variant) AS k FROM (SELECT split, variant, {_SHARPE.format('net')} AS sr FROM vp JOIN days USING (bar_date) JOIN folds ON d < train_end AND NOT (d >= ban_lo AND d < ban_hi) GROUP BY split, variant)) WHERE k = 1)"


def _splits(t: Tables) -> list[dict]:
    return books.walk_forward(t.bars().select("bar_date").distinct().count(), 5, 5, 3)


@add("variant_picks", f"WITH {_VARIANTS}, {_FOLDS} SELECT CAST(split AS INTEGER) AS split, variant, {r('sr')} AS train_sharpe FROM picks", "panel")
def variant_picks(t: Tables):
    return books.pick_variants(_variants(t), _splits(t))


@add("walk_forward_oos", f"WITH {_VARIANTS}, {_FOLDS} SELECT bar_date, CAST(split AS INTEGER) AS split, variant, {r('net')} AS net FROM vp JOIN days USING (bar_date) JOIN folds ON d >= test_lo AND d < test_hi JOIN picks USING (split, variant)", "panel")
def walk_forward_oos(t: Tables):
    v, s = _variants(t), _splits(t)
    return books.spliced(v, books.pick_variants(v, s), s)


@add("sharpe_moments", f"WITH {_VARIANTS}, m AS (SELECT variant, count(net) AS n, {_SHARPE.format('net')} AS sharpe, avg(net) AS mu FROM vp GROUP BY variant), g AS (SELECT variant, any_value(n) AS n, any_value(sharpe) AS sharpe, avg((net - mu) ** 2) AS m2, avg((net - mu) ** 3) AS m3, avg((net - mu) ** 4) AS m4 FROM vp JOIN m USING (variant) GROUP BY variant) SELECT variant, n, {r('sharpe')} AS sharpe, {r('m3 / m2 ** 1.5 * sqrt(n * (n - 1.0)) / (n - 2)')} AS skew, {r('(n - 1.0) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2 ** 2 - 3) + 6) + 3')} AS kurtosis FROM g", "panel")
def sharpe_moments(t: Tables):
    return judge.moments(_variants(t), "variant")


_PBO = f"""{_VARIANTS}, dealt AS (SELECT bar_date, d // (n // 6) AS block FROM days WHERE d // (n // 6) < 6),
    bs AS (SELECT variant, block, count(net) AS c, sum(net) AS s1, sum(net * net) AS s2 FROM vp JOIN dealt USING (bar_date) GROUP BY variant, block),
    combos AS (SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS combo, [a, b, c] AS ins FROM (SELECT unnest(range(0, 6)) AS a) JOIN (SELECT unnest(range(0, 6)) AS b) ON b > a JOIN (SELECT unnest(range(0, 6)) AS c) ON c > b),
    halves AS (SELECT combo, variant, list_contains(ins, block) AS inside, sum(bs.c) AS n, sum(s1) AS s1, sum(s2) AS s2 FROM bs CROSS JOIN combos GROUP BY 1, 2, 3),
    srs AS (SELECT combo, variant, max(CASE WHEN inside THEN sr END) AS i, max(CASE WHEN NOT inside THEN sr END) AS o FROM (SELECT combo, variant, inside, CASE WHEN (s2 - s1 * s1 / n) / (n - 1) > 1e-24 THEN s1 / n / sqrt((s2 - s1 * s1 / n) / (n - 1)) END AS sr FROM halves) GROUP BY 1, 2),
    rks AS (SELECT *, row_number() OVER (PARTITION BY combo ORDER BY i DESC NULLS LAST, variant) AS w, row_number() OVER (PARTITION BY combo ORDER BY o ASC NULLS FIRST, variant) AS rank, count(*) OVER (PARTITION BY combo) AS k FROM srs),
    pbo AS (SELECT CAST(combo AS INTEGER) AS combo, variant AS winner, rank, ln(rank / (k + 1) / (1 - rank / (k + 1))) AS logit FROM rks WHERE w = 1)"""


@add("pbo_splits", f"WITH {_PBO} SELECT combo, winner, CAST(rank AS INTEGER) AS rank, {r('logit')} AS logit FROM pbo", "panel")
def pbo_splits(t: Tables):
    return judge.overfitting(_variants(t), 6)


@add("pbo_summary", f"WITH {_PBO} SELECT {r('avg(CASE WHEN logit <= 0 THEN 1 ELSE 0 END)')} AS pbo, count(*) AS n_splits, {r('median(logit)')} AS median_logit FROM pbo", "panel")
def pbo_summary(t: Tables):
    return judge.overfitting_summary(judge.overfitting(_variants(t), 6))


def _normal(x: str) -> str:
    """SQL: the normal distribution function by the series of positive terms of the error function."""
    z = f"(abs({x}) / sqrt(2))"
    erf = f"2 / sqrt(pi()) * exp(-{z} * {z}) * list_sum(list_transform(range(0, 200), lambda k: CASE WHEN {z} > 0 THEN exp(2 * k * ln(2) + (2 * k + 1) * ln({z}) + lgamma(k + 1) - lgamma(2 * k + 2)) ELSE 0 END))"
    return f"(0.5 + 0.5 * sign({x}) * ({erf}))"


#: How many deviations the best of four skilless variants is expected at: normal quantiles by halving, weighted by Euler's constant (Mascheroni's), which is found as the limit of its series.
_BEST = f"""halved AS (SELECT p, 0.0::DOUBLE AS lo, 10.0::DOUBLE AS hi, 0 AS i FROM (VALUES (1 - 1 / 4.0::DOUBLE), (1 - 1 / (4 * exp(1.0::DOUBLE)))) AS v(p) UNION ALL SELECT p, CASE WHEN {_normal('((lo + hi) / 2)')} < p THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_normal('((lo + hi) / 2)')} < p THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM halved WHERE i < 48),
    euler AS (SELECT sum(1.0::DOUBLE / k) - ln(100000.0::DOUBLE) - 1 / 200000.0::DOUBLE + 1 / 120000000000.0::DOUBLE AS e FROM range(1, 100001) AS r(k)),
    expected AS (SELECT (1 - e) * min(lo) + e * max(lo) AS best FROM halved, euler WHERE i = 48 GROUP BY e)"""
_DEFLATED = f"""{_BEST}, {_VARIANTS}, m AS (SELECT variant, count(net) AS n, {_SHARPE.format('net')} AS sharpe, avg(net) AS mu FROM vp GROUP BY variant), g AS (SELECT variant, any_value(n) AS n, any_value(sharpe) AS sharpe, avg((net - mu) ** 2) AS m2, avg((net - mu) ** 3) AS m3, avg((net - mu) ** 4) AS m4 FROM vp JOIN m USING (variant) GROUP BY variant),
    h AS (SELECT variant, n, sharpe, m3 / m2 ** 1.5 * sqrt(n * (n - 1.0)) / (n - 2) AS skew, (n - 1.0) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2 ** 2 - 3) + 6) + 3 AS kurtosis, stddev_samp(sharpe) OVER () * (SELECT best FROM expected) AS best FROM g),
    x AS (SELECT *, (sharpe - best) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe) AS x FROM h), ds AS (SELECT *, {_normal('x')} AS dsr FROM x)"""


@add("deflated_sharpe", f"WITH RECURSIVE {_DEFLATED} SELECT variant, {r('dsr')} AS dsr, {r('sharpe')} AS sr_observed, {r('best')} AS sr_benchmark, n AS n_obs, CAST(4 AS INTEGER) AS n_trials, dsr > 0.95 AS passes FROM ds", "panel")
def deflated_sharpe(t: Tables):
    rows = judge.moments(_variants(t), "variant").collect()  # one row a variant
    trial = [x["sharpe"] for x in rows]
    out = [(x["variant"], *judge.deflated_sharpe(x["sharpe"], x["n"], x["skew"], x["kurtosis"], len(rows), trial_sharpes=trial).values()) for x in rows]
    return t.spark.createDataFrame(out, "variant string, dsr double, sr_observed double, sr_benchmark double, n_obs long, n_trials int, passes boolean")


def _judged(candidate: DataFrame, variants: DataFrame) -> dict:
    """The verdict on a candidate's daily results, deflated by the variants tried; these are the baselines too."""
    m = judge.moments(candidate.withColumn("all", F.lit(1)), "all").first()
    base = {x["variant"]: x["sharpe"] for x in judge.moments(variants, "variant").collect()}  # one row a variant
    known = m is not None and m["sharpe"] is not None and m["skew"] is not None and m["kurtosis"] is not None
    dsr = judge.deflated_sharpe(m["sharpe"], m["n"], m["skew"], m["kurtosis"], len(base), trial_sharpes=list(base.values())) if known else None
    pbo = judge.overfitting_summary(judge.overfitting(variants, 6)).first()["pbo"]
    return judge.verdict(m["sharpe"] if m else None, base, dsr, pbo)


_VERDICT = f"""{_BEST}, {_WEIGHTS}, {_PBO}, cm AS (SELECT count(net) AS n, {_SHARPE.format('net')} AS sharpe, avg(net) AS mu FROM pnl WHERE book = 'venue_feasible'),
    cg AS (SELECT any_value(n) AS n, any_value(sharpe) AS sharpe, avg((net - mu) ** 2) AS m2, avg((net - mu) ** 3) AS m3, avg((net - mu) ** 4) AS m4 FROM pnl, cm WHERE book = 'venue_feasible'),
    bl AS (SELECT variant, {_SHARPE.format('net')} AS sharpe FROM vp GROUP BY variant), bs_ AS (SELECT max(sharpe) AS top, arg_max(variant, sharpe) AS best, stddev_samp(sharpe) * (SELECT best FROM expected) AS against FROM bl),
    ch AS (SELECT n, sharpe, m3 / m2 ** 1.5 * sqrt(n * (n - 1.0)) / (n - 2) AS skew, (n - 1.0) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2 ** 2 - 3) + 6) + 3 AS kurtosis FROM cg),
    cx AS (SELECT sharpe, top, best, (sharpe - against) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe) AS x, (SELECT avg(CASE WHEN logit <= 0 THEN 1 ELSE 0 END) FROM pbo) AS pbo FROM ch, bs_),
    cv AS (SELECT *, sharpe > top AS beats, {_normal('x')} > 0.95 AS deflated FROM cx)"""


@add("promotion_verdict", f"WITH RECURSIVE {_VERDICT} SELECT beats AND deflated AND pbo < 0.5 AS promoted, concat_ws(',', CASE WHEN NOT beats THEN 'beats_baselines' END, CASE WHEN NOT deflated THEN 'dsr' END, CASE WHEN pbo >= 0.5 THEN 'pbo' END) AS failed, best AS best_baseline, {r('sharpe')} AS candidate, {r('pbo')} AS pbo FROM cv", "panel")
def promotion_verdict(t: Tables):
    v = _judged(books.run_books(_weights(t), t.spark).where("book = 'venue_feasible'"), _variants(t))
    return t.spark.createDataFrame([(v["promoted"], ",".join(v["failed_checks"]), v["best_baseline"], v["candidate_net_sharpe"], v["pbo"])], "promoted boolean, failed string, best_baseline string, candidate double, pbo double")


def _registry(t: Tables) -> DataFrame:
    return t.read("orders").selectExpr("concat('s', o_custkey % 50) as signal_id", "to_date(o_orderdate) as knowledge_date", "cast(o_orderkey % 4 as int) as n_trials", "(o_orderkey % 120) / 100D as pbo", "if(o_orderkey % 7 = 0, null, 0.5D) as deflated_sharpe", "o_orderkey % 3 = 0 as promoted", "o_orderkey % 2 = 0 as beat_baselines", "o_orderkey")


@add("registry_hygiene", "WITH g AS (SELECT concat('s', o_custkey % 50) AS signal_id, CAST(o_orderdate AS DATE) AS knowledge_date, [CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0 THEN 'promoted_without_beating_baselines' END, CASE WHEN o_orderkey % 4 < 1 THEN 'n_trials_below_one' END, CASE WHEN (o_orderkey % 120) / 100.0 > 1 THEN 'pbo_out_of_range' END, CASE WHEN o_orderkey % 7 = 0 THEN 'dsr_not_finite' END] AS p FROM orders) SELECT * FROM (SELECT signal_id, knowledge_date, unnest(p) AS problem FROM g) WHERE problem IS NOT NULL")
def registry_hygiene(t: Tables):
    return judge.registry_hygiene(_registry(t))


@add("registry_versions", "SELECT concat('s', o_custkey % 50) AS signal_id, count(*) AS versions, CAST(max(o_orderdate) AS DATE) AS knowledge_date FROM orders GROUP BY 1")
def registry_versions(t: Tables):
    return judge.latest_verdicts(_registry(t)).drop("promoted")
