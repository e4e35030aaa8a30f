"""Rolling statistics, factor models and correlation networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import books, factors, network
from ..operators.returns import change
from ..views import Tables, fixed
from .base import Catalog, r

CATALOG = Catalog()
add = CATALOG.add
WINDOW, LEAST = 60, 40


def dense_returns(t: Tables) -> DataFrame:
    return books.dense(t.returns(), "ret")


def market(t: Tables) -> DataFrame:
    level = t.factor_levels().where("factor = 'MKT'")
    return level.select("bar_date", fixed(change("value", "factor"), 9).alias("ret"))


def _trail(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_LAG = "lag({}) OVER (PARTITION BY symbol ORDER BY bar_date)"


@add("baseline_momentum", f"WITH m AS (SELECT *, CASE WHEN count(ret) {_trail(20)} >= 10 THEN avg(ret) {_trail(20)} END AS x FROM panel) SELECT symbol, bar_date, {r('ret')} AS ret, {r(_LAG.format('x'))} AS score FROM m", "panel")
def baseline_momentum(t: Tables):
    return books.momentum(dense_returns(t))


@add("baseline_beta", f"WITH f AS (SELECT bar_date, avg(ret) AS f FROM panel GROUP BY bar_date), j AS (SELECT panel.*, f.f FROM panel LEFT JOIN f USING (bar_date)), b AS (SELECT *, CASE WHEN count(CASE WHEN ret IS NOT NULL AND f IS NOT NULL THEN 1 END) {_trail(60)} >= 30 AND count(f) {_trail(60)} >= 30 AND var_samp(f) {_trail(60)} > 0 THEN covar_samp(ret, f) {_trail(60)} / var_samp(f) {_trail(60)} END AS x FROM j) SELECT symbol, bar_date, {r('ret')} AS ret, {r(_LAG.format('x'))} AS score FROM b", "panel")
def baseline_beta(t: Tables):
    return books.trailing_beta(dense_returns(t))


@add("baseline_own_event", f"WITH z AS (SELECT *, CASE WHEN count(ret) {_trail(20)} >= 10 THEN (ret - avg(ret) {_trail(20)}) / nullif(stddev_samp(ret) {_trail(20)}, 0) END AS z FROM panel) SELECT symbol, bar_date, {r('ret')} AS ret, {r(_LAG.format('CASE WHEN abs(z) >= 2 THEN -sign(z) WHEN z IS NOT NULL THEN 0.0 END'))} AS score FROM z", "panel")
def baseline_own_event(t: Tables):
    return books.own_event(dense_returns(t))


@add("dollar_neutral", f"WITH c AS (SELECT *, ret - avg(ret) OVER (PARTITION BY bar_date) AS c FROM panel) SELECT symbol, bar_date, {r('ret')} AS ret, {r('CASE WHEN sum(abs(c)) OVER (PARTITION BY bar_date) > 1e-12 THEN coalesce(c / sum(abs(c)) OVER (PARTITION BY bar_date), 0) ELSE 0 END')} AS weight FROM c", "panel")
def dollar_neutral(t: Tables):
    return books.dollar_neutral(dense_returns(t), "ret")


_SINGLE = f"j AS (SELECT returns.symbol, bar_date, returns.ret, market.ret AS f FROM returns JOIN market USING (bar_date) WHERE returns.ret IS NOT NULL AND market.ret IS NOT NULL), single AS (SELECT symbol, bar_date, count(*) {_trail(WINDOW)} AS n, covar_samp(ret, f) {_trail(WINDOW)} / var_samp(f) {_trail(WINDOW)} AS beta, ret - avg(ret) {_trail(WINDOW)} - covar_samp(ret, f) {_trail(WINDOW)} / var_samp(f) {_trail(WINDOW)} * (f - avg(f) {_trail(WINDOW)}) AS residual FROM j)"


@add("rolling_single", f"WITH {_SINGLE} SELECT symbol, bar_date, {r('beta')} AS beta, {r('residual')} AS residual FROM single WHERE n >= {LEAST}", "returns market")
def rolling_single(t: Tables):
    return factors.rolling_single(t.returns(), market(t), window=WINDOW, least=LEAST)


def _wide(t: Tables) -> DataFrame:
    r_ = factors.factor_returns(t.factor_levels(), {"MKT": "simple", "FX": "simple", "RATE": "diff"})
    return factors.factor_panel(r_, ["MKT", "FX", "RATE"])


@add("rolling_betas_lw")
def rolling_betas_lw(t: Tables):
    return factors.rolling_betas(t.returns(), _wide(t), ["MKT", "FX", "RATE"], window=WINDOW, least=LEAST, label=factors.regime(F.col("bar_date"), (("1998-01-01", "late"),), "early"))


@add("rolling_betas_ols_single", f"WITH {_SINGLE} SELECT symbol, 'MKT' AS factor, bar_date, {r('beta')} AS beta, CAST({WINDOW} AS INTEGER) AS n_obs, 'all' AS regime FROM single WHERE n >= {WINDOW}", "returns market")
def rolling_betas_ols_single(t: Tables):
    rets = t.returns().where("ret is not null")
    return factors.rolling_betas(rets, market(t).where("ret is not null").withColumnRenamed("ret", "MKT"), ["MKT"], window=WINDOW, least=WINDOW, method="ols", label=F.lit("all"))


@add("rolling_residual_single", f"WITH {_SINGLE} SELECT symbol, bar_date, {r('residual')} AS residual, 'MKT' AS strip_order FROM single WHERE n >= {WINDOW}", "returns market")
def rolling_residual_single(t: Tables):
    rets = t.returns().where("ret is not null")
    return factors.rolling_residuals(rets, market(t).where("ret is not null").withColumnRenamed("ret", "MKT"), ["MKT"], window=WINDOW, least=WINDOW, label=F.lit("all")).drop("explained")


@add("residual_ladder")
def residual_ladder(t: Tables):
    return factors.rolling_residuals(t.returns(), _wide(t), ["MKT", "FX", "RATE"], window=WINDOW, least=LEAST, label=F.lit("all"))


def _residuals(t: Tables) -> DataFrame:
    return factors.rolling_single(t.returns(), market(t), window=WINDOW, least=LEAST).select("symbol", "bar_date", "residual")


_SHARES = f"{_SINGLE}, res AS (SELECT symbol, bar_date, residual FROM single WHERE n >= {LEAST}), shares AS (SELECT symbol, count(*) AS n_obs, 1 - var_samp(residual) / var_samp(ret) AS r2 FROM returns JOIN res USING (symbol, bar_date) WHERE ret IS NOT NULL AND residual IS NOT NULL GROUP BY symbol HAVING count(*) >= 20 AND var_samp(ret) > 0)"


@add("variance_share", f"WITH {_SHARES} SELECT symbol, sector AS universe_class, n_obs, {r('r2')} AS r2 FROM shares LEFT JOIN sectors USING (symbol)", "returns market sectors")
def variance_share(t: Tables):
    return factors.variance_share(t.returns(), _residuals(t), classes=t.sectors().withColumnRenamed("sector", "universe_class"))


@add("variance_share_by_class", f"WITH {_SHARES} SELECT coalesce(sector, '(unclassified)') AS universe_class, count(*) AS n, {r('quantile_cont(r2, 0.5)')} AS median, {r('quantile_cont(r2, 0.25)')} AS p25, {r('quantile_cont(r2, 0.75)')} AS p75 FROM shares LEFT JOIN sectors USING (symbol) GROUP BY 1", "returns market sectors")
def variance_share_by_class(t: Tables):
    return factors.share_by_class(variance_share(t))


_SIDES = f"b AS (SELECT symbol, 'MKT' AS factor, bar_date, beta, CASE WHEN bar_date >= DATE '1998-08-10' THEN 'after' ELSE 'before' END AS regime FROM single WHERE n >= {LEAST}), near AS (SELECT *, row_number() OVER (PARTITION BY symbol, regime ORDER BY CASE WHEN regime = 'before' THEN -epoch(bar_date) ELSE epoch(bar_date) END) AS k FROM b), breaks AS (SELECT symbol, factor, avg(beta) FILTER (regime = 'after') - avg(beta) FILTER (regime = 'before') AS shift, sqrt((var_samp(beta) FILTER (regime = 'after') + var_samp(beta) FILTER (regime = 'before')) / 2) AS pooled FROM near WHERE k <= 50 GROUP BY symbol, factor HAVING count(*) FILTER (regime = 'before') >= 5 AND count(*) FILTER (regime = 'after') >= 5)"


def _labelled_betas(t: Tables) -> DataFrame:
    b = factors.rolling_single(t.returns(), market(t), window=WINDOW, least=LEAST)
    return b.select("symbol", F.lit("MKT").alias("factor"), "bar_date", "beta", factors.regime(F.col("bar_date"), (("1998-08-10", "after"),), "before").alias("regime"))


@add("regime_break", f"WITH {_SINGLE}, {_SIDES} SELECT symbol, factor, {r('shift')} AS shift, {r('pooled')} AS pooled, {r('abs(shift) / (pooled + 1e-12)')} AS ratio FROM breaks", "returns market")
def regime_break(t: Tables):
    return factors.regime_break(_labelled_betas(t), "before", "after", nearest=50)


@add("regime_break_by_factor", f"WITH {_SINGLE}, {_SIDES} SELECT factor, count(*) AS n, {r('median(abs(shift))')} AS median_shift, {r('median(abs(shift) / (pooled + 1e-12))')} AS median_ratio FROM breaks GROUP BY factor", "returns market")
def regime_break_by_factor(t: Tables):
    return factors.break_by_factor(factors.regime_break(_labelled_betas(t), "before", "after", nearest=50))


@add("factor_manifest", "SELECT position, v.factor, coalesce(n, 0) AS n_levels, last FROM (VALUES " + ", ".join(f"({i}, '{f}')" for i, f in enumerate(factors.ladder_order())) + ") v(position, factor) LEFT JOIN (SELECT CASE factor WHEN 'MKT' THEN 'XU100' WHEN 'FX' THEN 'USDTRY' ELSE factor END AS factor, count(*) AS n, max(bar_date) AS last FROM levels GROUP BY 1) x ON x.factor = v.factor", "levels")
def factor_manifest(t: Tables):
    """The manifest in its order, and the levels there are of each factor."""
    factors.validate_manifest()
    order = t.spark.createDataFrame(list(enumerate(factors.ladder_order())), "position int, factor string")
    levels = t.factor_levels().replace({"MKT": "XU100", "FX": "USDTRY"}, subset="factor").groupBy("factor").agg(F.count("*").alias("n"), F.max("bar_date").alias("last"))
    return order.join(levels, "factor", "left").select("position", "factor", F.coalesce("n", F.lit(0)).alias("n_levels"), "last")


def _panel(t: Tables) -> DataFrame:
    return network.panel(t.returns(), "ret", 60)


_PANEL = "p AS (SELECT symbol, bar_date, x FROM (SELECT symbol, bar_date, avg(ret) AS x, count(*) OVER (PARTITION BY symbol) AS n FROM returns WHERE ret IS NOT NULL GROUP BY symbol, bar_date) WHERE n >= 60), ps AS (SELECT p.*, sector FROM p JOIN sectors USING (symbol)), pairs AS (SELECT a.sector, a.symbol AS src, b.symbol AS dst, corr(a.x, b.x) AS corr, count(*) AS n_obs FROM ps a JOIN ps b ON a.bar_date = b.bar_date AND a.sector = b.sector AND a.symbol < b.symbol GROUP BY 1, 2, 3 HAVING count(*) >= 60)"


@add("sector_pairs", "SELECT a.sector, a.symbol AS src, b.symbol AS dst FROM sectors a JOIN sectors b ON a.sector = b.sector AND a.symbol < b.symbol", "sectors")
def sector_pairs(t: Tables):
    return network.sector_pairs(t.sectors())


@add("pair_corr", f"WITH {_PANEL} SELECT a.symbol AS src, b.symbol AS dst, {r('corr(a.x, b.x)')} AS corr, count(*) AS n_obs FROM p a JOIN p b ON a.bar_date = b.bar_date AND a.symbol < b.symbol GROUP BY 1, 2 HAVING count(*) >= 60", "returns sectors")
def pair_corr(t: Tables):
    return network.correlations(_panel(t))


@add("sector_corr", f"WITH {_PANEL} SELECT sector, src, dst, {r('corr')} AS corr, n_obs, {r('sqrt(2 * (1 - corr))')} AS distance, {r('corr * sqrt((n_obs - 2) / (1 - corr * corr))')} AS t FROM pairs", "returns sectors")
def sector_corr(t: Tables):
    return network.correlations(_panel(t), t.sectors()).withColumns({"distance": network.distance(), "t": network.t_statistic()})


@add("benjamini_hochberg", f"WITH {_PANEL}, tests AS (SELECT src, dst, exp(-abs(corr) * sqrt(n_obs)) AS p_value FROM pairs), ranked AS (SELECT *, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value) AS raw FROM tests), q AS (SELECT *, least(1, min(raw) OVER (ORDER BY p_value ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q_value FROM ranked) SELECT src, dst, {r('p_value')} AS p_value, {r('q_value')} AS q_value, q_value <= 0.05 AS passed FROM q", "returns sectors")
def benjamini_hochberg(t: Tables):
    c = network.correlations(_panel(t), t.sectors())
    return network.benjamini_hochberg(c.select("src", "dst", F.exp(-F.abs("corr") * F.sqrt("n_obs")).alias("p_value")))


def _tail(t: str, df: str) -> str:
    """SQL: two-sided tail of Student's t by its finite series for whole degrees of freedom, in powers of the squared cosine of atan(t / sqrt(df))."""
    x, sine = f"({df} / ({df} + {t} * {t}))", f"(abs({t}) / sqrt({df} + {t} * {t}))"
    even = f"{sine} * list_sum(list_transform(range(0, {df} // 2), lambda k: exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - k * ln(4)) * pow({x}, k)))"
    odd = f"2 / pi() * (asin({sine}) + {sine} * sqrt({x}) * coalesce(list_sum(list_transform(range(0, ({df} - 1) // 2), lambda k: exp(k * ln(4) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * pow({x}, k))), 0))"
    return f"(1 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END)"


def _fdr(pairs: str, where: str) -> str:
    """SQL: the tested pairs with their tails and q-values."""
    return f"tested AS (SELECT *, corr * sqrt((n_obs - 2) / (1 - corr * corr)) AS t FROM {pairs}), tails AS (SELECT *, {_tail('t', '(n_obs - 2)')} AS p_value FROM tested), ranked AS (SELECT *, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value) AS raw FROM tails), q AS (SELECT *, least(1, min(raw) OVER (ORDER BY p_value ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q_value FROM ranked) SELECT src, dst, sector, {r('corr')} AS corr, n_obs, {r('t')} AS t, {r('p_value')} AS p_value, {r('q_value')} AS q_value, q_value <= 0.05 AS passed FROM q WHERE {where}"


@add("fdr_edges", f"WITH {_PANEL}, {_fdr('pairs', 'q_value <= 0.05')}", "returns sectors")
def fdr_edges(t: Tables):
    return network.fdr_edges(network.correlations(_panel(t), t.sectors()))


#: Closes with the market's mean added have that in common, so some of their correlations pass.
_CLOSES = "cp AS (SELECT symbol, bar_date, close + value AS x, sector FROM bars JOIN sectors USING (symbol) JOIN (SELECT bar_date, value FROM levels WHERE factor = 'MKT') USING (bar_date)), pairs AS (SELECT a.sector, a.symbol AS src, b.symbol AS dst, corr(a.x, b.x) AS corr, count(*) AS n_obs FROM cp a JOIN cp b ON a.bar_date = b.bar_date AND a.sector = b.sector AND a.symbol < b.symbol GROUP BY 1, 2, 3 HAVING count(*) >= 60)"


def _closes(t: Tables) -> DataFrame:
    common = t.factor_levels().where("factor = 'MKT'").select("bar_date", "value")
    return network.correlations(network.panel(t.bars().join(common, "bar_date").withColumn("x", F.col("close") + F.col("value")).select("symbol", "bar_date", F.col("x").alias("close")), "close", 60), t.sectors())


@add("pair_p_values", f"WITH {_CLOSES}, {_fdr('pairs', 'true')}", "bars levels sectors")
def pair_p_values(t: Tables):
    c = _closes(t).withColumn("t", network.t_statistic())
    return network.benjamini_hochberg(c.withColumn("p_value", network.p_value(F.col("t"), (F.col("n_obs") - 2).cast("double"))))


@add("fdr_edges_of_closes", f"WITH {_CLOSES}, {_fdr('pairs', 'q_value <= 0.05 AND abs(corr) >= 0.05')}", "bars levels sectors")
def fdr_edges_of_closes(t: Tables):
    return network.fdr_edges(_closes(t), least_corr=0.05)


_EDGES = f"""{_PANEL}, nd AS (SELECT bar_date, row_number() OVER (ORDER BY bar_date) - 1 AS d, count(*) OVER () AS total FROM (SELECT DISTINCT bar_date FROM p)),
    w AS (SELECT bar_date, unnest(range(0, CAST(floor((total - 120) / 60) AS BIGINT) + 1)) AS w, d FROM nd),
    pw AS (SELECT ps.*, w.w FROM ps JOIN w USING (bar_date) WHERE w.w * 60 <= w.d AND w.d < w.w * 60 + 120),
    wc AS (SELECT w, a.symbol AS src, b.symbol AS dst, corr(a.x, b.x) AS corr FROM pw a JOIN pw b USING (w, bar_date, sector) WHERE a.symbol < b.symbol GROUP BY 1, 2, 3 HAVING count(*) >= 40),
    e AS (SELECT * FROM wc WHERE abs(corr) >= 0.1),
    k AS (SELECT c.w, c.n, coalesce(x.k, 0) AS k FROM (SELECT w, count(*) AS n FROM wc GROUP BY w) c LEFT JOIN (SELECT w, count(*) AS k FROM e GROUP BY w) x USING (w)),
    both_ AS (SELECT a.w, a.corr AS ca, b.corr AS cb FROM e a JOIN e b ON b.w = a.w + 1 AND a.src = b.src AND a.dst = b.dst),
    rk AS (SELECT w, rank() OVER (PARTITION BY w ORDER BY ca) + (count(*) OVER (PARTITION BY w, ca) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY w ORDER BY cb) + (count(*) OVER (PARTITION BY w, cb) - 1) / 2.0 AS rb FROM both_),
    sh AS (SELECT w, count(*) AS shared, CASE WHEN count(*) >= 3 THEN corr(ra, rb) END AS rho FROM rk GROUP BY w),
    st AS (SELECT a.w, a.k AS k_a, b.k AS k_b, coalesce(sh.shared, 0) AS shared, CASE WHEN a.k + b.k - coalesce(shared, 0) = 0 THEN 1.0 ELSE coalesce(shared, 0) / (a.k + b.k - coalesce(shared, 0)) END AS jaccard, a.k * b.k / a.n AS overlap, rho FROM k a JOIN k b ON b.w = a.w + 1 LEFT JOIN sh ON sh.w = a.w),
    stab AS (SELECT w, k_a, k_b, shared, jaccard, coalesce(overlap / nullif(k_a + k_b - overlap, 0), 0) AS expected, rho FROM st)"""


def _window_edges(t: Tables) -> tuple[DataFrame, DataFrame]:
    c = network.correlations(network.windows(_panel(t), 120, 60), t.sectors(), 40, ("w",))
    return c.where("abs(corr) >= 0.1").select("w", "src", "dst", "corr"), c.groupBy("w").agg(F.count("*").alias("n_candidates"))


@add("stability", f"WITH {_EDGES} SELECT CAST(w AS INTEGER) AS w, k_a, k_b, shared, {r('jaccard')} AS jaccard, {r('expected')} AS expected, {r('CASE WHEN expected > 0 THEN jaccard / expected END')} AS lift, {r('rho')} AS rho FROM stab", "returns sectors")
def stability(t: Tables):
    return network.stability(*_window_edges(t)).withColumn("lift", F.when(F.col("lift") < float("inf"), F.col("lift")))


_SUMMARY = f"{_EDGES}, summ AS (SELECT count(*) AS n_pairs, median(jaccard) AS median_jaccard, median(CASE WHEN expected > 0 THEN jaccard / expected END) AS median_lift, count(*) FILTER (expected = 0) AS n_infinite, median(CAST(k_a AS DOUBLE)) AS median_edges, median(rho) AS median_rho FROM stab)"
_FIGURES = f"n_pairs, {r('median_jaccard')} AS median_jaccard, {r('median_lift')} AS median_lift, n_infinite, {r('median_edges')} AS median_edges, {r('median_rho')} AS median_rho"


@add("stability_summary", f"WITH {_SUMMARY} SELECT {_FIGURES} FROM summ", "returns sectors")
def stability_summary(t: Tables):
    return network.stability_summary(network.stability(*_window_edges(t)))


@add("stability_gate", f"WITH {_SUMMARY} SELECT {_FIGURES}, coalesce(median_lift >= 3 AND median_jaccard >= 0.1 AND n_pairs >= 3 AND median_edges >= 5, false) AS go, concat_ws(',', CASE WHEN NOT coalesce(median_lift >= 3, false) THEN 'lift' END, CASE WHEN NOT coalesce(median_jaccard >= 0.1, false) THEN 'jaccard' END, CASE WHEN n_pairs < 3 THEN 'window_pairs' END, CASE WHEN NOT coalesce(median_edges >= 5, false) THEN 'edges' END) AS failed FROM summ", "returns sectors")
def stability_gate(t: Tables):
    return network.gate(network.stability_summary(network.stability(*_window_edges(t))))


#: A pair is in the tree unless its ends are connected by pairs that come before it.
@add("spanning_tree", f"WITH RECURSIVE {_PANEL}, e AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY corr DESC, src, dst) AS k FROM pairs), ways AS (SELECT sector, k, src AS u, dst AS v FROM e UNION ALL SELECT sector, k, dst, src FROM e), walk AS (SELECT sector, k AS edge, src AS node FROM e UNION SELECT walk.sector, walk.edge, ways.v FROM walk JOIN ways ON ways.sector = walk.sector AND ways.u = walk.node AND ways.k < walk.edge) SELECT sector, src, dst, {r('corr')} AS corr FROM e WHERE NOT EXISTS (SELECT 1 FROM walk WHERE walk.sector = e.sector AND walk.edge = e.k AND walk.node = e.dst)", "returns sectors")
def spanning_tree(t: Tables):
    return network.spanning_tree(network.correlations(_panel(t), t.sectors()))


@add("spanning_tree_size", f"WITH {_PANEL} SELECT sector, count(DISTINCT s) - 1 AS n_edges FROM (SELECT sector, src AS s FROM pairs UNION ALL SELECT sector, dst FROM pairs) GROUP BY sector", "returns sectors")
def spanning_tree_size(t: Tables):
    return spanning_tree(t).groupBy("sector").agg(F.count("*").alias("n_edges"))


@add("planar_filter")
def planar_filter(t: Tables):
    c = network.correlations(_panel(t)).withColumn("sector", F.lit("all"))
    return network.planar_filter(c)


@add("planar_filter_size", "SELECT 'all' AS sector, 3 * (count(DISTINCT symbol) - 2) AS n_edges FROM returns WHERE ret IS NOT NULL", "returns")
def planar_filter_size(t: Tables):
    return planar_filter(t).groupBy("sector").agg(F.count("*").alias("n_edges"))


@add("shrunk_corr", f"""WITH {_PANEL}, size AS (SELECT sector, count(DISTINCT symbol) AS p FROM ps GROUP BY sector), whole AS (SELECT sector, bar_date FROM ps JOIN size USING (sector) GROUP BY sector, bar_date, p HAVING count(*) = p),
    z AS (SELECT sector, symbol, bar_date, (x - avg(x) OVER w) / stddev_samp(x) OVER w AS z FROM ps JOIN whole USING (sector, bar_date) WINDOW w AS (PARTITION BY sector, symbol)),
    n AS (SELECT sector, count(*) AS n, sum(q * q) AS f FROM (SELECT sector, bar_date, sum(z * z) AS q FROM z GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT a.sector, a.symbol AS src, b.symbol AS dst, sum(a.z * b.z) AS s FROM z a JOIN z b ON a.sector = b.sector AND a.bar_date = b.bar_date GROUP BY 1, 2, 3),
    m AS (SELECT sector, n, p, f, sum(s / n * s / n) AS ss, sum(s / n) FILTER (src = dst) / p AS mu FROM s JOIN n USING (sector) JOIN size USING (sector) GROUP BY sector, n, p, f),
    d AS (SELECT *, (ss - p * mu * mu) / p AS d2, (f / n - ss) / (n * p) AS b2 FROM m)
    SELECT sector AS "group", src, dst, {r('(1 - CASE WHEN d2 > 0 AND b2 > 0 THEN least(b2, d2) / d2 ELSE 0 END) * s / n / mu')} AS corr FROM s JOIN d USING (sector) WHERE src < dst AND n >= 60 AND p >= 2""", "returns sectors")
def shrunk_corr(t: Tables):
    return network.shrunk(_panel(t).join(t.sectors().withColumnRenamed("sector", "group"), "symbol"))


@add("embedding_label_corr", f"WITH v AS (SELECT label, vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS k FROM embeddings) SELECT label, k, {r('avg(CAST(x AS DOUBLE))')} AS mean_x, count(*) AS n FROM v GROUP BY label, k")
def embedding_label_corr(t: Tables):
    v = t.read("embeddings").select("label", F.posexplode("embedding").alias("k", "x"))
    return v.groupBy("label", F.col("k").cast("long").alias("k")).agg(F.avg(F.col("x").cast("double")).alias("mean_x"), F.count("*").alias("n"))


@add("sector_lead_lag", f"WITH m AS (SELECT sector, bar_date, avg(ret) AS m, count(*) AS n FROM returns JOIN sectors USING (symbol) WHERE ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3), l AS (SELECT *, lag(m) OVER (PARTITION BY sector ORDER BY bar_date) AS before FROM m) SELECT a.sector AS leader, b.sector AS follower, {r('corr(a.before, b.m)')} AS corr, count(*) AS n FROM l a JOIN l b USING (bar_date) WHERE a.before IS NOT NULL GROUP BY 1, 2", "returns sectors")
def sector_lead_lag(t: Tables):
    m = t.returns().join(t.sectors(), "symbol").where("ret is not null").groupBy("sector", "bar_date").agg(F.avg("ret").alias("m"), F.count("*").alias("n")).where("n >= 3")
    lagged = m.withColumn("before", F.lag("m").over(Window.partitionBy("sector").orderBy("bar_date")))
    a = lagged.where("before is not null").select("bar_date", F.col("sector").alias("leader"), "before")
    return a.join(lagged.select("bar_date", F.col("sector").alias("follower"), "m"), "bar_date").groupBy("leader", "follower").agg(F.corr("before", "m").alias("corr"), F.count("*").alias("n"))


@add("daily_ic", f"WITH l AS (SELECT bar_date, ret, lag(ret) OVER (PARTITION BY symbol ORDER BY bar_date) AS p FROM returns) SELECT bar_date, {r('corr(p, ret)')} AS ic, count(*) AS n FROM l WHERE p IS NOT NULL AND ret IS NOT NULL GROUP BY bar_date HAVING count(*) >= 3 AND stddev_samp(p) > 1e-9 AND stddev_samp(ret) > 1e-9", "returns")
def daily_ic(t: Tables):
    df = t.returns().withColumn("p", F.lag("ret").over(Window.partitionBy("symbol").orderBy("bar_date"))).where("p is not null and ret is not null")
    out = df.groupBy("bar_date").agg(F.corr("p", "ret").alias("ic"), F.count("*").alias("n"), F.stddev_samp("p").alias("a"), F.stddev_samp("ret").alias("b"))
    return out.where("n >= 3 and a > 1e-9 and b > 1e-9").select("bar_date", "ic", "n")
