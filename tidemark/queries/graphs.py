"""Events, exposures, shocks and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import events, factors, graph, risk
from ..sources import parsers
from ..streaming import flow
from ..views import Tables
from .base import Catalog, r
from .panels import _SINGLE, LEAST, WINDOW, market

CATALOG = Catalog()
add = CATALOG.add

_THEMES = ("TERROR_GROUP;ATTACK", "WAR;MILITARY_OFFENSIVE", "EARTHQUAKE;NATURAL_DISASTER", "ECON_INTEREST_RATE;ELECTION", "ENV_OIL;SANCTION", "SPORTS;MUSIC", "TARIFF;WTO_TALKS;TREATY")


def _lines(t: Tables) -> DataFrame:
    """News records of 27 tab-separated columns made from the event stream; some too short."""
    themes = F.element_at(F.array(*map(F.lit, _THEMES)), (F.col("event_id") % 7 + 1).cast("int"))
    place = F.when(F.col("event_id") % 3 == 0, F.lit("1#Berlin#GM#x;1#Paris#FR#y")).otherwise(F.lit("1#Ankara#TU#x;1#Berlin#GM#y"))
    tone = F.concat_ws(",", F.format_string("%.2f", F.col("value") / 25 - 5), F.when(F.col("event_id") % 11 == 0, F.lit("x")).otherwise(F.lit("1.5")), F.lit("2"), F.lit("3"))
    cols = [F.col("event_id").cast("string"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit(""), F.lit("site"), F.lit("doc"), F.lit(""), F.lit(""), themes, F.lit(""), place, *[F.lit("")] * 5, tone, *[F.lit("")] * 11]
    whole = F.concat_ws("\t", *cols)
    return t.read("events").select(F.when(F.col("event_id") % 13 == 0, F.lit("a\tb\tc")).otherwise(whole).alias("value"))


#: The type each list of themes comes to.
_TYPES = ("terror_security", "armed_conflict", "natural_disaster", "fx_monetary_shock", "sanctions_export_controls", None, "trade_policy_tariff")
_NEWS = "n AS (SELECT event_id, CAST(ts AS DATE) AS event_date, event_id % 3 = 0 AS abroad, CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_TYPES) if x) + " END AS event_type, CASE WHEN event_id % 11 <> 0 THEN least(1.0, abs(CAST(printf('%.2f', value / 25 - 5) AS DOUBLE)) / 10) END AS severity FROM events WHERE event_id % 13 <> 0), ev AS (SELECT * FROM n WHERE NOT abroad AND event_type IS NOT NULL)"
_PRIOR = "pr AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c}', {s})" for t, p in events.PRIOR.items() for c, s in p.items()) + ") v(event_type, channel, shock_sign))"


def _typed(t: Tables) -> DataFrame:
    events.validate()
    return events.typed(parsers.news(_lines(t)))


@add("news_status", f"WITH {_NEWS} SELECT CASE WHEN abroad THEN 'other_country' WHEN event_type IS NULL THEN 'untyped' ELSE 'event' END AS status, count(*) AS n FROM n GROUP BY 1")
def news_status(t: Tables):
    return _typed(t).groupBy("status").agg(F.count("*").alias("n"))


@add("news_events", f"WITH {_NEWS} SELECT CAST(event_id AS VARCHAR) AS event_id, event_date, event_type, 'GM;TU' AS geography, {r('severity')} AS severity, event_date AS knowledge_date FROM ev")
def news_events(t: Tables):
    return events.events(_typed(t)).select("event_id", "event_date", "event_type", "geography", "severity", "knowledge_date")


@add("event_targets", f"WITH {_NEWS}, {_PRIOR} SELECT CAST(event_id AS VARCHAR) AS event_id, channel, CAST(shock_sign AS INTEGER) AS shock_sign, 0.3::DOUBLE AS confidence, 'inferred' AS evidence_tier, 0.7::DOUBLE AS uncertainty FROM ev JOIN pr USING (event_type)")
def event_targets(t: Tables):
    return events.targets(events.events(_typed(t))).select("event_id", "channel", "shock_sign", "confidence", "evidence_tier", "uncertainty")


@add("event_specs", f"WITH {_NEWS}, {_PRIOR} SELECT DISTINCT event_date, channel, CAST(shock_sign AS INTEGER) AS shock_sign FROM ev JOIN pr USING (event_type)")
def event_specs(t: Tables):
    e = events.events(_typed(t))
    return events.event_specs(e, events.targets(e))


@add("severity_by_type", f"WITH {_NEWS} SELECT event_type, {r('avg(severity)')} AS mean_severity, count(severity) AS n FROM ev GROUP BY event_type")
def severity_by_type(t: Tables):
    return events.events(_typed(t)).groupBy("event_type").agg(F.avg("severity").alias("mean_severity"), F.count("severity").alias("n"))


@add("quarter_hour_slots", "SELECT slot, concat(strftime(slot, '%Y%m%d%H%M%S'), '.gkg.csv.zip') AS name FROM (SELECT unnest(range(lo, hi + INTERVAL 1 SECOND, INTERVAL 15 MINUTE)) AS slot FROM (SELECT date_trunc('day', min(ts)) AS lo, date_trunc('day', max(ts)) AS hi FROM events))")
def quarter_hour_slots(t: Tables):
    """All slots from the first day of the events to their last."""
    lo, hi = t.read("events").agg(F.date_format(F.min("ts"), "yyyy-MM-dd 00:00:00"), F.date_format(F.max("ts"), "yyyy-MM-dd 00:00:00")).first()
    return events.slots(lo, hi, t.spark).withColumn("slot", F.col("slot").cast("timestamp_ntz"))


@add("quarter_hours", f"SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS start, event_type, count(*) AS n, {r('sum(value)')} AS total FROM events GROUP BY 1, 2")
def quarter_hours(t: Tables):
    return flow.quarter_hours(t.read("events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


def _betas(t: Tables) -> DataFrame:
    """Each brand's beta to the market, for two channels."""
    b = factors.rolling_single(t.returns(), market(t), window=WINDOW, least=LEAST).select("symbol", "bar_date", "beta")
    return b.select("symbol", F.lit("XU100").alias("factor"), "bar_date", "beta").unionByName(b.select("symbol", F.lit("USDTRY").alias("factor"), "bar_date", (F.col("beta") * -0.5).alias("beta")).where("substring(symbol, 7, 1) != '5'"))


_BETAS = f"{_SINGLE}, bt AS (SELECT symbol, 'market' AS channel, bar_date, beta FROM single WHERE n >= {LEAST} UNION ALL SELECT symbol, 'fx', bar_date, beta * -0.5 FROM single WHERE n >= {LEAST} AND substr(symbol, 7, 1) <> '5'), ex AS (SELECT symbol, channel, max(CASE WHEN bar_date = last THEN beta END) AS beta FROM (SELECT *, max(bar_date) OVER (PARTITION BY channel) AS last FROM bt) GROUP BY symbol, channel)"
_SHOCKS = "shk AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{c}', {s}::DOUBLE)" for n, p in risk.SCENARIOS.items() for c, s in p.items()) + ") v(scenario, channel, shock))"
_REPRICED = f"{_BETAS}, {_SHOCKS}, us AS (SELECT * FROM shk WHERE scenario IN (SELECT scenario FROM shk WHERE channel IN (SELECT channel FROM ex))), nn AS (SELECT scenario, count(*) AS n FROM us GROUP BY scenario), rp AS (SELECT nn.scenario, s.symbol, coalesce(sum(ex.beta * us.shock), 0) AS pnl, count(ex.beta) / any_value(nn.n) AS coverage FROM nn CROSS JOIN (SELECT DISTINCT symbol FROM ex) s JOIN us ON us.scenario = nn.scenario LEFT JOIN ex ON ex.symbol = s.symbol AND ex.channel = us.channel GROUP BY nn.scenario, s.symbol)"


@add("exposure_tensor", f"WITH {_BETAS} SELECT symbol, channel, {r('beta')} AS beta FROM ex", "returns market")
def exposure_tensor(t: Tables):
    return risk.exposures(_betas(t))


@add("reprice_suite", f"WITH {_REPRICED} SELECT scenario, symbol, {r('pnl')} AS pnl, {r('coverage')} AS coverage FROM rp", "returns market")
def reprice_suite(t: Tables):
    return risk.reprice(risk.exposures(_betas(t)), risk.scenarios(t.spark))


@add("unshockable_scenarios", f"WITH {_BETAS}, {_SHOCKS} SELECT DISTINCT scenario FROM shk WHERE scenario NOT IN (SELECT scenario FROM shk WHERE channel IN (SELECT channel FROM ex WHERE channel = 'fx'))", "returns market")
def unshockable_scenarios(t: Tables):
    return risk.unshockable(risk.exposures(_betas(t)).where("channel = 'fx'"), risk.scenarios(t.spark))


@add("stress_summary", f"WITH {_REPRICED} SELECT scenario, count(*) AS n, {r('avg(pnl)')} AS mean_pnl, {r('min(pnl)')} AS worst, {r('max(pnl)')} AS best, {r('avg(coverage)')} AS mean_coverage FROM rp GROUP BY scenario", "returns market")
def stress_summary(t: Tables):
    return risk.stress_summary(reprice_suite(t), "scenario")


_STRESS = f"{_BETAS}, one AS (SELECT s.symbol, coalesce(sum(ex.beta * k.shock), 0) AS pnl, count(ex.beta) / 2.0 AS coverage FROM (SELECT DISTINCT symbol FROM ex) s CROSS JOIN (VALUES ('market', -0.10::DOUBLE), ('fx', 0.05::DOUBLE)) k(channel, shock) LEFT JOIN ex ON ex.symbol = s.symbol AND ex.channel = k.channel GROUP BY s.symbol)"


def _stress(t: Tables) -> DataFrame:
    return risk.channel_stress(risk.exposures(_betas(t)), {"market": -0.10, "fx": 0.05})


@add("channel_stress", f"WITH {_STRESS} SELECT symbol, {r('pnl')} AS pnl, {r('coverage')} AS coverage FROM one", "returns market")
def channel_stress(t: Tables):
    return _stress(t)


@add("worst_exposed", f"WITH {_STRESS} SELECT symbol, {r('pnl')} AS pnl, {r('coverage')} AS coverage FROM one ORDER BY one.pnl, symbol LIMIT 10", "returns market")
def worst_exposed(t: Tables):
    return risk.extremes(_stress(t))


@add("best_exposed", f"WITH {_STRESS} SELECT symbol, {r('pnl')} AS pnl, {r('coverage')} AS coverage FROM one ORDER BY one.pnl DESC, symbol LIMIT 10", "returns market")
def best_exposed(t: Tables):
    return risk.extremes(_stress(t), worst=False)


@add("portfolio_stress", f"WITH {_STRESS} SELECT {r('sum(pnl) / 25')} AS pnl FROM one", "returns market")
def portfolio_stress(t: Tables):
    return risk.portfolio_stress(_stress(t), t.sectors().select("symbol", F.lit(1 / 25).alias("weight")))


@add("realized_shock", f"WITH x AS (SELECT factor, arg_min(value, bar_date) AS a, arg_max(value, bar_date) AS b, avg(value) AS m FROM levels WHERE bar_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' GROUP BY factor) SELECT factor, {r("CASE factor WHEN 'MKT' THEN b / a - 1 WHEN 'FX' THEN ln(b / a) ELSE b - a END")} AS shock FROM x", "levels")
def realized_shock(t: Tables):
    return risk.realized_shock(t.factor_levels(), {"MKT": "simple", "FX": "log", "RATE": "diff"}, "1998-01-01", "1998-12-31")


@add("control_survival", f"WITH {_BETAS} SELECT channel AS event, count(beta) AS n_names, count(*) FILTER (abs(beta) > 0.5) AS n_high, count(*) FILTER (abs(beta) <= 0.5) AS n_control, {r('count(*) FILTER (abs(beta) <= 0.5) / count(beta)')} AS control_fraction FROM ex GROUP BY channel", "returns market")
def control_survival(t: Tables):
    return events.control_survival(risk.exposures(_betas(t)).select(F.col("channel").alias("event"), "symbol", F.col("beta").alias("exposure")))


_LEGS = "SELECT event, symbol, exposure, shock_sign, CASE WHEN gross > 0 THEN leg / gross ELSE 0 END AS weight FROM (SELECT *, sum(abs(leg)) OVER (PARTITION BY event) AS gross FROM (SELECT x.*, CASE WHEN hi > lo AND exposure * shock_sign >= hi THEN 1.0 WHEN hi > lo AND exposure * shock_sign <= lo THEN -1.0 ELSE 0.0 END AS leg FROM x JOIN (SELECT event, quantile_cont(exposure * shock_sign, 0.7) AS hi, quantile_cont(exposure * shock_sign, 0.3) AS lo FROM x GROUP BY event) USING (event)))"


@add("event_cross_section", f"WITH {_BETAS}, x AS (SELECT channel AS event, symbol, beta AS exposure, CASE WHEN channel = 'fx' THEN -1 ELSE 1 END AS shock_sign FROM ex), legs AS ({_LEGS}) SELECT event, symbol, {r('exposure')} AS exposure, CAST(shock_sign AS INTEGER) AS shock_sign, {r('weight')} AS weight FROM legs", "returns market")
def event_cross_section(t: Tables):
    x = risk.exposures(_betas(t)).selectExpr("channel as event", "symbol", "beta as exposure", "if(channel = 'fx', -1, 1) as shock_sign")
    return events.cross_section(x)


def _drift_specs(t: Tables) -> DataFrame:
    """One event on the first of each month of orders, on two channels."""
    d = t.read("orders").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("event_date")).distinct()
    return d.select("event_date", F.explode(F.array(F.struct(F.lit("market").alias("channel"), F.lit(-1).alias("shock_sign")), F.struct(F.lit("fx").alias("channel"), F.lit(1).alias("shock_sign")))).alias("s")).select("event_date", "s.channel", "s.shock_sign")


@add("drift_weights", f"""WITH {_BETAS}, cal AS (SELECT bar_date, row_number() OVER (ORDER BY bar_date) - 1 AS d FROM (SELECT DISTINCT bar_date FROM bt)),
    sp AS (SELECT event_date, channel, shock_sign FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS event_date FROM orders) CROSS JOIN (VALUES ('market', -1), ('fx', 1)) v(channel, shock_sign)),
    en AS (SELECT sp.*, (SELECT min(d) FROM cal WHERE bar_date >= event_date) AS entry FROM sp),
    x AS (SELECT concat(event_date, '|', en.channel) AS event, entry, symbol, beta AS exposure, shock_sign FROM en JOIN cal ON cal.d = entry - 1 JOIN bt ON bt.bar_date = cal.bar_date AND bt.channel = en.channel WHERE entry >= 1 AND beta IS NOT NULL),
    legs AS ({_LEGS}), held AS (SELECT symbol, entry + h AS d, weight FROM legs JOIN (SELECT DISTINCT event, entry FROM x) USING (event) CROSS JOIN (SELECT unnest(range(0, 5)) AS h) WHERE weight <> 0),
    s AS (SELECT symbol, d, sum(weight) AS w FROM held GROUP BY symbol, d)
    SELECT symbol, bar_date, {r('CASE WHEN sum(abs(w)) OVER (PARTITION BY d) > 1e-12 THEN w / sum(abs(w)) OVER (PARTITION BY d) ELSE 0 END')} AS weight FROM s JOIN cal USING (d)""", "returns market")
def drift_weights(t: Tables):
    b = _betas(t).select("symbol", F.when(F.col("factor") == "XU100", "market").otherwise("fx").alias("channel"), "bar_date", "beta")
    return events.drift_weights(b, _drift_specs(t))


def _owned(t: Tables) -> DataFrame:
    return t.stakes().select("src", "dst", (F.col("pct") / 100).alias("fraction"), F.lit(1.0).alias("confidence"))


_PATHS = "RECURSIVE paths AS (SELECT s_suppkey AS cur, -0.1::DOUBLE AS s, [s_suppkey] AS path, 0 AS hop FROM supplier UNION ALL SELECT src, s * pct / 100, list_append(path, src), hop + 1 FROM paths JOIN stakes ON dst = cur WHERE NOT list_contains(path, src) AND hop < 7)"


def _shocked(t: Tables) -> DataFrame:
    return t.read("supplier").select(F.col("s_suppkey").alias("node"), F.lit(-0.1).alias("shock"))


@add("ownership_propagation", f"WITH {_PATHS} SELECT cur AS holder, {r('sum(s)')} AS shock, count(*) AS n_paths FROM paths WHERE hop > 0 GROUP BY cur", "stakes")
def ownership_propagation(t: Tables):
    return risk.propagate(_owned(t), _shocked(t))[0]


_TREE = "RECURSIVE walk AS (SELECT s_suppkey AS origin, s_suppkey AS node, 0 AS hops FROM supplier UNION ALL SELECT origin, {1}, hops + 1 FROM walk JOIN controls ON {0} = node WHERE hops < {2})"


def _origins(t: Tables) -> DataFrame:
    return t.read("supplier").select(F.col("s_suppkey").alias("node"))


@add("blast_radius_down", f"WITH {_TREE.format('src', 'dst', 12)} SELECT origin, node, CAST(min(hops) AS INTEGER) AS hops FROM walk WHERE hops > 0 GROUP BY origin, node", "controls")
def blast_radius_down(t: Tables):
    return risk.reach(t.controls(), _origins(t))


@add("blast_radius_up", "WITH RECURSIVE walk AS (SELECT s_suppkey AS origin, s_suppkey AS node, 0 AS hops FROM supplier UNION ALL SELECT origin, src, hops + 1 FROM walk JOIN controls ON dst = node WHERE hops < 12) SELECT origin, node, CAST(min(hops) AS INTEGER) AS hops FROM walk WHERE hops > 0 GROUP BY origin, node", "controls")
def blast_radius_up(t: Tables):
    return risk.reach(t.controls(), t.read("supplier").select(F.col("s_suppkey").alias("node")), direction="up")


def _distance(t: Tables) -> DataFrame:
    root = t.spark.createDataFrame([(1,)], "node long")
    none = t.controls().where("false")
    return graph.control_distance(t.controls(), none, root, 4)


@add("control_distance", "WITH RECURSIVE walk AS (SELECT 1::BIGINT AS origin, 1::BIGINT AS node, 0 AS hops UNION ALL SELECT origin, dst, hops + 1 FROM walk JOIN controls ON src = node WHERE hops < 4) SELECT origin, node, CAST(min(hops) AS INTEGER) AS hops FROM walk WHERE hops > 0 GROUP BY origin, node", "controls")
def control_distance(t: Tables):
    return _distance(t)


def _holdings(t: Tables) -> DataFrame:
    s = t.read("supplier")
    total = Window.partitionBy("s_nationkey")
    pos = F.greatest(F.col("s_acctbal"), F.lit(1.0))
    return s.select(F.col("s_nationkey").alias("portfolio"), F.col("s_suppkey").alias("company"), (pos / F.sum(pos).over(total)).alias("weight"))


_GROUP = "RECURSIVE walk AS (SELECT 1::BIGINT AS node, 0 AS hops UNION ALL SELECT dst, hops + 1 FROM walk JOIN controls ON src = node WHERE hops < 4), near AS (SELECT node, min(hops) AS hops FROM walk GROUP BY node), hd AS (SELECT s_nationkey AS portfolio, s_suppkey AS company, greatest(s_acctbal, 1.0) / sum(greatest(s_acctbal, 1.0)) OVER (PARTITION BY s_nationkey) AS weight FROM supplier)"


@add("group_exposure", f"WITH {_GROUP} SELECT portfolio, company, {r('weight')} AS weight, CAST(hops AS INTEGER) AS hops, hops IS NOT NULL AS in_group FROM hd LEFT JOIN near ON node = company", "controls")
def group_exposure(t: Tables):
    return graph.group_exposure(_holdings(t), _distance(t), 1)


@add("group_weight", f"WITH {_GROUP} SELECT portfolio, {r('round(sum(CASE WHEN hops IS NOT NULL THEN weight ELSE 0 END), 4)')} AS group_weight FROM hd LEFT JOIN near ON node = company GROUP BY portfolio", "controls")
def group_weight(t: Tables):
    return graph.group_weight(group_exposure(t))


@add("control_cycles", "SELECT s_suppkey AS node, s_suppkey // 3 * 3 AS component FROM supplier WHERE s_suppkey // 3 * 3 > 0 AND s_suppkey // 3 * 3 + 2 <= (SELECT max(s_suppkey) FROM supplier)")
def control_cycles(t: Tables):
    """Suppliers in rings of three."""
    s = t.read("supplier").where("s_suppkey >= 3")
    ring = s.selectExpr("s_suppkey as src", "if(s_suppkey % 3 = 2, s_suppkey - 2, s_suppkey + 1) as dst")
    top = t.read("supplier").agg(F.max("s_suppkey").alias("m"))
    whole = ring.join(F.broadcast(top), F.expr("src div 3 * 3 + 2 <= m")).select("src", "dst")
    return graph.components(whole)


_RINGED = "SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS first, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier"


@add("control_rings", f"SELECT s_suppkey AS node, first AS component FROM ({_RINGED})")
def control_rings(t: Tables):
    """The suppliers of each nation in one ring, however long, and two links out of it that close nothing."""
    by = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    s = t.read("supplier").select("s_suppkey", F.coalesce(F.lead("s_suppkey").over(by), F.first("s_suppkey").over(by)).alias("dst"))
    out = s.selectExpr("s_suppkey as src", "s_suppkey + 1000000000000 as dst").union(s.selectExpr("s_suppkey + 2000000000000", "s_suppkey"))
    return graph.components(s.selectExpr("s_suppkey as src", "dst").union(out))


@add("control_cycles_none", "SELECT s_suppkey AS node, s_suppkey AS component FROM supplier WHERE false")
def control_cycles_none(t: Tables):
    return graph.components(t.controls())


@add("sector_inherit", "WITH RECURSIVE own AS (SELECT s_suppkey AS node, s_nationkey AS sector FROM supplier WHERE s_suppkey % 4 = 1), walk AS (SELECT s_suppkey AS origin, s_suppkey AS node, 0 AS hops FROM supplier WHERE s_suppkey % 4 <> 1 AND s_suppkey > 1 UNION ALL SELECT origin, src, hops + 1 FROM walk JOIN controls ON dst = walk.node) SELECT origin AS node, CAST(sector AS BIGINT) AS sector, source, CAST(hops AS INTEGER) AS hops FROM (SELECT origin, own.sector, walk.node AS source, hops, row_number() OVER (PARTITION BY origin ORDER BY hops, walk.node) AS k FROM walk JOIN own ON own.node = walk.node WHERE hops > 0) WHERE k = 1", "controls")
def sector_inherit(t: Tables):
    own = t.read("supplier").where("s_suppkey % 4 = 1").selectExpr("s_suppkey as node", "cast(s_nationkey as bigint) as sector")
    return graph.inherit(own, t.controls().withColumnsRenamed({"src": "parent", "dst": "child"}))


@add("sector_coverage", "SELECT floor(round(avg(CASE WHEN s_suppkey % 4 = 1 THEN 1.0 ELSE 0.0 END), 4) * 1e6 + 0.5) / 1e6 AS by_company, (SELECT floor(round(avg(CASE WHEN l_suppkey % 4 = 1 THEN 1.0 ELSE 0.0 END), 4) * 1e6 + 0.5) / 1e6 FROM lineitem) AS by_instrument FROM supplier")
def sector_coverage(t: Tables):
    nodes = t.read("supplier").selectExpr("s_suppkey as node")
    return graph.sector_coverage(nodes, nodes.where("node % 4 = 1"), t.read("lineitem").selectExpr("l_suppkey as node"))


@add("graph_upsert", "SELECT c_custkey AS uuid, CASE WHEN o.n IS NOT NULL THEN concat('new ', c_name) ELSE c_name END AS name, o.n AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey")
def graph_upsert(t: Tables):
    old = t.read("customer").selectExpr("c_custkey as uuid", "c_name as name", "cast(null as bigint) as orders")
    new = t.read("orders").groupBy("o_custkey").agg(F.count("*").alias("orders")).join(old.select("uuid", "name"), F.col("o_custkey") == F.col("uuid")).selectExpr("uuid", "concat('new ', name) as name", "orders")
    return graph.upsert(old, new, "uuid")


@add("edge_link", "SELECT l_suppkey AS src, l_partkey AS dst, max(l_quantity) AS quantity FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY 1, 2")
def edge_link(t: Tables):
    rows = t.read("lineitem").selectExpr("l_suppkey as src", "l_partkey as dst", "l_quantity as quantity")
    return graph.link(rows, t.read("supplier").where("s_acctbal > 0"), t.read("part").where("p_size > 10"), "s_suppkey", "p_partkey", ("quantity",))


@add("edge_keep_existing", "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem a WHERE l_suppkey <> l_partkey AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_suppkey = a.l_suppkey AND b.l_partkey = a.l_partkey AND b.l_linenumber = 1)")
def edge_keep_existing(t: Tables):
    rows = t.read("lineitem").selectExpr("l_suppkey as src", "l_partkey as dst", "l_linenumber")
    return graph.keep_existing(rows.where("l_linenumber = 1"), rows.select("src", "dst"))
