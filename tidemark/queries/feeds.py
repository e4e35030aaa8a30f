"""Landing, reference tables, legal entities, onboarding and probes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import entities, graph, monitors, network, pit, probes, risk
from ..sources import landing, parsers, reference
from ..views import Tables
from . import graphs as graph_queries
from .base import AS_OF, Catalog, r
from .graphs import _typed
from .names import _CODES, _isins, _names, _payloads
from .panels import _PANEL, _panel
from .reads import _REGIME

CATALOG = Catalog()
add = CATALOG.add


@add("land_prices", "WITH x AS (SELECT symbol, bar_date, quantity, coalesce(abs(abs(close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_date) - 1) - 0.10) <= 0.003, false) AS locked FROM bars) SELECT symbol, count(*) AS n, min(bar_date) AS first, max(bar_date) AS last, count(*) FILTER (locked) AS n_is_limit_lock, count(*) FILTER (coalesce(quantity, 0) = 0) AS n_is_stale FROM x GROUP BY symbol", "bars")
def land_prices(t: Tables):
    return landing.account(landing.price_rows(_payloads(t)), "symbol", flags=("is_limit_lock", "is_stale"))


@add("land_levels", f"SELECT symbol AS factor, bar_date, {r('close')} AS value, bar_date AS knowledge_date FROM bars WHERE day(bar_date) % 7 <> 0", "bars")
def land_levels(t: Tables):
    bar = F.struct(F.col("bar_date").cast("string").alias("date"), F.when(F.day("bar_date") % 7 != 0, F.col("close")).alias("close"))
    bars = t.bars().groupBy("symbol").agg(F.collect_list(bar).alias("bars"))
    payload = bars.select(F.to_json(F.struct(F.struct("symbol", "bars").alias("data"))).alias("payload"))
    return landing.level_rows(payload).select("factor", "bar_date", "value", "knowledge_date")


@add("land_flow", " UNION ALL ".join(f"SELECT '{f}' AS factor, CAST(o_orderdate AS DATE) AS bar_date, {r(v)} AS value, CAST(o_orderdate AS DATE) + 6 AS knowledge_date FROM orders" for f, v in (("FFLOW", "o_totalprice"), ("FFLOW_STOCK", "o_totalprice * 2"))))
def land_flow(t: Tables):
    item = F.struct(F.date_format("o_orderdate", "dd-MM-yyyy").alias("Tarih"), F.col("o_totalprice").cast("string").alias("TP_MKNETHAR_M7"), (F.col("o_totalprice") * 2).cast("string").alias("TP_MKNETHAR_M1"))
    return landing.flow_rows(t.read("orders").select(F.to_json(F.struct(F.array(item).alias("items"))).alias("payload"))).drop("source")


@add("land_regimes", f"SELECT o_custkey AS symbol, strftime(o_orderdate + INTERVAL 26 YEAR, '%Y%m') AS period, {_REGIME.format('(year(o_orderdate) + 26)')} AS regime, CAST(o_orderdate AS DATE) AS knowledge_date FROM orders WHERE o_orderkey % 5 <> 0")
def land_regimes(t: Tables):
    periods = t.read("orders").selectExpr("o_custkey as symbol", "if(o_orderkey % 5 = 0, 'unknown', date_format(add_months(o_orderdate, 312), 'yyyyMM')) as period", "to_date(o_orderdate) as declared")
    return landing.regime_rows(periods)


@add("land_events", f"SELECT status, n FROM ({graph_queries.CATALOG.sql['news_status']}) x WHERE status <> 'event'")
def land_events(t: Tables):
    """What is skipped, by its reason."""
    return landing.event_rows(_records(t))[2]


def _records(t: Tables) -> DataFrame:
    return _typed(t).select("record_id", "date", "themes", "locations", "tone")


@add("land_memberships", "SELECT symbol, universe, valid_from, valid_to, knowledge_date FROM memberships", "memberships")
def land_memberships(t: Tables):
    row = F.struct("symbol", "universe", F.lit(None).cast("string").alias("universe_class"), F.col("valid_from").cast("string").alias("valid_from"), F.coalesce(F.col("valid_to").cast("string"), F.lit("")).alias("valid_to"), F.col("knowledge_date").cast("string").alias("knowledge_date"), F.lit("register").alias("source"))
    documents = t.memberships().groupBy("symbol").agg(F.collect_list(row).alias("universe_membership")).select(F.to_json(F.struct("universe_membership")).alias("payload"))
    return landing.membership_rows(documents).select("symbol", "universe", "valid_from", "valid_to", "knowledge_date")


_TRADED = "tk AS (SELECT CASE WHEN c_custkey < 4 THEN ['ISCTR', 'VAKBN', 'YKBNK', 'KRDMD'][1 + c_custkey] ELSE concat('T', c_custkey) END AS symbol, c_custkey AS k FROM customer)"


@add("land_universe_class", f"WITH {_TRADED} SELECT symbol, CASE WHEN k < 4 THEN 'operating' WHEN k % 4 = 0 THEN 'holding' WHEN k % 4 = 1 THEN 'gyo_reit' WHEN k % 4 = 2 THEN 'operating' END AS universe_class, CASE WHEN k < 4 THEN ['ISATR', 'TVB', 'YKB', 'KRDMA'][1 + k] WHEN k % 4 < 3 THEN symbol END AS found_as, CASE WHEN k < 4 OR k % 4 < 3 THEN 'derived' ELSE 'refused' END AS status FROM tk")
def land_universe_class(t: Tables):
    code = "coalesce(get(array('ISCTR', 'VAKBN', 'YKBNK', 'KRDMD'), cast(c_custkey as int)), concat('T', c_custkey))"
    c = t.read("customer").selectExpr(f"{code} as symbol", "c_custkey as k")
    own = c.where("k >= 4").selectExpr("symbol", "case k % 4 when 0 then 'HOLDİNGLER VE YATIRIM' when 1 then 'GAYRİMENKUL YATIRIM ORTAKLIKLARI' when 2 then 'BANKALAR' else '' end as sector")
    others = c.where("k < 4").selectExpr("get(array('ISATR', 'TVB', 'YKB', 'KRDMA'), cast(k as int)) as symbol", "'BANKALAR' as sector")
    return landing.class_rows(c, own.unionByName(others))


@add("land_edges", f"WITH {_PANEL}, sp AS (SELECT min(bar_date) AS a, max(bar_date) AS b FROM p) SELECT src AS symbol_a, dst AS symbol_b, b AS window_end, CAST(b - a AS INTEGER) AS \"window\", {r('corr')} AS value, CAST(sign(corr) AS INTEGER) AS sign, 'fdr_sector' AS method, true AS fdr_passed, DATE '{AS_OF}' AS knowledge_date FROM pairs, sp WHERE abs(corr) >= 0.05", "returns sectors")
def land_edges(t: Tables):
    panel = _panel(t)
    edges = network.correlations(panel, t.sectors()).where("abs(corr) >= 0.05").withColumn("p_value", F.lit(0.01))
    span = panel.agg(F.min("bar_date").alias("a"), F.max("bar_date").alias("b"))
    return landing.edge_rows(edges.join(F.broadcast(span)), F.col("a"), F.col("b"), AS_OF).drop("p_value")  # one row


@add("land_registry", f"SELECT concat('S', n_nationkey) AS signal_id, n_name AS hypothesis, DATE '{AS_OF}' AS knowledge_date, CAST(12 AS INTEGER) AS n_trials, 0.25::DOUBLE AS deflated_sharpe, 0.4::DOUBLE AS pbo, true AS beat_baselines, false AS promoted FROM nation")
def land_registry(t: Tables):
    verdict = {"n_trials": 12, "dsr": 0.25, "pbo": 0.4, "beats_baselines": True, "promoted": False}
    return landing.registry_row(verdict, t.read("nation").select(F.concat(F.lit("S"), "n_nationkey").alias("signal_id"), F.col("n_name").alias("hypothesis"), F.lit(AS_OF).cast("date").alias("knowledge_date")))


_CHOICES = f"{_CODES}, ch AS (SELECT concat('T', p_partkey) AS ticker, isin, CASE WHEN p_partkey % 8 <> 3 THEN 'unconfirmed' WHEN NOT (ok AND p_partkey % 3 <> 2) THEN 'chosen-not-valid-equity-isin' WHEN p_partkey % 16 = 3 THEN 'chosen-not-a-candidate' ELSE 'honoured' END AS status, p_partkey FROM checked WHERE p_partkey % 4 = 3)"


def _choices(t: Tables) -> DataFrame:
    return _isins(t).where("p_partkey % 4 = 3").selectExpr("concat(' t', p_partkey) as ticker", "lower(isin) as chosen", "p_partkey % 8 = 3 as confirmed", "if(p_partkey % 16 = 3, array('TRAXXXXXXXX1'), array(isin, 'TRAXXXXXXXX1')) as candidates")


@add("isin_choices", f"WITH {_CHOICES} SELECT ticker, CASE WHEN status = 'honoured' THEN isin END AS isin, status FROM ch")
def isin_choices(t: Tables):
    return reference.settled(_choices(t))


@add("isin_lookup", f"WITH {_CHOICES}, x AS (SELECT concat('T', c.p_partkey) AS ticker, CASE WHEN c.p_partkey % 4 < 2 THEN CASE WHEN c.ok THEN c.isin END WHEN c.p_partkey % 4 = 3 AND ch.status = 'honoured' THEN c.isin END AS isin, CASE WHEN c.p_partkey % 4 < 2 THEN CASE WHEN c.ok THEN 'found' ELSE 'failed-validation' END WHEN c.p_partkey % 4 = 2 THEN 'not-in-reference' WHEN ch.status = 'honoured' THEN 'disambiguated' ELSE 'ambiguous' END AS status FROM checked c LEFT JOIN ch USING (p_partkey) UNION ALL SELECT '', NULL, 'empty-ticker') SELECT ticker, isin, coalesce(substr(isin, 1, 3) IN ('TRA', 'TRE'), false) AS is_equity, status IN ('found', 'disambiguated', 'ambiguous') AS is_traded, status FROM x")
def isin_lookup(t: Tables):
    i = _isins(t).withColumn("ticker", F.concat(F.lit("t"), "p_partkey"))
    asked = i.select("ticker").union(t.spark.createDataFrame([(None,), (" ",)], "ticker string"))
    return reference.lookup_isins(asked, i.where("p_partkey % 4 < 2"), i.where("p_partkey % 4 = 3"), _choices(t))


@add("candidate_isins", f"WITH {_CODES} SELECT p_partkey % 700 AS lei, string_agg(DISTINCT isin, ',' ORDER BY isin) AS isins FROM checked WHERE ok AND p_partkey % 3 <> 2 GROUP BY 1")
def candidate_isins(t: Tables):
    rows = _isins(t).selectExpr("p_partkey % 700 as lei", "if(p_partkey % 2 = 0, isin, null) as isin", "if(p_partkey % 2 = 0, null, array(isin, isin)) as candidates")
    return reference.candidate_isins(rows).select("lei", F.array_join("isins", ",").alias("isins"))


#: Parts' brands are main sectors, their types leaves; some are torn.
_SECTORS = "sec AS (SELECT DISTINCT concat('M', p_partkey % 25) AS code, 1 AS level, CASE WHEN p_partkey % 25 = 24 THEN 'M1' END AS parent FROM part UNION SELECT DISTINCT concat('L', p_partkey % 150), 2, CASE WHEN p_partkey % 150 = 7 THEN NULL WHEN p_partkey % 150 = 8 THEN 'M99' ELSE concat('M', p_partkey % 150 % 24) END FROM part), mem AS (SELECT concat('T', p_partkey) AS ticker, CASE WHEN p_partkey % 11 = 0 THEN 'M1' WHEN p_partkey % 13 = 0 THEN 'L999' ELSE concat('L', p_partkey % 150) END AS leaf FROM part)"


def _sectors(t: Tables) -> tuple[DataFrame, DataFrame]:
    p = t.read("part")
    main = p.selectExpr("concat('M', p_partkey % 25) as code", "1 as level", "if(p_partkey % 25 = 24, 'M1', null) as parent")
    leaf = p.selectExpr("concat('L', p_partkey % 150) as code", "2 as level", "case p_partkey % 150 when 7 then null when 8 then 'M99' else concat('M', p_partkey % 150 % 24) end as parent")
    members = p.selectExpr("concat('T', p_partkey) as ticker", "case when p_partkey % 11 = 0 then 'M1' when p_partkey % 13 = 0 then 'L999' else concat('L', p_partkey % 150) end as leaf")
    return main.union(leaf).distinct(), members


@add("sector_reference_problems", f"WITH {_SECTORS} SELECT 'sector' AS kind, code AS key, CASE WHEN parent IS NOT NULL AND parent NOT IN (SELECT code FROM sec) THEN 'unknown parent' WHEN level = 2 THEN 'leaf without a parent' ELSE 'main sector with a parent' END AS problem FROM sec WHERE parent IS NOT NULL AND parent NOT IN (SELECT code FROM sec) OR level = 2 AND parent IS NULL OR level = 1 AND parent IS NOT NULL UNION ALL SELECT 'member', ticker, CASE WHEN level IS NULL THEN 'unknown sector' ELSE 'not a leaf' END FROM mem LEFT JOIN sec ON code = leaf WHERE coalesce(level, 0) <> 2")
def sector_reference_problems(t: Tables):
    return reference.sector_problems(*_sectors(t))


@add("sector_lookup", f"WITH {_SECTORS} SELECT ticker, leaf, CASE WHEN level = 2 THEN parent ELSE code END AS main, 'found' AS status FROM mem LEFT JOIN sec ON code = leaf UNION ALL SELECT concat('C', c_custkey), NULL, NULL, 'not-in-reference' FROM customer")
def sector_lookup(t: Tables):
    sectors, members = _sectors(t)
    asked = members.select("ticker").union(t.read("customer").select(F.concat(F.lit("c"), "c_custkey")))
    return reference.lookup_sectors(asked, sectors, members)


@add("sector_backfill", "WITH RECURSIVE walk AS (SELECT s_suppkey AS origin, s_suppkey AS node, 0 AS hops FROM supplier WHERE s_suppkey % 4 <> 1 AND s_suppkey % 10 <> 0 UNION ALL SELECT origin, src, hops + 1 FROM walk JOIN controls ON dst = node WHERE node % 10 <> 0), hit AS (SELECT origin, node, row_number() OVER (PARTITION BY origin ORDER BY hops) AS k FROM walk WHERE hops > 0 AND node % 4 = 1) SELECT s_suppkey AS uuid, CASE WHEN s_suppkey % 4 = 1 THEN concat('L', s_suppkey % 5) WHEN node IS NOT NULL THEN concat('L', node % 5) END AS sector, CASE WHEN s_suppkey % 4 = 1 THEN 'reference' WHEN node IS NOT NULL THEN 'inherited' END AS basis, CASE WHEN s_suppkey % 4 = 1 OR node IS NOT NULL THEN 'linked' ELSE 'no-sector' END AS status FROM supplier LEFT JOIN hit ON origin = s_suppkey AND k = 1", "controls")
def sector_backfill(t: Tables):
    s = t.read("supplier")
    leaves = t.spark.range(5).selectExpr("concat('L', id) as code", "2 as level", "'M0' as parent").union(t.spark.createDataFrame([("M0", 1, None)], "code string, level int, parent string"))
    members = s.where("s_suppkey % 4 = 1").selectExpr("concat('T', s_suppkey) as ticker", "concat('L', s_suppkey % 5) as leaf")
    companies = s.selectExpr("s_suppkey as uuid", "if(s_suppkey % 3 = 0, null, concat('t', s_suppkey)) as ticker", "s_suppkey % 10 = 0 as external").withColumn("ticker", F.expr("if(uuid % 4 = 1, concat('t', uuid), ticker)"))
    return reference.backfill_sectors(companies, leaves, members, t.controls().withColumnsRenamed({"src": "parent", "dst": "child"}))


@add("newest_relations", f"SELECT l_suppkey AS parent, l_partkey AS child, {r('max(l_quantity)')} AS pct FROM lineitem x WHERE l_orderkey = (SELECT max(l_orderkey) FROM lineitem y WHERE y.l_suppkey = x.l_suppkey AND y.l_partkey = x.l_partkey) GROUP BY 1, 2")
def newest_relations(t: Tables):
    rows = t.read("lineitem").selectExpr("l_suppkey as parent", "l_partkey as child", "l_orderkey as row", "cast(l_quantity as double) as pct")
    return reference.newest_relations(rows)


_EXTRA = "[0, 1, 1, 1, 2, 0, 1, 2][1 + c_custkey % 8]"
_SCORE = f"round(3.0 / (3 + {_EXTRA}) - CASE WHEN c_custkey % 5 = 0 THEN 0.05 ELSE 0 END, 3)"
_MATCHED = f"lm AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 7 <> 0 THEN concat('LEI', c_custkey) END AS lei, CASE WHEN c_custkey % 7 <> 0 THEN {_SCORE} END AS score, CASE WHEN c_custkey % 7 = 0 THEN 'no_candidates' WHEN {_SCORE} >= 0.6 THEN 'matched' ELSE 'below_threshold' END AS status FROM customer)"


def _matches(t: Tables) -> DataFrame:
    c = _names(t).join(t.read("customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    records = c.where("c_custkey % 7 != 0").selectExpr("concat('LEI', c_custkey) as lei", "concat('Sirket O', c_custkey, ' ', c_mktsegment, ' SANAYI A.S.') as legal_name", "if(c_custkey % 5 = 0, 'LAPSED', 'ACTIVE') as status")
    funds = c.selectExpr("concat('F', c_custkey) as lei", "concat('Sirket O', c_custkey, ' ', c_mktsegment, ' EMEKLILIK FONU') as legal_name", "'ACTIVE' as status")
    return entities.match_records(c.withColumnRenamed("c_custkey", "uuid"), records.union(funds))


@add("lei_match", f"WITH {_MATCHED} SELECT key, lei, {r('score')} AS score, status FROM lm")
def lei_match(t: Tables):
    return _matches(t).drop("record")


@add("lei_backfill", f"WITH {_MATCHED} SELECT key AS uuid, CASE WHEN status = 'matched' THEN lei END AS lei, CASE WHEN status = 'matched' THEN 'written' ELSE status END AS status FROM lm WHERE key % 3 <> 0 AND key % 2 = 0")
def lei_backfill(t: Tables):
    companies = t.read("customer").selectExpr("c_custkey as uuid", "if(c_custkey % 3 = 0, 'known', '') as lei", "c_custkey % 2 = 0 as is_listed")
    return entities.backfill_leis(companies, _matches(t))


@add("isin_backfill", f"WITH {_CODES}, g AS (SELECT p_partkey % 700 AS k, isin, p_partkey % 3 AS c FROM codes), s AS (SELECT k, count(DISTINCT isin) FILTER (c <> 2) AS n, min(isin) FILTER (c <> 2) AS one FROM g GROUP BY k) SELECT CAST(i AS BIGINT) AS uuid, CASE WHEN n = 1 THEN one END AS isin, CASE WHEN s.k IS NULL THEN 'none' WHEN n = 1 THEN 'single-equity' WHEN n > 1 THEN 'ambiguous-multi-equity' ELSE 'no-equity-class' END AS method, CASE WHEN n = 1 THEN 'written' ELSE 'needs_review' END AS status FROM (SELECT c_custkey AS i FROM customer) r LEFT JOIN s ON s.k = i WHERE i % 4 <> 0")
def isin_backfill(t: Tables):
    companies = t.read("customer").selectExpr("c_custkey as uuid", "'ZZZZZ' as ticker", "concat('L', c_custkey) as lei", "if(c_custkey % 4 = 0, 'known', null) as isin")
    return entities.backfill_isins(companies, _isins(t).selectExpr("concat('L', p_partkey % 700) as lei", "isin"))


@add("market_data", "SELECT concat('C', c_custkey) AS symbol, ['not_carried_yet', 'carried', 'carried_other_code'][1 + c_custkey % 3] AS market_data, CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 8 END AS n_codes FROM customer")
def market_data(t: Tables):
    codes = "case c_custkey % 3 when 0 then array('', null) when 1 then array(concat('C', c_custkey), 'X') else transform(sequence(1, 12), i -> concat('Y', i)) end as codes"
    return monitors.market_data(t.read("customer").selectExpr("concat('C', c_custkey) as symbol", codes)).select("symbol", "market_data", F.size("vendor_codes").alias("n_codes"))


_STAGED = "st AS (SELECT concat('F', c_custkey) AS filing_id, concat('C', c_custkey) AS ticker, c_custkey % 2 = 0 AS g, c_custkey % 3 = 0 AS s, c_custkey IN (SELECT o_custkey FROM orders) AS u, c_custkey % 5 = 0 AS f FROM customer WHERE c_custkey % 7 <> 0)"
_PENDING = "list_filter([CASE WHEN NOT g THEN 'gleif_identity' END, CASE WHEN NOT s THEN 'sector' END, CASE WHEN NOT u THEN 'universe_prices' END, CASE WHEN NOT f THEN 'factor_refit' END], lambda x: x IS NOT NULL)"


def _staged(t: Tables) -> DataFrame:
    c = t.read("customer").selectExpr("concat('F', c_custkey) as filing_id", "concat('C', c_custkey) as ticker", "if(c_custkey % 2 = 0, 'L', null) as lei", "'I' as isin", "if(c_custkey % 3 = 0, 'S', '') as sector", "c_custkey % 7 != 0 as is_listed", "c_custkey")
    traded = t.read("orders").select(F.concat(F.lit("C"), "o_custkey").alias("symbol"))
    return monitors.onboarding_status(c.drop("c_custkey"), traded, c.where("c_custkey % 5 = 0").select(F.col("ticker").alias("symbol")), c.select(F.col("ticker").alias("symbol")))


@add("onboarding_status", f"WITH {_STAGED} SELECT filing_id, ticker, array_to_string({_PENDING}, ',') AS pending, {_PENDING}[1] AS next_step FROM st")
def onboarding_status(t: Tables):
    return _staged(t).withColumn("pending", F.array_join("pending", ","))


@add("onboarding_plan", f"WITH {_STAGED}, x AS (SELECT ticker, unnest({_PENDING}) AS stage, generate_subscripts({_PENDING}, 1) AS step FROM st) SELECT ticker, CAST(step AS INTEGER) AS step, stage, CASE stage WHEN 'gleif_identity' THEN 'fill in the entity and security identifiers' WHEN 'sector' THEN 'link the company to its sector' WHEN 'universe_prices' THEN 'pull bars, returns and the universe class' ELSE 'fit betas and residuals' END AS what FROM x")
def onboarding_plan(t: Tables):
    return monitors.onboarding_plan(_staged(t))


@add("empirical_scenario", f"WITH x AS (SELECT factor, arg_min(value, bar_date) AS a, arg_max(value, bar_date) AS b FROM levels WHERE bar_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' GROUP BY factor) SELECT 'year_1998' AS scenario, CASE factor WHEN 'MKT' THEN 'market' WHEN 'FX' THEN 'fx' ELSE 'rates_cds' END AS channel, {r("CASE factor WHEN 'MKT' THEN b / a - 1 WHEN 'FX' THEN ln(b / a) ELSE b - a END")} AS shock FROM x", "levels")
def empirical_scenario(t: Tables):
    return risk.empirical_scenario(t.factor_levels(), {"MKT": "simple", "FX": "log", "RATE": "diff"}, "1998-01-01", "1998-12-31", "year_1998", {"market": "MKT", "fx": "FX", "rates_cds": "RATE"})


@add("prior_shocks", f"SELECT CAST(o_orderkey AS VARCHAR) AS scenario, channel, {r('s * (o_orderkey % 10) / 10.0')} AS shock FROM orders, (VALUES ('energy', 1), ('market', -1)) v(channel, s) WHERE o_orderkey % 3 = 0 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), channel, {r('s * (o_orderkey % 10) / 10.0')} FROM orders, (VALUES ('rates_cds', 1), ('fx', -1)) v(channel, s) WHERE o_orderkey % 3 = 1")
def prior_shocks(t: Tables):
    e = t.read("orders").selectExpr("cast(o_orderkey as string) as event_id", "case o_orderkey % 3 when 0 then 'energy_supply_disruption' when 1 then 'cbrt_regulatory_action' else 'pandemic' end as event_type", "if(o_orderkey % 3 = 2, null, (o_orderkey % 10) / 10.0D) as severity")
    return risk.prior_shocks(e)


_VERSIONS = "ve AS (SELECT c_nationkey AS src, c_custkey AS dst, CAST(o_orderdate AS DATE) AS knowledge_date, CAST(o_orderdate AS DATE) AS valid_from, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + 400 END AS valid_to, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey)"


@add("graph_asof", f"WITH {_VERSIONS}, k AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY knowledge_date DESC, valid_from DESC, valid_to DESC NULLS LAST, o_orderkey DESC) AS n FROM ve WHERE knowledge_date <= DATE '{AS_OF}') SELECT src, dst, valid_from, valid_to, knowledge_date FROM k WHERE n = 1 AND valid_from <= DATE '{AS_OF}' AND (valid_to IS NULL OR valid_to >= DATE '{AS_OF}')")
def graph_asof(t: Tables):
    v = t.read("orders").join(t.read("customer"), F.col("o_custkey") == F.col("c_custkey")).selectExpr("c_nationkey as src", "c_custkey as dst", "to_date(o_orderdate) as knowledge_date", "to_date(o_orderdate) as valid_from", "if(o_orderkey % 3 = 0, date_add(to_date(o_orderdate), 400), null) as valid_to", "o_orderkey")
    return pit.graph_asof(v, AS_OF).drop("o_orderkey")


@add("universe_class_asof", f"WITH m AS (SELECT o_custkey AS symbol, CASE WHEN o_orderkey % 4 <> 0 THEN concat('class ', o_orderkey % 3) END AS universe_class, CAST(date_trunc('year', o_orderdate) AS DATE) AS valid_from, CAST(o_orderdate AS DATE) AS knowledge_date FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '{AS_OF}'), n AS (SELECT * FROM m WHERE universe_class IS NOT NULL AND valid_from = (SELECT max(valid_from) FROM m x WHERE x.symbol = m.symbol)), l AS (SELECT *, max(knowledge_date) OVER (PARTITION BY symbol) AS k FROM n) SELECT symbol, min(universe_class) AS universe_class FROM l WHERE knowledge_date = k GROUP BY symbol")
def universe_class_asof(t: Tables):
    m = t.read("orders").selectExpr("o_custkey as symbol", "if(o_orderkey % 4 = 0, null, concat('class ', o_orderkey % 3)) as universe_class", "to_date(date_trunc('year', o_orderdate)) as valid_from", "to_date(o_orderdate) as knowledge_date")
    return pit.universe_classes(m, AS_OF)


def _blocks(t: Tables) -> DataFrame:
    return probes.blocks(probes.sector_means(t.returns().withColumnRenamed("ret", "residual"), t.sectors(), 3))


_BLOCKS = """m AS (SELECT sector, bar_date, avg(ret) AS x FROM returns JOIN sectors USING (symbol) WHERE ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3),
    dy AS (SELECT bar_date, row_number() OVER (ORDER BY bar_date) - 1 AS d, count(*) OVER () AS total FROM (SELECT DISTINCT bar_date FROM m)),
    de AS (SELECT bar_date, h AS horizon, d // h AS b, total // h AS n_blocks FROM dy, (VALUES (1), (5), (10), (21)) v(h) WHERE d // h < total // h),
    g AS (SELECT DISTINCT s.sector, horizon, b, n_blocks, n_blocks // 2 AS half FROM (SELECT DISTINCT sector FROM m) s, de),
    f AS (SELECT g.*, coalesce(s, 0) AS s FROM g LEFT JOIN (SELECT horizon, sector, b, sum(x) AS s FROM m JOIN de USING (bar_date) GROUP BY 1, 2, 3) USING (horizon, sector, b)),
    z AS (SELECT horizon, sector, b, half, n_blocks, (s - avg(s) FILTER (b < half) OVER w) / (stddev_pop(s) FILTER (b < half) OVER w + 1e-9) AS z FROM f WINDOW w AS (PARTITION BY horizon, sector)),
    sp AS (SELECT a.horizon, a.sector AS supplier, c.sector AS customer, a.z AS x, c.z AS y, a.b >= a.half AS test FROM z a JOIN z c ON c.horizon = a.horizon AND c.b = a.b + 1 WHERE a.b <> a.half - 1 AND a.half - 1 >= 6 AND a.n_blocks - a.half - 1 >= 5),
    co AS (SELECT horizon, supplier, customer, corr(x, y) FILTER (NOT test) AS a, corr(x, y) FILTER (test) AS c FROM sp GROUP BY 1, 2, 3)"""


@add("lead_lag_pairs", f"WITH {_BLOCKS} SELECT CAST(horizon AS INTEGER) AS horizon, supplier, customer, {r('round(a, 4)')} AS train_corr, {r('round(c, 4)')} AS test_corr, coalesce(sign(round(a, 4)) = sign(round(c, 4)) AND abs(round(c, 4)) > 0.15 AND abs(round(a, 4)) > 0.1, false) AS confirmed FROM co WHERE supplier <> customer", "returns sectors")
def lead_lag_pairs(t: Tables):
    s = t.sectors().select("sector").distinct()
    pairs = s.withColumnRenamed("sector", "supplier").join(s.withColumnRenamed("sector", "customer"), F.col("supplier") != F.col("customer"))
    return probes.lead_lag_pairs(_blocks(t), pairs)


@add("lead_lag_ic")
def lead_lag_ic(t: Tables):
    return probes.lead_lag_ic(_blocks(t))


_DEALT = "nb AS (SELECT c_custkey AS id, c_custkey % 6 AS k FROM customer)"


def _disclosures(t: Tables) -> DataFrame:
    who = F.element_at(F.array(F.lit("Sağlık Bakanlığı"), F.lit("Acme GmbH"), F.lit("Almanya mukim"), F.lit("bir müşteri"), F.concat(F.lit("Firma"), "c_custkey", F.lit(" Lojistik")), F.lit("-")), (F.col("c_custkey") % 6 + 1).cast("int"))
    ratio = F.when(F.col("c_custkey") % 4 == 0, "%12").otherwise("-")
    row = lambda label, value: F.concat(F.lit('<tr><td class="ilk">' + label + " *</td><td><b>"), value, F.lit("</b></td></tr>"))
    return t.read("customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("T"), "c_custkey").alias("declaring"), F.concat(F.lit("<table>"), row(probes.WHO, who), row(probes.RATIO, ratio), F.lit("</table>")).alias("html"))


def _new_business(t: Tables) -> DataFrame:
    listed = t.read("customer").select(F.concat(F.lit("T"), "c_custkey").alias("ticker"), F.concat(F.lit("Firma"), "c_custkey", F.lit(" Holding")).alias("name"), (F.col("c_custkey") % 12 == 4).alias("is_listed"))
    return probes.new_business(_disclosures(t), listed)


_KIND = "CASE k WHEN 0 THEN 'government' WHEN 1 THEN 'foreign' WHEN 2 THEN 'foreign' WHEN 3 THEN 'anonymized' WHEN 4 THEN 'named_domestic' ELSE 'unnamed' END"


@add("new_business", f"WITH {_DEALT} SELECT id, concat('T', id) AS declaring, ['Sağlık Bakanlığı', 'Acme GmbH', 'Almanya mukim', 'bir müşteri', concat('Firma', id, ' Lojistik'), '-'][1 + k] AS counterparty, {_KIND} AS kind, id % 4 = 0 AS has_ratio, CASE WHEN id % 12 = 4 THEN concat('T', id) END AS matched FROM nb")
def new_business(t: Tables):
    return _new_business(t)


@add("new_business_coverage", f"WITH {_DEALT} SELECT {_KIND} AS kind, count(*) AS n, count(*) FILTER (id % 4 = 0) AS n_ratio, count(*) FILTER (id % 12 = 4) AS n_matched, {r('round(count(*) FILTER (id % 12 = 4) / (SELECT count(*) FROM nb), 4)')} AS share FROM nb GROUP BY 1")
def new_business_coverage(t: Tables):
    return probes.new_business_coverage(_new_business(t))


@add("listed_words", "SELECT concat('FIRMA', c_custkey) AS word, concat('T', c_custkey) AS ticker FROM customer WHERE c_custkey % 12 = 4")
def listed_words(t: Tables):
    c = t.read("customer")
    return probes.listed_words(c.select(F.concat(F.lit("T"), "c_custkey").alias("ticker"), F.concat(F.lit("Fırma"), "c_custkey", F.lit(" Holding A.Ş.")).alias("name"), (F.col("c_custkey") % 12 == 4).alias("is_listed")))


@add("query_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%d-%m-%Y') END AS day FROM orders")
def query_dates(t: Tables):
    given = "case o_orderkey % 5 when 0 then date_format(o_orderdate, 'yyyy-MM-dd') when 1 then date_format(o_orderdate, 'dd-MM-yyyy') when 2 then date_format(o_orderdate, 'yyyy-M-d') when 3 then date_format(o_orderdate, 'yyyy-MM-d') else date_format(o_orderdate, 'yyyyMMdd') end as given"
    return t.read("orders").selectExpr("o_orderkey", given).select("o_orderkey", parsers.query_date(F.col("given")).alias("day"))


@add("ticker_lookup", "SELECT concat('T', c_custkey) AS ticker, CASE WHEN c_custkey % 3 < 2 THEN concat('F', lpad(CAST(c_custkey // 3 * 3 AS VARCHAR), 9, '0')) END AS filing_id, CASE WHEN c_custkey % 3 < 2 THEN 'found' ELSE 'unknown' END AS status FROM customer")
def ticker_lookup(t: Tables):
    c = t.read("customer").select("c_custkey")
    members = c.where("c_custkey % 3 = 0").selectExpr("concat('F', lpad(c_custkey, 9, '0')) as filing_id", "concat('t', c_custkey, ' , T', c_custkey + 1) as ticker")
    return parsers.find_tickers(members, c.selectExpr("concat(' t', c_custkey) as ticker"))


_FIRMS = "firms AS (SELECT s_suppkey AS uuid, CASE WHEN s_suppkey % 3 = 0 THEN concat('T', s_suppkey) END AS ticker, CASE WHEN s_suppkey % 7 <> 0 THEN s_name END AS name FROM supplier)"


def _firms(t: Tables) -> DataFrame:
    return t.read("supplier").selectExpr("s_suppkey as uuid", "if(s_suppkey % 3 = 0, concat('T', s_suppkey), null) as ticker", "if(s_suppkey % 7 != 0, s_name, null) as name")


@add("control_links", f"WITH {_FIRMS} SELECT coalesce(a.ticker, a.name) AS src, coalesce(b.ticker, b.name) AS dst FROM controls JOIN firms a ON a.uuid = src JOIN firms b ON b.uuid = dst WHERE coalesce(a.ticker, a.name) IS NOT NULL AND coalesce(b.ticker, b.name) IS NOT NULL", "controls")
def control_links(t: Tables):
    return graph.control_links(_firms(t), t.controls())


@add("ownership_links", f"WITH {_FIRMS} SELECT a.ticker AS src, b.ticker AS dst, {r('pct / 100')} AS fraction, 1.0::DOUBLE AS confidence FROM stakes JOIN firms a ON a.uuid = src JOIN firms b ON b.uuid = dst WHERE a.ticker IS NOT NULL AND b.ticker IS NOT NULL", "stakes")
def ownership_links(t: Tables):
    return graph.ownership_links(_firms(t), t.stakes(), listed_only=True)


def _members(t: Tables) -> DataFrame:
    return t.read("customer").selectExpr("concat('OID', c_custkey) as filing_id", "if(c_custkey % 4 = 0, '', concat('T', c_custkey, if(c_custkey % 5 = 0, ', X', ''))) as ticker", "c_name as name", "c_custkey % 4 != 0 as is_listed")


@add("seed_companies", "SELECT concat('co-oid', c_custkey) AS uuid, CASE WHEN c_custkey % 4 <> 0 THEN concat('T', c_custkey) END AS ticker, c_name AS name, concat('OID', c_custkey) AS filing_id, 'TR' AS jurisdiction, c_custkey % 4 <> 0 AS is_listed FROM customer")
def seed_companies(t: Tables):
    return graph.seed(_members(t), listed_only=False)[0]


@add("seed_issues", "SELECT concat('co-oid', c_custkey) AS src, concat('se-oid', c_custkey, '-t', c_custkey) AS dst FROM customer WHERE c_custkey % 4 <> 0")
def seed_issues(t: Tables):
    return graph.seed(_members(t))[2]


def _filings(t: Tables) -> DataFrame:
    return t.read("orders").selectExpr("concat('OID', o_custkey) as filing_id", "o_orderkey div 2 as index", "o_orderpriority as subject", "o_orderstatus as type", "o_orderdate as published")


@add("disclosure_nodes", "WITH x AS (SELECT o_orderkey // 2 AS index, o_orderdate, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_orderkey // 2 ORDER BY o_orderdate DESC, o_orderpriority DESC, o_orderstatus DESC) AS k FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) SELECT index, o_orderpriority AS subject, o_orderstatus AS type, CAST(o_orderdate AS DATE) AS published FROM x WHERE k = 1")
def disclosure_nodes(t: Tables):
    return graph.disclosures(_filings(t), _members(t))[0]


@add("disclosure_links", "SELECT DISTINCT concat('co-oid', o_custkey) AS src, o_orderkey // 2 AS dst FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def disclosure_links(t: Tables):
    return graph.disclosures(_filings(t), _members(t))[1]


_FORMS = "f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders), a AS (SELECT * FROM f WHERE k <= 5), rows_ AS (SELECT a.*, l_suppkey AS child, CAST(l_quantity AS DOUBLE) AS pct FROM a JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 3 = 0), b AS (SELECT o_custkey, min(k) AS k FROM rows_ GROUP BY 1), nw AS (SELECT o_custkey AS parent, child, max(pct) AS pct, CAST(max(o_orderdate) AS DATE) AS as_of FROM rows_ JOIN b USING (o_custkey, k) GROUP BY 1, 2), kn AS (SELECT c_custkey AS parent, c_custkey % 10 AS child, 1.0::DOUBLE AS pct, DATE '1990-01-01' AS as_of FROM customer)"


@add("harvested_relations", f"WITH {_FORMS} SELECT parent, child, {r('pct')} AS pct, as_of FROM nw UNION ALL SELECT parent, child, {r('pct')}, as_of FROM kn WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.parent = kn.parent AND nw.child = kn.child)")
def harvested_relations(t: Tables):
    forms = t.read("orders").selectExpr("o_custkey as company", "o_orderkey as index", "o_orderdate as published")
    relations = t.read("lineitem").where("l_orderkey % 3 = 0").selectExpr("l_orderkey as index", "l_suppkey as child", "cast(l_quantity as double) as pct")  # a third of the forms has the table
    known = t.read("customer").selectExpr("c_custkey as parent", "c_custkey % 10 as child", "1.0D as pct", "date'1990-01-01' as as_of")
    return reference.harvested(forms, relations, known)
