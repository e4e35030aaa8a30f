"""Stored state: spans computed anew, steps of the schema, snapshots, onboarding; outcomes of feeds; imports and board seats."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import books, events, graph, network, risk
from ..plans import onboarding, runs
from ..sources import adapter, graphload, landing, members, parsers, reference
from ..sources.store import Store
from ..tables import shared_folder
from ..views import Tables
from . import graphs, reads
from .base import AS_OF, VIEWS, Catalog, r
from .names import _CODES, _isins

CATALOG = Catalog()
add = CATALOG.add


def _store(t: Tables, version: int = 2) -> Store:
    return Store(t.spark, f"{shared_folder(t.spark)}/store-{uuid.uuid4().hex}", version)


#: The returns' SQL over the newest versions known by AS_OF.
_KNOWN = f"bv AS ({VIEWS['bar_versions']}), kb AS (SELECT symbol, bar_date, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, bar_date ORDER BY knowledge_date DESC) AS v FROM bv WHERE knowledge_date <= DATE '{AS_OF}') WHERE v = 1), kl AS (SELECT * FROM levels WHERE knowledge_date <= DATE '{AS_OF}'), m AS (SELECT b.symbol"
_RECOMPUTED = reads.CATALOG.sql["total_return"].replace("m AS (SELECT b.symbol", _KNOWN).replace("FROM bars b LEFT JOIN levels fx", "FROM kb b LEFT JOIN kl fx").replace("LEFT JOIN levels cpi", "LEFT JOIN kl cpi").replace("CASE WHEN day(b.bar_date) <= 7 THEN 0.01 ELSE 0 END AS y", "0 AS y")


@add("returns_recomputed", _RECOMPUTED)
def returns_recomputed(t: Tables):
    """Returns landed early, and computed anew once later versions of the bars are known."""
    store = _store(t)
    store.append("prices", t.bar_versions())
    store.append("factors", t.factor_levels())
    runs.build_returns(store, as_of="1997-06-30", fx="FX", cpi="RATE")
    return runs.build_returns(store, as_of=AS_OF, fx="FX", cpi="RATE").drop("knowledge_date").select("symbol", "bar_date", "ret_nominal_try", "ret_usd", "ret_real_try", "limit_lock_adj")


@add("schema_steps", "SELECT concat('S', s_suppkey) AS uuid, s_name AS name, CAST(NULL AS VARCHAR) AS listing_status FROM supplier UNION ALL SELECT concat('C', c_custkey), c_name, CASE WHEN c_custkey % 2 = 0 THEN 'listed' ELSE 'private' END FROM customer")
def schema_steps(t: Tables):
    """Companies stored before a column was there, read together with later ones."""
    old = _store(t, 1)
    old.append("company", t.read("supplier").selectExpr("concat('S', s_suppkey) as uuid", "s_name as name"))
    new = Store(t.spark, old.root)
    new.append("company", t.read("customer").selectExpr("concat('C', c_custkey) as uuid", "c_name as name", "if(c_custkey % 2 = 0, 'listed', 'private') as listing_status"))
    new.migrate()
    return new.read("company").select("uuid", "name", "listing_status")


@add("member_snapshots", "SELECT CAST(day AS DATE) AS asked, concat('o', s_suppkey) AS code, concat(s_name, v) AS name, CAST(taken AS DATE) AS knowledge_date FROM supplier, (VALUES ('2024-03-01', ' 1', '2024-03-01'), ('2024-03-08', ' 1', '2024-03-01'), ('2024-03-09', ' 2', '2024-03-09')) AS d(day, v, taken)")
def member_snapshots(t: Tables):
    """The list on three days; within a week it is not fetched again."""
    store, times, out = _store(t), iter(("1", "2", "3")), None
    fetch = lambda: t.read("supplier").selectExpr("concat('o', s_suppkey) as code", f"concat(s_name, ' {next(times)}') as name", "concat('T', s_suppkey) as ticker")
    for day in ("2024-03-01", "2024-03-08", "2024-03-09"):
        one = members.members(store, as_of=day, fetch=fetch).select(F.lit(day).cast("date").alias("asked"), "code", "name", "knowledge_date")
        out = one if out is None else out.unionByName(one)
    return out


@add("onboarding_runs", "SELECT concat('T', s_suppkey) AS symbol, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 1 WHEN s_suppkey % 2 = 0 THEN 2 ELSE 3 END AS INTEGER) AS n_done, CASE WHEN s_suppkey % 3 = 0 THEN 'sector' WHEN s_suppkey % 2 = 0 THEN 'refit' END AS next_step, s_suppkey % 3 <> 0 AND s_suppkey % 2 <> 0 AS complete FROM supplier")
def onboarding_runs(t: Tables):
    """A run that breaks in its second step, and the run after it."""
    store, broken = _store(t), [True]
    k = F.substring("symbol", 2, 20).cast("long")

    def sector(store, waiting):
        if broken.pop() if broken else False:
            raise ValueError("no sectors today")
        return waiting.where(k % 3 != 0)

    steps = [("identity", lambda store, waiting: waiting), ("sector", sector), ("refit", lambda store, waiting: waiting.where(k % 2 != 0))]
    symbols = t.read("supplier").selectExpr("concat('T', s_suppkey) as symbol")
    onboarding.run(store, symbols, steps, as_of="2024-01-01")
    return onboarding.run(store, symbols, steps, as_of="2024-01-02").drop("detail")


_OUTCOME = "CASE WHEN l_orderkey % 50 = 0 THEN 'absent' WHEN l_orderkey % 50 = 1 AND l_linenumber % 3 = 0 THEN 'unreachable' ELSE 'found' END"


@add("feed_account", f"WITH p AS (SELECT l_returnflag AS source, l_orderkey AS request, count(*) FILTER ({_OUTCOME} = 'found') AS pages, bool_or({_OUTCOME} = 'unreachable') AS lost, bool_or({_OUTCOME} = 'absent') AS gap, bool_or(l_linenumber = 7) AS capped FROM lineitem GROUP BY 1, 2) SELECT source, count(*) AS n_requests, count(*) FILTER (NOT lost AND pages > 0) AS n_found, count(*) FILTER (NOT lost AND pages = 0 AND gap) AS n_absent, count(*) FILTER (lost) AS n_unreachable, CAST(sum(pages) AS BIGINT) AS n_pages, count(*) FILTER (capped) AS n_capped FROM p GROUP BY source")
def feed_account(t: Tables):
    """Orders as requests, their lines as pages."""
    feed = t.read("lineitem").selectExpr("l_returnflag as source", "cast(l_orderkey as string) as request", "l_linenumber - 1 as page", f"{_OUTCOME} as outcome", "if(l_linenumber = 7, 'most', null) as ended")
    return adapter.account(feed)


_EXPORT = f"{_CODES}, x AS (SELECT concat('T', p_partkey % 40) AS ticker, CASE WHEN p_partkey % 7 = 0 THEN concat('US', substr(isin, 3)) ELSE isin END AS isin, p_partkey % 5 < 3 AS privileged, CASE WHEN p_partkey % 7 = 0 THEN 'foreign' WHEN NOT ok THEN 'malformed' WHEN p_partkey % 3 = 2 THEN 'non-equity' ELSE 'counts' END AS reason FROM checked)"


def _export(t: Tables):
    code = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("us"), F.substring("isin", 3, 20))).otherwise(F.lower("isin"))
    return _isins(t).select(F.expr("concat(' t', p_partkey % 40)").alias("ticker"), code.alias("isin"), F.expr("if(p_partkey % 5 < 3, 'B Grubu imtiyazlı pay', 'Adi pay')").alias("description"))


@add("isin_import", f"WITH {_EXPORT}, g AS (SELECT ticker, count(*) AS n, count(*) FILTER (NOT privileged) AS traded, min(isin) AS one, min(isin) FILTER (NOT privileged) AS common, string_agg(isin, ',' ORDER BY isin) AS candidates FROM x WHERE reason = 'counts' GROUP BY ticker) SELECT ticker, CASE WHEN n = 1 THEN one WHEN traded = 1 THEN common END AS isin, CASE WHEN n = 1 THEN 'single' WHEN traded = 1 THEN 'unique-after-exclude' ELSE 'ambiguous' END AS status, candidates FROM g")
def isin_import(t: Tables):
    return reference.imported_isins(_export(t))[0].withColumn("candidates", F.array_join("candidates", ","))


@add("isin_import_refused", f"WITH {_EXPORT} SELECT DISTINCT ticker, isin, reason FROM x WHERE reason <> 'counts'")
def isin_import_refused(t: Tables):
    return reference.imported_isins(_export(t))[1]


@add("custody_sets", "WITH s AS (SELECT to_base(s_suppkey % 40000, 36, 3) AS code, s_name AS name, s_suppkey % 6 AS k FROM supplier) SELECT 'custody' AS bucket, code, name FROM s WHERE k % 3 = 0 UNION ALL SELECT 'execution', code, name FROM s WHERE k % 3 = 1 UNION ALL SELECT 'domestic', code, name FROM s WHERE k % 3 = 2 OR k = 1")
def custody_sets(t: Tables):
    """The three maps of a reference document, checked as a whole; brokers may be domestic as well. Codes are used again after 40,000 suppliers, in the next edition."""
    s = t.read("supplier").selectExpr("s_suppkey div 40000 as edition", "lpad(conv(s_suppkey % 40000, 10, 36), 3, '0') as code", "s_name as name", "s_suppkey % 6 as k")
    codes = lambda held: F.struct(F.map_from_entries(F.collect_list(F.when(F.expr(held), F.struct("code", "name")))).alias("codes"))
    doc = s.groupBy("edition").agg(F.lit(1).alias("schema_version"), F.lit("register").alias("source"), F.lit("2026-01-01").alias("fetched_iso"), codes("k % 3 = 0").alias("foreign_custody_members"), codes("k % 3 = 1").alias("foreign_execution_brokers"), codes("k % 3 = 2 or k = 1").alias("domestic_despite_foreign_parent"))
    return reference.custody(doc.select("edition", F.to_json(F.struct(*doc.drop("edition").columns)).alias("payload")), "edition").select("bucket", "code", "name")


@add("board_interlocks", "WITH s AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS c FROM lineitem) SELECT x.c AS a, y.c AS b, count(*) AS n_people FROM s x JOIN s y ON x.p = y.p AND x.c < y.c GROUP BY 1, 2")
def board_interlocks(t: Tables):
    """Parts as people, on the boards of all who deliver them."""
    return graph.interlocks(t.read("lineitem").selectExpr("l_partkey as src", "l_suppkey as dst"))


@add("board_seats", "SELECT DISTINCT ON (src, dst) src, dst, role, since FROM (SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS role, CAST(l_shipdate AS DATE) AS since FROM lineitem WHERE l_partkey % 10 <> 0 AND l_suppkey % 10 <> 0) ORDER BY src, dst, since, role")
def board_seats(t: Tables):
    rows = t.read("lineitem").selectExpr("l_partkey as src", "l_suppkey as dst", "l_returnflag as role", "to_date(l_shipdate) as since")
    return graph.board_seats(rows, t.read("part").where("p_partkey % 10 != 0").selectExpr("p_partkey as uuid"), t.read("supplier").where("s_suppkey % 10 != 0").selectExpr("s_suppkey as uuid"))


#: Suppliers as companies, nations as sectors within regions, customers as people; the second load has other properties for every third pair.
_LOADED = """
    SELECT 'subsector_of' AS kind, concat('n', n_nationkey) AS src, concat('r', n_regionkey) AS dst, '' AS said FROM nation
    UNION ALL SELECT 'in_sector', concat('s', s_suppkey), concat('n', s_nationkey), 'register' FROM supplier
    UNION ALL SELECT 'holds_stake', concat('s', s_suppkey // 2), concat('s', s_suppkey), CASE WHEN s_suppkey % 3 = 0 THEN '2 second' ELSE '1 first' END FROM supplier WHERE s_suppkey > 1
    UNION ALL SELECT 'holds_stake', concat('c', c_custkey), concat('s', c_custkey), '1 first' FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier)
    UNION ALL SELECT 'controls', concat('s', s_suppkey // 2), concat('s', s_suppkey), 'votes' FROM supplier WHERE s_suppkey > 1
    UNION ALL SELECT 'board_member_of', concat('c', c_custkey), concat('s', c_custkey), 'chair' FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier)
"""


@add("graph_load", _LOADED)
def graph_load(t: Tables):
    """Everything stored by two loads of typed edges; those to nobody are left out."""
    store = _store(t)
    s, c = t.read("supplier"), t.read("customer")
    sectors = t.read("region").selectExpr("concat('r', r_regionkey) as code", "r_name as name", "1 as level", "cast(null as string) as parent").unionByName(t.read("nation").selectExpr("concat('n', n_nationkey) as code", "n_name as name", "2 as level", "concat('r', n_regionkey) as parent"))
    graphload.load_sectors(store, sectors)
    held = s.where("s_suppkey > 1").selectExpr("concat('s', s_suppkey div 2) as src", "concat('s', s_suppkey) as dst", "'Company' as label", "1D as pct", "'first' as source", "s_suppkey as k")
    seats = c.selectExpr("concat('c', c_custkey) as src", "concat('s', c_custkey) as dst")
    graphload.load_all(
        store,
        {"company": s.selectExpr("concat('s', s_suppkey) as uuid", "s_name as name"), "person": c.selectExpr("concat('c', c_custkey) as uuid", "c_name as name")},
        {"in_sector": s.selectExpr("concat('s', s_suppkey) as src", "concat('n', s_nationkey) as dst", "'register' as source"), "holds_stake": held.drop("k").unionByName(seats.selectExpr("src", "dst", "'Person' as label", "1D as pct", "'first' as source")), "controls": held.selectExpr("src", "dst", "'votes' as basis"), "board_member_of": seats.withColumn("role", F.lit("chair"))},
    )
    graphload.load_edges(store, "holds_stake", held.where("k % 3 = 0").withColumn("pct", F.lit(2.0)).withColumn("source", F.lit("second")))
    said = {"subsector_of": F.lit(""), "in_sector": F.col("source"), "holds_stake": F.concat(F.col("pct").cast("int"), F.lit(" "), "source"), "controls": F.col("basis"), "board_member_of": F.col("role")}
    out = None
    for kind, column in said.items():
        one = store.read(kind).select(F.lit(kind).alias("kind"), "src", "dst", column.alias("said"))
        out = one if out is None else out.unionByName(one)
    return out


@add("land_series", "SELECT factor, count(*) AS n, min(bar_date) AS first, max(bar_date) AS last, max(knowledge_date) AS known FROM (SELECT DISTINCT 'CPI' AS factor, CAST(date_trunc('month', o_orderdate) AS DATE) AS bar_date, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) + 2 AS knowledge_date FROM orders UNION ALL SELECT DISTINCT 'VIX', CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT DISTINCT 'CDS', CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) FROM orders WHERE o_orderdate >= DATE '1997-01-01') GROUP BY factor")
def land_series(t: Tables):
    """Three kinds of series landed, and landed again: what the store has of each."""
    store, o = _store(t), t.read("orders")
    cpi = F.struct(F.date_format("o_orderdate", "yyyy-M").alias("Tarih"), F.lit("1.5").alias("TP_FG_J0"))
    vix = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(F.col("o_orderkey") % 7 == 0, ".").otherwise("19.5").alias("value"))
    cds = F.struct(F.create_map(F.lit("1"), F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("DATA_VAL"), F.lit(3.0).alias("CLOSE_VAL"))).alias("quote"))
    payload = lambda name, x: o.select(F.to_json(F.struct(x.alias(name))).alias("payload"))
    rows = landing.cpi_rows(payload("items", F.array(cpi))).unionByName(landing.macro_rows(payload("observations", F.array(vix)), "VIX")).unionByName(landing.rate_rows(payload("result", cds), "CDS", start="1997-01-01"))
    for _ in range(2):
        landing.land_series(store, rows)
    return store.read("factors").groupBy("factor").agg(F.count("*").alias("n"), F.min("bar_date").alias("first"), F.max("bar_date").alias("last"), F.max("knowledge_date").alias("known"))


@add("parent_map", "SELECT dst AS child, src AS parent FROM controls WHERE src > 0 UNION SELECT s_suppkey, s_suppkey // 3 FROM supplier WHERE s_suppkey > 2", "controls")
def parent_map(t: Tables):
    return graph.parents(t.controls(), t.read("supplier").where("s_suppkey > 2").selectExpr("s_suppkey as src", "s_suppkey div 3 as dst"))


@add("signal_panels", f"WITH k AS (SELECT symbol FROM returns WHERE ret IS NOT NULL GROUP BY symbol HAVING count(*) >= 60), g AS (SELECT symbol, bar_date FROM k, (SELECT DISTINCT bar_date FROM returns WHERE ret IS NOT NULL AND symbol IN (SELECT symbol FROM k))) SELECT g.symbol, g.bar_date, {r('x.ret')} AS x, {r('CASE WHEN month(g.bar_date) % 2 = 1 THEN x.ret * 2 ELSE x.ret END')} AS ret, CASE WHEN x.symbol IS NOT NULL THEN month(g.bar_date) % 2 = 1 END AS is_limit_lock, CASE WHEN day(g.bar_date) <= 7 THEN day(g.bar_date) % 2 = 0 END AS short_eligible FROM g LEFT JOIN (SELECT * FROM returns WHERE ret IS NOT NULL) x ON x.symbol = g.symbol AND x.bar_date = g.bar_date", "returns")
def signal_panels(t: Tables):
    """Returns of odd months come twice, the second time threefold and locked; short eligibility is known for the first week of a month."""
    own = t.returns().where("ret is not null")
    rets = own.selectExpr("symbol", "bar_date", "ret", "false as limit_lock_adj").unionByName(own.where("month(bar_date) % 2 = 1").selectExpr("symbol", "bar_date", "ret * 3 as ret", "true as limit_lock_adj"))
    days = own.select("bar_date").distinct().where("day(bar_date) <= 7")
    shorts = own.select("symbol").distinct().join(F.broadcast(days.agg(F.collect_set("bar_date").alias("d")))).select("symbol", F.explode("d").alias("bar_date")).withColumn("short_eligible", F.day("bar_date") % 2 == 0)  # days are few
    return books.signal_panels(network.panel(own.withColumnRenamed("ret", "residual"), "residual", 60), rets, shorts)


@add("exposure_panels", f"WITH {graphs._BETAS}, m AS (SELECT channel, symbol, bar_date, CASE WHEN day(bar_date) <= 15 THEN beta * 2 ELSE beta END AS beta FROM bt), g AS (SELECT channel, symbol, bar_date FROM (SELECT DISTINCT channel, symbol FROM m), (SELECT DISTINCT bar_date FROM bars WHERE month(bar_date) <= 6)) SELECT g.channel, g.symbol, g.bar_date, {r('m.beta')} AS beta FROM g LEFT JOIN m ON m.channel = g.channel AND m.symbol = g.symbol AND m.bar_date = g.bar_date", "returns market")
def exposure_panels(t: Tables):
    """Betas of the first half of a month come twice, the second time threefold; the days asked for are those of the years' first halves. No factor stands for energy."""
    b = graphs._betas(t)
    twice = b.unionByName(b.where("day(bar_date) <= 15").withColumn("beta", F.col("beta") * 3))
    return events.exposure_panels(twice, {"market": "XU100", "fx": "USDTRY", "energy": "BRENT"}, t.bars().where("month(bar_date) <= 6").select("bar_date"))


@add("type_stress", f"WITH {graphs._BETAS}, {graphs._NEWS}, {graphs._PRIOR}, ty AS (SELECT event_type, count(*) AS n_events, coalesce(avg(severity), 1.0) AS mean_severity FROM ev GROUP BY event_type), shk AS (SELECT event_type AS scenario, channel, shock_sign * mean_severity AS shock FROM ty JOIN pr USING (event_type)), us AS (SELECT * FROM shk WHERE scenario IN (SELECT scenario FROM shk WHERE channel IN (SELECT channel FROM ex))), nn AS (SELECT scenario, count(*) AS n FROM us GROUP BY scenario), rp AS (SELECT nn.scenario, s.symbol, coalesce(sum(ex.beta * us.shock), 0) AS pnl, count(ex.beta) / any_value(nn.n) AS coverage FROM nn CROSS JOIN (SELECT DISTINCT symbol FROM ex) s JOIN us ON us.scenario = nn.scenario LEFT JOIN ex ON ex.symbol = s.symbol AND ex.channel = us.channel GROUP BY nn.scenario, s.symbol) SELECT scenario AS event_type, any_value(n_events) AS n_events, {r('any_value(mean_severity)')} AS mean_severity, count(*) AS n, {r('avg(pnl)')} AS mean_pnl, {r('min(pnl)')} AS worst, {r('max(pnl)')} AS best, {r('avg(coverage)')} AS mean_coverage FROM rp JOIN ty ON event_type = scenario GROUP BY scenario", "returns market")
def type_stress(t: Tables):
    return risk.type_stress(risk.exposures(graphs._betas(t)), events.events(graphs._typed(t)))


@add("relation_documents", f"SELECT concat('P', l_suppkey) AS parent, concat('C', l_partkey) AS child, {r('arg_max(l_quantity, l_orderkey * 10 + l_linenumber)')} AS pct FROM lineitem GROUP BY 1, 2")
def relation_documents(t: Tables):
    """A document of relations for each supplier; of a pair that is listed twice the last one counts."""
    item = F.struct(F.struct("l_orderkey", "l_linenumber").alias("at"), F.struct(F.concat(F.lit("P"), "l_suppkey").alias("parent"), F.concat(F.lit("C"), "l_partkey").alias("child"), F.col("l_quantity").cast("double").alias("pct")).alias("r"))
    listed = t.read("lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(item)).alias("items")).select(F.to_json(F.struct(F.transform("items", lambda x: x["r"]).alias("relations"))).alias("payload"))
    return reference.newest_relations(parsers.relations(listed)).select("parent", "child", "pct")
