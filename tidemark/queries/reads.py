"""Point-in-time reads, identifiers, returns and flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import factors, pit, returns
from ..views import Tables
from .base import AS_OF, Catalog, r

CATALOG = Catalog()
add = CATALOG.add


@add("pit_series", f"SELECT symbol, bar_date, close, knowledge_date FROM bar_versions WHERE knowledge_date <= DATE '{AS_OF}'", "bar_versions")
def pit_series(t: Tables):
    return pit.PitReader(AS_OF, {"prices": t.bar_versions()}.__getitem__).table("prices", columns=["symbol", "bar_date", "close", "knowledge_date"])


@add("pit_latest_by", f"SELECT symbol, bar_date, close, knowledge_date FROM bar_versions WHERE knowledge_date <= DATE '{AS_OF}' AND bar_date = (SELECT max(bar_date) FROM bar_versions WHERE knowledge_date <= DATE '{AS_OF}')", "bar_versions")
def pit_latest_by(t: Tables):
    return pit.PitReader(AS_OF, {"prices": t.bar_versions()}.__getitem__).table("prices", columns=["symbol", "bar_date", "close", "knowledge_date"], newest="bar_date")


@add("pit_distinct_symbols", f"SELECT DISTINCT symbol FROM bar_versions WHERE knowledge_date <= DATE '{AS_OF}'", "bar_versions")
def pit_distinct_symbols(t: Tables):
    return pit.PitReader(AS_OF, {"prices": t.bar_versions()}.__getitem__).table("prices", columns=["symbol"], distinct=True)


@add("pit_latest_version", f"SELECT symbol, bar_date, close, quantity, volume_try, knowledge_date FROM (SELECT *, row_number() OVER (PARTITION BY symbol, bar_date ORDER BY knowledge_date DESC) AS n FROM bar_versions WHERE knowledge_date <= DATE '{AS_OF}') WHERE n = 1", "bar_versions")
def pit_latest_version(t: Tables):
    return pit.latest_version(pit.visible(t.bar_versions(), AS_OF), "symbol", "bar_date")


@add("universe_asof", f"SELECT DISTINCT universe, symbol FROM (SELECT *, row_number() OVER (PARTITION BY symbol, universe, valid_from ORDER BY knowledge_date DESC) AS n FROM memberships WHERE knowledge_date <= DATE '{AS_OF}') WHERE n = 1 AND valid_from <= DATE '{AS_OF}' AND (valid_to IS NULL OR valid_to >= DATE '{AS_OF}')", "memberships")
def universe_asof(t: Tables):
    return pit.members(t.memberships(), AS_OF)


@add("idempotent_append", "SELECT symbol, bar_date, min(close) AS close, knowledge_date FROM bar_versions WHERE knowledge_date <> bar_date + 7 GROUP BY symbol, bar_date, knowledge_date", "bar_versions")
def idempotent_append(t: Tables):
    all_ = t.bar_versions().select("symbol", "bar_date", "close", "knowledge_date")
    stored = all_.where("knowledge_date = date_add(bar_date, 7)")
    return pit.append_new(stored, all_.unionByName(all_), ["symbol", "bar_date", "knowledge_date"])


def companies(t: Tables):
    """Customers with a code that some share, and one that not all have."""
    return t.read("customer").selectExpr("c_custkey as uuid", "c_name as name", "concat('K', c_custkey div 2 * 2 + if(c_custkey % 10 = 0, 1, c_custkey % 2)) as code", "if(c_nationkey % 5 = 0, null, concat('L', c_custkey)) as lei")


_COMPANIES = "companies AS (SELECT c_custkey AS uuid, c_name AS name, concat('K', c_custkey // 2 * 2 + CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE c_custkey % 2 END) AS code, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE concat('L', c_custkey) END AS lei FROM customer), legs AS (SELECT uuid, 'name' AS field, name AS value FROM companies UNION ALL SELECT uuid, 'code', code FROM companies UNION ALL SELECT uuid, 'lei', lei FROM companies WHERE lei IS NOT NULL)"


@add("id_resolve", f"WITH {_COMPANIES}, wanted AS (SELECT DISTINCT concat('K', o_custkey) AS value FROM orders), known AS (SELECT value, count(DISTINCT uuid) AS n, min(uuid) AS uuid FROM legs GROUP BY value) SELECT wanted.value, CASE WHEN n = 1 THEN uuid END AS uuid, CASE WHEN n IS NULL THEN 'unknown' WHEN n = 1 THEN 'found' ELSE 'refused' END AS status FROM wanted LEFT JOIN known USING (value)")
def id_resolve(t: Tables):
    return pit.resolve(companies(t), t.read("orders").selectExpr("concat('K', o_custkey) as value"), "uuid", ["name", "code", "lei"])


@add("id_round_trip", f"WITH {_COMPANIES}, owners AS (SELECT field, value, count(DISTINCT uuid) AS n FROM legs GROUP BY field, value) SELECT uuid, bool_and(n = 1) AS ok FROM legs JOIN owners USING (field, value) GROUP BY uuid")
def id_round_trip(t: Tables):
    return pit.round_trip(companies(t), "uuid", ["name", "code", "lei"])


@add("id_collisions", f"WITH {_COMPANIES} SELECT field, value, count(DISTINCT uuid) AS n_companies FROM legs GROUP BY field, value HAVING count(DISTINCT uuid) > 1")
def id_collisions(t: Tables):
    return pit.collisions(companies(t), "uuid", ["name", "code", "lei"])


@add("provenance_check", "SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'confidence' END, CASE WHEN c_nationkey = 0 THEN 'source' END) AS lacking FROM customer WHERE c_acctbal < 0 OR c_nationkey = 0")
def provenance_check(t: Tables):
    df = t.read("customer").selectExpr("c_custkey", "if(c_acctbal < 0, null, 0.5) as confidence", "if(c_nationkey = 0, null, 'crm') as source")
    return pit.incomplete(df, ["confidence", "source"]).select("c_custkey", "lacking")


@add("factor_coverage", "SELECT column0 AS factor, EXISTS (SELECT 1 FROM levels WHERE factor = column0) AS present FROM (VALUES ('MKT'), ('FX'), ('RATE'), ('GOLD')) v(column0)", "levels")
def factor_coverage(t: Tables):
    return pit.coverage(t.spark.createDataFrame([("MKT",), ("FX",), ("RATE",), ("GOLD",)], "factor string"), t.factor_levels(), "factor")


@add("liquid_universe", "SELECT symbol, count(ret) AS n_obs FROM returns GROUP BY symbol ORDER BY n_obs DESC, symbol LIMIT 10", "returns")
def liquid_universe(t: Tables):
    return pit.most_covered(t.returns(), "ret", 10)


@add("simple_return", f"SELECT symbol, bar_date, {r('close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_date) - 1')} AS ret FROM bars", "bars")
def simple_return(t: Tables):
    return t.bars().select("symbol", "bar_date", returns.change("close").alias("ret"))


_LAGGED = "lag(value) OVER (PARTITION BY factor ORDER BY bar_date)"


@add("factor_returns", f"SELECT factor, bar_date, knowledge_date, CASE factor WHEN 'MKT' THEN {r(f'value / {_LAGGED} - 1')} WHEN 'FX' THEN {r(f'ln(value / {_LAGGED})')} ELSE {r(f'value - {_LAGGED}')} END AS ret FROM levels", "levels")
def factor_returns(t: Tables):
    return factors.factor_returns(t.factor_levels(), {"MKT": "simple", "FX": "log", "RATE": "diff"})


@add("factor_level_method", f"SELECT factor, bar_date, knowledge_date, {r('value')} AS ret FROM levels WHERE factor = 'RATE'", "levels")
def factor_level_method(t: Tables):
    return factors.factor_returns(t.factor_levels(), {"RATE": "level"})


_LOCKED = "locked AS (SELECT symbol, bar_date, close, coalesce(abs(abs(close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_date) - 1) - 0.10) <= 0.03, false) AS is_limit_lock FROM bars)"


@add("limit_lock_flag", f"WITH {_LOCKED} SELECT symbol, bar_date, close, is_limit_lock FROM locked", "bars")
def limit_lock_flag(t: Tables):
    return returns.limit_locks(t.bars().select("symbol", "bar_date", "close"), tolerance=0.03)


_CENSOR = f"""WITH {_LOCKED},
    moved AS (SELECT symbol, bar_date, is_limit_lock, close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_date) - 1 AS ret FROM locked),
    runs AS (SELECT *, coalesce(sum(CASE WHEN is_limit_lock THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM moved),
    whole AS (SELECT symbol, run, bool_or(is_limit_lock) AS touched, CASE WHEN count(ret) = count(*) THEN product(1 + ret) - 1 END AS total FROM runs GROUP BY symbol, run)"""


@add("censor_windows", f"{_CENSOR} SELECT runs.symbol, bar_date, is_limit_lock, {r('CASE WHEN is_limit_lock THEN NULL WHEN touched THEN total ELSE ret END')} AS ret, touched AS limit_lock_adj FROM runs JOIN whole USING (symbol, run)", "bars")
def censor_windows(t: Tables):
    df = returns.limit_locks(t.bars().select("symbol", "bar_date", "close"), tolerance=0.03)
    return returns.censor(df.select("symbol", "bar_date", "is_limit_lock", returns.change("close").alias("ret")), ["ret"])


@add("staleness", "SELECT symbol, bar_date, traded, coalesce(traded = 0, true) AS is_stale FROM (SELECT symbol, bar_date, CASE WHEN quantity < 100 THEN 0 WHEN quantity < 150 THEN NULL ELSE quantity END AS traded FROM bars)", "bars")
def staleness(t: Tables):
    return returns.stale(t.bars().selectExpr("symbol", "bar_date", "case when quantity < 100 then 0 when quantity < 150 then null else quantity end as traded"), "traded")


@add("dividend_yield", f"SELECT symbol, bar_date, {r('close * 0.01 / close')} AS yield FROM bars WHERE day(bar_date) <= 7", "bars")
def dividend_yield(t: Tables):
    bars = t.bars()
    return returns.dividend_yields(bars.where("day(bar_date) <= 7").selectExpr("symbol", "bar_date", "close * 0.01 as cash"), bars)[0]


@add("dividend_refused", f"SELECT symbol, bar_date, {r('close * 0.01')} AS cash FROM bars WHERE day(bar_date) <= 7 AND quantity < 100", "bars")
def dividend_refused(t: Tables):
    bars = t.bars()
    return returns.dividend_yields(bars.where("day(bar_date) <= 7").selectExpr("symbol", "bar_date", "close * 0.01 as cash"), bars.where("quantity >= 100"))[1]


@add("total_return", f"""WITH m AS (SELECT b.symbol, b.bar_date, b.close, fx.value AS fx, cpi.value AS cpi, CASE WHEN day(b.bar_date) <= 7 THEN 0.01 ELSE 0 END AS y,
        coalesce(abs(abs(close / lag(close) OVER w - 1) - 0.10) <= 0.003, false) AS locked, row_number() OVER w AS n
        FROM bars b LEFT JOIN levels fx ON fx.bar_date = b.bar_date AND fx.factor = 'FX' LEFT JOIN levels cpi ON cpi.bar_date = b.bar_date AND cpi.factor = 'RATE' WINDOW w AS (PARTITION BY b.symbol ORDER BY b.bar_date)),
    k AS (SELECT symbol, bar_date, locked, n, close / lag(close) OVER w - 1 + y AS nominal, (close / fx) / lag(close / fx) OVER w - 1 + y AS usd, (close / lag(close) OVER w + y) / (cpi / lag(cpi) OVER w) - 1 AS real_, coalesce(sum(CASE WHEN locked THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM m WINDOW w AS (PARTITION BY symbol ORDER BY bar_date)),
    g AS (SELECT symbol, run, bool_or(locked) AS touched, CASE WHEN count(nominal) = count(*) THEN product(1 + nominal) - 1 END AS tn, CASE WHEN count(usd) = count(*) THEN product(1 + usd) - 1 END AS tu, CASE WHEN count(real_) = count(*) THEN product(1 + real_) - 1 END AS tr FROM k GROUP BY symbol, run)
    SELECT k.symbol, bar_date, {r('CASE WHEN locked THEN NULL WHEN touched THEN tn ELSE nominal END')} AS ret_nominal_try, {r('CASE WHEN locked THEN NULL WHEN touched THEN tu ELSE usd END')} AS ret_usd, {r('CASE WHEN locked THEN NULL WHEN touched THEN tr ELSE real_ END')} AS ret_real_try, touched AS limit_lock_adj FROM k JOIN g USING (symbol, run) WHERE n > 1""", "levels")
def total_return(t: Tables):
    bars, levels = t.bars(), t.factor_levels()
    yields = bars.where("day(bar_date) <= 7").selectExpr("symbol", "bar_date", "0.01D as yield")
    return returns.total_returns(bars, levels.where("factor = 'FX'"), levels.where("factor = 'RATE'"), yields)


_REGIME = "CASE WHEN {0} <= 2022 THEN 'nominal_pre2023' WHEN {0} <= 2024 THEN 'ias29_2023_2024' ELSE 'suspended_2025_2027' END"


@add("accounting_regime", f"SELECT o_orderkey, strftime(o_orderdate + INTERVAL 26 YEAR, '%Y%m') AS period, {_REGIME.format('(year(o_orderdate) + 26)')} AS regime FROM orders")
def accounting_regime(t: Tables):
    df = t.read("orders").selectExpr("o_orderkey", "date_format(add_months(o_orderdate, 312), 'yyyyMM') as period")
    return df.withColumn("regime", returns.accounting_regime(F.col("period")))


@add("guarded_growth", f"""WITH y AS (SELECT o_custkey, year(o_orderdate) + 26 AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY 1, 2),
    b AS (SELECT a.o_custkey, a.y, a.v, p.v AS base, {_REGIME.format('a.y')} <> {_REGIME.format('(a.y - 1)')} AS straddles FROM y a JOIN y p ON a.o_custkey = p.o_custkey AND p.y = a.y - 1)
    SELECT o_custkey, CAST(y AS VARCHAR) AS period, CASE WHEN straddles THEN 'straddle' WHEN base = 0 THEN 'zero_base' ELSE 'ok' END AS status, CASE WHEN NOT straddles AND base <> 0 THEN {r('v / base - 1')} END AS growth FROM b""")
def guarded_growth(t: Tables):
    y = t.read("orders").groupBy("o_custkey", (F.year("o_orderdate") + 26).alias("y")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))
    both = y.join(y.select("o_custkey", (F.col("y") + 1).alias("y"), F.col("v").alias("base"), F.col("y").cast("string").alias("base_period")), ["o_custkey", "y"]).withColumn("period", F.col("y").cast("string"))
    return returns.guarded_growth(both, "v", "period", "base", "base_period").select("o_custkey", "period", "status", "growth")


@add("asof_by_knowledge", f"SELECT d.bar_date, {r('m.ret')} AS ret FROM (SELECT DISTINCT bar_date FROM bars) d ASOF LEFT JOIN monthly m ON d.bar_date >= m.knowledge_date", "bars monthly")
def asof_by_knowledge(t: Tables):
    return factors.align_by_knowledge(t.monthly_factor(), t.bars())


_BREAKS = (("1996-03-01", "first"), ("1998-08-10", "second"), ("2000-01-01", "third"))


@add("regime_label", "SELECT o_orderkey, CASE WHEN o_orderdate >= DATE '2000-01-01' THEN 'third' WHEN o_orderdate >= DATE '1998-08-10' THEN 'second' WHEN o_orderdate >= DATE '1996-03-01' THEN 'first' ELSE 'base' END AS regime FROM orders")
def regime_label(t: Tables):
    return t.read("orders").select("o_orderkey", factors.regime(F.to_date("o_orderdate"), _BREAKS, "base").alias("regime"))


@add("factor_panel", f"SELECT bar_date, max(CASE WHEN factor = 'MKT' THEN {r('value')} END) AS MKT, max(CASE WHEN factor = 'FX' THEN {r('value')} END) AS FX, max(CASE WHEN factor = 'RATE' THEN {r('value')} END) AS RATE FROM levels GROUP BY bar_date", "levels")
def factor_panel(t: Tables):
    return factors.factor_panel(t.factor_levels().withColumnRenamed("value", "ret"), ["MKT", "FX", "RATE"])
