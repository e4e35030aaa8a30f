"""Registration of queries, and the domain frames in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..views import Tables, fixed

Query = Callable[[SparkSession, str], DataFrame]
#: Reads are made as of this day.
AS_OF = "1999-06-30"
DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to DIGITS digits, so that orders of addition do not show."""
    return df.select(*(fixed(F.col(f"`{c}`"), DIGITS).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


class Catalog:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, views: str = ""):
        def register(build: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, folder: rounded(build(Tables(spark, folder)))
            if sql:
                self.sql[name] = with_views(views, sql)
            return build

        return register


def r(x: str) -> str:
    """SQL: rounded as ``rounded`` does, the same in all engines."""
    return f"(floor(({x}) * 1e{DIGITS} + 0.5) / 1e{DIGITS})"


def with_views(names: str, sql: str) -> str:
    """sql after the named views and those they need; sql may begin with more of its own."""
    wanted: list[str] = []

    def need(n: str) -> None:
        for x in NEEDS.get(n, ()):
            need(x)
        if n not in wanted:
            wanted.append(n)

    for n in names.split():
        need(n)
    if not wanted:
        return sql
    recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
    sql = sql.strip()
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    for lead in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(lead):
            return f"WITH {recursive}{head},\n{sql[len(lead):]}"
    return f"WITH {recursive}{head}\n{sql}"


_MONEY = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"


def _bars(where: str, lag: int) -> str:
    price, quantity = _MONEY.format("l_extendedprice"), _MONEY.format("l_quantity")
    return f"SELECT p_brand AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS bar_date, floor({price} / {quantity} * 1e6 + 0.5) / 1e6 AS close, {quantity} AS quantity, {price} AS volume_try, CAST(date_trunc('week', l_shipdate) AS DATE) + {lag} AS knowledge_date FROM lineitem JOIN part ON l_partkey = p_partkey {where} GROUP BY p_brand, CAST(date_trunc('week', l_shipdate) AS DATE)"


VIEWS = {
    "bars": _bars("", 7),
    "bar_versions": f"{_bars('WHERE l_linenumber <= 3', 7)} UNION ALL {_bars('', 28)}",
    "sectors": "SELECT DISTINCT p_brand AS symbol, substr(p_brand, 1, 7) AS sector FROM part",
    "returns": "SELECT symbol, bar_date, floor((close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_date) - 1) * 1e9 + 0.5) / 1e9 AS ret FROM bars",
    "levels": "SELECT *, bar_date + 7 AS knowledge_date FROM (SELECT 'MKT' AS factor, bar_date, floor(CAST(sum(CAST(close AS DECIMAL(18,6))) AS DOUBLE) / count(*) * 1e6 + 0.5) / 1e6 AS value FROM bars GROUP BY bar_date UNION ALL SELECT 'FX', CAST(date_trunc('week', o_orderdate) AS DATE), floor(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) * 1e6 + 0.5) / 1e6 FROM orders GROUP BY 2 UNION ALL SELECT 'RATE', CAST(date_trunc('week', l_shipdate) AS DATE), floor(CAST(sum(CAST(l_discount AS DECIMAL(18,2)) * 100) AS DOUBLE) / count(*) * 1e6 + 0.5) / 1e6 FROM lineitem GROUP BY 2)",
    "monthly": "SELECT 'FLOW' AS factor, CAST(date_trunc('month', o_orderdate) AS DATE) AS bar_date, floor(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) * 1e6 + 0.5) / 1e6 AS ret, last_day(CAST(date_trunc('month', o_orderdate) AS DATE)) + 6 AS knowledge_date FROM orders GROUP BY CAST(date_trunc('month', o_orderdate) AS DATE)",
    "market": "SELECT bar_date, floor((value / lag(value) OVER (ORDER BY bar_date) - 1) * 1e9 + 0.5) / 1e9 AS ret FROM levels WHERE factor = 'MKT'",
    "spans": "SELECT c_name AS symbol, lower(c_mktsegment) AS universe, CAST(min(o_orderdate) AS DATE) AS valid_from, CAST(max(o_orderdate) AS DATE) AS last_day FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name, c_mktsegment",
    "memberships": "SELECT symbol, universe, valid_from, CAST(NULL AS DATE) AS valid_to, valid_from AS knowledge_date FROM spans UNION ALL SELECT symbol, universe, valid_from, last_day, last_day + 10 FROM spans",
    "controls": "SELECT s_suppkey // 2 AS src, s_suppkey AS dst FROM supplier WHERE s_suppkey > 1",
    "stakes": "SELECT src, dst, max(pct) AS pct FROM (SELECT s_suppkey // 2 AS src, s_suppkey AS dst, CAST(10 + s_suppkey % 40 AS DOUBLE) AS pct FROM supplier WHERE s_suppkey > 1 UNION ALL SELECT s_suppkey // 3, s_suppkey, CAST(10 + s_suppkey % 40 AS DOUBLE) FROM supplier WHERE s_suppkey > 2) WHERE src > 0 GROUP BY src, dst",
    "days": "SELECT bar_date, row_number() OVER (ORDER BY bar_date) - 1 AS d, count(*) OVER () AS n FROM (SELECT DISTINCT bar_date FROM bars)",
    "panel": "SELECT s.symbol, days.bar_date, returns.ret FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN days LEFT JOIN returns ON returns.symbol = s.symbol AND returns.bar_date = days.bar_date",
}
NEEDS = {"returns": ("bars",), "levels": ("bars",), "market": ("levels",), "memberships": ("spans",), "days": ("bars",), "panel": ("days", "returns")}
