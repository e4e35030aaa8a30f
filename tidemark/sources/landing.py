"""Parsed feeds into stored tables, with what was landed and what was left out.

Each feed is shaped by a transform of frames (the ``*_rows`` functions), which queries and
tests use alone, and landed by ``land``, which appends and gives an account of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions import identity as I
from ..operators import events, returns
from ..tables import cut
from . import parsers
from .store import Store, write_report

#: Traded codes and the code of the same issuer that the graph has.
ALIASES = {"ISCTR": "ISATR", "VAKBN": "TVB", "YKBNK": "YKB", "KRDMD": "KRDMA"}
#: The weekly foreign flow's series and factors.
FLOW = (("TP.MKNETHAR.M7", "FFLOW"), ("TP.MKNETHAR.M1", "FFLOW_STOCK"))


def price_rows(payloads: DataFrame, band: float = 0.10) -> DataFrame:
    """Bars with their flags: closes that moved by just the daily band, and days without trade."""
    return returns.stale(returns.limit_locks(parsers.bars(payloads), band)).withColumn("source", F.lit("vendor"))


def level_rows(payloads: DataFrame, factor: str | None = None) -> DataFrame:
    """A series' closes as a factor's levels; a bar without a close is no level. Without a name the symbol is the factor."""
    name = F.lit(factor) if factor else F.col("symbol")
    return parsers.bars(payloads).where("close is not null").select(name.alias("factor"), "bar_date", F.col("close").alias("value"), F.lit("vendor").alias("source"), "knowledge_date")


def flow_rows(payloads: DataFrame) -> DataFrame:
    """Weekly flow and stock of foreign holdings, each week once, known by its release."""
    first, *rest = (parsers.weekly_series(payloads, series, factor) for series, factor in FLOW)
    for one in rest:
        first = first.unionByName(one)
    return first.withColumn("source", F.lit("central_bank"))


def cpi_rows(payloads: DataFrame, factor: str = "CPI") -> DataFrame:
    """Monthly consumer prices as a factor's levels, known by their release."""
    return parsers.consumer_prices(payloads, factor).withColumn("source", F.lit("central_bank"))


def macro_rows(payloads: DataFrame, factor: str) -> DataFrame:
    """A daily macro series of observations, such as an index of volatility; missing days are no levels."""
    return parsers.observations(payloads, factor).withColumn("source", F.lit("macro"))


def rate_rows(payloads: DataFrame, factor: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """A bond's yield or a swap's spread by day, within a span."""
    return parsers.quotes(payloads, factor, start, end).withColumn("source", F.lit("bonds"))


def land_series(store: Store, rows: DataFrame, *, report_dir: str | None = None) -> dict:
    """Levels of one or several series, whatever they were parsed from; with the last day and what it was known by for each, so a gap between the two shows."""
    got = cut(rows, "series")
    out = land(store, "factors", got)
    each = got.groupBy("factor").agg(F.count("*").alias("n"), F.min("bar_date").alias("first"), F.max("bar_date").alias("last"), F.max("knowledge_date").alias("known"))
    out["series"] = {r["factor"]: {c: r[c] for c in ("n", "first", "last", "known")} for r in each.collect()}  # a row for each series
    if report_dir:
        write_report(report_dir, "land_series", out)
    return out


def event_rows(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, targets, skipped): typed events, their channels by the prior, and (status, n) of what is none."""
    typed = events.typed(records)
    found = events.events(typed)
    skipped = typed.where("status != 'event'").groupBy("status").agg(F.count("*").alias("n"))
    return found, events.targets(found), skipped


def regime_rows(periods: DataFrame) -> DataFrame:
    """Declared periods with the accounting regime of their fiscal year; periods without a year or a day are left out."""
    return periods.select("symbol", "period", returns.accounting_regime(F.col("period")).alias("regime"), F.col("declared").alias("knowledge_date")).where("regime is not null and knowledge_date is not null")


def membership_rows(documents: DataFrame) -> DataFrame:
    """Versions of membership spans from documents (one JSON a row); a document without any is refused, an empty end is an open one."""
    form = "struct<universe_membership:array<struct<symbol:string,universe:string,universe_class:string,valid_from:string,valid_to:string,knowledge_date:string,source:string>>>"
    rows = documents.select(parsers.json_column(documents, form).getField("universe_membership").alias("m"))
    if rows.where("m is null or size(m) = 0").head(1):
        raise Refused("a document without membership rows")
    day = lambda c: F.nullif(F.col(c), F.lit("")).cast("date").alias(c.split(".")[-1])
    m = rows.select(F.explode("m").alias("m"))
    return m.select("m.symbol", "m.universe", "m.universe_class", day("m.valid_from"), day("m.valid_to"), "m.source", day("m.knowledge_date"))


def class_rows(symbols: DataFrame, sectors: DataFrame) -> DataFrame:
    """(symbol, universe_class, found_as, status): the class by the sector of the symbol's own code, else of the same issuer's other code; unknown ones are refused."""
    alias = F.create_map(*(F.lit(x) for p in ALIASES.items() for x in p))
    known = sectors.select(F.col("symbol").alias("code"), "sector").where("sector is not null and sector != ''").groupBy("code").agg(F.min("sector").alias("sector"))
    asked = symbols.select("symbol").distinct().withColumn("other", F.try_element_at(alias, F.col("symbol")))
    df = asked.join(known.select(F.col("code").alias("symbol"), F.col("sector").alias("own")), "symbol", "left").join(known.select(F.col("code").alias("other"), F.col("sector").alias("second")), "other", "left")
    kind = I.universe_class(F.coalesce("own", "second"))
    found_as = F.when(F.col("own").isNotNull(), F.col("symbol")).when(F.col("second").isNotNull(), F.col("other"))
    return df.select("symbol", kind.alias("universe_class"), found_as.alias("found_as"), F.when(kind.isNull(), "refused").otherwise("derived").alias("status"))


def edge_rows(edges: DataFrame, window_start: Column, window_end: Column, as_of: str) -> DataFrame:
    """A window's significant edges as rows of the stored snapshot; only what has passed is kept, never the whole matrix."""
    return edges.select(
        F.col("src").alias("symbol_a"), F.col("dst").alias("symbol_b"), window_end.alias("window_end"), F.datediff(window_end, window_start).alias("window"), F.col("corr").alias("value"), "p_value",
        F.signum("corr").cast("int").alias("sign"), F.lit("fdr_sector").alias("method"), F.lit(True).alias("fdr_passed"), F.lit(as_of).cast("date").alias("knowledge_date"),
    )


def registry_row(verdict: dict, provenance: DataFrame) -> DataFrame:
    """A registry row for each row of provenance (signal_id, hypothesis, feature_family, spans, cost_model, purge_embargo, book, knowledge_date) with the verdict's figures as they are; the registry judges nothing."""
    number = lambda k: F.lit(verdict.get(k)).cast("double")
    return provenance.select("*", F.lit(int(verdict["n_trials"])).alias("n_trials"), number("dsr").alias("deflated_sharpe"), number("pbo").alias("pbo"), F.lit(bool(verdict["beats_baselines"])).alias("beat_baselines"), F.lit(bool(verdict["promoted"])).alias("promoted"))


def account(rows: DataFrame, *keys: str, day: str = "bar_date", flags: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n, first, last, n_<flag>): what there is of each key."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(day).alias("first"), F.max(day).alias("last"), *(F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f"n_{f}") for f in flags))


def land(store: Store, table: str, rows: DataFrame, *, day: str = "bar_date", report_dir: str | None = None, name: str | None = None, skipped: DataFrame | None = None) -> dict:
    """Append and say what came: counts and the span, never the data. No rows are no error, but are reported as none."""
    n = store.append(table, rows)
    span = rows.agg(F.min(day).alias("first"), F.max(day).alias("last")).first() if n else None
    out = {"table": table, "n": n, "first": span and span["first"], "last": span and span["last"]}
    if skipped is not None:
        out["skipped"] = {r["status"]: r["n"] for r in skipped.collect()}  # a row for each status
    if report_dir:
        write_report(report_dir, name or f"land_{table}", out)
    return out


def land_news(store: Store, records: DataFrame, *, report_dir: str | None = None) -> dict:
    """Events and their targets; what is skipped is counted by its reason."""
    found, targets, skipped = event_rows(records)
    out = land(store, "events", found, day="event_date", skipped=skipped)
    out["n_targets"] = store.append("event_targets", targets)
    if report_dir:
        write_report(report_dir, "news_ingestion", out)
    return out


def land_registry(store: Store, verdict: dict, provenance: DataFrame, *, report_dir: str | None = None) -> dict:
    out = land(store, "signal_registry", registry_row(verdict, provenance), day="knowledge_date")
    if report_dir:
        write_report(report_dir, "signal_registry", out | {"verdict": verdict})
    return out
