"""Health of identifiers, freshness, new listings, and what is left to do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pit

FLOORS = {"isin": 0.80, "filing_id": 0.99, "lei": 0.88}


def leg_coverage(companies: DataFrame, floors: dict[str, float] = FLOORS) -> DataFrame:
    """(leg, coverage, floor, ok)."""
    one = companies.agg(*(F.avg(F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", 1.0).otherwise(0.0)).alias(f) for f in floors))
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("leg"), F.col(f).alias("coverage"), F.lit(floor).alias("floor")) for f, floor in floors.items())))
    return one.select(rows.alias("r")).select("r.leg", F.round("r.coverage", 4).alias("coverage"), "r.floor", F.coalesce(F.col("r.coverage") >= F.col("r.floor"), F.lit(False)).alias("ok"))


def bridge_health(companies: DataFrame, key: str = "uuid", floors: dict[str, float] = FLOORS) -> DataFrame:
    """(n_below_floor, n_collisions, n_broken_round_trips, healthy)."""
    legs = list(floors)
    a = leg_coverage(companies, floors).agg(F.count_if(~F.col("ok")).alias("n_below_floor"))
    b = pit.collisions(companies, key, legs).agg(F.count("*").alias("n_collisions"))
    c = pit.round_trip(companies, key, legs).agg(F.count_if(~F.col("ok")).alias("n_broken_round_trips"))
    return a.join(b).join(c).withColumn("healthy", (F.col("n_below_floor") == 0) & (F.col("n_collisions") == 0))  # one row each


def latest_bars(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max("bar_date").alias("last_bar"))


def freshness(symbols: DataFrame, latest: DataFrame, as_of: str, max_age: int = 7) -> DataFrame:
    """(symbol, last_bar, age_days, status): current, stale or missing."""
    age = F.datediff(F.lit(as_of).cast("date"), "last_bar")
    return symbols.select("symbol").distinct().join(latest, "symbol", "left").select("symbol", "last_bar", age.alias("age_days"), F.when(F.col("last_bar").isNull(), "missing").when(age > max_age, "stale").otherwise("current").alias("status"))


def pull_windows(fresh: DataFrame, as_of: str, full_start: str = "2023-01-01", overlap: int = 5) -> DataFrame:
    """(symbol, start, end) of what has to be fetched again, oldest first."""
    start = F.when(F.col("last_bar").isNull(), F.lit(full_start).cast("date")).otherwise(F.date_sub("last_bar", overlap))
    return fresh.where("status != 'current'").select("symbol", start.alias("start"), F.lit(as_of).cast("date").alias("end")).orderBy("start", "symbol")


def chunks(windows: DataFrame, most_days: int = 900) -> DataFrame:
    """(symbol, start, end) cut to spans of so many days at most."""
    s = F.explode(F.sequence("start", "end", F.expr(f"interval {most_days} days")))
    return windows.where("start <= end").select("symbol", s.alias("from"), "end").select("symbol", F.col("from").alias("start"), F.least(F.col("end"), F.date_add("from", most_days - 1)).alias("end"))


def listing_diff(upstream: DataFrame, known: DataFrame) -> DataFrame:
    """(filing_id, upstream_ticker, known_ticker, change): new, retired, or another ticker where the sets of codes have none in common."""
    codes = lambda c: F.filter(F.split(F.upper(F.coalesce(F.col(c), F.lit(""))), "[, ]+"), lambda x: x != "")
    df = upstream.select("filing_id", F.col("ticker").alias("upstream_ticker"), F.lit(1).alias("u")).join(known.select("filing_id", F.col("ticker").alias("known_ticker"), F.lit(1).alias("k")), "filing_id", "full_outer")
    change = F.when(F.col("k").isNull(), "new").when(F.col("u").isNull(), "retired").when(~F.arrays_overlap(codes("upstream_ticker"), codes("known_ticker")), "ticker_change")
    return df.select("filing_id", "upstream_ticker", "known_ticker", change.alias("change")).where("change is not null")


def onboarding(companies: DataFrame, stages: dict[str, DataFrame], key: str = "ticker") -> DataFrame:
    """(key, pending, n_pending): what each company still lacks; those with most left first. A stage's frame holds the keys that have passed it."""
    df = companies.select(key).where(F.col(key).isNotNull()).distinct()
    for name, done in stages.items():
        df = df.join(done.select(F.col(key)).distinct().withColumn(f"_{name}", F.lit(True)), key, "left")
    pending = F.array_compact(F.array(*(F.when(F.col(f"_{n}").isNull(), F.lit(n)) for n in stages)))
    return df.select(key, F.array_join(pending, ",").alias("pending"), F.size(pending).alias("n_pending")).where("n_pending > 0").orderBy(F.desc("n_pending"), F.desc(key))


def drift(anchors: DataFrame, live: DataFrame, keys: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """(keys, expected, found, status) of known values: ok, drift or missing."""
    df = anchors.select(*keys, F.col(value).alias("expected")).join(live.select(*keys, F.col(value).alias("found")), keys, "left")
    close = F.abs(F.col("found") - F.col("expected")) <= tolerance * F.greatest(F.lit(1.0), F.abs("expected"))
    return df.withColumn("status", F.when(F.col("found").isNull(), "missing").when(close, "ok").otherwise("drift"))


def smoke_status(reports: DataFrame, sources: DataFrame, now: str, max_age: float = 30.0) -> DataFrame:
    """(source, status) from the newest report of each source: missing, unreadable, drift, stale or ok."""
    last = reports.groupBy("source").agg(F.max_by(F.struct("ok", "written"), "written").alias("r"))
    age = F.datediff(F.lit(now).cast("date"), F.col("r.written"))
    status = F.when(F.col("r").isNull(), "missing").when(F.col("r.ok").isNull(), "unreadable").when(~F.col("r.ok"), "drift").when(age > max_age, "stale").otherwise("ok")
    return sources.select("source").distinct().join(last, "source", "left").select("source", status.alias("status"))


def heartbeat(checks: dict[str, Column], df: DataFrame) -> DataFrame:
    """(green, reasons) of one row of figures by named conditions that must hold."""
    bad = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())))
    green = reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for c in checks.values()))
    return df.select(green.alias("green"), F.array_join(bad, ",").alias("reasons"))


#: Counterparties by what their names hold, in this order.
BUCKETS = (("public", r"(?iu)\b(ministry|municipality|bakanl|belediye|kamu|t\.c\.)"), ("foreign", r"(?iu)\b(gmbh|ltd|llc|inc|s\.a\.|b\.v\.|plc)\b"), ("corporate", r"(?iu)(a\.ş|a\.s|holding|sanayi|san\.)"))


def bucket(c: Column) -> Column:
    out = F.lit("other")
    for name, form in reversed(BUCKETS):
        out = F.when(c.rlike(form), name).otherwise(out)
    return F.when(F.trim(c) == "", "unnamed").otherwise(F.when(c.isNull(), "unnamed").otherwise(out))


#: The stages of taking a company in, in order, with what each does.
STAGES = (
    ("kap_identity", "seed the company and its security from the member list"),
    ("gleif_identity", "fill in the entity and security identifiers"),
    ("sector", "link the company to its sector"),
    ("universe_prices", "pull bars, returns and the universe class"),
    ("factor_refit", "fit betas and residuals"),
)


def market_data(found: DataFrame) -> DataFrame:
    """(symbol, market_data, vendor_codes) of (symbol, codes): carried, carried under another code, or not yet (to be asked for again)."""
    codes = F.filter(F.coalesce("codes", F.array().cast("array<string>")), lambda c: c.isNotNull() & (c != ""))
    kind = F.when(F.size(codes) == 0, "not_carried_yet").when(F.array_contains(codes, F.col("symbol")), "carried").otherwise("carried_other_code")
    return found.select("symbol", kind.alias("market_data"), F.slice(codes, 1, 8).alias("vendor_codes"))


def onboarding_status(companies: DataFrame, returns: DataFrame, betas: DataFrame, universe: DataFrame) -> DataFrame:
    """(filing_id, ticker, pending, next_step) of listed companies: which stages are still to come, an empty list where none is."""
    df = companies.where("is_listed and ticker is not null")
    for name, rows in (("_r", returns), ("_b", betas), ("_u", universe)):
        df = df.join(rows.select(F.col("symbol").alias("ticker")).distinct().withColumn(name, F.lit(True)), "ticker", "left")
    there = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    done = {"kap_identity": there("filing_id"), "gleif_identity": there("lei") & there("isin"), "sector": there("sector"), "universe_prices": F.col("_r").isNotNull() & F.col("_u").isNotNull(), "factor_refit": F.col("_b").isNotNull()}
    pending = F.array_compact(F.array(*(F.when(~done[s], F.lit(s)) for s, _ in STAGES)))
    return df.select("filing_id", "ticker", pending.alias("pending"), F.try_element_at(pending, F.lit(1)).alias("next_step"))


def onboarding_plan(status: DataFrame) -> DataFrame:
    """(ticker, step, stage, what): what is left to do for each company, in order."""
    what = F.create_map(*(F.lit(x) for s in STAGES for x in s))
    rows = status.select("ticker", F.posexplode("pending").alias("step", "stage"))
    return rows.select("ticker", (F.col("step") + 1).alias("step"), "stage", what[F.col("stage")].alias("what"))


def daily_plan(fresh: DataFrame, as_of: str, *, limit: int | None = None, full_start: str = "2023-01-01", overlap: int = 5, most_days: int = 900) -> DataFrame:
    """(symbol, start, end): what one update fetches, in pieces the vendor allows; of the oldest ``limit`` symbols (none or 0: all)."""
    windows = pull_windows(fresh, as_of, full_start, overlap)
    return chunks(windows.limit(limit) if limit else windows, most_days)
