"""News records to typed events, their channel targets, and exposure weights around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions.identity import once
from .factors import LADDER

COUNTRY = "TU"
#: Theme patterns by event type; the order of types breaks ties.
PATTERNS = {
    "terror_security": ("TERROR", "SUICIDE_ATTACK", "SECURITY_SERVICES", "ATTACK"),
    "armed_conflict": ("ARMEDCONFLICT", "WAR", "INSURGENCY", "MILITARY_OFFENSIVE", "ACT_FORCEPOSTURE"),
    "natural_disaster": ("NATURAL_DISASTER", "EARTHQUAKE", "FLOOD", "WILDFIRE", "DISASTER"),
    "pandemic": ("PANDEMIC", "EPIDEMIC", "INFECTIOUS", "MEDICAL_DISEASE", "HEALTH_PANDEMIC"),
    "sanctions_export_controls": ("SANCTION", "EMBARGO", "EXPORT_CONTROL", "ECON_SANCTION"),
    "energy_supply_disruption": ("ENV_OIL", "ENV_GAS", "ENV_NATURALGAS", "FUELPRICES", "ECON_OILPRICE", "ENERGY"),
    "cbrt_regulatory_action": ("ECON_CENTRALBANK", "GOVERNMENT_REGULATION", "LEGISLATION", "REGULATION"),
    "fx_monetary_shock": ("ECON_CURRENCY", "ECON_DEVALUATION", "ECON_INFLATION", "ECON_INTEREST_RATE", "ECON_EXCHANGE"),
    "elections_political_transition": ("ELECTION", "POLITICAL_TURMOIL", "DEMOCRACY", "COUP", "GOVERNMENT_CHANGE", "REFERENDUM"),
    "trade_policy_tariff": ("TARIFF", "TRADE_DISPUTE", "ECON_TRADE", "ECON_FREETRADE", "WTO"),
    "diplomatic_shift": ("DIPLOM", "ALLIANCE", "NEGOTIATIONS", "PEACEKEEPING", "TREATY"),
}
#: Signed channels a typical event of a type shocks.
PRIOR = {
    "fx_monetary_shock": {"fx": 1, "rates_cds": 1, "market": -1},
    "sanctions_export_controls": {"fx": 1, "foreign_flow": -1, "sector": -1},
    "armed_conflict": {"energy": 1, "fx": 1, "rates_cds": 1, "foreign_flow": -1},
    "diplomatic_shift": {"fx": 1, "foreign_flow": -1, "rates_cds": 1},
    "trade_policy_tariff": {"sector": -1, "fx": 1},
    "energy_supply_disruption": {"energy": 1, "market": -1},
    "cbrt_regulatory_action": {"rates_cds": 1, "fx": -1},
    "elections_political_transition": {"fx": 1, "rates_cds": 1, "foreign_flow": -1, "market": -1},
    "terror_security": {"fx": 1, "foreign_flow": -1, "market": -1},
    "natural_disaster": {"sector": -1, "market": -1},
    "pandemic": {"market": -1, "sector": -1, "energy": -1},
}
CONFIDENCE, UNCERTAINTY = 0.3, 0.7


def validate() -> None:
    if set(PATTERNS) != set(PRIOR) or any(c not in LADDER or s not in (1, -1) for p in PRIOR.values() for c, s in p.items()):
        raise Refused("every event type needs patterns, and signed shocks on known channels")


def parts(c: str, sep: str = ";") -> Column:
    return F.filter(F.split(F.coalesce(F.col(c), F.lit("")), sep), lambda x: x != "")


def countries(locations: str = "locations") -> Column:
    """Distinct country codes: the third field of each block."""
    codes = F.transform(parts(locations), lambda b: F.try_element_at(F.split(b, "#"), F.lit(3)))
    return F.array_distinct(F.filter(codes, lambda x: x.isNotNull() & (x != "")))


def event_type(themes: Column, patterns: dict[str, tuple[str, ...]] = PATTERNS) -> Column:
    """The type most themes fall under (each theme counts once for a type); ties by the order of types; none is NULL."""
    joined = F.upper(F.array_join(themes, ";"))
    # a match begins with a theme and takes it in whole, so there is one for each and none is read twice
    counts = [F.struct(F.regexp_count(joined, F.lit(f"(?<![^;])[^;]*?(?:{'|'.join(needles)})[^;]*+")).alias("n"), F.lit(-rank).alias("order"), F.lit(name).alias("type")) for rank, (name, needles) in enumerate(patterns.items())]
    return once(F.array_max(F.array(*counts)), lambda best: F.when(best["n"] > 0, best["type"]))


def severity(tone: str = "tone") -> Column:
    """Absolute tone over ten, 1 at most; NULL unless the first four parts are numbers."""
    n = [F.try_element_at(F.split(F.coalesce(F.col(tone), F.lit("")), ","), F.lit(i)).try_cast("double") for i in range(1, 5)]
    ok = n[0].isNotNull() & n[1].isNotNull() & n[2].isNotNull() & n[3].isNotNull()
    return F.when(ok, F.least(F.lit(1.0), F.abs(n[0]) / 10))


def typed(records: DataFrame, country: str = COUNTRY) -> DataFrame:
    """Records (record_id, date, themes, locations, tone) with their status: event, other_country, untyped or undated."""
    read = F.struct(countries().alias("_codes"), event_type(parts("themes")).alias("event_type"), F.try_to_timestamp(F.substring(F.trim("date"), 1, 8), F.lit("yyyyMMdd")).cast("date").alias("event_date"), severity().alias("severity"))
    # exploded, so that each record is read once, however often what follows uses the results
    df = records.select("*", F.explode(F.array(read)).alias("_read")).select(*(F.col(c) for c in records.columns), "_read.*")
    status = F.when(~F.array_contains("_codes", country), "other_country").when(F.col("event_type").isNull(), "untyped").when(F.col("event_date").isNull(), "undated").otherwise("event")
    return df.withColumn("status", status).withColumn("geography", F.array_join(F.array_sort("_codes"), ";")).drop("_codes")


def events(df: DataFrame, source: str = "news") -> DataFrame:
    """Rows of the events table from typed records; known when they are published."""
    none = F.lit(None).cast("string")
    return df.where("status = 'event'").select(F.col("record_id").alias("event_id"), "event_date", F.lit("day").alias("date_precision"), "event_type", none.alias("actors"), "geography", "severity", F.lit(source).alias("source"), F.col("event_date").alias("knowledge_date"))


def prior(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, c, s) for t, p in PRIOR.items() for c, s in p.items()], "event_type string, channel string, shock_sign int")


def targets(found: DataFrame) -> DataFrame:
    """Rows of the targets table: the type's typical signs, marked as inferred and without a size."""
    df = found.join(F.broadcast(prior(found.sparkSession)), "event_type")
    return df.select("event_id", "channel", "shock_sign", F.lit(None).cast("double").alias("shock_magnitude"), F.lit(CONFIDENCE).alias("confidence"), F.lit("inferred").alias("evidence_tier"), F.lit(UNCERTAINTY).alias("uncertainty"), F.lit("taxonomy_prior").alias("source"), "knowledge_date")


def event_specs(events_: DataFrame, targets_: DataFrame) -> DataFrame:
    """Distinct (event_date, channel, shock_sign) of the newest version of each event."""
    newest = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("knowledge_date"), F.desc("event_date")))
    last = events_.withColumn("_n", newest).where("_n = 1").select("event_id", "event_date")
    return last.join(targets_.select("event_id", "channel", "shock_sign"), "event_id").select("event_date", "channel", "shock_sign").distinct()


def exposure_panels(betas: DataFrame, channel_factor: dict[str, str], days: DataFrame | None = None) -> DataFrame:
    """(channel, symbol, bar_date, beta): each channel by its factor's betas, of several on a day the mean.

    With ``days`` every symbol of a channel is on all of them, NULL where it has no beta,
    and on no other. A channel whose factor has no betas has no rows, rather than zeros.
    """
    channel = F.explode(F.filter(F.array(*(F.struct(F.lit(c).alias("channel"), F.lit(f).alias("of")) for c, f in channel_factor.items())), lambda x: x["of"] == F.col("factor")))
    mean = betas.where(F.col("factor").isin(*channel_factor.values())).withColumn("_c", channel).groupBy(F.col("_c.channel").alias("channel"), "symbol", "bar_date").agg(F.avg("beta").alias("beta"))
    if days is None:
        return mean
    listed = days.agg(F.array_sort(F.collect_set("bar_date")).alias("_days"))  # days are few
    grid = mean.select("channel", "symbol").distinct().join(F.broadcast(listed)).select("channel", "symbol", F.explode("_days").alias("bar_date"))
    return grid.join(mean, ["channel", "symbol", "bar_date"], "left")


def _leg(e: Column, hi: Column, lo: Column) -> Column:
    return F.when((hi > lo) & (e >= hi), 1.0).when((hi > lo) & (e <= lo), -1.0).otherwise(0.0)


def cross_section(exposed: DataFrame, quantile: float = 0.3) -> DataFrame:
    """weight: +1 for the top and -1 for the bottom signed exposures of an event, over their number; flat unless the quantiles differ.

    ``exposed`` has (event, symbol, exposure, shock_sign).
    """
    df = exposed.withColumn("_e", F.col("exposure") * F.col("shock_sign"))
    q = df.groupBy("event").agg(F.percentile("_e", F.lit(1 - quantile)).alias("hi"), F.percentile("_e", F.lit(quantile)).alias("lo"))
    df = df.join(q, "event").withColumn("_l", _leg(F.col("_e"), F.col("hi"), F.col("lo")))
    gross = F.sum(F.abs("_l")).over(Window.partitionBy("event"))
    return df.withColumn("weight", F.when(gross > 0, F.col("_l") / gross).otherwise(0.0)).drop("_e", "_l", "hi", "lo")


def control_survival(exposed: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(event, n_names, n_high, n_control, control_fraction): how many names are hardly exposed."""
    n, c = F.count("exposure"), F.count_if(F.abs("exposure") <= threshold)
    return exposed.groupBy("event").agg(n.alias("n_names"), (n - c).alias("n_high"), c.alias("n_control"), F.try_divide(c, n).alias("control_fraction"))


def drift_grid(betas: DataFrame, specs: DataFrame, choices: list[tuple[str, float, int, int]]) -> DataFrame:
    """(variant, symbol, bar_date, weight) for each choice of (variant, quantile, drift, lag), in one plan.

    From the first trading day at or after each event, for ``drift`` days, the
    cross-section of exposures known ``lag`` days before; summed over events and scaled to
    one. ``betas`` has (symbol, channel, bar_date, beta).
    """
    day = betas.select("bar_date").distinct().withColumn("d", F.row_number().over(Window.partitionBy().orderBy("bar_date")) - 1)
    nxt = day.select(F.col("bar_date").alias("at"), F.lit(1).alias("k"), "d").unionByName(specs.select(F.col("event_date").alias("at"), F.lit(0).alias("k"), F.lit(None).cast("int").alias("d")).distinct())
    first = F.first("d", ignorenulls=True).over(Window.partitionBy().orderBy("at", "k").rowsBetween(0, Window.unboundedFollowing))
    entry = nxt.select("at", "k", first.alias("entry")).where("k = 0 and entry is not null").select(F.col("at").alias("event_date"), "entry")
    lags = F.explode(F.array(*map(F.lit, sorted({lag for *_, lag in choices}))))
    placed = specs.join(F.broadcast(entry), "event_date").withColumn("lag", lags).where(F.col("entry") >= F.col("lag")).withColumn("event", F.concat_ws("|", F.col("event_date").cast("string"), "channel", F.col("shock_sign").cast("string")))  # a row for each day of the panel
    seen = betas.where("beta is not null").join(F.broadcast(day), "bar_date").withColumn("lag", lags).select("symbol", "channel", "lag", (F.col("d") + F.col("lag")).alias("entry"), F.col("beta").alias("exposure"))
    exposed = seen.join(placed, ["channel", "entry", "lag"]).select("event", "lag", "entry", "symbol", (F.col("exposure") * F.col("shock_sign")).alias("_e"))
    # the quantiles of each event, all choices in one pass
    wanted = sorted({q for _, q, *_ in choices})
    cuts = exposed.groupBy("event", "lag").agg(F.array(*(F.struct(F.lit(q).alias("quantile"), F.percentile("_e", F.lit(1 - q)).alias("hi"), F.percentile("_e", F.lit(q)).alias("lo")) for q in wanted)).alias("cuts"))
    legs = exposed.join(cuts, ["event", "lag"]).withColumn("c", F.explode("cuts")).select("event", "lag", "entry", "symbol", "c.quantile", _leg(F.col("_e"), F.col("c.hi"), F.col("c.lo")).alias("_l"))
    gross = F.sum(F.abs("_l")).over(Window.partitionBy("event", "lag", "quantile"))
    weighed = legs.withColumn("weight", F.when(gross > 0, F.col("_l") / gross).otherwise(0.0)).where("weight != 0")
    drifts = F.array(*(F.struct(F.lit(name).alias("variant"), F.lit(q).alias("q"), F.lit(d).alias("drift"), F.lit(lag).alias("l")) for name, q, d, lag in choices))
    each = weighed.withColumn("o", F.explode(F.filter(drifts, lambda o: (o["q"] == F.col("quantile")) & (o["l"] == F.col("lag")))))
    held = each.withColumn("d", F.explode(F.sequence("entry", F.col("entry") + F.col("o.drift") - 1)))
    sums = held.groupBy(F.col("o.variant").alias("variant"), "symbol", "d").agg(F.sum("weight").alias("_w")).join(F.broadcast(day), "d")
    whole = F.sum(F.abs("_w")).over(Window.partitionBy("variant", "bar_date"))
    return sums.select("variant", "symbol", "bar_date", F.when(whole > 1e-12, F.col("_w") / whole).otherwise(0.0).alias("weight"))


def drift_weights(betas: DataFrame, specs: DataFrame, *, drift: int = 5, quantile: float = 0.3, lag: int = 1) -> DataFrame:
    """(symbol, bar_date, weight) of one choice: see ``drift_grid``."""
    return drift_grid(betas, specs, [("", quantile, drift, lag)]).drop("variant")


def slots(start: str, end: str, spark: SparkSession) -> DataFrame:
    """(slot, name): quarter hours from start to end, both included, and their file names."""
    df = spark.sql(f"select explode(sequence(timestamp'{start}', timestamp'{end}', interval 15 minutes)) as slot")
    return df.select("slot", F.concat(F.date_format("slot", "yyyyMMddHHmmss"), F.lit(".gkg.csv.zip")).alias("name"))
