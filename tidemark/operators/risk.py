"""Exposures, shocks and their propagation over ownership and control."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Fabrication, Refused
from ..tables import cut
from .factors import LADDER

#: The factor whose beta stands for a channel.
CHANNEL_FACTOR = {"market": "XU100", "fx": "USDTRY", "rates_cds": "TRCDS5Y", "energy": "BRENT", "foreign_flow": "FFLOW", "holding": "XHOLD"}
#: Stylised scenarios as signed channel shocks.
SCENARIOS = {
    "try_depreciation_10": {"fx": 0.10},
    "rate_cds_widening": {"rates_cds": 0.20, "market": -0.04},
    "oil_spike": {"energy": 0.20, "fx": 0.03},
    "global_risk_off": {"market": -0.08, "fx": 0.05, "rates_cds": 0.08, "energy": -0.06},
    "imamoglu_shock_stylized": {"market": -0.12, "fx": 0.10, "rates_cds": 0.15, "holding": -0.10},
}


def scenarios(spark: SparkSession, library: dict[str, dict[str, float]] = SCENARIOS) -> DataFrame:
    """(scenario, channel, shock), checked."""
    for name, shocks in library.items():
        if not shocks or any(c not in LADDER or s != s or abs(s) == float("inf") for c, s in shocks.items()):
            raise Refused(f"scenario {name} has no shocks, or one on an unknown channel or without a finite size")
    return spark.createDataFrame([(n, c, float(s)) for n, shocks in library.items() for c, s in shocks.items()], "scenario string, channel string, shock double")


def prior_shock(event_type: str, severity: float = 1.0) -> dict[str, float]:
    """The signs an event of this type is expected to have on channels, times its severity: as coarse as that prior."""
    from .events import PRIOR

    if event_type not in PRIOR:
        raise Refused(f"no prior for events of type {event_type!r}")
    if severity != severity or abs(severity) == float("inf"):
        raise Refused("a severity has to be finite")
    return {channel: sign * float(severity) for channel, sign in PRIOR[event_type].items()}


def prior_shocks(events_: DataFrame) -> DataFrame:
    """(scenario, channel, shock) of typed events with a severity: one scenario each."""
    from .events import prior

    rows = events_.where("severity is not null").join(F.broadcast(prior(events_.sparkSession)), "event_type")  # types times channels
    return rows.select(F.col("event_id").alias("scenario"), "channel", (F.col("shock_sign") * F.col("severity")).alias("shock"))


def empirical_scenario(levels: DataFrame, methods: dict[str, str], start: str, end: str, name: str, channel_factor: dict[str, str] = CHANNEL_FACTOR) -> DataFrame:
    """(scenario, channel, shock) as a span of days really had it, by the factors that stand for the channels; without any it is refused."""
    channel = F.create_map(*(F.lit(x) for c, f in channel_factor.items() for x in (f, c)))[F.col("factor")]
    out = realized_shock(levels, {f: m for f, m in methods.items() if f in channel_factor.values()}, start, end).select(F.lit(name).alias("scenario"), channel.alias("channel"), "shock")
    if not out.head(1):
        raise Fabrication(f"no factor of a channel has values from {start} to {end}")
    return out


def exposures(betas: DataFrame, channel_factor: dict[str, str] = CHANNEL_FACTOR) -> DataFrame:
    """(symbol, channel, beta): the row of each channel's last day; a symbol of the channel without a beta on that day has NULL, not an older one."""
    channel = F.create_map(*(F.lit(x) for c, f in channel_factor.items() for x in (f, c)))[F.col("factor")]
    # used twice here, and by every reader of the result
    known = cut(betas.where(F.col("factor").isin(*channel_factor.values())).select("symbol", channel.alias("channel"), "bar_date", "beta"))
    last = known.groupBy("channel").agg(F.max("bar_date").alias("last"))
    held = known.join(F.broadcast(last), "channel")  # a row for each channel
    return held.groupBy("symbol", "channel").agg(F.max(F.when((F.col("bar_date") == F.col("last")) & ~F.isnan("beta"), F.col("beta"))).alias("beta"))


def realized_shock(levels: DataFrame, methods: dict[str, str], start: str, end: str) -> DataFrame:
    """(factor, shock) over a span by each factor's method; without values or over a base of zero there is none."""
    method = F.create_map(*(F.lit(x) for p in methods.items() for x in p))[F.col("factor")]
    span = levels.where(F.col("bar_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("value").isNotNull() & F.col("factor").isin(*methods))
    ends = span.groupBy("factor", method.alias("method")).agg(F.min_by("value", "bar_date").alias("a"), F.max_by("value", "bar_date").alias("b"), F.avg("value").alias("m"))
    ratio = F.try_divide(F.col("b"), F.col("a"))
    shock = F.when(F.col("method") == "simple", ratio - 1).when(F.col("method") == "log", F.when(ratio > 0, F.ln(ratio))).when(F.col("method") == "diff", F.col("b") - F.col("a")).otherwise(F.col("m"))
    return ends.select("factor", shock.alias("shock")).where("shock is not null")


def reprice(exposed: DataFrame, shocks: DataFrame) -> DataFrame:
    """(scenario, symbol, pnl, coverage): sum of beta times shock over the scenario's channels; a channel without a beta adds nothing and lowers the coverage.

    A scenario none of whose channels is exposed anywhere has no rows (``unshockable``).
    """
    have = exposed.select("channel").distinct()
    usable = shocks.join(shocks.join(have, "channel", "left_semi").select("scenario").distinct(), "scenario", "left_semi")
    n = usable.groupBy("scenario").agg(F.count("*").alias("n"))
    hit = exposed.where("beta is not null").join(F.broadcast(usable), "channel").groupBy("scenario", "symbol").agg(F.sum(F.col("beta") * F.col("shock")).alias("pnl"), F.count("*").alias("known"))
    grid = exposed.select("symbol").distinct().join(F.broadcast(n))  # scenarios are few
    return grid.join(hit, ["scenario", "symbol"], "left").select("scenario", "symbol", F.coalesce("pnl", F.lit(0.0)).alias("pnl"), (F.coalesce("known", F.lit(0)) / F.col("n")).alias("coverage"))


def unshockable(exposed: DataFrame, shocks: DataFrame) -> DataFrame:
    good = shocks.join(exposed.select("channel").distinct(), "channel", "left_semi").select("scenario").distinct()
    return shocks.select("scenario").distinct().join(good, "scenario", "left_anti")


def channel_stress(exposed: DataFrame, shock: dict[str, float]) -> DataFrame:
    """One shock vector; an empty one, an unknown channel, or none that is exposed is refused."""
    if not shock:
        raise Fabrication("there is no shock")
    if set(shock) - set(LADDER):
        raise Refused(f"unknown channels: {sorted(set(shock) - set(LADDER))}")
    shocks = scenarios(exposed.sparkSession, {"shock": shock})
    if not exposed.where(F.col("channel").isin(*shock)).head(1):
        raise Fabrication("no exposure to any shocked channel")
    return reprice(exposed, shocks).drop("scenario")


def type_stress(exposed: DataFrame, events_: DataFrame) -> DataFrame:
    """(event_type, n_events, mean_severity, n, mean_pnl, worst, best, mean_coverage): the exposures under each type's prior at its mean severity.

    An event counts once; a type without any severity has 1. Types without a prior, or on
    whose channels nothing is exposed, are left out.
    """
    from .events import prior

    once = events_.groupBy("event_id").agg(F.max(F.struct("event_type", "severity")).alias("e")).select("e.*")
    severity = F.avg(F.when(~F.isnan("severity"), F.col("severity")))
    types = cut(once.groupBy("event_type").agg(F.count("*").alias("n_events"), F.coalesce(severity, F.lit(1.0)).alias("mean_severity")))  # used at both ends
    shocks = types.join(F.broadcast(prior(events_.sparkSession)), "event_type").select(F.col("event_type").alias("scenario"), "channel", (F.col("shock_sign") * F.col("mean_severity")).alias("shock"))  # types times channels
    return stress_summary(reprice(exposed, shocks), "scenario").withColumnRenamed("scenario", "event_type").join(types, "event_type").select("event_type", "n_events", "mean_severity", "n", "mean_pnl", "worst", "best", "mean_coverage")


def portfolio_stress(stress: DataFrame, weights: DataFrame) -> DataFrame:
    return stress.join(weights, "symbol").agg(F.sum(F.col("weight") * F.col("pnl")).alias("pnl"))


def extremes(stress: DataFrame, n: int = 10, worst: bool = True) -> DataFrame:
    return stress.orderBy(F.col("pnl").asc() if worst else F.col("pnl").desc(), "symbol").limit(n)


def stress_summary(stress: DataFrame, *keys: str) -> DataFrame:
    return stress.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("pnl").alias("mean_pnl"), F.min("pnl").alias("worst"), F.max("pnl").alias("best"), F.avg("coverage").alias("mean_coverage"))


def propagate(edges: DataFrame, shocks: DataFrame, max_hops: int = 6, least_confidence: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Shocks carried from held to holder along all simple paths, and the cycles met.

    ``edges`` has (src holder, dst held, fraction, confidence); ``shocks`` has (node,
    shock). Returns (holder, shock, n_paths) and (node, hops) where a path came back on
    itself. Paths have up to max_hops + 1 edges. Each hop is one join with the edges.
    """
    if edges.where(~F.col("fraction").between(0, 1) | F.col("fraction").isNull()).head(1):
        raise Refused("ownership fractions lie between 0 and 1")
    kept = edges.where(F.coalesce("confidence", F.lit(1.0)) >= least_confidence).select("src", "dst", "fraction")
    paths = shocks.select(F.col("node").alias("at"), F.col("shock").alias("s"), F.array("node").alias("path"))
    reached, cycles = [], []
    for hop in range(1, max_hops + 2):
        # every hop is written, so plans stay short and no hop is computed twice
        step = cut(paths.join(kept, F.col("at") == F.col("dst")).select("s", "path", "src", "fraction"))
        cycles.append(step.where(F.array_contains("path", F.col("src"))).select(F.col("src").alias("node"), F.lit(hop).alias("hops")))
        paths = step.where(~F.array_contains("path", F.col("src"))).select(F.col("src").alias("at"), (F.col("s") * F.col("fraction")).alias("s"), F.concat("path", F.array("src")).alias("path"))
        reached.append(paths.select(F.col("at").alias("holder"), "s"))
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    return union(reached).groupBy("holder").agg(F.sum("s").alias("shock"), F.count("*").alias("n_paths")), union(cycles).distinct()


def reach(edges: DataFrame, origins: DataFrame, max_hops: int = 12, direction: str = "down") -> DataFrame:
    """(origin, node, hops): fewest hops along edges from src to dst (down), against them (up), or either way (both); the origin is left out."""
    ways = {"down": [("src", "dst")], "up": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[direction]
    steps = None
    for a, b in ways:
        e = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
        one = _reach(e.distinct(), origins, max_hops)
        steps = one if steps is None else steps.unionByName(one)
    return steps.groupBy("origin", "node").agg(F.min("hops").alias("hops"))


def _reach(e: DataFrame, origins: DataFrame, max_hops: int) -> DataFrame:
    """Hop by hop, each written: what is new comes by a join with the hop before, and is told apart from all that was seen."""
    frontier = origins.select(F.col("node").alias("origin"), "node", F.lit(0).alias("hops")).distinct()
    seen = [cut(frontier)]
    for hop in range(1, max_hops + 1):
        known = reduce(DataFrame.unionByName, seen).select("origin", "node")
        step = seen[-1].join(e, F.col("node") == F.col("a")).select("origin", F.col("b").alias("node")).distinct()
        new = cut(step.join(known, ["origin", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if not new.head(1):
            break
        seen.append(new)
    return reduce(DataFrame.unionByName, seen).where("hops > 0")
