"""Factor returns, regimes, alignment, rolling betas and residuals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions import linalg
from .returns import change

#: The order in which channels are stripped.
LADDER = ("market", "fx", "rates_cds", "energy", "sector", "foreign_flow", "holding")
#: Fixed values: (factor, channel, return method, source, series, status, frequency).
MANIFEST = (
    ("XU100", "market", "simple", "matriks", "XU100", "available", "daily"),
    ("MSCIEM", "market", "simple", "matriks", "EEM", "blocked", "daily"),
    ("VIX", "market", "diff", "fred", "VIXCLS", "available", "daily"),
    ("USDTRY", "fx", "simple", "matriks", "USDTRY", "available", "daily"),
    ("EURTRY", "fx", "simple", "matriks", "EURTRY", "available", "daily"),
    ("TRY2Y", "rates_cds", "diff", "worldgovbonds", "TRY2Y", "available", "daily"),
    ("TRY10Y", "rates_cds", "diff", "worldgovbonds", "TRY10Y", "available", "daily"),
    ("TRCDS5Y", "rates_cds", "diff", "worldgovbonds", "TRCDS5Y", "available", "daily"),
    ("BRENT", "energy", "simple", "matriks", "BRENT", "available", "daily"),
    ("NATGAS", "energy", "simple", "fred", "DHHNGSP", "available", "daily"),
    ("GOLD", "energy", "simple", "matriks", "XAUUSD", "available", "daily"),
    ("XBANK", "sector", "simple", "matriks", "XBANK", "available", "daily"),
    ("XUSIN", "sector", "simple", "matriks", "XUSIN", "available", "daily"),
    ("XKMYA", "sector", "simple", "matriks", "XKMYA", "available", "daily"),
    ("XELKT", "sector", "simple", "matriks", "XELKT", "available", "daily"),
    ("XGIDA", "sector", "simple", "matriks", "XGIDA", "available", "daily"),
    ("XUTEK", "sector", "simple", "matriks", "XUTEK", "available", "daily"),
    ("FFLOW", "foreign_flow", "level", "evds", "TP.MKNETHAR.M7", "available", "weekly"),
    ("XHOLD", "holding", "simple", "matriks", "XHOLD", "available", "daily"),
)
#: Market regimes by the day each begins.
BASELINE = "baseline_pre2018"
BREAKS = (
    ("2018-08-10", "tl_crisis_2018"),
    ("2021-11-22", "tl_crisis_2021_2022"),
    ("2023-06-07", "orthodox_turn_2023"),
    ("2025-03-19", "imamoglu_shock_2025"),
    ("2025-08-29", "post_shortban_2025"),
)


def validate_manifest(manifest=MANIFEST) -> None:
    names = [m[0] for m in manifest]
    if len(set(names)) != len(names):
        raise Refused("a factor is listed twice")
    for name, channel, method, _, series, status, frequency in manifest:
        if channel not in LADDER or method not in ("simple", "log", "diff", "level") or not series or status not in ("available", "blocked") or frequency not in ("daily", "weekly", "monthly"):
            raise Refused(f"factor {name} is not well formed")


def specs(manifest=MANIFEST, available_only: bool = True) -> dict[str, str]:
    """Return method by factor."""
    return {m[0]: m[2] for m in manifest if not available_only or m[5] != "blocked"}


def ladder_order(manifest=MANIFEST, available_only: bool = True) -> list[str]:
    return [m[0] for m in sorted((m for m in manifest if not available_only or m[5] != "blocked"), key=lambda m: LADDER.index(m[1]))]


def order_present(present: list[str], manifest=MANIFEST) -> list[str]:
    """Factors in ladder order, unknown ones last as they came."""
    order = ladder_order(manifest, False)
    return sorted(dict.fromkeys(present), key=lambda f: order.index(f) if f in order else len(order))


def weekly_factors(manifest=MANIFEST) -> list[str]:
    return [m[0] for m in manifest if m[6] == "weekly" and m[5] != "blocked"]


def blocked_factors(manifest=MANIFEST) -> list[str]:
    return [m[0] for m in manifest if m[5] == "blocked"]


def factor_returns(levels: DataFrame, methods: dict[str, str]) -> DataFrame:
    """(factor, bar_date, ret) by each factor's method; of several levels on a day the newest known counts."""
    newest = F.row_number().over(Window.partitionBy("factor", "bar_date").orderBy(F.col("knowledge_date").desc(), "value"))
    df = levels.withColumn("_n", newest).where("_n = 1")
    method = F.create_map(*(F.lit(x) for pair in methods.items() for x in pair))[F.col("factor")]
    ret = F.when(method == "simple", change("value", "factor")).when(method == "log", change("value", "factor", method="log")).when(method == "diff", change("value", "factor", method="diff")).when(method == "level", F.col("value"))
    return df.where(F.col("factor").isin(*methods)).select("factor", "bar_date", "knowledge_date", ret.alias("ret"))


def regime(day: Column, breaks=BREAKS, baseline: str = BASELINE) -> Column:
    """Label of the newest break at or before a day."""
    out = F.lit(baseline)
    for start, name in breaks:
        out = F.when(day >= F.lit(start).cast("date"), name).otherwise(out)
    return F.when(day.isNotNull(), out)


def align_by_knowledge(facts: DataFrame, grid: DataFrame, value: str = "ret") -> DataFrame:
    """(bar_date, value) on the grid's days: the newest fact known by then, one released the same day included."""
    fact = facts.select(F.col("knowledge_date").alias("d"), F.lit(0).alias("k"), F.col("bar_date").alias("b"), F.col(value).alias("v"))
    days = grid.select(F.col("bar_date").alias("d")).distinct().select("d", F.lit(1).alias("k"), F.lit(None).cast("date").alias("b"), F.lit(None).cast("double").alias("v"))
    newest = F.last("v", ignorenulls=True).over(Window.partitionBy().orderBy("d", "k", "b"))
    return fact.unionByName(days).select("d", "k", newest.alias(value)).where("k = 1").select(F.col("d").alias("bar_date"), value)


def factor_panel(returns: DataFrame, order: list[str]) -> DataFrame:
    """One row a day with a column for each factor."""
    return returns.groupBy("bar_date").pivot("factor", order).agg(F.last("ret", ignorenulls=True))


def _windows(symbol: pd.DataFrame, order: list[str], window: int, least: int, some: int = 512) -> Iterator[tuple]:
    """(days, regimes, windows, mask, last row is whole) of a symbol's dates, some at a time: the last ``window`` joined rows of each, masked to those in the date's regime with all values; dates with too few are left out."""
    pdf = symbol.sort_values("bar_date")
    values = pdf[["ret", *order]].to_numpy(float)
    whole = ~np.isnan(values).any(axis=1)
    days, names = pdf["bar_date"].to_numpy(), pdf["regime"].to_numpy()
    for low in range(window - 1, len(pdf), some):
        ends = np.arange(low, min(low + some, len(pdf)))
        at = ends[:, None] + np.arange(1 - window, 1)
        mask = whole[at] & (names[at] == names[ends][:, None])
        enough = mask.sum(axis=1) >= max(least, 2)
        if enough.any():
            ends, at, mask = ends[enough], at[enough], mask[enough]
            yield days[ends], names[ends], values[at], mask, whole[ends]


def _joined(returns: DataFrame, panel: DataFrame, order: list[str], label: Column | None) -> DataFrame:
    label = regime(F.col("bar_date")) if label is None else label
    return returns.select("symbol", "bar_date", "ret").join(panel.select("bar_date", *order), "bar_date").withColumn("regime", label)


def rolling_betas(returns: DataFrame, panel: DataFrame, order: list[str], *, window: int = 60, least: int = 40, method: str = "ledoit_wolf", label: Column | None = None) -> DataFrame:
    """(symbol, factor, bar_date, beta, n_obs, regime): partial betas within a regime; too few rows give none."""

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for days, names, x, mask, _ in _windows(pdf, order, window, least):
            beta = linalg.partial_betas_of_windows(x, mask, method)
            each = lambda v: np.repeat(v, len(order))
            parts.append(pd.DataFrame({"symbol": key[0], "factor": np.tile(np.array(order, object), len(days)), "bar_date": each(days), "beta": beta.ravel(), "n_obs": each(mask.sum(axis=1)), "regime": each(names)}))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["symbol", "factor", "bar_date", "beta", "n_obs", "regime"])

    return _joined(returns, panel, order, label).groupBy("symbol").applyInPandas(fit, "symbol string, factor string, bar_date date, beta double, n_obs int, regime string")


def rolling_residuals(returns: DataFrame, panel: DataFrame, order: list[str], *, window: int = 60, least: int = 40, label: Column | None = None) -> DataFrame:
    """(symbol, bar_date, residual, strip_order, explained): the residual of each window's last row, which must be whole; explained has each rung's part."""

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for days, _, x, mask, whole in _windows(pdf, order, window, least):
            residual, shares = linalg.strip_of_windows(x[whole], mask[whole])
            parts.append(pd.DataFrame({"symbol": key[0], "bar_date": days[whole], "residual": residual, "strip_order": ">".join(order), "explained": list(shares)}))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["symbol", "bar_date", "residual", "strip_order", "explained"])

    return _joined(returns, panel, order, label).groupBy("symbol").applyInPandas(fit, "symbol string, bar_date date, residual double, strip_order string, explained array<double>")


def rolling_single(returns: DataFrame, factor: DataFrame, *, window: int = 60, least: int = 40) -> DataFrame:
    """(symbol, bar_date, beta, residual) on one factor by windows of rows, all in SQL: the closed form of the above without regimes."""
    df = returns.select("symbol", "bar_date", "ret").join(factor.select("bar_date", F.col("ret").alias("f")), "bar_date").where("ret is not null and f is not null")
    w = Window.partitionBy("symbol").orderBy("bar_date").rowsBetween(1 - window, 0)
    beta = F.try_divide(F.covar_samp("ret", "f").over(w), F.var_samp("f").over(w))
    out = df.withColumns({"n": F.count("*").over(w), "beta": beta, "residual": F.col("ret") - F.avg("ret").over(w) - beta * (F.col("f") - F.avg("f").over(w))})
    return out.where(F.col("n") >= least).select("symbol", "bar_date", "beta", "residual")


def variance_share(returns: DataFrame, residuals: DataFrame, least: int = 20, classes: DataFrame | None = None) -> DataFrame:
    """(symbol, universe_class, n_obs, r2) with r2 = 1 - var(residual) / var(return) over common days."""
    both = returns.select("symbol", "bar_date", "ret").join(residuals.select("symbol", "bar_date", "residual"), ["symbol", "bar_date"]).where("ret is not null and residual is not null")
    out = both.groupBy("symbol").agg(F.count("*").alias("n_obs"), F.var_samp("ret").alias("v"), F.var_samp("residual").alias("e")).where((F.col("n_obs") >= least) & (F.col("v") > 0))
    out = out.join(classes.select("symbol", "universe_class"), "symbol", "left") if classes is not None else out.withColumn("universe_class", F.lit(None).cast("string"))
    return out.select("symbol", "universe_class", "n_obs", (1 - F.col("e") / F.col("v")).alias("r2"))


def share_by_class(shares: DataFrame) -> DataFrame:
    q = lambda p: F.percentile("r2", F.lit(p))
    return shares.groupBy(F.coalesce("universe_class", F.lit("(unclassified)")).alias("universe_class")).agg(F.count("*").alias("n"), q(0.5).alias("median"), q(0.25).alias("p25"), q(0.75).alias("p75"))


def regime_break(betas: DataFrame, before: str, after: str, least: int = 5, nearest: int | None = None) -> DataFrame:
    """(symbol, factor, shift, pooled, ratio) of mean betas in two regimes; with ``nearest`` only so many days on either side of the break."""
    df = betas.where(F.col("regime").isin(before, after))
    if nearest:
        last = F.row_number().over(Window.partitionBy("symbol", "factor", "regime").orderBy(F.desc("bar_date")))
        first = F.row_number().over(Window.partitionBy("symbol", "factor", "regime").orderBy("bar_date"))
        df = df.withColumn("_n", F.when(F.col("regime") == before, last).otherwise(first)).where(F.col("_n") <= nearest)
    own = lambda r, f: f(F.when(F.col("regime") == r, F.col("beta")))
    sides = df.groupBy("symbol", "factor").agg(*(own(r, f).alias(f"{n}{i}") for i, r in enumerate((before, after)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    pooled = F.sqrt((F.col("v0") + F.col("v1")) / 2)
    return sides.where((F.col("n0") >= least) & (F.col("n1") >= least)).select("symbol", "factor", (F.col("m1") - F.col("m0")).alias("shift"), pooled.alias("pooled"), (F.abs(F.col("m1") - F.col("m0")) / (pooled + 1e-12)).alias("ratio"))


def break_by_factor(breaks: DataFrame) -> DataFrame:
    return breaks.groupBy("factor").agg(F.count("*").alias("n"), F.median(F.abs("shift")).alias("median_shift"), F.median("ratio").alias("median_ratio"))


#: Factors that hardly go together, on which a break shows.
PRIMARY = ("XU100", "USDTRY", "TRCDS5Y")


def regime_break_on(returns: DataFrame, factor_returns_: DataFrame, before: str, after: str, *, only: tuple[str, ...] = PRIMARY, window: int = 60, least: int = 40, least_days: int = 5, nearest: int | None = None, label: Column | None = None) -> DataFrame:
    """(factor, n, median_shift, median_ratio) of betas fitted anew on a few factors that hardly go together, where the whole panel's betas are too noisy to show a break."""
    order = [r[0] for r in factor_returns_.where(F.col("factor").isin(*only)).select("factor").distinct().collect()]  # as many as ``only`` at most
    order = [f for f in only if f in order]
    if not order:
        return break_by_factor(regime_break(returns.sparkSession.createDataFrame([], "symbol string, factor string, bar_date date, beta double, regime string"), before, after))
    panel = factor_panel(factor_returns_.where(F.col("factor").isin(*order)), order)
    return break_by_factor(regime_break(rolling_betas(returns, panel, order, window=window, least=least, label=label), before, after, least_days, nearest))


RegimeOf = Callable[[Column], Column]
