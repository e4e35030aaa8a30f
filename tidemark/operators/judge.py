"""Is a backtest better than luck: Sharpe statistics, their deflation, and overfitting."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Fabrication
from ..functions.linalg import NORMAL
from .books import sharpe

EULER = 0.5772156649015329


def moments(pnl: DataFrame, *keys: str, value: str = "net") -> DataFrame:
    """(keys, n, sharpe, skew, kurtosis): bias-corrected skew and non-excess kurtosis."""
    n = F.count(value)
    g1, g2 = F.skewness(value), F.kurtosis(value)
    skew = F.when(n >= 3, g1 * F.sqrt((n * (n - 1)).cast("double")) / (n - 2))
    kurt = F.when(n >= 4, F.try_divide((n - 1).cast("double"), ((n - 2) * (n - 3)).cast("double")) * ((n + 1) * g2 + 6) + 3).otherwise(g2 + 3)
    return pnl.groupBy(*keys).agg(n.alias("n"), sharpe(value).alias("sharpe"), skew.alias("skew"), kurt.alias("kurtosis"))


def probabilistic_sharpe(sr: float, n: int, skew: float, kurtosis: float, against: float = 0.0) -> float | None:
    """That the true ratio exceeds ``against``."""
    spread = 1 - skew * sr + (kurtosis - 1) / 4 * sr * sr
    return NORMAL.cdf((sr - against) * math.sqrt(n - 1) / math.sqrt(spread)) if n > 1 and spread > 0 else None


def expected_best(variance: float, trials: int) -> float:
    """The best Sharpe ratio of so many skilless trials, as expected."""
    if trials < 1:
        raise Fabrication("the number of trials is unknown")
    if trials == 1 or variance <= 0:
        return 0.0
    return math.sqrt(variance) * ((1 - EULER) * NORMAL.inv_cdf(1 - 1 / trials) + EULER * NORMAL.inv_cdf(1 - 1 / (trials * math.e)))


def deflated_sharpe(sr: float, n: int, skew: float, kurtosis: float, trials: int, *, variance: float | None = None, trial_sharpes: list[float] | None = None, confidence: float = 0.95) -> dict:
    if variance is None:
        good = [s for s in trial_sharpes or [] if s is not None and math.isfinite(s)]
        mean = sum(good) / len(good) if good else 0.0
        variance = sum((s - mean) ** 2 for s in good) / (len(good) - 1) if len(good) > 1 else (1 + sr * sr / 2) / n
    best = expected_best(variance, trials)
    dsr = probabilistic_sharpe(sr, n, skew, kurtosis, best)
    return {"dsr": dsr, "sr_observed": sr, "sr_benchmark": best, "n_obs": n, "n_trials": trials, "passes": dsr is not None and dsr > confidence}


def overfitting(pnl: DataFrame, blocks: int = 10, value: str = "net") -> DataFrame:
    """(combo, winner, rank, logit): combinatorially symmetric cross-validation of variants over equal blocks of days.

    In each half of the blocks the best variant (first of equals) is taken; its rank in
    the other half among k gives the logit of rank / (k + 1). Days beyond whole blocks go.
    """
    if blocks < 2 or blocks % 2:
        raise ValueError("blocks come in even numbers")
    days = pnl.select("bar_date").distinct().select("bar_date", (F.row_number().over(Window.partitionBy().orderBy("bar_date")) - 1).alias("d"), F.count("*").over(Window.partitionBy()).alias("n"))
    size = F.floor(F.col("n") / blocks)
    dealt = days.withColumn("block", F.floor(F.col("d") / size)).where(F.col("block") < blocks).select("bar_date", "block")
    sums = pnl.join(F.broadcast(dealt), "bar_date").groupBy("variant", "block").agg(F.count(value).alias("c"), F.sum(value).alias("s1"), F.sum(F.col(value) * F.col(value)).alias("s2"))
    combos = pnl.sparkSession.createDataFrame([(i, list(c)) for i, c in enumerate(combinations(range(blocks), blocks // 2))], "combo int, ins array<int>")  # C(blocks, blocks / 2) rows
    spread = sums.join(F.broadcast(combos))
    inside = F.array_contains("ins", F.col("block").cast("int"))
    total = spread.groupBy("combo", "variant", inside.alias("inside")).agg(F.sum("c").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    mean = F.col("s1") / F.col("n")
    var = F.try_divide(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.col("n") - 1)
    ratio = F.when(var > 1e-24, mean / F.sqrt(var))
    sides = total.groupBy("combo", "variant").agg(F.max(F.when(F.col("inside"), ratio)).alias("sr_in"), F.max(F.when(~F.col("inside"), ratio)).alias("sr_out"))
    by = Window.partitionBy("combo")
    ranked = sides.withColumns({"_w": F.row_number().over(by.orderBy(F.col("sr_in").desc_nulls_last(), "variant")), "rank": F.row_number().over(by.orderBy(F.col("sr_out").asc_nulls_first(), "variant")), "k": F.count("*").over(by)})
    share = F.col("rank") / (F.col("k") + 1)
    return ranked.where("_w = 1").select("combo", F.col("variant").alias("winner"), "rank", F.ln(share / (1 - share)).alias("logit"))


def overfitting_summary(table: DataFrame) -> DataFrame:
    return table.agg(F.avg((F.col("logit") <= 0).cast("int")).alias("pbo"), F.count("*").alias("n_splits"), F.median("logit").alias("median_logit"))


def safe_blocks(days: int, wanted: int = 10) -> int | None:
    """An even number of blocks the days suffice for, or none."""
    n = min(wanted, days)
    n -= n % 2
    return n if n >= 2 else None


def verdict(candidate: float | None, baselines: dict[str, float | None], dsr: dict | None, pbo: float | None, *, pbo_limit: float = 0.5, capacity_ok: bool = True) -> dict:
    """Promoted only if every check holds; an unknown figure fails its check, an unknown baseline is beaten by a known candidate."""
    best = max(baselines, key=lambda b: (baselines[b] is not None, baselines[b] or 0.0)) if baselines else None
    beats = candidate is not None and all(b is None or candidate > b for b in baselines.values())
    checks = {"beats_baselines": beats, "dsr": bool(dsr and dsr["passes"]), "pbo": pbo is not None and pbo < pbo_limit, "capacity": capacity_ok}
    return {"promoted": all(checks.values()), "failed_checks": [c for c, ok in checks.items() if not ok], "beats_baselines": beats, "best_baseline": best, "candidate_net_sharpe": candidate, "dsr": dsr and dsr["dsr"], "pbo": pbo}


def registry_hygiene(registry: DataFrame) -> DataFrame:
    """(signal_id, knowledge_date, problem) of entries that cannot be right."""
    p = F.array_compact(F.array(
        F.when(F.col("promoted") & ~F.coalesce(F.col("beat_baselines"), F.lit(False)), F.lit("promoted_without_beating_baselines")),
        F.when(F.coalesce(F.col("n_trials"), F.lit(0)) < 1, F.lit("n_trials_below_one")),
        F.when((F.col("pbo") < 0) | (F.col("pbo") > 1), F.lit("pbo_out_of_range")),
        F.when(F.col("deflated_sharpe").isNull() | F.isnan("deflated_sharpe"), F.lit("dsr_not_finite")),
    ))
    return registry.select("signal_id", "knowledge_date", F.explode(p).alias("problem"))


def latest_verdicts(registry: DataFrame) -> DataFrame:
    return registry.groupBy("signal_id").agg(F.count("*").alias("versions"), F.max_by("promoted", "knowledge_date").alias("promoted"), F.max("knowledge_date").alias("knowledge_date"))
