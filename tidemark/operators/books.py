"""Signals, weights and backtests on long panels (symbol, bar_date, ...).

Row windows count a panel's days, so panels are made dense first (``dense``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Books and costs.
BOOKS = (("research", False, False, False, False, 1.0), ("venue_feasible", True, True, False, True, 1.0), ("stress", True, False, True, True, 3.0))
COST_BPS, BORROW_BPS, PERIODS = 10.0, 100.0, 252
TINY = 1e-12


def dense(panel: DataFrame, value: str) -> DataFrame:
    """Every symbol on every day of the panel; NULL where it has no value. The days are few and are sent to all tasks as one list."""
    days = panel.agg(F.array_sort(F.collect_set("bar_date")).alias("_days"))
    grid = panel.select("symbol").distinct().join(F.broadcast(days)).select("symbol", F.explode("_days").alias("bar_date"))
    return grid.join(panel.select("symbol", "bar_date", value), ["symbol", "bar_date"], "left")


def aligned(weights: DataFrame, other: DataFrame) -> DataFrame:
    """The weights with another panel's columns on their symbols and days; what it lacks is NULL, which every rule takes as neutral."""
    return weights.join(other, ["symbol", "bar_date"], "left")


def signal_panels(panel: DataFrame, returns: DataFrame, shorts: DataFrame | None = None, value: str = "x") -> DataFrame:
    """(symbol, bar_date, x, ret, is_limit_lock, short_eligible) on the whole grid of a residual panel.

    Of several returns of a day the mean counts; a day is locked if any of them says so, a
    name cannot be sold short if any row says so. Unknown stays NULL.
    """
    own = returns.groupBy("symbol", "bar_date").agg(F.avg("ret").alias("ret"), F.bool_or("limit_lock_adj").alias("is_limit_lock"))
    df = aligned(dense(panel, value), own)
    if shorts is None:
        return df.withColumn("short_eligible", F.lit(None).cast("boolean"))
    return aligned(df, shorts.groupBy("symbol", "bar_date").agg(F.bool_and("short_eligible").alias("short_eligible")))


def _trail(length: int, keys: tuple[str, ...] = ("symbol",)):
    return Window.partitionBy(*keys).orderBy("bar_date").rowsBetween(1 - length, 0)


def _lag(c: Column, keys: tuple[str, ...] = ("symbol",)) -> Column:
    return F.lag(c).over(Window.partitionBy(*keys).orderBy("bar_date"))


def _enough(c: str, length: int, agg, keys: tuple[str, ...] = ("symbol",)) -> Column:
    """A trailing aggregate that needs half the window's values, two at least."""
    return F.when(F.count(c).over(_trail(length, keys)) >= max(2, length // 2), agg(F.col(c)).over(_trail(length, keys)))


def dollar_neutral(df: DataFrame, score: str, weight: str = "weight", by: tuple[str, ...] = ("bar_date",)) -> DataFrame:
    """Weights of a day: demeaned scores over their absolute sum; all zero if nothing is left. A NULL score weighs 0 and does not enter the mean."""
    day = Window.partitionBy(*by)
    centred = F.col(score) - F.avg(score).over(day)
    df = df.withColumn("_c", centred)
    gross = F.sum(F.abs("_c")).over(day)
    return df.withColumn(weight, F.when(gross > TINY, F.coalesce(F.col("_c") / gross, F.lit(0.0))).otherwise(F.lit(0.0))).drop("_c")


def momentum(panel: DataFrame, lookback: int = 20) -> DataFrame:
    """score: yesterday's trailing mean return."""
    mean = F.when(F.count("ret").over(_trail(lookback)) >= lookback // 2, F.avg("ret").over(_trail(lookback)))
    return panel.withColumn("_m", mean).withColumn("score", _lag(F.col("_m"))).drop("_m")


def trailing_beta(panel: DataFrame, factor: DataFrame | None = None, lookback: int = 60) -> DataFrame:
    """score: yesterday's trailing beta to a factor (the mean over symbols by default).

    The covariance is over days with both values, the variance over all of the factor's.
    """
    f = factor.select("bar_date", F.col("ret").alias("f")) if factor is not None else panel.groupBy("bar_date").agg(F.avg("ret").alias("f"))
    df = panel.join(f, "bar_date", "left")
    least = lookback // 2
    both = F.when(F.col("ret").isNotNull() & F.col("f").isNotNull(), F.lit(1))
    cov = F.when(F.count(both).over(_trail(lookback)) >= least, F.covar_samp("ret", "f").over(_trail(lookback)))
    var = F.when(F.count("f").over(_trail(lookback)) >= least, F.var_samp("f").over(_trail(lookback)))
    return df.withColumn("_b", F.try_divide(cov, F.when(var > 0, var))).withColumn("score", _lag(F.col("_b"))).drop("_b", "f")


def own_event(panel: DataFrame, lookback: int = 20, least_z: float = 2.0) -> DataFrame:
    """score: fades yesterday's move if it was large against its own past."""
    least = lookback // 2
    n = F.count("ret").over(_trail(lookback))
    z = F.try_divide(F.col("ret") - F.avg("ret").over(_trail(lookback)), F.when(n >= least, F.stddev_samp("ret").over(_trail(lookback))))
    return panel.withColumn("_z", z).withColumn("score", _lag(F.when(F.abs("_z") >= least_z, -F.signum("_z")).otherwise(F.when(F.col("_z").isNotNull(), F.lit(0.0))))).drop("_z")


def comoved(panel: DataFrame, edges: DataFrame, value: str = "x") -> DataFrame:
    """(symbol, bar_date, predicted): neighbours' values weighted by signed correlation over the sum of weights; a missing neighbour adds to neither, its weight stays."""
    both = edges.select(F.col("src").alias("symbol"), F.col("dst").alias("peer"), "corr").unionByName(edges.select(F.col("dst").alias("symbol"), F.col("src").alias("peer"), "corr"))
    weight = both.groupBy("symbol").agg(F.sum(F.abs("corr")).alias("_w"))
    peers = panel.select(F.col("symbol").alias("peer"), "bar_date", F.col(value).alias("_v"))
    sums = both.join(peers, "peer").groupBy("symbol", "bar_date").agg(F.sum(F.col("corr") * F.coalesce("_v", F.lit(0.0))).alias("_s"))
    return sums.join(weight, "symbol").select("symbol", "bar_date", F.try_divide("_s", "_w").alias("predicted"))


def spread(panel: DataFrame, edges: DataFrame, value: str = "x") -> DataFrame:
    """spread: a value less what its neighbours predict; NULL without neighbours."""
    return panel.join(comoved(panel, edges, value), ["symbol", "bar_date"], "left").withColumn("spread", F.col(value) - F.col("predicted")).drop("predicted")


def schedule(days: DataFrame, edge_window: int = 250, step: int = 60) -> DataFrame:
    """(refit, first, last, effective, until): windows of trading days, and the days on which each one's edges are used."""
    n = days.select("bar_date").distinct().select("bar_date", (F.row_number().over(Window.partitionBy().orderBy("bar_date")) - 1).alias("d"))
    ends = n.where((F.col("d") >= edge_window) & ((F.col("d") - edge_window) % step == 0)).select(((F.col("d") - edge_window) / step).cast("int").alias("refit"), F.col("d").alias("e"), F.col("bar_date").alias("effective"))
    first = n.select((F.col("d") + edge_window).alias("e"), F.col("bar_date").alias("first"))
    last = n.select((F.col("d") + 1).alias("e"), F.col("bar_date").alias("last"))
    until = F.lead("effective").over(Window.partitionBy().orderBy("refit"))
    return ends.join(first, "e").join(last, "e").select("refit", "first", "last", "effective", until.alias("until"))


def fade_scores(panel: DataFrame, choices: list[tuple[str, int, float]], value: str = "spread", lookback: int = 60, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(variant, score) of each row for each choice of (variant, accum, least_z): minus yesterday's z-score of the accumulated spread.

    All accumulations and z-scores are windows over the same rows, so however many choices
    there are, the panel is dealt and sorted once. One day accumulated is the spread
    itself. Where a threshold is set, a smaller or unknown z-score fades nothing (0);
    without one an unknown one is NULL.
    """
    df, accums = panel, sorted({n for _, n, _ in choices})
    for n in accums:
        df = df.withColumn(f"_a{n}", _enough(value, n, F.sum, keys) if n > 1 else F.col(value))
    for n in accums:
        std = _enough(f"_a{n}", lookback, F.stddev_samp, keys)
        df = df.withColumn(f"_z{n}", F.struct(F.try_divide(F.col(f"_a{n}") - _enough(f"_a{n}", lookback, F.avg, keys), F.when(std > 0, std)).alias("z")))
    df = df.withColumns({f"_y{n}": _lag(F.col(f"_z{n}"), keys) for n in accums})  # NULL on the first day only

    def score(n: int, least_z: float) -> Column:
        z = F.col(f"_y{n}.z")
        return F.when(F.col(f"_y{n}").isNotNull(), F.when(F.abs(z) >= least_z, -z).otherwise(F.lit(0.0)) if least_z > 0 else -z)

    each = F.explode(F.array(*(F.struct(F.lit(name).alias("variant"), score(n, least_z).alias("score")) for name, n, least_z in choices)))
    return df.withColumn("_c", each).select(*panel.columns, "_c.variant", "_c.score")


def fade_signal(panel: DataFrame, value: str = "spread", accum: int = 5, lookback: int = 60, least_z: float = 0.0) -> DataFrame:
    """score of one choice: see ``fade_scores``."""
    return fade_scores(panel, [("", accum, least_z)], value, lookback).drop("variant")


def grid(spark: SparkSession, **choices: list) -> DataFrame:
    """One row for each combination, numbered; the choices are literals."""
    df = spark.range(1)
    for name, values in choices.items():
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return df.drop("id").withColumn("variant", F.concat_ws("|", *(F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in choices)))


def walk_forward(n: int, n_splits: int = 5, purge: int = 0, embargo: int = 0) -> list[dict]:
    """Anchored splits of days 0 to n - 1: train on [0, train_end) less the embargoed stretch before the preceding block, test on [test_lo, test_hi)."""
    fold = n // (n_splits + 1)
    out = []
    for i in range(n_splits):
        lo = fold * (i + 1)
        hi = n if i == n_splits - 1 else lo + fold
        banned = (max(0, lo - fold - embargo), max(0, lo - fold)) if embargo else (0, 0)
        if fold and lo - purge > 0:
            out.append({"split": i, "train_end": max(0, lo - purge), "ban_lo": banned[0], "ban_hi": banned[1], "test_lo": lo, "test_hi": hi})
    return out


def books(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BOOKS), "book string, apply_costs boolean, enforce_short boolean, ban_shorts boolean, block_lock boolean, cost_multiplier double")


def constrain(weights: DataFrame, shorts: str = "short_eligible", lock: str = "is_limit_lock") -> DataFrame:
    """held: the weight after the book's rules: shorts are cut where banned, then a locked name keeps its last weight (0 if it has none). Weights are not scaled again.

    ``weights`` has (book columns, symbol, bar_date, weight) and optionally the two flags.
    """
    flag = lambda c: F.col(c) if c in weights.columns else F.lit(None).cast("boolean")
    explicit = F.coalesce(~flag(shorts), F.lit(False))
    cut = F.when(F.col("ban_shorts") | (F.col("enforce_short") & explicit), F.greatest(F.col("weight"), F.lit(0.0))).otherwise(F.col("weight"))
    locked = F.col("block_lock") & F.coalesce(flag(lock), F.lit(False))
    df = weights.withColumns({"_w": F.coalesce(cut, F.lit(0.0)), "_l": locked})
    past = Window.partitionBy("book", "symbol").orderBy("bar_date").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("held", F.coalesce(F.last(F.when(~F.col("_l"), F.col("_w")), ignorenulls=True).over(past), F.lit(0.0))).drop("_w", "_l")


def daily_pnl(held: DataFrame, forward: str = "fwd", scale: float | Column = 1.0, keys: tuple[str, ...] = ("book",)) -> DataFrame:
    """(keys, bar_date, gross, turnover, cost, borrow, net, exposure): a missing forward return counts as 0; the first day trades from nothing."""
    before = F.lag("held", 1, 0.0).over(Window.partitionBy(*keys, "symbol").orderBy("bar_date"))
    df = held.withColumn("_t", F.abs(F.col("held") - before))
    on = F.when(F.col("apply_costs"), F.col("cost_multiplier")).otherwise(0.0)
    sums = df.groupBy(*keys, "bar_date").agg(F.sum(F.col("held") * F.coalesce(F.col(forward), F.lit(0.0))).alias("gross"), F.sum("_t").alias("turnover"), F.sum(F.greatest(-F.col("held"), F.lit(0.0))).alias("_short"), F.sum(F.abs("held")).alias("exposure"), F.max(on).alias("_on"))
    scale = scale if isinstance(scale, Column) else F.lit(scale)
    cost, borrow = F.col("turnover") * COST_BPS / 1e4 * F.col("_on"), F.col("_short") * BORROW_BPS / 1e4 / PERIODS * F.col("_on")
    return sums.select(*keys, "bar_date", (F.col("gross") * scale).alias("gross"), "turnover", (cost * scale).alias("cost"), (borrow * scale).alias("borrow"), ((F.col("gross") - cost - borrow) * scale).alias("net"), "exposure")


def sharpe(c: str) -> Column:
    """Mean over standard deviation of the finite values; NULL for fewer than two or no spread."""
    x = F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    return F.when((F.count(x) >= 2) & (F.stddev_samp(x) > TINY), F.avg(x) / F.stddev_samp(x))


def performance(pnl: DataFrame, *keys: str) -> DataFrame:
    return pnl.groupBy(*keys).agg(F.count("*").alias("n_periods"), sharpe("gross").alias("gross_sharpe"), sharpe("net").alias("net_sharpe"), F.sum("net").alias("total_net"), F.avg("turnover").alias("avg_turnover"), F.avg("exposure").alias("avg_exposure"))


def run_books(weights: DataFrame, spark: SparkSession) -> DataFrame:
    """Daily results of the same weights in all books."""
    return daily_pnl(constrain(weights.join(F.broadcast(books(spark)))))  # three rows are broadcast


def capacity(pnl_of_book: DataFrame, scales: tuple[float, ...] = (0.5, 1.0, 2.0, 5.0, 10.0)) -> DataFrame:
    """(scale, net_sharpe, total_net) of one book's held weights at several sizes."""
    df = pnl_of_book.withColumn("scale", F.explode(F.array(*map(F.lit, scales))))
    return df.withColumn("net", F.col("net") * F.col("scale")).groupBy("scale").agg(sharpe("net").alias("net_sharpe"), F.sum("net").alias("total_net"))


def pick_variants(pnl: DataFrame, splits: list[dict]) -> DataFrame:
    """(split, variant, train_sharpe): each split's best variant in training; none counts as worst, ties go to the first name."""
    spark = pnl.sparkSession
    folds = spark.createDataFrame([tuple(s.values()) for s in splits], "split int, train_end int, ban_lo int, ban_hi int, test_lo int, test_hi int")
    day = pnl.select("bar_date").distinct().withColumn("d", F.row_number().over(Window.partitionBy().orderBy("bar_date")) - 1)
    train = pnl.join(day, "bar_date").join(F.broadcast(folds), (F.col("d") < F.col("train_end")) & ~((F.col("d") >= F.col("ban_lo")) & (F.col("d") < F.col("ban_hi"))))
    by = train.groupBy("split", "variant").agg(sharpe("net").alias("train_sharpe"))
    best = F.row_number().over(Window.partitionBy("split").orderBy(F.col("train_sharpe").desc_nulls_last(), "variant"))
    return by.withColumn("_n", best).where("_n = 1").drop("_n")


def spliced(pnl: DataFrame, picks: DataFrame, splits: list[dict]) -> DataFrame:
    """(bar_date, split, variant, net): out of sample, each test block from its split's pick."""
    spark = pnl.sparkSession
    folds = spark.createDataFrame([(s["split"], s["test_lo"], s["test_hi"]) for s in splits], "split int, test_lo int, test_hi int")
    day = pnl.select("bar_date").distinct().withColumn("d", F.row_number().over(Window.partitionBy().orderBy("bar_date")) - 1)
    chosen = F.broadcast(folds.join(picks.select("split", "variant"), "split"))
    rows = pnl.join(day, "bar_date").join(chosen.withColumnRenamed("variant", "pick"), (F.col("variant") == F.col("pick")) & (F.col("d") >= F.col("test_lo")) & (F.col("d") < F.col("test_hi")))
    return rows.select("bar_date", "split", "variant", "net")
