"""Returns and flags on bars. A gap makes a return NULL; nothing is filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAND, TOLERANCE = 0.10, 0.003

#: Accounting regimes by fiscal year.
REGIMES = ((2022, "nominal_pre2023"), (2024, "ias29_2023_2024"), (9999, "suspended_2025_2027"))


def _in_order(by: str | None = "symbol", at: str = "bar_date"):
    return (Window.partitionBy(by) if by else Window.partitionBy()).orderBy(at)


def change(value: str | Column, by: str = "symbol", at: str = "bar_date", method: str = "simple") -> Column:
    """Return of a level by its method: simple, log (NULL unless positive), diff, or level itself."""
    now = F.col(value) if isinstance(value, str) else value
    before = F.lag(now).over(_in_order(by, at))
    if method == "simple":
        return F.try_divide(now, before) - 1
    if method == "log":
        return F.when((now > 0) & (before > 0), F.ln(F.try_divide(now, before)))
    if method == "diff":
        return now - before
    if method == "level":
        return now
    raise ValueError(f"no method {method!r}")


def limit_locks(bars: DataFrame, band: float = BAND, tolerance: float = TOLERANCE) -> DataFrame:
    """is_limit_lock: the close moved by just the daily band."""
    move = F.abs(change("close"))
    return bars.withColumn("is_limit_lock", F.coalesce(F.abs(move - band) <= tolerance, F.lit(False)))


def stale(bars: DataFrame, quantity: str = "quantity") -> DataFrame:
    """is_stale: nothing was traded; without the column no bar is."""
    flag = F.coalesce(F.expr(f"try_cast(`{quantity}` as double)") == 0, F.lit(True)) if quantity in bars.columns else F.lit(False)
    return bars.withColumn("is_stale", flag)


def censor(df: DataFrame, returns: list[str], lock: str = "is_limit_lock", flag: str = "limit_lock_adj") -> DataFrame:
    """Returns in a run of locked days are NULL; the day that resolves it has them compounded (NULL if any is)."""
    before = _in_order().rowsBetween(Window.unboundedPreceding, -1)
    locked = F.coalesce(F.col(lock), F.lit(False))
    df = df.withColumn("_run", F.coalesce(F.sum((~locked).cast("int")).over(before), F.lit(0)))
    run = Window.partitionBy("symbol", "_run")
    touched = F.max(locked.cast("int")).over(run) == 1
    for r in returns:
        whole = F.when(F.count(r).over(run) == F.count("*").over(run), F.product(1 + F.col(r)).over(run) - 1)
        df = df.withColumn(f"_{r}", F.when(locked, F.lit(None)).otherwise(F.when(touched, whole).otherwise(F.col(r))))
    df = df.withColumn(flag, touched)
    for r in returns:
        df = df.withColumn(r, F.col(f"_{r}")).drop(f"_{r}")
    return df.drop("_run")


def dividend_yields(dividends: DataFrame, bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbol, bar_date, yield) from cash over the raw close of the ex-date, and the dividends refused for want of one."""
    raw = bars.select("symbol", "bar_date", F.col("close").alias("raw"))
    both = dividends.join(raw, ["symbol", "bar_date"], "left")
    return both.where("raw > 0").groupBy("symbol", "bar_date").agg(F.sum(F.col("cash") / F.col("raw")).alias("yield")), both.where("raw is null or raw <= 0").drop("raw")


def total_returns(bars: DataFrame, fx: DataFrame | None = None, cpi: DataFrame | None = None, yields: DataFrame | None = None) -> DataFrame:
    """Nominal, dollar and real returns with dividends, censored over the full series; then each symbol's first bar goes."""
    df = bars if "is_limit_lock" in bars.columns else limit_locks(bars)
    none = F.lit(None).cast("double")
    df = df.join(fx.select("bar_date", F.col("value").alias("fx")), "bar_date", "left") if fx is not None else df.withColumn("fx", none)
    df = df.join(cpi.select("bar_date", F.col("value").alias("cpi")), "bar_date", "left") if cpi is not None else df.withColumn("cpi", none)
    df = df.join(yields.select("symbol", "bar_date", "yield"), ["symbol", "bar_date"], "left") if yields is not None else df.withColumn("yield", none)
    cash = F.coalesce("yield", F.lit(0.0))
    nominal = change("close") + cash
    usd = change(F.try_divide(F.col("close"), F.col("fx"))) + cash
    real = F.try_divide(1 + nominal, 1 + change("cpi")) - 1
    df = df.select("symbol", "bar_date", "is_limit_lock", nominal.alias("ret_nominal_try"), usd.alias("ret_usd"), real.alias("ret_real_try"), F.row_number().over(_in_order()).alias("_n"))
    return censor(df, ["ret_nominal_try", "ret_usd", "ret_real_try"]).where("_n > 1").drop("_n", "is_limit_lock")


def accounting_regime(period: Column) -> Column:
    """Regime of a YYYYMM period's fiscal year; NULL where there is no year."""
    year = F.substring(period, 1, 4).try_cast("int")
    out = F.lit(None).cast("string")
    for last, name in reversed(REGIMES):
        out = F.when(year <= last, name).otherwise(out)
    return F.when(year.isNotNull(), out)


def guarded_growth(df: DataFrame, now: str, period: str, base: str, base_period: str, converted: Column | None = None) -> DataFrame:
    """growth and status: refused across accounting regimes unless converted, and over a base of zero."""
    converted = F.lit(False) if converted is None else converted
    straddles = (accounting_regime(F.col(period)) != accounting_regime(F.col(base_period))) & ~converted
    status = F.when(straddles, "straddle").when(F.col(base) == 0, "zero_base").when(F.col(now).isNull() | F.col(base).isNull(), "missing").otherwise("ok")
    return df.withColumn("status", status).withColumn("growth", F.when(F.col("status") == "ok", F.try_divide(F.col(now), F.col(base)) - 1))
