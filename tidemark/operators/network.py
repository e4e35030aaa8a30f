"""Correlation networks of residuals: pairs, false discovery control, filters and their stability."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linalg
from ..functions.planarity import is_planar

GATE = {"min_lift": 3.0, "min_jaccard": 0.10, "min_window_pairs": 3, "min_median_edges": 5}


def panel(values: DataFrame, value: str, least: int = 60) -> DataFrame:
    """(symbol, bar_date, x): the mean of repeated rows, of symbols with enough values."""
    df = values.where(F.col(value).isNotNull()).groupBy("symbol", "bar_date").agg(F.avg(value).alias("x"))
    return df.withColumn("_n", F.count("*").over(Window.partitionBy("symbol"))).where(F.col("_n") >= least).drop("_n")


def correlations(p: DataFrame, sectors: DataFrame | None = None, least: int = 60, extra: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, corr, n_obs) over the days both have; with sectors only pairs within one, which keeps the join small."""
    if sectors is not None:
        p = p.join(sectors.select("symbol", "sector").where("sector is not null"), "symbol")
    on = ["bar_date", *extra] + (["sector"] if sectors is not None else [])
    a, b = p.withColumnsRenamed({"symbol": "src", "x": "xa"}), p.withColumnsRenamed({"symbol": "dst", "x": "xb"})
    keys = [*extra, *(["sector"] if sectors is not None else []), "src", "dst"]
    return a.join(b, on).where("src < dst").groupBy(*keys).agg(F.corr("xa", "xb").alias("corr"), F.count("*").alias("n_obs")).where((F.col("n_obs") >= least) & F.col("corr").isNotNull() & ~F.isnan("corr"))


def sector_pairs(sectors: DataFrame) -> DataFrame:
    s = sectors.where("sector is not null")
    return s.select("sector", F.col("symbol").alias("src")).join(s.select("sector", F.col("symbol").alias("dst")), "sector").where("src < dst").select("sector", "src", "dst")


def t_statistic(corr: str = "corr", n: str = "n_obs"):
    return F.col(corr) * F.sqrt(F.try_divide((F.col(n) - 2).cast("double"), F.greatest(F.lit(1e-12), 1 - F.col(corr) * F.col(corr))))


def p_value(t: Column, df: Column) -> Column:
    """Two-sided, of Student's t; there is no such function in SQL."""

    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        p = linalg.t_two_sided(t.to_numpy(float, na_value=np.nan), df.to_numpy(float, na_value=np.nan))
        return pd.Series(p).astype("Float64").mask(np.isnan(p))  # no test, no value

    return F.pandas_udf(tail, "double")(t, df)


def benjamini_hochberg(df: DataFrame, p: str = "p_value", alpha: float = 0.05, by: tuple[str, ...] = (), ranges: int = 200) -> DataFrame:
    """With q_value and passed within each family; a NULL p is no test.

    Equal p-values have one q-value, so each is ranked once. Ranks come in ranges of p
    bounded by quantiles: a rank is the tests in the ranges before, and those up to it in
    its own; no family is sorted in one task.
    """
    family = F.struct(F.lit(0).alias("all"), *by)
    each = df.where(F.col(p).isNotNull()).groupBy(family.alias("_f"), F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = each.agg(F.percentile_approx("_p", shares, 100 * ranges)).first()[0] or []
    each = each.withColumn("_b", F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))).cast("array<double>"), lambda x: x <= F.col("_p"))))
    own = Window.partitionBy("_f", "_b").orderBy("_p")
    each = each.withColumn("_upto", F.sum("_n").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    in_order = Window.partitionBy("_f").orderBy("_b")  # as many rows as ranges
    sums = each.groupBy("_f", "_b").agg(F.sum("_n").alias("_n"))
    sums = sums.select("_f", "_b", F.coalesce(F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("_f")).alias("_m"))
    raw = each.join(sums, ["_f", "_b"]).select("_f", "_b", "_p", (F.col("_p") * F.col("_m") / (F.col("_before") + F.col("_upto"))).alias("_raw"))
    behind = raw.groupBy("_f", "_b").agg(F.min("_raw").alias("_least"))
    behind = behind.select("_f", "_b", F.min("_least").over(in_order.rowsBetween(1, Window.unboundedFollowing)).alias("_least"))
    q = raw.join(behind, ["_f", "_b"]).select("_f", "_p", F.least(F.lit(1.0), F.min("_raw").over(own.rowsBetween(0, Window.unboundedFollowing)), "_least").alias("q_value"))
    out = df.withColumns({"_f": family, "_p": F.col(p)}).join(q, ["_f", "_p"], "left")
    return out.select(*df.columns, "q_value", F.coalesce(F.col("q_value") <= alpha, F.lit(False)).alias("passed"))


def fdr_edges(corr: DataFrame, alpha: float = 0.05, least_corr: float = 0.0, by: tuple[str, ...] = ()) -> DataFrame:
    """The pairs that pass; the family is all tested pairs, before small correlations are left out."""
    df = corr.withColumn("t", t_statistic()).withColumn("p_value", p_value(F.col("t"), (F.col("n_obs") - 2).cast("double")))
    return benjamini_hochberg(df, alpha=alpha, by=by).where(F.col("passed") & (F.abs("corr") >= least_corr))


def distance(corr: str = "corr"):
    return F.sqrt(F.greatest(F.lit(0.0), 2 * (1 - F.col(corr))))


def shrunk(p: DataFrame, least: int = 60) -> DataFrame:
    """(group, src, dst, corr): Ledoit-Wolf correlation of each group over the days all its symbols have; too few days give nothing."""

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="bar_date", columns="symbol", values="x").dropna()
        if len(wide) < least or wide.shape[1] < 2:
            return pd.DataFrame(columns=["group", "src", "dst", "corr"])
        z = (wide - wide.mean()) / wide.std(ddof=1).replace(0, 1)
        cov = linalg.ledoit_wolf(z.to_numpy())
        d = np.sqrt(np.diag(cov))
        c, names = cov / np.outer(d, d), list(wide.columns)
        return pd.DataFrame([(key[0], names[i], names[j], float(c[i, j])) for i in range(len(names)) for j in range(i + 1, len(names))], columns=["group", "src", "dst", "corr"])

    return p.groupBy("group").applyInPandas(fit, "group string, src string, dst string, corr double")


def _tree(edges: pd.DataFrame) -> list[int]:
    """Rows of a spanning tree, smallest distances first."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for i, (a, b) in enumerate(zip(edges.src, edges.dst, strict=True)):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            kept.append(i)
    return kept


def spanning_tree(corr: DataFrame, by: str = "sector") -> DataFrame:
    """(by, src, dst, corr) of the minimum spanning tree of each group by the distance of correlations; ties by names."""

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["corr", "src", "dst"], ascending=[False, True, True]).reset_index(drop=True)
        return pdf.iloc[_tree(pdf)][[by, "src", "dst", "corr"]]

    return corr.select(by, "src", "dst", "corr").groupBy(by).applyInPandas(fit, f"{by} string, src string, dst string, corr double")


def planar_filter(corr: DataFrame, by: str = "sector") -> DataFrame:
    """(by, src, dst, corr) of the maximally filtered planar graph of each group: strongest pairs first, as long as it stays planar, 3 (n - 2) at most."""

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_a=pdf["corr"].abs()).sort_values(["_a", "src", "dst"], ascending=[False, True, True])
        n = len(set(pdf.src) | set(pdf.dst))
        most, edges, kept = max(n - 1, 3 * (n - 2)), [], []
        for i, (a, b) in enumerate(zip(pdf.src, pdf.dst, strict=True)):
            if len(kept) == most:
                break
            if is_planar([*edges, (a, b)]):
                edges.append((a, b))
                kept.append(i)
        return pdf.iloc[kept][[by, "src", "dst", "corr"]]

    return corr.select(by, "src", "dst", "corr").groupBy(by).applyInPandas(fit, f"{by} string, src string, dst string, corr double")


def windows(p: DataFrame, window: int, step: int) -> DataFrame:
    """The panel's rows once for each window of trading days they are in: window number ``w``, whole windows only."""
    days = p.select("bar_date").distinct().select("bar_date", (F.row_number().over(Window.partitionBy().orderBy("bar_date")) - 1).alias("d"), F.count("*").over(Window.partitionBy()).alias("total"))
    last = F.floor((F.col("total") - window) / step)
    spread = days.where(F.col("total") >= window).select("bar_date", F.explode(F.expr(f"filter(sequence(greatest(0, cast(floor((d - {window}) / {step}) as int)), cast(floor(d / {step}) as int)), w -> w * {step} <= d and d < w * {step} + {window})")).alias("w"), last.alias("_last"))
    return p.join(F.broadcast(spread.where(F.col("w") <= F.col("_last")).drop("_last")), "bar_date")  # trading days times windows they are in


def stability(edges: DataFrame, n_candidates: DataFrame) -> DataFrame:
    """(w, k_a, k_b, shared, jaccard, expected, lift, rho) for consecutive windows of edges (w, src, dst, corr)."""
    sizes = n_candidates.select("w", "n_candidates").join(edges.groupBy("w").agg(F.count("*").alias("k")), "w", "left").select("w", "n_candidates", F.coalesce("k", F.lit(0)).alias("k"))
    nxt = sizes.select((F.col("w") - 1).alias("w"), F.col("k").alias("k_b"))
    both = edges.select("w", "src", "dst", F.col("corr").alias("ca")).join(edges.select((F.col("w") - 1).alias("w"), "src", "dst", F.col("corr").alias("cb")), ["w", "src", "dst"])
    ranked = both
    for c in ("ca", "cb"):  # average ranks
        ties = Window.partitionBy("w", c)
        ranked = ranked.withColumn(f"r{c}", F.rank().over(Window.partitionBy("w").orderBy(c)) + (F.count("*").over(ties) - 1) / 2)
    shared = ranked.groupBy("w").agg(F.count("*").alias("shared"), F.when(F.count("*") >= 3, F.corr("rca", "rcb")).alias("rho"))
    out = sizes.join(nxt, "w").join(shared, "w", "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    union = F.col("k") + F.col("k_b") - F.col("shared")
    jaccard = F.when(union == 0, F.lit(1.0)).otherwise(F.col("shared") / union)
    overlap = F.col("k") * F.col("k_b") / F.col("n_candidates")
    expected = F.coalesce(F.try_divide(overlap, F.col("k") + F.col("k_b") - overlap), F.lit(0.0))
    out = out.withColumns({"jaccard": jaccard, "expected": expected})
    return out.select("w", F.col("k").alias("k_a"), "k_b", "shared", "jaccard", "expected", F.when(F.col("expected") > 0, F.col("jaccard") / F.col("expected")).otherwise(F.lit(float("inf"))).alias("lift"), "rho")


def stability_summary(table: DataFrame) -> DataFrame:
    finite = F.when(F.col("lift") < float("inf"), F.col("lift"))
    return table.agg(F.count("*").alias("n_pairs"), F.median("jaccard").alias("median_jaccard"), F.median(finite).alias("median_lift"), F.count_if(F.col("lift") == float("inf")).alias("n_infinite"), F.median(F.col("k_a").cast("double")).alias("median_edges"), F.median("rho").alias("median_rho"))


def gate(summary: DataFrame, limits: dict = GATE) -> DataFrame:
    """(go, failed): all four checks must hold; a NULL figure fails."""
    checks = {"lift": ("median_lift", limits["min_lift"]), "jaccard": ("median_jaccard", limits["min_jaccard"]), "window_pairs": ("n_pairs", limits["min_window_pairs"]), "edges": ("median_edges", limits["min_median_edges"])}
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(F.col(c) >= least, F.lit(False)), F.lit(n)) for n, (c, least) in checks.items())))
    return summary.select("*", (F.size(failed) == 0).alias("go"), F.array_join(failed, ",").alias("failed"))


def random_jaccard(a: int, b: int, candidates: int) -> float:
    """Of two random edge sets of these sizes, as expected."""
    shared = a * b / candidates if candidates else 0.0
    return shared / (a + b - shared) if a + b - shared else 0.0
