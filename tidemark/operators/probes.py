"""Feasibility probes: lead-lag between sectors, and how much of disclosed new business can be traded."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity as I
from ..sources import parsers

HORIZONS = (1, 5, 10, 21)
LEAST_NAMES, RIDGE = 8, 5.0
#: A pair is confirmed if its correlations have one sign and are at least so large in the first and the second half.
CONFIRM_TRAIN, CONFIRM_TEST = 0.1, 0.15
#: Suppliers and customers by parts of their sectors' names.
PAIRS = (
    ("ELEKTRİK GAZ VE BUHAR", "METAL EŞYA MAKİNE"), ("ELEKTRİK GAZ VE BUHAR", "ANA METAL SANAYİ"), ("ANA METAL SANAYİ", "METAL EŞYA MAKİNE"), ("KİMYA İLAÇ PETROL", "TEKSTİL"),
    ("KİMYA İLAÇ PETROL", "TAŞ VE TOPRAĞA"), ("BANKALAR", "HOLDİNGLER"), ("ANA METAL SANAYİ", "İNŞAAT"), ("TAŞ VE TOPRAĞA", "İNŞAAT"),
)


def sector_means(residuals: DataFrame, sectors: DataFrame, least_names: int = LEAST_NAMES) -> DataFrame:
    """(sector, bar_date, x): mean residual of days with enough names."""
    both = residuals.where("residual is not null").join(sectors.where("sector is not null").select("symbol", "sector"), "symbol")
    return both.groupBy("sector", "bar_date").agg(F.avg("residual").alias("x"), F.count("*").alias("n")).where(F.col("n") >= least_names).select("sector", "bar_date", "x")


def blocks(means: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(horizon, sector, b, z, n_blocks, half): sums over whole blocks of days, scaled by each sector's first half; a sector without a day adds 0.

    The days are those on which any sector has a mean; a last block that is not whole is
    left out. ``half`` is the number of blocks in the first half.
    """
    days = means.select("bar_date").distinct().withColumn("d", F.row_number().over(Window.orderBy("bar_date")) - 1)  # one row a day
    total = days.agg(F.count("*").alias("total"))
    dealt = days.join(F.broadcast(total)).select("bar_date", "d", "total", F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))
    dealt = dealt.select("bar_date", "horizon", F.floor(F.col("d") / F.col("horizon")).alias("b"), F.floor(F.col("total") / F.col("horizon")).alias("n_blocks")).where("b < n_blocks")
    sums = means.join(F.broadcast(dealt), "bar_date").groupBy("horizon", "sector", "b").agg(F.sum("x").alias("s"))  # days times horizons
    grid = means.select("sector").distinct().join(F.broadcast(dealt.select("horizon", "b", "n_blocks").distinct()))  # sectors times blocks, as the matrix has
    full = grid.join(sums, ["horizon", "sector", "b"], "left").withColumn("s", F.coalesce("s", F.lit(0.0))).withColumn("half", F.floor(F.col("n_blocks") / 2))
    first = F.when(F.col("b") < F.col("half"), F.col("s"))
    by = Window.partitionBy("horizon", "sector")
    return full.withColumns({"_m": F.avg(first).over(by), "_d": F.stddev_pop(first).over(by)}).select("horizon", "sector", "b", ((F.col("s") - F.col("_m")) / (F.col("_d") + 1e-9)).alias("z"), "n_blocks", "half")


def _steps(z: DataFrame) -> DataFrame:
    """Each block with the next one of its half: (horizon, sector, b, z, next, test)."""
    nxt = F.lead("z").over(Window.partitionBy("horizon", "sector").orderBy("b"))
    out = z.withColumn("next", nxt).withColumn("test", F.col("b") >= F.col("half")).where("next is not null and b != half - 1")
    usable = (F.col("half") - 1 >= 6) & (F.col("n_blocks") - F.col("half") - 1 >= 5)
    return out.where(usable)


def lead_lag_pairs(z: DataFrame, pairs: DataFrame) -> DataFrame:
    """(horizon, supplier, customer, train_corr, test_corr, confirmed) of sector pairs; horizons with too few blocks have no rows."""
    s = _steps(z)
    a = s.select("horizon", "b", "test", F.col("sector").alias("supplier"), F.col("z").alias("x"))
    c = s.select("horizon", "b", F.col("sector").alias("customer"), F.col("next").alias("y"))
    both = a.join(F.broadcast(pairs), "supplier").join(c, ["horizon", "b", "customer"])  # a few pairs
    out = both.groupBy("horizon", "supplier", "customer").agg(*(F.round(F.corr(F.when(w, F.col("x")), F.when(w, F.col("y"))), 4).alias(n) for n, w in (("train_corr", ~F.col("test")), ("test_corr", F.col("test")))))
    sure = (F.signum("train_corr") == F.signum("test_corr")) & (F.abs("train_corr") > CONFIRM_TRAIN) & (F.abs("test_corr") > CONFIRM_TEST)
    return out.withColumn("confirmed", F.coalesce(sure, F.lit(False)))


def named_pairs(sectors: DataFrame, pairs: tuple[tuple[str, str], ...] = PAIRS) -> DataFrame:
    """(supplier, customer): for each pair of parts of names the first sectors that have them."""
    wanted = sectors.sparkSession.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, c string")
    names = sectors.where("sector is not null").select("sector").distinct()
    first = lambda part, out: wanted.join(F.broadcast(names), F.contains("sector", F.col(part))).groupBy("i").agg(F.min("sector").alias(out))  # noqa: E731  names of sectors are few
    return first("a", "supplier").join(first("c", "customer"), "i").select("supplier", "customer").distinct()


def lead_lag_ic(z: DataFrame, ridge: float = RIDGE) -> DataFrame:
    """(horizon, n_test, ic): ridge regression of all sectors' next blocks on all sectors' blocks in the first half; mean correlation across sectors in the second.

    Products of pairs of sectors are added up by Spark; a task solves one horizon's
    system, whose size is the number of sectors squared. Predictions are joins again.
    """
    s = _steps(z)
    train = s.where("not test").select("horizon", "b", "sector", "z", "next")
    other = train.select("horizon", "b", F.col("sector").alias("with"), F.col("z").alias("w"))
    moments = train.join(other, ["horizon", "b"]).groupBy("horizon", "with", "sector").agg(F.sum(F.col("w") * F.col("z")).alias("xx"), F.sum(F.col("w") * F.col("next")).alias("xy"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        xx, xy = (rows.pivot(index="with", columns="sector", values=v) for v in ("xx", "xy"))
        beta = np.linalg.solve(xx.to_numpy() + ridge * np.eye(len(xx)), xy.to_numpy())
        out = pd.DataFrame(beta, index=xx.index, columns=xx.columns).stack().rename("beta").reset_index()
        return out.assign(horizon=rows["horizon"].iloc[0])[["horizon", "with", "sector", "beta"]]

    beta = moments.groupBy("horizon").applyInPandas(solve, "horizon int, `with` string, sector string, beta double")
    test = s.where("test")
    predicted = test.select("horizon", "b", F.col("sector").alias("with"), "z").join(beta, ["horizon", "with"]).groupBy("horizon", "b", "sector").agg(F.sum(F.col("z") * F.col("beta")).alias("p"))
    both = predicted.join(test.select("horizon", "b", "sector", "next"), ["horizon", "b", "sector"])
    daily = both.groupBy("horizon", "b").agg(F.corr("p", "next").alias("ic"), F.stddev_pop("p").alias("u"), F.stddev_pop("next").alias("v"))
    return daily.groupBy("horizon").agg(F.count("*").alias("n_test"), F.round(F.coalesce(F.avg(F.when((F.col("u") > 1e-9) & (F.col("v") > 1e-9), F.col("ic"))), F.lit(0.0)), 4).alias("ic"))


#: Who a counterparty is by what its name holds, in this order.
COUNTERPARTIES = (
    ("government", r"(?iu)cumhurbaşkan|bakanlığ|müdürlüğ|başkanlığ|belediye|üniversite|valilik|koordinasyon|il sağlık|hastane|genel müdürlük"),
    ("foreign", r"(?iu)\b(inc|corp|gmbh|ltd\.?|llc|co\.|limited|company|construction|foodstuff)\b|kazakist|kuveyt|çin|china|abd|amerika|almanya|yurtdış"),
    ("anonymized", r"(?iu)yerleşik|mukim|uluslararas|bayiler|müşterimiz|müşteri$|firma$|şirket$|bir "),
)
#: Words too common to name a listed company.
COMMON = ("TURKIYE", "ENERJI", "TICARET", "SANAYI", "HOLDING", "YATIRIM", "GAYRIMENKUL", "TRADING", "BANKA", "BANKASI", "TEKNOLOJI", "ELEKTRIK", "INSAAT", "GIDA", "SAGLIK", "ANONIM", "SIRKETI", "GRUP", "METAL", "CELIK", "URETIM", "MAKINA")
#: The table cells a disclosure is read from.
WHO, RATIO = "Müşterinin/Tedarikçinin Adı Soyadı/Ticaret Ünvanı", "Varsa Müşterinin/Tedarikçinin Ortaklığın Kamuya Açıklanan Son Gelir Tablosundaki Net Satışlar/Satılan Mal Maliyeti İçindeki Payı"


def counterparty(c: Column) -> Column:
    """What kind of counterparty a name is; only a named domestic one can be a listed company."""
    out = reduce(lambda rest, rule: F.when(c.rlike(rule[1]), rule[0]).otherwise(rest), reversed(COUNTERPARTIES), F.lit("named_domestic"))
    return F.when(F.coalesce(F.trim(c), F.lit("")).isin("", "-"), "unnamed").otherwise(out)


def distinctive(c: Column) -> Column:
    """A name's words of more than five letters that are not common."""
    words = F.split(F.trim(F.regexp_replace(F.upper(I.fold(c)), "[^A-Z0-9 ]", "")), " +")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 5) & ~w.isin(*COMMON)))


def listed_words(companies: DataFrame) -> DataFrame:
    """(word, ticker): the distinctive words of listed companies' names; of several companies with one the first by ticker."""
    return companies.where("is_listed and ticker is not null and length(name) > 4").select("ticker", F.explode(distinctive(F.col("name"))).alias("word")).groupBy("word").agg(F.min("ticker").alias("ticker"))


def new_business(disclosures: DataFrame, companies: DataFrame) -> DataFrame:
    """(id, declaring, counterparty, kind, has_ratio, matched): disclosures of new business, and the listed company each named domestic counterparty may be.

    ``disclosures`` has (id, declaring, html). A match is a shared distinctive word, so
    it is an upper bound.
    """
    cell = lambda label: parsers.cell(F.col("html"), label.replace("/", "[/]") + "[^<]*")
    d = disclosures.select("id", "declaring", F.nullif(cell(WHO), F.lit("")).alias("counterparty"), F.nullif(cell(RATIO), F.lit("")).alias("ratio"))
    d = d.select("id", "declaring", "counterparty", counterparty(F.col("counterparty")).alias("kind"), (F.coalesce("ratio", F.lit("-")) != "-").alias("has_ratio"))
    words = d.where("kind = 'named_domestic'").select("id", F.posexplode(distinctive(F.col("counterparty"))).alias("at", "word"))
    hit = words.join(listed_words(companies), "word").groupBy("id").agg(F.min_by("ticker", F.struct("at", "ticker")).alias("matched"))
    return d.join(hit, "id", "left")


def new_business_coverage(found: DataFrame) -> DataFrame:
    """(kind, n, n_ratio, n_matched, share): counts by kind of counterparty; share is what of all disclosures may be traded."""
    total = found.agg(F.count("*").alias("total"))
    by = found.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("has_ratio").alias("n_ratio"), F.count("matched").alias("n_matched"))
    return by.join(F.broadcast(total)).select("kind", "n", "n_ratio", "n_matched", F.round(F.col("n_matched") / F.col("total"), 4).alias("share"))
