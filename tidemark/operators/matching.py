"""Names resolved to companies, precision first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity as I

RARE = 3
#: Tokens that share so many letters agree.
PREFIX = 5
#: Place words that a company may have and the name not.
SOFT = ("TURK", "TURKIYE")


def index(companies: DataFrame, key: str = "uuid", name: str = "name") -> DataFrame:
    """(etype, tokens, company, key): companies with the same tokens and kind once, by the first name; tokens are structs (token, prefix, df) with the number of companies that have them."""
    c = companies.where(F.coalesce(F.col(name), F.lit("")) != "").select(F.col(key).alias("key"), F.col(name).alias("name"), F.array_sort(I.identity_tokens(F.col(name))).alias("own"), I.entity_type(F.col(name)).alias("etype"))
    alike = c.groupBy("own", "etype").agg(F.min(F.struct("name", "key")).alias("head"), F.count("*").alias("n")).where(F.size("own") > 0)
    each = alike.select("own", "etype", "head", "n", F.explode("own").alias("token"))
    df = each.groupBy("token").agg(F.sum("n").alias("df"))
    tokens = F.array_sort(F.collect_list(F.struct("token", F.substring("token", 1, PREFIX).alias("prefix"), "df")))
    # a set has few tokens
    return each.join(df, "token").groupBy("own", "etype", "head").agg(tokens.alias("tokens")).select("etype", "tokens", F.col("head.name").alias("company"), F.col("head.key").alias("key"))


def classes(known: DataFrame, rare: int = RARE) -> DataFrame:
    """(etype, tokens, company, key): the first company of those that no name can tell apart; tokens are structs (prefix, soft, df), df up to the first number that is not rare."""
    marks = F.array_sort(F.transform("tokens", lambda t: F.struct(t["prefix"].alias("prefix"), t["token"].isin(*SOFT).alias("soft"), F.least(t["df"], F.lit(rare + 1)).alias("df"))))
    return known.groupBy("etype", marks.alias("tokens")).agg(F.min(F.struct("company", "key")).alias("head")).select("etype", "tokens", "head.*")


def match(names: DataFrame, companies: DataFrame, *, threshold: float = 0.6, rare: int = RARE, key: str = "uuid", name: str = "name") -> DataFrame:
    """(name, key, score, status) for each distinct name.

    Two tokens agree if they are equal or share their first five letters, so agreement is
    equality of these prefixes. A company needs ``threshold`` of the name's tokens and its
    leading one, a compatible type, and no rare token that the name has not. The largest
    share wins, then fewest extra tokens, then the name.

    Names with the same prefixes are looked up once, and companies with the same prefixes,
    equally rare as far as it counts, are represented by the first, which would win among
    them (``classes``); so work grows with different prefixes, not with names times
    companies. Who fits shares the leading token and one more that is known beforehand:
    the company's rarest token, if that is rare, as the name must have it; else any other
    of the name's (or none, for a name of one token). The join is on both, so common words
    alone bring nobody together.
    """
    n = names.select("name").distinct().select("name", I.identity_tokens(F.col("name")).alias("own"), I.entity_type(F.col("name")).alias("itype"))
    n = n.withColumn("have", F.transform("own", lambda t: F.substring(t, 1, PREFIX)))
    asked = n.where(F.size("have") > 0).select("have", "itype").distinct().withColumn("lead", F.element_at("have", F.lit(1)))
    known = classes(index(companies, key, name), rare)
    known = known.withColumn("theirs", F.array_distinct(F.transform("tokens", lambda t: t["prefix"])))
    must = F.array_min(F.transform(F.filter("tokens", lambda t: (t["df"] <= rare) & ~t["soft"]), lambda t: F.struct(t["df"].alias("df"), t["prefix"].alias("prefix"))))
    known = known.withColumn("must", must["prefix"])
    # a name asks under (leading token, each of its tokens), a company answers under (each of its tokens, the one that must be shared)
    ask = asked.select("itype", "have", "lead", F.explode(F.array_distinct("have")).alias("other"))
    answer = known.withColumn("lead", F.explode("theirs")).withColumn("others", F.when(F.col("must").isNotNull(), F.array("must")).otherwise(F.col("theirs")))
    pairs = ask.join(answer.select("etype", "tokens", "company", "key", "theirs", "must", "lead", F.explode("others").alias("other")), ["lead", "other"])
    # without a rare token, the leading one alone brings only names of one token
    pairs = pairs.where(F.col("must").isNotNull() | (F.col("other") != F.col("lead")) | (F.size(F.array_distinct("have")) == 1))
    shared = F.size(F.filter("have", lambda p: F.array_contains("theirs", p)))
    extra = F.filter("tokens", lambda t: ~F.array_contains("have", t["prefix"]) & ~t["soft"])
    scored = pairs.select("have", "itype", "etype", "company", "key", (shared / F.size("have")).alias("share"), F.size(extra).alias("extras"), F.coalesce(F.array_min(F.transform(extra, lambda t: t["df"])), F.lit(rare + 1)).alias("rarest"))
    fit = scored.where((F.col("share") >= threshold) & (F.col("rarest") > rare) & ~I.type_conflict(F.col("itype"), F.col("etype")))
    best = fit.groupBy("have", "itype").agg(F.min(F.struct((-F.round("share", 6)).alias("o"), "extras", "company", "key", "share")).alias("b")).select(F.col("have").alias("_have"), F.col("itype").alias("_itype"), F.col("b.key").alias("key"), F.round("b.share", 3).alias("score"))
    status = F.when(F.size("own") == 0, "no-identity-tokens").when(F.col("key").isNotNull(), "matched").otherwise("no-confident-match")
    return n.join(best, (F.col("have") == F.col("_have")) & F.col("itype").eqNullSafe(F.col("_itype")), "left").select("name", "key", "score", status.alias("status"))


def backfill(relations: DataFrame, companies: DataFrame, controls: DataFrame, *, threshold: float = 0.6) -> DataFrame:
    """(src, child, dst, pct, status) of parent-child relations: controls_new, corroborated, stake, self, or unmatched; existing edges are not touched."""
    found = match(relations.select(F.col("child").alias("name")), companies, threshold=threshold)
    df = relations.join(found.select(F.col("name").alias("child"), F.col("key").alias("dst")), "child", "left")
    old = controls.select("src", "dst", F.lit(True).alias("_old"))
    df = df.join(old, ["src", "dst"], "left")
    status = F.when(F.col("dst").isNull(), "unmatched").when(F.col("src") == F.col("dst"), "self").when(F.col("_old"), "corroborated").when(F.col("pct") > 50, "controls_new").otherwise("stake")
    return df.select("src", "child", "dst", "pct", status.alias("status"))


def parent_edges(parents: DataFrame, by_lei: DataFrame) -> DataFrame:
    """(src, dst, kind, status) from (uuid, direct, ultimate): direct parents control and have a subsidiary, ultimate ones (if others) control; parents outside are external."""
    legs = parents.select("uuid", F.explode(F.array(F.struct(F.lit("direct").alias("kind"), F.col("direct").alias("lei")), F.struct(F.lit("ultimate").alias("kind"), F.when(~F.col("ultimate").eqNullSafe(F.col("direct")), F.col("ultimate")).alias("lei")))).alias("p")).select("uuid", "p.kind", "p.lei").where("lei is not null")
    df = legs.join(by_lei.select("lei", F.col("uuid").alias("parent")), "lei", "left")
    return df.select(F.coalesce("parent", F.concat(F.lit("ext-"), F.lower("lei"))).alias("src"), F.col("uuid").alias("dst"), "kind", F.when(F.col("parent").isNull(), "external").when(F.col("parent") == F.col("uuid"), "self").otherwise("known").alias("status"))


def cross_validated(companies: DataFrame, exchange: DataFrame, candidates: DataFrame) -> DataFrame:
    """(uuid, isin, method) from the exchange's list (ticker, isin) and other candidates (uuid, isins): agree, authoritative, conflict or none; only the first two are written."""
    df = companies.select("uuid", "ticker").join(exchange.select("ticker", "isin"), "ticker", "left").join(candidates, "uuid", "left")
    has = F.size(F.coalesce("isins", F.array().cast("array<string>"))) > 0
    method = F.when(F.col("isin").isNull(), "none").when(~I.isin_ok(F.col("isin")), "invalid").when(has & F.array_contains("isins", F.col("isin")), "agree").when(has & (F.size(F.filter("isins", I.equity_isin)) > 0), "conflict").otherwise("authoritative")
    return df.select("uuid", "isin", method.alias("method"))


def listing_status(companies: DataFrame, exchange: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """(uuid, status): traded if the exchange's list has the ticker, also where its code is ambiguous; else not traded, or without a ticker."""
    a = exchange.select("ticker").union(ambiguous.select("ticker")).distinct().withColumn("_t", F.lit(True))
    return companies.select("uuid", "ticker").join(a, "ticker", "left").select("uuid", F.when(F.coalesce("ticker", F.lit("")) == "", "no_ticker").when(F.col("_t"), "equity_traded").otherwise("not_traded").alias("status"))
