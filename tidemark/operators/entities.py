"""Names to legal-entity records, and the identifiers that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity as I
from ..tables import cut, dealt

#: Words of funds and foundations, which carry the names of their founders.
NOISE = ("FON", "FONU", "VAKFI", "VAKIF", "EMEKLI", "EMEKLILIK", "PORTFOY")
#: A shared word of so many letters is distinctive; without one a share counts for less.
DISTINCTIVE, WEAK, INACTIVE = 4, 0.4, 0.05
#: Pick methods that are written without review.
CONFIDENT = ("TRA+ticker", "single-equity")


def _noise(tokens: Column) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, NOISE)))


def match_records(companies: DataFrame, records: DataFrame, *, threshold: float = 0.6, common: int = 50_000, key: str = "uuid", name: str = "name") -> DataFrame:
    """(key, lei, record, score, status) of each company: matched, below_threshold or no_candidates.

    Candidates are what a search for a name's first two brand words finds (its only one,
    if it has no other): records that have both. So the join is on a pair of words, and
    common ones alone bring nobody together. Equal names are looked up once. Words that
    more than ``common`` records have are paired with others only, and among themselves
    for the pairs that names ask for.

    The score is the share of the company's brand words that a record's name has, weak
    if no shared word is distinctive, and a little less if the record is not active.
    Funds are left out unless the company is one. Of equal scores the closer whole name
    wins (by edit distance over the longer length), then the smaller identifier.
    """
    n = companies.select(F.col(name).alias("name")).where("name is not null and trim(name) != ''").distinct()
    n = n.select("name", I.brand_set(F.col("name")).alias("brand"), I.scored(F.col("name")).alias("whole")).where(F.size("brand") > 0).withColumn("fund", _noise(F.split("whole", " ")))
    one, two = F.col("brand")[0], F.coalesce(F.get("brand", F.lit(1)), F.col("brand")[0])
    n = cut(n.withColumns({"one": F.least(one, two), "two": F.greatest(one, two)}))
    r = records.where("lei is not null").groupBy("lei").agg(F.min(F.struct(F.coalesce("legal_name", F.lit("")).alias("record"), F.upper(F.coalesce("status", F.lit("ACTIVE"))).alias("state"))).alias("r")).select("lei", "r.record", "r.state")
    r = cut(r.withColumn("text", I.scored(F.col("record"))).withColumn("words", F.array_distinct(F.split("text", " "))))
    # a name has few words, so few pairs; a pair of two words that very many records have is looked up only if a name asks for it
    words = r.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    often = words.where(F.col("n") > common).agg(F.collect_set("word").alias("often"))  # at most all words / common
    each = r.select("lei", "words").join(F.broadcast(often)).select("lei", F.array_except("words", "often").alias("seldom"), F.array_intersect("words", "often").alias("often"))
    pair = lambda x, y: F.struct(F.least(x, y).alias("one"), F.greatest(x, y).alias("two"))
    inner = lambda own: F.flatten(F.transform(own, lambda x, i: F.transform(F.slice(own, i + 1, F.size(own)), lambda y: pair(x, y))))
    outer = F.flatten(F.transform("seldom", lambda x: F.transform("often", lambda y: pair(x, y))))
    keys = cut(each.select("lei", F.concat(inner(F.col("seldom")), outer).alias("keys"), "often"))
    size = keys.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    asked = n.select("one", "two").distinct().join(F.broadcast(often), F.array_contains("often", F.col("one")) & F.array_contains("often", F.col("two"))).select("one", "two")
    plain = dealt(keys.select("lei", F.explode("keys").alias("k")).select("lei", "k.*"), size, "one", "two")
    both = keys.where(F.size("often") > 0).select("lei", F.explode(inner(F.col("often"))).alias("k")).select("lei", "k.*").join(F.broadcast(asked), ["one", "two"])
    found = dealt(n.select("name", "one", "two"), size, "one", "two").join(plain, ["one", "two"]).select("name", "lei")
    found = cut(found.union(n.select("name", "one", "two").join(both, ["one", "two"]).select("name", "lei")))
    met = max(found.count(), companies.count())
    pairs = dealt(found, met, "lei").join(dealt(r, met, "lei"), "lei")
    pairs = dealt(pairs, met, "name").join(dealt(n, met, "name"), "name").where(F.col("fund") | ~_noise(F.col("words")))
    shared = F.array_intersect("brand", "words")
    share = F.size(shared) / F.size("brand")
    score = F.when(F.exists(shared, lambda w: F.length(w) >= DISTINCTIVE), share).otherwise(share * WEAK) - F.when(F.col("state") != "ACTIVE", INACTIVE).otherwise(0.0)
    close = 1 - F.levenshtein("whole", "text") / F.greatest(F.length("whole"), F.length("text"))
    best = pairs.groupBy("name").agg(F.min(F.struct((-F.round(score, 4)).alias("s"), (-F.round(close, 4)).alias("c"), "lei", "record")).alias("b"))
    got = best.select("name", "b.lei", "b.record", F.round(F.greatest(-F.col("b.s"), F.lit(0.0)), 3).alias("score"))
    out = dealt(companies.select(F.col(key).alias("key"), F.col(name).alias("name")), met, "name").join(got, "name", "left")
    status = F.when(F.col("lei").isNull(), "no_candidates").when(F.col("score") >= threshold, "matched").otherwise("below_threshold")
    return out.select("key", "lei", "record", "score", status.alias("status"))


def backfill_leis(companies: DataFrame, matches: DataFrame, *, only_missing: bool = True, listed_only: bool = True) -> DataFrame:
    """(uuid, lei, status): confident matches for companies that lack one; what is there is never replaced."""
    wanted = companies
    if only_missing:
        wanted = wanted.where("lei is null or lei = ''")
    if listed_only:
        wanted = wanted.where("is_listed")
    m = matches.select(F.col("key").alias("uuid"), F.when(F.col("status") == "matched", F.col("lei")).alias("new"), "status")
    return wanted.select("uuid").join(m, "uuid", "left").select("uuid", F.col("new").alias("lei"), F.when(F.col("status") == "matched", "written").otherwise(F.coalesce("status", F.lit("no_candidates"))).alias("status"))


def backfill_isins(companies: DataFrame, instruments: DataFrame) -> DataFrame:
    """(uuid, isin, method, status): each entity's equity code where the choice is sure; others are for review with their candidates."""
    codes = instruments.groupBy("lei").agg(F.array_sort(F.collect_set("isin")).alias("isins"))
    df = companies.where("lei is not null and lei != '' and (isin is null or isin = '')").select("uuid", "ticker", "lei").join(codes, "lei", "left")
    pick = I.pick_isin(F.coalesce("isins", F.array().cast("array<string>")), F.col("ticker"))
    sure = F.col("p.method").isin(*CONFIDENT) & F.col("p.isin").isNotNull()
    return df.withColumn("p", pick).select("uuid", F.when(sure, F.col("p.isin")).alias("isin"), F.col("p.method").alias("method"), F.when(sure, "written").otherwise("needs_review").alias("status"))
