"""Reads as of a date: nothing known later is seen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import LookAhead, Refused
from ..schemas import TABLES


def visible(df: DataFrame, as_of: str) -> DataFrame:
    return df.where(F.col("knowledge_date") <= F.lit(as_of).cast("date"))


def latest_version(df: DataFrame, *key: str) -> DataFrame:
    """For each key the row with the latest knowledge date; the key does not include it. Of rows known on the same day the one with the greatest values counts."""
    rest = [F.col(f"`{c}`").desc() for c in df.columns if c not in (*key, "knowledge_date")]
    newest = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("knowledge_date").desc(), *rest))
    return df.withColumn("_n", newest).where("_n = 1").drop("_n")


def latest_by(df: DataFrame, column: str) -> DataFrame:
    """The rows that have the greatest value of a column over the whole frame."""
    top = df.agg(F.max(column).alias("_top"))
    return df.join(F.broadcast(top), F.col(column) == F.col("_top"), "left_semi")  # one row is broadcast


def members(df: DataFrame, as_of: str, universe: str | None = None) -> DataFrame:
    """Symbols in a universe on a date, by the newest visible version of each span; the end day counts."""
    seen = visible(df, as_of)
    seen = seen if universe is None else seen.where(F.col("universe") == universe)
    day = F.lit(as_of).cast("date")
    spans = latest_version(seen, "symbol", "universe", "valid_from")
    return spans.where((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day))).select("universe", "symbol").distinct()


class PitReader:
    """Tables bounded by a knowledge date. ``load`` gives a table's frame by name."""

    def __init__(self, as_of: str | None, load: Callable[[str], DataFrame]):
        if not as_of:
            raise LookAhead("a read needs the date it is made as of")
        self.as_of, self.load = as_of, load

    def table(self, name: str, *, symbol: str | None = None, columns: list[str] | None = None, where: str | Column | None = None, newest: str | None = None, distinct: bool = False) -> DataFrame:
        if name not in TABLES:
            raise Refused(f"no stored table is called {name!r}")
        df = visible(self.load(name), self.as_of)
        for condition in ([F.col("symbol") == symbol] if symbol else []) + ([where] if where is not None else []):
            df = df.where(condition)
        df = latest_by(df, newest) if newest else df
        df = df.select(*columns) if columns else df
        return df.distinct() if distinct else df

    def universe(self, universe: str = "listed") -> DataFrame:
        return members(self.load("universe_membership"), self.as_of, universe).select("symbol").orderBy("symbol")


def graph_asof(edges: DataFrame, as_of: str, *key: str) -> DataFrame:
    """Edges as they were known and held on a day: of each (src, dst and key) the newest visible version, if its span is open then."""
    day = F.lit(as_of).cast("date")
    known = latest_version(visible(edges, as_of), "src", "dst", *key)
    spans = [F.col("valid_from").isNull() | (F.col("valid_from") <= day)] * ("valid_from" in edges.columns) + [F.col("valid_to").isNull() | (F.col("valid_to") >= day)] * ("valid_to" in edges.columns)
    for held in spans:
        known = known.where(held)
    return known


def universe_classes(memberships: DataFrame, as_of: str) -> DataFrame:
    """(symbol, universe_class): the class of the newest span that was known, by its newest version that has one (then the first by name)."""
    seen = visible(memberships, as_of)
    newest = seen.groupBy("symbol").agg(F.max("valid_from").alias("valid_from"))
    rows = seen.where("universe_class is not null").join(newest, ["symbol", "valid_from"])
    last = rows.groupBy("symbol").agg(F.max("knowledge_date").alias("knowledge_date"))
    return rows.join(last, ["symbol", "knowledge_date"]).groupBy("symbol").agg(F.min("universe_class").alias("universe_class"))


def legs(companies: DataFrame, uuid: str, fields: list[str]) -> DataFrame:
    """(uuid, field, value) of all identifiers that are there."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))
    return companies.select(F.col(uuid).alias("uuid"), pairs.alias("p")).select("uuid", "p.field", "p.value").where("value is not null and value != ''")


def resolve(companies: DataFrame, values: DataFrame, uuid: str, fields: list[str]) -> DataFrame:
    """(value, uuid, status): found if exactly one company has the value on any leg, refused if several have."""
    known = legs(companies, uuid, fields).groupBy("value").agg(F.count_distinct("uuid").alias("n"), F.min("uuid").alias("uuid"))
    return values.select("value").distinct().join(known, "value", "left").select("value", F.when(F.col("n") == 1, F.col("uuid")).alias("uuid"), F.when(F.col("n").isNull(), "unknown").when(F.col("n") == 1, "found").otherwise("refused").alias("status"))


def round_trip(companies: DataFrame, uuid: str, fields: list[str]) -> DataFrame:
    """(uuid, ok): whether all of a company's identifiers lead back to it alone."""
    legs_ = legs(companies, uuid, fields)
    owners = legs_.groupBy("field", "value").agg(F.count_distinct("uuid").alias("n"))
    return legs_.join(owners, ["field", "value"]).groupBy("uuid").agg(F.bool_and(F.col("n") == 1).alias("ok"))


def collisions(companies: DataFrame, uuid: str, fields: list[str]) -> DataFrame:
    """(field, value, n_companies) of identifiers that several companies have."""
    return legs(companies, uuid, fields).groupBy("field", "value").agg(F.count_distinct("uuid").alias("n_companies")).where("n_companies > 1")


def incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without complete provenance, with the columns they lack."""
    lacking = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in columns)))
    return df.withColumn("lacking", F.array_join(lacking, ",")).where("lacking != ''")


def coverage(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(key, present) for each wanted key."""
    have = present.select(key).distinct().withColumn("present", F.lit(True))
    return wanted.select(key).distinct().join(have, key, "left").select(key, F.coalesce("present", F.lit(False)).alias("present"))


def most_covered(panel: DataFrame, value: str, n: int) -> DataFrame:
    """The n symbols with most values; ties by symbol."""
    return panel.groupBy("symbol").agg(F.count(value).alias("n_obs")).orderBy(F.desc("n_obs"), "symbol").limit(n)


def append_new(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """The incoming rows whose key is not stored yet, one for each key (the one with the smallest values)."""
    rest = [c for c in incoming.columns if c not in key]
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*(rest or key)))
    return incoming.withColumn("_n", first).where("_n = 1").drop("_n").join(existing.select(*key), key, "left_anti")
