"""Domain frames from the star schema's tables.

Sums are taken over decimals, which do not depend on the order of addition, and only
then become doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fixed(x, digits: int):
    """Half up by floor, which every engine computes alike; values too large for it stay."""
    return F.when(F.abs(x) < 1e9, F.floor(x * 10.0**digits + 0.5) / 10.0**digits).otherwise(x)


class Tables:
    """The tables of one folder, and the frames derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _bars(self, lines: DataFrame, lag_days: int) -> DataFrame:
        part = self.read("part").select("p_partkey", F.col("p_brand").alias("symbol"))
        money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
        week = F.to_date(F.date_trunc("week", "l_shipdate"))
        rows = lines.select("l_partkey", "l_extendedprice", "l_quantity", week.alias("bar_date"))
        # added up per part before the join, so the fact table is not shuffled whole
        sums = rows.groupBy("l_partkey", "bar_date").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("l_extendedprice"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("l_quantity"))
        out = sums.join(part, sums.l_partkey == part.p_partkey).groupBy("symbol", "bar_date").agg(money("l_extendedprice").alias("volume_try"), money("l_quantity").alias("quantity"))
        return out.select("symbol", "bar_date", fixed(F.col("volume_try") / F.col("quantity"), 6).alias("close"), "quantity", "volume_try", F.date_add("bar_date", lag_days).alias("knowledge_date"))

    def bars(self) -> DataFrame:
        """Weekly bars of each brand, known a week later."""
        return self._bars(self.read("lineitem"), 7)

    def bar_versions(self) -> DataFrame:
        """A first version from the first three lines of orders, and the whole one, known four weeks later."""
        return self._bars(self.read("lineitem").where("l_linenumber <= 3"), 7).unionByName(self._bars(self.read("lineitem"), 28))

    def sectors(self) -> DataFrame:
        return self.read("part").select(F.col("p_brand").alias("symbol"), F.substring("p_brand", 1, 7).alias("sector")).distinct()

    def factor_levels(self) -> DataFrame:
        """MKT: mean close of a week; FX: mean order value; RATE: mean discount in percent."""
        mkt = self.bars().groupBy("bar_date").agg(fixed(F.sum(F.col("close").cast("decimal(18,6)")).cast("double") / F.count("*"), 6).alias("value")).select(F.lit("MKT").alias("factor"), "bar_date", "value")
        week = lambda c: F.to_date(F.date_trunc("week", c)).alias("bar_date")
        mean = lambda x: fixed(F.sum(x).cast("double") / F.count("*"), 6).alias("value")
        fx = self.read("orders").groupBy(week("o_orderdate")).agg(mean(F.col("o_totalprice").cast("decimal(18,2)"))).select(F.lit("FX").alias("factor"), "bar_date", "value")
        rate = self.read("lineitem").groupBy(week("l_shipdate")).agg(mean(F.col("l_discount").cast("decimal(18,2)") * 100)).select(F.lit("RATE").alias("factor"), "bar_date", "value")
        return mkt.unionByName(fx).unionByName(rate).withColumn("knowledge_date", F.date_add("bar_date", 7))

    def monthly_factor(self) -> DataFrame:
        """A sparse factor: mean order value of a month, known six days after its end."""
        month = F.to_date(F.date_trunc("month", "o_orderdate"))
        out = self.read("orders").groupBy(month.alias("bar_date")).agg(fixed(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("*"), 6).alias("ret"))
        return out.select(F.lit("FLOW").alias("factor"), "bar_date", "ret", F.date_add(F.last_day("bar_date"), 6).alias("knowledge_date"))

    def returns(self) -> DataFrame:
        """(symbol, bar_date, ret): simple weekly returns, the first one NULL."""
        from .operators.returns import change

        return self.bars().select("symbol", "bar_date", fixed(change("close", "symbol"), 9).alias("ret"))

    def memberships(self) -> DataFrame:
        """Customers belong to a universe from their first order; the second version, known later, closes the span."""
        orders = self.read("orders").groupBy(F.col("o_custkey")).agg(F.to_date(F.min("o_orderdate")).alias("valid_from"), F.to_date(F.max("o_orderdate")).alias("last_day"))
        cust = self.read("customer").join(orders, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_name").alias("symbol"), F.lower("c_mktsegment").alias("universe"), "valid_from", "last_day")
        first = cust.select("symbol", "universe", "valid_from", F.lit(None).cast("date").alias("valid_to"), F.col("valid_from").alias("knowledge_date"))
        return first.unionByName(cust.select("symbol", "universe", "valid_from", F.col("last_day").alias("valid_to"), F.date_add("last_day", 10).alias("knowledge_date")))

    def controls(self) -> DataFrame:
        """Supplier k div 2 controls supplier k."""
        s = self.read("supplier").where("s_suppkey > 1")
        return s.select(F.expr("s_suppkey div 2").alias("src"), F.col("s_suppkey").alias("dst"))

    def stakes(self) -> DataFrame:
        """Suppliers k div 2 and k div 3 hold (10 + k mod 40) percent of k."""
        s = self.read("supplier")
        pct = F.expr("10 + s_suppkey % 40").cast("double")
        a = s.where("s_suppkey > 1").select(F.expr("s_suppkey div 2").alias("src"), F.col("s_suppkey").alias("dst"), pct.alias("pct"))
        b = s.where("s_suppkey > 2").select(F.expr("s_suppkey div 3").alias("src"), F.col("s_suppkey").alias("dst"), pct.alias("pct"))
        return a.unionByName(b).where("src > 0").groupBy("src", "dst").agg(F.max("pct").alias("pct"))
