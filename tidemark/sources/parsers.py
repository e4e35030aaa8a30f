"""Landed payloads (one JSON or text value a row) to rows. What cannot be read is dropped and, where it matters, counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Drift

BAR = "struct<date:string,open:double,high:double,low:double,close:double,volume:double,quantity:double>"


def json_column(df: DataFrame, schema: str, payload: str = "payload") -> Column:
    return F.from_json(F.col(payload), schema)


def bars(df: DataFrame) -> DataFrame:
    """Bars of payloads with data.allBars, else data.bars; bars without a date are dropped; known on their day."""
    data = json_column(df, f"struct<data:struct<symbol:string,allBars:array<{BAR}>,bars:array<{BAR}>>>")
    b = df.select(data.alias("p")).select(F.col("p.data.symbol").alias("symbol"), F.explode(F.coalesce("p.data.allBars", "p.data.bars")).alias("b"))
    day = F.try_to_timestamp(F.substring("b.date", 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    return b.select("symbol", day.alias("bar_date"), "b.open", "b.high", "b.low", "b.close", F.col("b.volume").alias("volume_try"), "b.quantity", day.alias("knowledge_date")).where("bar_date is not null")


def corporate_actions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbol, kind, ex_date) with a date, and (symbol, n_refused) of those with a blank one."""
    p = df.select("symbol", json_column(df, "struct<capital_increases_exdates:array<string>,dividends:array<struct<exDate:string,exDividend:string>>>").alias("p"))
    rows = p.select("symbol", F.explode(F.concat(F.transform(F.coalesce("p.capital_increases_exdates", F.array().cast("array<string>")), lambda d: F.struct(F.lit("capital_increase").alias("kind"), d.alias("day"))), F.transform(F.coalesce("p.dividends", F.array().cast("array<struct<exDate:string,exDividend:string>>")), lambda d: F.struct(F.lit("dividend").alias("kind"), F.coalesce(d["exDate"], d["exDividend"]).alias("day"))))).alias("a"))
    rows = rows.select("symbol", "a.kind", F.try_to_timestamp(F.substring(F.trim("a.day"), 1, 10), F.lit("yyyy-MM-dd")).cast("date").alias("ex_date"))
    return rows.where("ex_date is not null"), rows.groupBy("symbol").agg(F.count_if(F.col("ex_date").isNull()).alias("n_refused"))


def declaration_periods(df: DataFrame) -> DataFrame:
    """(symbol, period, declared) of nested items and periods."""
    p = df.select("symbol", json_column(df, "struct<data:struct<declarationDates:struct<items:array<struct<periods:array<struct<period:string,declarationDate:string>>>>>>>").alias("p"))
    rows = p.select("symbol", F.explode("p.data.declarationDates.items").alias("i")).select("symbol", F.explode("i.periods").alias("d"))
    return rows.select("symbol", "d.period", F.substring("d.declarationDate", 1, 10).try_cast("date").alias("declared"))


def consumer_prices(df: DataFrame, factor: str = "CPI", series: str = "TP_FG_J0") -> DataFrame:
    """(factor, bar_date, value, knowledge_date) of YYYY-M months; published on the third of the next month."""
    items = df.select(F.explode(json_column(df, "struct<items:array<map<string,string>>>").getField("items")).alias("i"))
    month = F.try_to_timestamp(F.col("i")["Tarih"], F.lit("yyyy-M")).cast("date")
    return items.select(F.lit(factor).alias("factor"), month.alias("bar_date"), F.col("i")[series].try_cast("double").alias("value"), F.date_add(F.add_months(F.trunc(month, "MM"), 1), 2).alias("knowledge_date")).where("bar_date is not null and value is not null")


def weekly_series(df: DataFrame, series: str, factor: str, lag_days: int = 6) -> DataFrame:
    """(factor, bar_date, value, knowledge_date) of DD-MM-YYYY days."""
    items = df.select(F.explode(json_column(df, "struct<items:array<map<string,string>>>").getField("items")).alias("i"))
    day = F.try_to_timestamp(F.col("i")["Tarih"], F.lit("dd-MM-yyyy")).cast("date")
    return items.select(F.lit(factor).alias("factor"), day.alias("bar_date"), F.col("i")[series.replace(".", "_")].try_cast("double").alias("value"), F.date_add(day, lag_days).alias("knowledge_date")).where("bar_date is not null and value is not null")


def observations(df: DataFrame, factor: str) -> DataFrame:
    """(factor, bar_date, value, knowledge_date) of observations; a dot is a missing value."""
    o = df.select(F.explode(json_column(df, "struct<observations:array<struct<date:string,value:string>>>").getField("observations")).alias("o"))
    day = F.col("o.date").try_cast("date")
    return o.select(F.lit(factor).alias("factor"), day.alias("bar_date"), F.col("o.value").try_cast("double").alias("value"), day.alias("knowledge_date")).where("bar_date is not null and value is not null")


def quotes(df: DataFrame, factor: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """(factor, bar_date, value, knowledge_date) of a map of quotes by id, clipped to a span."""
    q = df.select(F.explode(F.map_values(json_column(df, "struct<result:struct<quote:map<string,struct<DATA_VAL:string,CLOSE_VAL:double>>>>").getField("result").getField("quote"))).alias("q"))
    day = F.substring("q.DATA_VAL", 1, 10).try_cast("date")
    out = q.select(F.lit(factor).alias("factor"), day.alias("bar_date"), F.col("q.CLOSE_VAL").alias("value"), day.alias("knowledge_date")).where("bar_date is not null and value is not null")
    return out.where(F.col("bar_date").between(F.lit(start or "0001-01-01").cast("date"), F.lit(end or "9999-12-31").cast("date")))


def members(df: DataFrame) -> DataFrame:
    """(filing_id, ticker, name, is_listed), the last row of each id."""
    m = df.select(F.posexplode(json_column(df, "array<struct<mkkMemberOid:string,stockCode:string,kapMemberTitle:string>>")).alias("n", "m"))
    last = m.groupBy(F.col("m.mkkMemberOid").alias("filing_id")).agg(F.max_by("m", "n").alias("m"))
    code = F.trim(F.coalesce("m.stockCode", F.lit("")))
    return last.where("filing_id is not null").select("filing_id", F.nullif(code, F.lit("")).alias("ticker"), F.col("m.kapMemberTitle").alias("name"), (code != "").alias("is_listed"))


#: Places of the columns used of a 27-column news record.
NEWS = {"record_id": 0, "date": 1, "source_name": 3, "document": 4, "themes": 7, "locations": 9, "tone": 15}


def news(lines: DataFrame, line: str = "value") -> DataFrame:
    """Records of tab-separated lines; a line of fewer than 27 columns is dropped."""
    f = F.split(F.col(line), "\t")
    return lines.where(F.size(f) >= 27).select(*(F.get(f, F.lit(i)).alias(n) for n, i in NEWS.items()))


def news_or_drift(lines: DataFrame) -> DataFrame:
    """As ``news``, but lines without a single record are refused."""
    out = news(lines)
    if lines.where("trim(value) != ''").head(1) and not out.head(1):
        raise Drift("no line has the columns of a news record")
    return out


def refuse_count_drift(found: DataFrame, expected: int, what: str) -> None:
    """A known slice has to come to as many records as it did when it was captured."""
    n = found.count()
    if n != expected:
        raise Drift(f"{what}: {n} records instead of {expected}")


def relations(documents: DataFrame) -> DataFrame:
    """(parent, child, pct, as_of, row) of reference documents with relations, in their order; a document without any gives none."""
    form = "struct<relations:array<struct<parent:string,child:string,pct:double,as_of:string>>>"
    rows = documents.select(F.posexplode(json_column(documents, form).getField("relations")).alias("row", "r"))
    return rows.select("r.parent", "r.child", "r.pct", F.substring("r.as_of", 1, 10).try_cast("date").alias("as_of"), "row").where("parent is not null and child is not null")


def plain(html: Column) -> Column:
    """HTML as text: no scripts, styles or tags, common entities as characters, single spaces."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def cell(html: Column, label: str) -> Column:
    """Text of the table cell behind the one with a label."""
    return plain(F.regexp_extract(html, rf"(?is)<t[dh][^>]*>\s*{label}\s*</t[dh]>\s*<td[^>]*>(.*?)</td>", 1))


def subsidiaries(df: DataFrame, html: str = "html") -> DataFrame:
    """(row, child, activity, capital, pct) of table rows with a company's name, a field and a share; one row for each child."""
    from ..functions.identity import percent, turkish_amount

    rows = df.select("source", F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "tr"))
    cells = rows.select("source", "row", F.transform(F.regexp_extract_all("tr", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), plain).alias("c"))
    legal = r"(?i)(A\.?\s?Ş\.?|A\.?\s?S\.?|LTD|GMBH|B\.?V\.?|INC|LLC|S\.?A\.?)\s*$"
    out = cells.where((F.size("c") >= 4) & F.col("c")[0].rlike(legal)).select("source", "row", F.col("c")[0].alias("child"), F.col("c")[1].alias("activity"), turkish_amount(F.col("c")[2]).alias("capital"), percent(F.try_element_at("c", F.lit(-1))).alias("pct"))
    return out.groupBy("source", "child").agg(F.max_by(F.struct("row", "activity", "capital", "pct"), "row").alias("r")).select("source", "child", "r.row", "r.activity", "r.capital", "r.pct")


def isin_list(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """(ticker, isin, status) of (ticker, isin) rows: valid equity codes; one is unique, several are ambiguous."""
    from ..functions.identity import equity_isin, isin_ok

    good = df.where(isin_ok(F.col("isin")) & equity_isin(F.col("isin"))).groupBy("ticker").agg(F.array_sort(F.collect_set("isin")).alias("all"))
    return df.select("ticker").distinct().join(good, "ticker", "left").select("ticker", F.when(F.size("all") == 1, F.col("all")[0]).alias("isin"), F.when(F.col("all").isNull(), "invalid").when(F.size("all") == 1, "unique").otherwise("ambiguous").alias("status"))


def custody_codes(df: DataFrame) -> DataFrame:
    """(bucket, code, problem): codes of three letters or digits, each in one bucket."""
    n = df.groupBy("code").agg(F.count_distinct("bucket").alias("n"))
    return df.join(n, "code").select("bucket", "code", F.when(~F.col("code").rlike("^[A-Z0-9]{3}$"), "malformed").when(F.col("n") > 1, "in_several_buckets").alias("problem"))


def query_date(c: Column) -> Column:
    """A day as the central bank's queries want it, DD-MM-YYYY, from that or from an ISO day; NULL for anything else."""
    iso = F.try_to_timestamp(F.when(c.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), c), F.lit("yyyy-M-d"))
    return F.coalesce(F.date_format(iso, "dd-MM-yyyy"), F.when(c.rlike("^[0-9]{2}-[0-9]{2}-[0-9]{4}$"), c))


def find_tickers(members_: DataFrame, asked: DataFrame) -> DataFrame:
    """(ticker, filing_id, status) of each distinct ticker asked for, among the members' lists of codes; of several members the first by id."""
    code = F.explode(F.transform(F.split("ticker", ","), lambda x: F.upper(F.trim(x))))
    have = members_.where("ticker is not null").select(code.alias("ticker"), "filing_id").groupBy("ticker").agg(F.min("filing_id").alias("filing_id"))
    want = asked.select(F.upper(F.trim("ticker")).alias("ticker")).distinct()
    return want.join(have, "ticker", "left").select("ticker", "filing_id", F.when(F.col("filing_id").isNull(), "unknown").otherwise("found").alias("status"))
