"""Curated reference tables as frames: exchange codes, sectors, subsidiaries, candidate identifiers.

Nothing ambiguous is resolved by itself: a code counts if it is valid, a choice among
several only if somebody has confirmed it, and every refusal carries its reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions import identity as I
from ..tables import cut


def _clean(c: str) -> Column:
    return F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))


def settled(choices: DataFrame) -> DataFrame:
    """(ticker, isin, status) of (ticker, chosen, confirmed, candidates): honoured, or why not."""
    chosen, offered = _clean("chosen"), F.transform(F.coalesce("candidates", F.array().cast("array<string>")), lambda c: F.upper(F.trim(c)))
    status = F.when(~F.coalesce("confirmed", F.lit(False)), "unconfirmed").when(~(I.isin_ok(chosen) & I.equity_isin(chosen)), "chosen-not-valid-equity-isin").when(~F.array_contains(offered, chosen), "chosen-not-a-candidate").otherwise("honoured")
    return choices.select(_clean("ticker").alias("ticker"), F.when(status == "honoured", chosen).alias("isin"), status.alias("status"))


def lookup_isins(tickers: DataFrame, mappings: DataFrame, ambiguous: DataFrame, choices: DataFrame) -> DataFrame:
    """(ticker, isin, is_equity, is_traded, status) of each distinct ticker.

    A mapped code that fails its check digit is reported and not given out. A ticker with
    several codes is traded, but has one only if a choice was honoured.
    """
    asked = tickers.select(_clean("ticker").alias("ticker")).distinct()
    mapped = mappings.select(_clean("ticker").alias("ticker"), _clean("isin").alias("mapped")).groupBy("ticker").agg(F.max("mapped").alias("mapped"))
    several = ambiguous.select(_clean("ticker").alias("ticker")).distinct().withColumn("several", F.lit(True))
    chosen = settled(choices).where("isin is not null").groupBy("ticker").agg(F.min("isin").alias("chosen"))
    df = asked.join(mapped, "ticker", "left").join(several, "ticker", "left").join(chosen, "ticker", "left")
    good = I.isin_ok(F.col("mapped"))
    status = F.when(F.col("ticker") == "", "empty-ticker").when(good, "found").when(F.col("mapped").isNotNull(), "failed-validation").when(F.col("several") & F.col("chosen").isNotNull(), "disambiguated").when(F.col("several"), "ambiguous").otherwise("not-in-reference")
    isin = F.when(good, F.col("mapped")).when(F.col("mapped").isNull() & F.col("several"), F.col("chosen"))
    df = df.select("ticker", F.when(F.col("ticker") != "", isin).alias("isin"), status.alias("status"), "several")
    return df.select("ticker", "isin", F.coalesce(I.equity_isin(F.col("isin")), F.lit(False)).alias("is_equity"), (F.col("status").isin("found", "disambiguated", "ambiguous") | F.coalesce("several", F.lit(False))).alias("is_traded"), "status")


#: Fixed value: what the description of a line that is not traded holds.
NOT_TRADED = "İMTİYAZL"


def _folded(c: Column) -> Column:
    """Upper case without Turkish marks, for comparing descriptions."""
    return F.upper(F.translate(c, "İıŞşÇçĞğÖöÜü", "IISSCCGGOOUU"))


def imported_isins(rows: DataFrame, *, order: str | None = None, exclude: str | None = NOT_TRADED, every_class: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ticker, isin, status, candidates), and (ticker, isin, reason) of the rows left out, from an export of (ticker, isin, description).

    A ticker with one valid equity code has it. Of several, those whose description holds
    ``exclude`` (whatever its case and marks) are dropped; if one is left, it is the
    ticker's (``unique-after-exclude``), else the ticker is ambiguous and nothing is
    guessed. A code sent twice has its last description by ``order`` (else the greatest).
    With ``every_class`` codes of other classes count too.
    """
    text = F.coalesce(F.col("description"), F.lit("")) if "description" in rows.columns else F.lit("")
    said = rows.select(_clean("ticker").alias("ticker"), _clean("isin").alias("isin"), text.alias("description"), (F.col(order) if order else F.lit(0)).alias("_o")).where("ticker != '' and isin != ''")
    valid = I.isin_ok(F.col("isin"))
    counted = valid if every_class else valid & I.equity_isin(F.col("isin"))
    one = said.where(counted).groupBy("ticker", "isin").agg(F.max(F.struct("_o", "description")).alias("d"))
    traded = F.lit(True) if exclude is None else ~F.contains(_folded(F.col("d.description")), _folded(F.lit(exclude)))
    of = one.groupBy("ticker").agg(F.array_sort(F.collect_list("isin")).alias("candidates"), F.count_if(traded).alias("n"), F.min(F.when(traded, F.col("isin"))).alias("left"))
    status = F.when(F.size("candidates") == 1, "single").when(F.col("n") == 1, "unique-after-exclude").otherwise("ambiguous")
    isin = F.when(status == "single", F.col("candidates")[0]).when(status == "unique-after-exclude", F.col("left"))
    reason = F.when(F.col("isin").rlike("^[A-Z]{2}") & ~F.startswith("isin", F.lit("TR")), "foreign").when(valid, "non-equity").otherwise("malformed")
    return of.select("ticker", isin.alias("isin"), status.alias("status"), "candidates"), said.where(~counted).select("ticker", "isin", reason.alias("reason")).distinct()


#: The version of the custody reference that is read, and its maps: the field, and the name of the bucket here.
CUSTODY_VERSION = 1
CUSTODY_MAPS = {"foreign_custody_members": "custody", "foreign_execution_brokers": "execution", "domestic_despite_foreign_parent": "domestic"}


def custody(documents: DataFrame, edition: str | None = None) -> DataFrame:
    """(bucket, code, name, source, fetched) of the custody reference: one document of JSON in ``payload``.

    Refused as a whole, rather than half trusted: another version, a code that is not
    three capital letters or digits, no custody codes at all, and a custody code that is
    also an execution broker's or a domestic one, which would count its flow twice or with
    the wrong sign.

    With ``edition`` there is one document for each value of that column, which the rows
    keep. A code may stand for another member in another edition, so each is checked by
    itself; only custody codes need not be in every one.
    """
    form = "struct<schema_version:int,source:string,fetched_iso:string," + ",".join(f"{m}:struct<codes:map<string,string>>" for m in CUSTODY_MAPS) + ">"
    key = F.col(edition) if edition else F.lit(1)
    read = cut(documents.select(key.alias("_edition"), F.from_json("payload", form).alias("d")))
    each = read.groupBy("_edition").agg(F.count("*").alias("n"), F.count("d").alias("known"), F.max("d.schema_version").alias("version"))
    wrong = each.where((F.col("n") != 1) | (F.col("known") != 1) | ~F.col("version").eqNullSafe(F.lit(CUSTODY_VERSION))).orderBy("_edition").first()
    if wrong and (wrong["n"] != 1 or wrong["known"] != 1) or not read.select("_edition").head(1):
        raise Refused("a custody reference is one document")
    if wrong:
        raise Refused(f"the custody reference has version {wrong['version']}, not {CUSTODY_VERSION}")
    maps = F.explode(F.array(*(F.struct(F.lit(bucket).alias("bucket"), F.col(f"d.{field}.codes").alias("codes")) for field, bucket in CUSTODY_MAPS.items())))
    flat = read.select("_edition", "d.source", F.to_date("d.fetched_iso").alias("fetched"), maps.alias("m"))
    rows = cut(flat.select("_edition", "m.bucket", F.explode("m.codes").alias("code", "name"), "source", "fetched"))
    n = lambda b: F.count_if(F.col("bucket") == b)
    codes = rows.groupBy("_edition", "code").agg(n("custody").alias("custody"), n("execution").alias("execution"), n("domestic").alias("domestic"))
    problem = F.when(~F.col("code").rlike("^[A-Z0-9]{3}$"), "malformed").when((F.col("custody") > 0) & (F.col("execution") > 0), "in both custody and execution").when((F.col("custody") > 0) & (F.col("domestic") > 0), "in both custody and domestic")
    bad = [f"{r['code']}: {r['problem']}" for r in codes.select("code", problem.alias("problem")).where("problem is not null").orderBy("code").limit(5).collect()]
    if bad:
        raise Refused("; ".join(bad))
    if not rows.where("bucket = 'custody'").head(1):
        raise Refused("no custody codes; the foreign leg would be empty")
    return rows.withColumnRenamed("_edition", edition) if edition else rows.drop("_edition")


def custody_set(reference: DataFrame, bucket: str) -> DataFrame:
    """(code, name) of one bucket: custody, execution or domestic."""
    if bucket not in CUSTODY_MAPS.values():
        raise Refused(f"no bucket is called {bucket!r}")
    return reference.where(F.col("bucket") == bucket).select("code", "name")


def candidate_isins(instruments: DataFrame) -> DataFrame:
    """(lei, isins): the valid equity codes among each entity's picked code and candidates."""
    every = F.explode(F.array_union(F.array("isin"), F.coalesce("candidates", F.array().cast("array<string>"))))
    flat = instruments.select("lei", every.alias("code")).where(I.isin_ok(F.col("code")) & I.equity_isin(F.col("code")))
    return flat.groupBy("lei").agg(F.array_sort(F.collect_set("code")).alias("isins"))


def sector_problems(sectors: DataFrame, memberships: DataFrame) -> DataFrame:
    """(kind, key, problem) of (code, level, parent) and (ticker, leaf): parents that are not there, levels that do not fit, members off the leaves."""
    up = sectors.select(F.col("code").alias("parent"), F.lit(True).alias("there")).distinct()
    s = sectors.select("code", "level", "parent").join(up, "parent", "left")
    problem = F.when(F.col("parent").isNotNull() & F.col("there").isNull(), "unknown parent").when((F.col("level") == 2) & F.col("parent").isNull(), "leaf without a parent").when((F.col("level") == 1) & F.col("parent").isNotNull(), "main sector with a parent")
    a = s.select(F.lit("sector").alias("kind"), F.col("code").alias("key"), problem.alias("problem"))
    m = memberships.select("ticker", F.col("leaf").alias("code")).join(sectors.select("code", "level"), "code", "left")
    b = m.select(F.lit("member").alias("kind"), F.col("ticker").alias("key"), F.when(F.col("level").isNull(), "unknown sector").when(F.col("level") != 2, "not a leaf").alias("problem"))
    return a.unionByName(b).where("problem is not null")


def refuse_bad_sectors(sectors: DataFrame, memberships: DataFrame) -> None:
    found = [f"{r['kind']} {r['key']}: {r['problem']}" for r in sector_problems(sectors, memberships).orderBy("kind", "key").limit(5).collect()]
    if found:
        raise Refused("; ".join(found))


def main_sectors(sectors: DataFrame) -> DataFrame:
    """(code, main): a leaf's parent; any other sector is its own."""
    return sectors.select("code", F.when(F.col("level") == 2, F.col("parent")).otherwise(F.col("code")).alias("main"))


def lookup_sectors(tickers: DataFrame, sectors: DataFrame, memberships: DataFrame) -> DataFrame:
    """(ticker, leaf, main, status) of each distinct ticker."""
    asked = tickers.select(_clean("ticker").alias("ticker")).distinct()
    of = memberships.select(_clean("ticker").alias("ticker"), "leaf").groupBy("ticker").agg(F.max("leaf").alias("leaf"))
    df = asked.join(of, "ticker", "left").join(main_sectors(sectors).withColumnRenamed("code", "leaf"), "leaf", "left")
    return df.select("ticker", "leaf", "main", F.when(F.col("ticker") == "", "empty-ticker").when(F.col("leaf").isNull(), "not-in-reference").otherwise("found").alias("status"))


def rolled_up(memberships: DataFrame, sectors: DataFrame) -> DataFrame:
    """(symbol, sector) by main sectors; a code that is in no sector stays as it is."""
    return memberships.withColumnRenamed("sector", "code").join(main_sectors(sectors), "code", "left").select("symbol", F.coalesce("main", "code").alias("sector"))


def newest_relations(rows: DataFrame, order: str = "row") -> DataFrame:
    """One row for each (parent, child): the last by ``order``, of these the greatest."""
    rest = [c for c in rows.columns if c not in ("parent", "child", order)]
    last = rows.groupBy("parent", "child").agg(F.max(F.struct(order, *rest)).alias("r"))
    return last.select("parent", "child", *(F.col(f"r.{c}").alias(c) for c in rest))


def backfill_sectors(companies: DataFrame, sectors: DataFrame, memberships: DataFrame, parents: DataFrame) -> DataFrame:
    """(uuid, sector, basis, status): companies linked to their own leaf, else by inheritance from the nearest parent that has one of its own; foreign entities inherit nothing."""
    from ..operators.graph import inherit

    refuse_bad_sectors(sectors, memberships)
    found = lookup_sectors(companies.select("ticker"), sectors, memberships).where("status = 'found'").select("ticker", "leaf")
    own = cut(companies.withColumn("_t", _clean("ticker")).join(found.withColumnRenamed("ticker", "_t"), "_t").where("_t != ''").select(F.col("uuid").alias("node"), F.col("leaf").alias("sector")))
    local = parents.join(companies.where(~F.coalesce("external", F.lit(False))).select(F.col("uuid").alias("child")), "child", "left_semi")
    got = inherit(own, local).select(F.col("node").alias("uuid"), F.col("sector"), F.lit("inherited").alias("basis"))
    linked = own.select(F.col("node").alias("uuid"), "sector", F.lit("reference").alias("basis")).unionByName(got)
    return companies.select("uuid").join(linked, "uuid", "left").select("uuid", "sector", "basis", F.when(F.col("sector").isNull(), "no-sector").otherwise("linked").alias("status"))


def newest_forms(forms: DataFrame, most: int = 5) -> DataFrame:
    """(company, index, published, k): each company's newest forms, at most so many, as only these are asked for."""
    newest = F.row_number().over(Window.partitionBy("company").orderBy(F.desc("published"), F.desc("index")))
    return forms.select("company", "index", "published").distinct().withColumn("k", newest).where(F.col("k") <= most)


def harvested(forms: DataFrame, relations: DataFrame, known: DataFrame, most: int = 5) -> DataFrame:
    """(parent, child, pct, as_of): the relations of each company's newest form that has any, in place of what was known of the same pairs; other known pairs stay.

    ``forms`` has (company, index, published), ``relations`` (index, child, pct) as read
    from the forms, ``known`` (parent, child, pct, as_of).
    """
    asked = newest_forms(forms, most)
    rows = asked.join(relations, "index")
    best = rows.groupBy("company").agg(F.min("k").alias("k"))
    new = rows.join(best, ["company", "k"]).groupBy(F.col("company").alias("parent"), "child").agg(F.max(F.struct("pct", "published")).alias("r")).select("parent", "child", "r.pct", F.to_date("r.published").alias("as_of"))
    return known.select("parent", "child", "pct", "as_of").join(new, ["parent", "child"], "left_anti").unionByName(new)
