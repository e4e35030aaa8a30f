"""Names, identifiers, parsers and monitors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity as I
from ..operators import matching, monitors
from ..sources import parsers
from ..views import Tables
from .base import AS_OF, Catalog, r

CATALOG = Catalog()
add = CATALOG.add

_FORMS = ("A.Ş.", "HOLDİNG A.Ş.", "BANKASI T.A.O.", "SİGORTA", "GAYRİMENKUL YATIRIM ORTAKLIĞI A.Ş.", "SANAYİ VE TİCARET A.Ş.", "FAKTORİNG", "VARLIK KİRALAMA")
_MARKED = "concat('Türk Şirket Ö', c_custkey, ' ', c_mktsegment, ' ', ['" + "', '".join(_FORMS) + "'][1 + c_custkey % 8])"
_FOLDED = "translate({}, 'İıŞşÇçĞğÖöÜü', 'IiSsCcGgOoUu')"


def _names(t: Tables) -> DataFrame:
    form = F.element_at(F.array(*map(F.lit, _FORMS)), (F.col("c_custkey") % 8 + 1).cast("int"))
    return t.read("customer").select("c_custkey", F.concat(F.lit("Türk Şirket Ö"), F.col("c_custkey"), F.lit(" "), F.col("c_mktsegment"), F.lit(" "), form).alias("name"))


@add("ascii_fold", f"SELECT c_custkey, {_FOLDED.format(_MARKED)} AS folded, trim(regexp_replace(upper({_FOLDED.format(_MARKED)}), '[^A-Z0-9]+', ' ', 'g')) AS scored FROM customer")
def ascii_fold(t: Tables):
    return _names(t).select("c_custkey", I.fold(F.col("name")).alias("folded"), I.scored(F.col("name")).alias("scored"))


#: What is left of each form once the legal end is cut.
_REST = ("", "HOLDİNG", "BANKASI", "SİGORTA", "GAYRİMENKUL YATIRIM", "", "FAKTORİNG", "VARLIK KİRALAMA")


@add("brand_tokens", "SELECT c_custkey, trim(concat('Şirket Ö', c_custkey, ' ', c_mktsegment, ' ', ['" + "', '".join(_REST) + "'][1 + c_custkey % 8])) AS brand, concat('Şirket Ö', c_custkey) AS core FROM customer")
def brand_tokens(t: Tables):
    return _names(t).select("c_custkey", F.array_join(I.brand(F.col("name")), " ").alias("brand"), I.query_core(F.col("name"), 2).alias("core"))


@add("query_variants", "SELECT c_custkey, concat_ws('|', concat('Şirket Ö', c_custkey), concat('Şirket Ö', c_custkey, ' ', c_mktsegment), CASE WHEN c_custkey % 8 IN (1, 2, 3, 4, 6, 7) THEN concat('Şirket Ö', c_custkey, ' ', c_mktsegment, ' ', split_part(['', 'HOLDİNG', 'BANKASI', 'SİGORTA', 'GAYRİMENKUL', '', 'FAKTORİNG', 'VARLIK'][1 + c_custkey % 8], ' ', 1)) END, concat('Sirket O', c_custkey), concat('Sirket O', c_custkey, ' ', c_mktsegment), 'Şirket', 'Sirket') AS variants FROM customer")
def query_variants(t: Tables):
    return _names(t).select("c_custkey", F.array_join(I.query_variants(F.col("name")), "|").alias("variants"))


_TYPES = ("NULL", "'HOLDING'", "'BANK'", "'INSURANCE'", "'REIT'", "NULL", "'FACTORING'", "'ASSET_LEASING'")


@add("entity_type", "SELECT c_custkey, [" + ", ".join(_TYPES) + "][1 + c_custkey % 8] AS etype, coalesce([" + ", ".join(_TYPES) + "][1 + c_custkey % 8] <> 'BANK', false) AS conflict FROM customer")
def entity_type(t: Tables):
    kind = I.entity_type(F.col("name"))
    return _names(t).select("c_custkey", kind.alias("etype"), I.type_conflict(kind, F.lit("BANK")).alias("conflict"))


def _all_words() -> list[tuple[int, str, tuple[str, ...]]]:
    """(rank, kind, words) of every group of words that makes a name one of a kind."""
    return [(rank, kind, words) for rank, (kind, groups) in enumerate(I.KINDS) for words in groups]


_SAID = "[" + ", ".join(f"'{' '.join(w.replace('BANK*', 'KALKINMABANKASI') for w in words)}'" for _, _, words in _all_words()) + ", 'TEKSTIL']"
_GROUPS = "(VALUES " + ", ".join(f"({rank}, '{kind}', [{', '.join(repr(w) for w in words)}])" for rank, kind, words in _all_words()) + ") g(rank, kind, words)"


#: Every customer's name with the words of one group, and of another one, so that precedence shows.
@add("entity_kinds", f"WITH n AS (SELECT c_custkey, string_split(concat('FIRMA ', {_SAID}[1 + c_custkey % {len(_all_words()) + 1}], ' ', {_SAID}[1 + c_custkey // 7 % {len(_all_words()) + 1}]), ' ') AS t FROM customer), m AS (SELECT c_custkey, kind, row_number() OVER (PARTITION BY c_custkey ORDER BY rank) AS k FROM n, {_GROUPS} WHERE len(list_filter(words, lambda w: CASE WHEN w = 'BANK*' THEN len(list_filter(t, lambda x: regexp_matches(x, 'BANK(ASI)?$'))) > 0 ELSE list_contains(t, w) END)) = len(words)) SELECT c.c_custkey, m.kind AS etype FROM customer c LEFT JOIN m ON m.c_custkey = c.c_custkey AND m.k = 1")
def entity_kinds(t: Tables):
    said = [" ".join(w.replace("BANK*", "KalkınmaBankası") for w in words) for _, _, words in _all_words()] + ["Tekstil"]
    word = lambda place: F.get(F.array(*map(F.lit, said)), (place % len(said)).cast("int"))
    key = F.col("c_custkey")
    name = F.concat_ws(" ", F.lit("Firma"), word(key), word(F.floor(key / 7)))
    return t.read("customer").select("c_custkey", I.entity_type(name).alias("etype"))


_NEEDLES = "[" + ", ".join(f"'{needle}'" for needle, _ in I.CLASSES) + ", 'BANKALAR']"


@add("universe_classes", f"WITH s AS (SELECT c_custkey, CASE c_custkey % 11 WHEN 9 THEN '' WHEN 10 THEN NULL ELSE concat('BIST ', {_NEEDLES}[1 + c_custkey % {len(I.CLASSES) + 1}], 'LARI ', {_NEEDLES}[1 + c_custkey // 5 % {len(I.CLASSES) + 1}]) END AS sector FROM customer) SELECT c_custkey, CASE WHEN sector IS NULL OR sector = '' THEN NULL " + " ".join(f"WHEN contains(sector, '{needle}') THEN '{name}'" for needle, name in I.CLASSES) + " ELSE 'operating' END AS universe_class FROM s")
def universe_classes(t: Tables):
    """Every class, and sectors that two of them fit."""
    needles = [needle for needle, _ in I.CLASSES] + ["BANKALAR"]
    word = lambda place: F.get(F.array(*map(F.lit, needles)), (place % len(needles)).cast("int"))
    key = F.col("c_custkey")
    sector = F.when(key % 11 == 9, "").when(key % 11 == 10, F.lit(None)).otherwise(F.concat(F.lit("BIST "), word(key), F.lit("LARI "), word(F.floor(key / 5))))
    return t.read("customer").select("c_custkey", I.universe_class(sector).alias("universe_class"))


@add("identity_tokens", "SELECT c_custkey, upper(concat('SIRKET,O', c_custkey, ',', c_mktsegment)) AS own FROM customer")
def identity_tokens(t: Tables):
    return _names(t).select("c_custkey", F.array_join(I.identity_tokens(F.col("name")), ",").alias("own"))


@add("universe_class", "SELECT c_custkey, ['operating', 'holding', 'operating', 'operating', 'operating', 'operating', 'operating', 'operating'][1 + c_custkey % 8] AS universe_class FROM customer")
def universe_class(t: Tables):
    return _names(t).select("c_custkey", I.universe_class(F.col("name")).alias("universe_class"))


@add("name_slug", f"SELECT c_custkey, trim(regexp_replace(lower({_FOLDED.format(_MARKED)}), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer")
def name_slug(t: Tables):
    return _names(t).select("c_custkey", I.slug(F.col("name")).alias("slug"))


_ISIN = "concat('TR', ['A', 'E', 'F'][1 + p_partkey % 3], lpad(CAST(p_partkey % 100000000 AS VARCHAR), 8, '0'), CAST(p_size % 10 AS VARCHAR))"


def _isins(t: Tables) -> DataFrame:
    return t.read("part").selectExpr("p_partkey", "p_brand as ticker", "concat('TR', element_at(array('A', 'E', 'F'), cast(1 + p_partkey % 3 as int)), lpad(cast(p_partkey % 100000000 as string), 8, '0'), cast(p_size % 10 as string)) as isin")


# T is 29, R 27, A 10, E 14 and F 15: the digits before the number, doubled in turn from the right
_LUHN = f"list_sum(list_transform(range(1, length(dg) + 1), lambda i: CASE WHEN (length(dg) - i) % 2 = 1 THEN (2 * CAST(dg[i] AS INTEGER)) // 10 + (2 * CAST(dg[i] AS INTEGER)) % 10 ELSE CAST(dg[i] AS INTEGER) END)) % 10 = 0"
_CODES = f"codes AS (SELECT p_partkey, p_brand AS ticker, {_ISIN} AS isin, concat('2927', ['10', '14', '15'][1 + p_partkey % 3], substr({_ISIN}, 4)) AS dg FROM part), checked AS (SELECT *, {_LUHN} AS ok FROM codes)"


@add("isin_check", f"WITH {_CODES} SELECT p_partkey, isin, ok, p_partkey % 3 <> 2 AS equity FROM checked")
def isin_check(t: Tables):
    return _isins(t).select("p_partkey", "isin", I.isin_ok(F.col("isin")).alias("ok"), I.equity_isin(F.col("isin")).alias("equity"))


@add("isin_list", f"WITH {_CODES}, good AS (SELECT ticker, count(DISTINCT isin) AS n, min(isin) AS isin FROM checked WHERE ok AND p_partkey % 3 <> 2 GROUP BY ticker) SELECT t.ticker, CASE WHEN n = 1 THEN isin END AS isin, CASE WHEN n IS NULL THEN 'invalid' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS status FROM (SELECT DISTINCT ticker FROM codes) t LEFT JOIN good USING (ticker)")
def isin_list(t: Tables):
    return parsers.isin_list(_isins(t))


@add("isin_pick", f"WITH {_CODES}, g AS (SELECT p_partkey % 700 AS lei, isin, p_partkey % 3 AS k FROM codes), s AS (SELECT lei, min(isin) FILTER (k = 0 AND contains(isin, CAST(lei AS VARCHAR))) AS named, count(*) FILTER (k <> 2) AS n, min(isin) FILTER (k <> 2) AS one, count(*) AS total FROM g GROUP BY lei) SELECT lei, CASE WHEN named IS NOT NULL THEN named WHEN n = 1 THEN one END AS isin, CASE WHEN named IS NOT NULL THEN 'TRA+ticker' WHEN n = 1 THEN 'single-equity' WHEN n > 1 THEN 'ambiguous-multi-equity' ELSE 'no-equity-class' END AS method FROM s")
def isin_pick(t: Tables):
    g = _isins(t).groupBy((F.col("p_partkey") % 700).alias("lei")).agg(F.collect_set("isin").alias("isins"))
    return g.withColumn("p", I.pick_isin(F.col("isins"), F.col("lei").cast("string"))).select("lei", "p.isin", "p.method")


@add("turkish_numbers", f"SELECT o_orderkey, {r('o_totalprice')} AS amount, CASE WHEN o_orderkey % 120 <= 100 THEN {r('o_orderkey % 120 + 0.5 * (CASE WHEN o_orderkey % 120 < 100 THEN 1 ELSE 0 END)')} END AS pct FROM orders")
def turkish_numbers(t: Tables):
    amount = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    pct = F.concat(F.lit("%"), (F.col("o_orderkey") % 120).cast("string"), F.when(F.col("o_orderkey") % 120 < 100, ",5").otherwise(",0"))
    return t.read("orders").select("o_orderkey", I.turkish_amount(amount).alias("amount"), I.percent(pct).alias("pct"))


def _wanted(t: Tables) -> DataFrame:
    """Every customer's name, every other one without its ending; and some names of nobody."""
    n = _names(t)
    known = F.when(F.col("c_custkey") % 2 == 0, F.regexp_replace("name", "A\\.Ş\\.$", "")).otherwise(F.col("name"))
    return n.select(known.alias("name")).union(n.where("c_custkey % 3 = 0 and c_custkey % 2 = 1").select(F.concat(F.lit("Bilinmeyen X"), F.col("c_custkey"))))


def _match_sql() -> str:
    """A company must share its number's first letters with a name, as its number is rare; the segment adds to the score."""
    kinds = "[NULL, 'HOLDING', 'BANK', 'INSURANCE', 'REIT', NULL, 'FACTORING', 'ASSET_LEASING'][1 + c_custkey % 8]"
    return f"""
        WITH c AS (SELECT c_custkey AS uuid, {_MARKED} AS company, left(concat('O', c_custkey), 5) AS p, left(upper(c_mktsegment), 5) AS seg, {kinds} AS kind FROM customer),
        w AS (SELECT CASE WHEN uuid % 2 = 0 THEN regexp_replace(company, 'A\\.Ş\\.$', '') ELSE company END AS name, p, seg, kind FROM c),
        pairs AS (SELECT name, uuid, company, CASE WHEN c.seg = w.seg THEN 3 ELSE 2 END AS shared FROM w JOIN c USING (p) WHERE w.kind IS NULL OR w.kind = coalesce(c.kind, '')),
        best AS (SELECT name, uuid, shared FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY shared DESC, company, uuid) AS n FROM pairs) WHERE n = 1)
        SELECT name, uuid AS key, round(shared / 3.0, 3) AS score, 'matched' AS status FROM best
        UNION ALL SELECT concat('Bilinmeyen X', c_custkey), NULL, NULL, 'no-confident-match' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 1
    """


@add("name_match", _match_sql())
def name_match(t: Tables):
    return matching.match(_wanted(t), _names(t).withColumnRenamed("c_custkey", "uuid"))


@add("listing_status", "SELECT c_custkey AS uuid, CASE WHEN c_nationkey = 0 THEN 'no_ticker' WHEN c_custkey % 3 = 0 OR c_custkey % 7 = 0 THEN 'equity_traded' ELSE 'not_traded' END AS status FROM customer")
def listing_status(t: Tables):
    c = t.read("customer").selectExpr("c_custkey as uuid", "if(c_nationkey = 0, '', concat('T', c_custkey)) as ticker", "c_custkey")
    return matching.listing_status(c, c.where("c_custkey % 3 = 0"), c.where("c_custkey % 7 = 0 and ticker != ''"))


@add("isin_cross_validation", f"WITH {_CODES} SELECT p_partkey AS uuid, CASE WHEN p_partkey % 5 <> 0 THEN isin END AS isin, CASE WHEN p_partkey % 5 = 0 THEN 'none' WHEN NOT ok THEN 'invalid' WHEN p_partkey % 4 = 0 THEN 'agree' WHEN p_partkey % 4 = 1 THEN 'conflict' ELSE 'authoritative' END AS method FROM checked")
def isin_cross_validation(t: Tables):
    i = _isins(t).withColumn("ticker", F.col("p_partkey").cast("string"))
    c = i.selectExpr("p_partkey as uuid", "ticker")
    other = i.where("p_partkey % 4 < 2").selectExpr("p_partkey as uuid", "if(p_partkey % 4 = 0, array(isin), array('TRAXXXXXXXX1')) as isins")
    return matching.cross_validated(c, i.where("p_partkey % 5 != 0"), other)


@add("parent_edges", "WITH p AS (SELECT s_suppkey AS uuid, s_suppkey // 2 AS d, s_suppkey // 4 AS u FROM supplier), l AS (SELECT uuid, 'direct' AS kind, d AS x FROM p UNION ALL SELECT uuid, 'ultimate', u FROM p WHERE u <> d) SELECT CASE WHEN x > 0 AND x % 5 <> 0 THEN CAST(x AS VARCHAR) ELSE concat('ext-l', x) END AS src, CAST(uuid AS VARCHAR) AS dst, kind, CASE WHEN x > 0 AND x % 5 <> 0 THEN 'known' ELSE 'external' END AS status FROM l")
def parent_edges(t: Tables):
    s = t.read("supplier")
    p = s.selectExpr("cast(s_suppkey as string) as uuid", "concat('L', s_suppkey div 2) as direct", "concat('L', s_suppkey div 4) as ultimate")
    return matching.parent_edges(p, s.where("s_suppkey % 5 != 0").selectExpr("cast(s_suppkey as string) as uuid", "concat('L', s_suppkey) as lei"))


def _payloads(t: Tables) -> DataFrame:
    """Each brand's bars as one vendor payload."""
    b = t.bars().select("symbol", F.struct(F.col("bar_date").cast("string").alias("date"), "close", F.col("volume_try").alias("volume"), "quantity").alias("b"))
    data = F.struct(F.struct("symbol", "allBars").alias("data"))
    return b.groupBy("symbol").agg(F.collect_list("b").alias("allBars")).select(F.to_json(data["data"].alias("x")).alias("inner")).select(F.concat(F.lit('{"data":'), "inner", F.lit("}")).alias("payload"))


@add("parse_bars", f"SELECT symbol, bar_date, {r('close')} AS close, {r('volume_try')} AS volume_try, {r('quantity')} AS quantity, bar_date AS knowledge_date FROM bars", "bars")
def parse_bars(t: Tables):
    return parsers.bars(_payloads(t)).select("symbol", "bar_date", "close", "volume_try", "quantity", "knowledge_date")


@add("parse_observations", f"SELECT 'VIX' AS factor, CAST(o_orderdate AS DATE) AS bar_date, {r('o_totalprice')} AS value, CAST(o_orderdate AS DATE) AS knowledge_date FROM orders WHERE o_orderkey % 9 <> 0")
def parse_observations(t: Tables):
    p = t.read("orders").selectExpr("concat('{\"observations\":[{\"date\":\"', date_format(o_orderdate, 'yyyy-MM-dd'), '\",\"value\":\"', if(o_orderkey % 9 = 0, '.', cast(o_totalprice as string)), '\"}]}') as payload")
    return parsers.observations(p, "VIX")


@add("parse_consumer_prices", f"SELECT 'CPI' AS factor, CAST(date_trunc('month', o_orderdate) AS DATE) AS bar_date, {r('o_totalprice')} AS value, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) + 2 AS knowledge_date FROM orders")
def parse_consumer_prices(t: Tables):
    p = t.read("orders").selectExpr("concat('{\"items\":[{\"Tarih\":\"', date_format(o_orderdate, 'yyyy-M'), '\",\"TP_FG_J0\":\"', cast(o_totalprice as string), '\"}]}') as payload")
    return parsers.consumer_prices(p)


@add("parse_weekly_series", f"SELECT 'FFLOW' AS factor, CAST(o_orderdate AS DATE) AS bar_date, {r('o_totalprice')} AS value, CAST(o_orderdate AS DATE) + 6 AS knowledge_date FROM orders")
def parse_weekly_series(t: Tables):
    p = t.read("orders").selectExpr("concat('{\"items\":[{\"Tarih\":\"', date_format(o_orderdate, 'dd-MM-yyyy'), '\",\"TP_MKNETHAR_M7\":\"', cast(o_totalprice as string), '\"}]}') as payload")
    return parsers.weekly_series(p, "TP.MKNETHAR.M7", "FFLOW")


@add("parse_quotes", f"SELECT 'CDS' AS factor, CAST(o_orderdate AS DATE) AS bar_date, {r('o_totalprice')} AS value, CAST(o_orderdate AS DATE) AS knowledge_date FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'")
def parse_quotes(t: Tables):
    p = t.read("orders").selectExpr("concat('{\"result\":{\"quote\":{\"', o_orderkey, '\":{\"DATA_VAL\":\"', date_format(o_orderdate, 'yyyy-MM-dd'), '\",\"CLOSE_VAL\":', cast(o_totalprice as string), '}}}}') as payload")
    return parsers.quotes(p, "CDS", "1997-01-01", "1998-12-31")


@add("html_text_size", "SELECT page_id, length(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(?:script\\b.*?</script|style\\b.*?</style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), ' ')) AS n FROM pages")
def html_text_size(t: Tables):
    return t.read("pages").select("page_id", F.length(parsers.plain(F.col("html"))).cast("long").alias("n"))


@add("subsidiary_rows", "SELECT CAST(s_suppkey AS VARCHAR) AS source, concat('Child ', s_suppkey, ' A.Ş.') AS child, 'Üretim' AS activity, floor((s_suppkey * 1000 + 0.5) * 1e6 + 0.5) / 1e6 AS capital, CAST(s_suppkey % 100 AS DOUBLE) AS pct FROM supplier")
def subsidiary_rows(t: Tables):
    s = t.read("supplier").selectExpr("cast(s_suppkey as string) as source", "concat('<table><tr><th>Ad</th></tr><tr><td><b>Child ', s_suppkey, ' A.Ş.</b></td><td>Üretim</td><td>', translate(format_number(s_suppkey * 1000 + 0.5D, 1), ',.', '.,'), '</td><td>%', s_suppkey % 100, '</td></tr></table>') as html")
    return parsers.subsidiaries(s).drop("row")


@add("custody_codes", "SELECT c_mktsegment AS bucket, substr(c_name, -3) AS code, CASE WHEN NOT regexp_full_match(substr(c_name, -3), '[A-Z0-9]{3}') THEN 'malformed' WHEN n > 1 THEN 'in_several_buckets' END AS problem FROM customer JOIN (SELECT substr(c_name, -3) AS code, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 1) x ON x.code = substr(c_name, -3)")
def custody_codes(t: Tables):
    return parsers.custody_codes(t.read("customer").selectExpr("c_mktsegment as bucket", "right(c_name, 3) as code"))


@add("counterparty_bucket", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'public' WHEN 1 THEN 'foreign' WHEN 2 THEN 'corporate' WHEN 3 THEN 'other' ELSE 'unnamed' END AS bucket FROM customer")
def counterparty_bucket(t: Tables):
    who = F.element_at(F.array(*map(F.lit, ("Sağlık Bakanlığı", "Acme GmbH", "Koza A.Ş.", "bir kişi", " "))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return t.read("customer").select("c_custkey", monitors.bucket(who).alias("bucket"))


_PEOPLE = "co AS (SELECT c_custkey AS uuid, concat('I', c_custkey // 2) AS isin, concat('F', c_custkey) AS filing_id, CASE WHEN c_nationkey % 5 <> 0 THEN concat('L', c_custkey) END AS lei FROM customer)"


def _people(t: Tables) -> DataFrame:
    return t.read("customer").selectExpr("c_custkey as uuid", "concat('I', c_custkey div 2) as isin", "concat('F', c_custkey) as filing_id", "if(c_nationkey % 5 != 0, concat('L', c_custkey), null) as lei")


@add("leg_coverage", f"WITH {_PEOPLE}, x AS (SELECT 'isin' AS leg, avg(CASE WHEN isin IS NOT NULL THEN 1.0 ELSE 0 END) AS c, 0.8::DOUBLE AS floor FROM co UNION ALL SELECT 'filing_id', avg(CASE WHEN filing_id IS NOT NULL THEN 1.0 ELSE 0 END), 0.99 FROM co UNION ALL SELECT 'lei', avg(CASE WHEN lei IS NOT NULL THEN 1.0 ELSE 0 END), 0.88 FROM co) SELECT leg, {r('round(c, 4)')} AS coverage, floor, c >= floor AS ok FROM x")
def leg_coverage(t: Tables):
    return monitors.leg_coverage(_people(t))


@add("bridge_health", f"WITH {_PEOPLE}, c AS (SELECT isin, count(*) AS n FROM co GROUP BY isin) SELECT CASE WHEN (SELECT avg(CASE WHEN lei IS NOT NULL THEN 1.0 ELSE 0 END) FROM co) >= 0.88 THEN 0::BIGINT ELSE 1::BIGINT END AS n_below_floor, count(*) FILTER (n > 1) AS n_collisions, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS n_broken_round_trips, count(*) FILTER (n > 1) = 0 AND (SELECT avg(CASE WHEN lei IS NOT NULL THEN 1.0 ELSE 0 END) FROM co) >= 0.88 AS healthy FROM c")
def bridge_health(t: Tables):
    return monitors.bridge_health(_people(t))


def _fresh(t: Tables) -> DataFrame:
    last = t.read("orders").where(f"o_orderdate <= date'{AS_OF}'").selectExpr("concat('C', o_custkey) as symbol", "to_date(o_orderdate) as bar_date")
    return monitors.freshness(t.read("customer").selectExpr("concat('C', c_custkey) as symbol"), monitors.latest_bars(last), AS_OF, 90)


_FRESH = f"fr AS (SELECT concat('C', c_custkey) AS symbol, d AS last_bar, CAST(DATE '{AS_OF}' - d AS INTEGER) AS age_days, CASE WHEN d IS NULL THEN 'missing' WHEN DATE '{AS_OF}' - d > 90 THEN 'stale' ELSE 'current' END AS status FROM customer LEFT JOIN (SELECT o_custkey, CAST(max(o_orderdate) AS DATE) AS d FROM orders WHERE o_orderdate <= DATE '{AS_OF}' GROUP BY 1) ON o_custkey = c_custkey)"


@add("freshness", f"WITH {_FRESH} SELECT * FROM fr")
def freshness(t: Tables):
    return _fresh(t)


_PULLS = f"{_FRESH}, pl AS (SELECT symbol, coalesce(last_bar - 5, DATE '1995-01-01') AS start, DATE '{AS_OF}' AS \"end\" FROM fr WHERE status <> 'current')"


@add("pull_windows", f"WITH {_PULLS} SELECT * FROM pl")
def pull_windows(t: Tables):
    return monitors.pull_windows(_fresh(t), AS_OF, "1995-01-01")


@add("pull_chunks", f"WITH {_PULLS}, x AS (SELECT symbol, start, \"end\" AS e, unnest(range(0, CAST(\"end\" - start AS BIGINT) // 900 + 1)) AS i FROM pl) SELECT symbol, start + CAST(i * 900 AS INTEGER) AS start, least(e, start + CAST(i * 900 + 899 AS INTEGER)) AS \"end\" FROM x")
def pull_chunks(t: Tables):
    return monitors.chunks(monitors.pull_windows(_fresh(t), AS_OF, "1995-01-01"))


@add("listing_diff", "WITH u AS (SELECT concat('F', c_custkey) AS filing_id, concat('T', c_custkey, CASE WHEN c_custkey % 6 = 0 THEN ', X' ELSE '' END) AS ticker FROM customer WHERE c_custkey % 5 <> 0), k AS (SELECT concat('F', c_custkey) AS filing_id, concat('T', c_custkey + CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END) AS ticker FROM customer WHERE c_custkey % 7 <> 0) SELECT coalesce(u.filing_id, k.filing_id) AS filing_id, u.ticker AS upstream_ticker, k.ticker AS known_ticker, CASE WHEN k.filing_id IS NULL THEN 'new' WHEN u.filing_id IS NULL THEN 'retired' ELSE 'ticker_change' END AS change FROM u FULL JOIN k ON u.filing_id = k.filing_id WHERE k.filing_id IS NULL OR u.filing_id IS NULL OR string_split(u.ticker, ', ')[1] <> k.ticker")
def listing_diff(t: Tables):
    c = t.read("customer")
    return monitors.listing_diff(c.where("c_custkey % 5 != 0").selectExpr("concat('F', c_custkey) as filing_id", "concat('T', c_custkey, if(c_custkey % 6 = 0, ', X', '')) as ticker"), c.where("c_custkey % 7 != 0").selectExpr("concat('F', c_custkey) as filing_id", "concat('T', c_custkey + if(c_custkey % 11 = 0, 1, 0)) as ticker"))


@add("onboarding_queue", "WITH x AS (SELECT concat('C', c_custkey) AS ticker, c_custkey % 2 = 0 AS a, c_custkey % 3 = 0 AS b, c_custkey IN (SELECT o_custkey FROM orders) AS c FROM customer) SELECT ticker, concat_ws(',', CASE WHEN NOT a THEN 'universe' END, CASE WHEN NOT b THEN 'betas' END, CASE WHEN NOT c THEN 'returns' END) AS pending, CAST((NOT a)::INT + (NOT b)::INT + (NOT c)::INT AS INTEGER) AS n_pending FROM x WHERE NOT (a AND b AND c)")
def onboarding_queue(t: Tables):
    c = t.read("customer").selectExpr("concat('C', c_custkey) as ticker", "c_custkey")
    done = {"universe": c.where("c_custkey % 2 = 0"), "betas": c.where("c_custkey % 3 = 0"), "returns": t.read("orders").selectExpr("concat('C', o_custkey) as ticker")}
    return monitors.onboarding(c, done)


@add("anchor_drift", f"SELECT o_orderkey, {r('o_totalprice')} AS expected, CASE WHEN o_orderkey % 5 <> 0 THEN {r('o_totalprice + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END')} END AS found, CASE WHEN o_orderkey % 5 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'drift' ELSE 'ok' END AS status FROM orders")
def anchor_drift(t: Tables):
    o = t.read("orders").select("o_orderkey", F.col("o_totalprice").alias("value"))
    return monitors.drift(o, o.where("o_orderkey % 5 != 0").withColumn("value", F.expr("value + if(o_orderkey % 7 = 0, 1, 0)")), ["o_orderkey"], "value")


@add("smoke_status", "SELECT concat('s', n_nationkey) AS source, CASE n_nationkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'unreadable' WHEN 2 THEN 'drift' WHEN 3 THEN 'stale' ELSE 'ok' END AS status FROM nation")
def smoke_status(t: Tables):
    n = t.read("nation")
    rep = n.where("n_nationkey % 5 > 0").selectExpr("concat('s', n_nationkey) as source", "case n_nationkey % 5 when 1 then null when 2 then false else true end as ok", "if(n_nationkey % 5 = 3, date'2024-01-01', date'2024-03-01') as written")
    return monitors.smoke_status(rep, n.selectExpr("concat('s', n_nationkey) as source"), "2024-03-10")


@add("heartbeat", f"WITH h AS ({CATALOG.sql['bridge_health']}) SELECT n_collisions = 0 AND n_below_floor <= 1 AS green, concat_ws(',', CASE WHEN n_collisions <> 0 THEN 'collisions' END, CASE WHEN n_below_floor > 1 THEN 'floors' END) AS reasons FROM h")
def heartbeat(t: Tables):
    h = monitors.bridge_health(_people(t))
    return monitors.heartbeat({"collisions": F.col("n_collisions") == 0, "floors": F.col("n_below_floor") <= 1}, h)
