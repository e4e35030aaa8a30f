"""Document fingerprints by I-Match over several randomised lexicons.

The lexicon holds the terms whose share of documents lies in a band (a band of inverse
document frequency); counts cover the whole corpus. Each of ``SUBSETS`` random subsets of
the lexicon gives one part of a fingerprint: the hash of the document's distinct terms in
that subset, sorted. Subsets are thin and of several densities, so that some of them miss
all of the terms an edit has touched, for short texts and for long ones. Two fingerprints
are alike by the share of equal parts among those that are not empty in both.

A term is in the lexicon if at least ``low`` of all documents have it, so there are at
most (mean distinct terms of a document) / low such terms at any size of the corpus; this
bounded list is part of the query plan. Everything is DataFrame and SQL functions.

The next document of each is found in ranges of keys and, within a key, of a hash of the
text. Bounds are keys of the table itself, from Spark's range partitioning, so no range
depends on how keys are spread or what they look like, and a key with many rows is dealt
to several. (Rows of equal key and text are the same row; they stay together.)

Defined cases: a null text is an empty one; a text with fewer than ``FEW`` lexicon terms
is fingerprinted by all its terms, without any by its whole text; equal texts have equal
fingerprints; keys may be numbers, dates or strings; rows of equal keys follow each other
by a hash of their texts (descending), null keys come behind all others; a table of one
row is followed by itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import collect_bounded

LOW, HIGH = 0.002, 0.2
#: Densities of the random lexicon subsets (one of so many terms), and how many of each.
DENSITIES, EACH = (24, 96, 384, 1536), 16
SUBSETS = len(DENSITIES) * EACH
FEW = 4
MAX_LEXICON = 1_500_000
_WORD_EDGE = r"[^\\p{L}\\p{N}]+"


def terms(text: str) -> str:
    """SQL for the distinct terms of a text, as 64-bit hashes."""
    return f"array_distinct(transform(filter(split(lower({text}), '{_WORD_EDGE}'), w -> w != ''), w -> xxhash64(w)))"


def lexicon(docs: DataFrame, *, text: str = "text", low: float = LOW, high: float = HIGH) -> list[list[int]]:
    """The terms in the band, dealt to buckets by their value."""
    total = docs.count()
    counts = docs.selectExpr(f"explode({terms(text)}) as term").groupBy("term").count()
    band = counts.where((F.col("count") >= low * total) & (F.col("count") <= high * total)).select("term")
    found = [r[0] for r in collect_bounded(band, MAX_LEXICON, "the lexicon")]
    size = 1 << max(0, (len(found) // 4).bit_length())
    out: list[list[int]] = [[] for _ in range(size)]
    for t in sorted(found):
        out[t % size].append(t)
    return out


def parts(text: str, words: list[list[int]], name: str) -> list[tuple[str, Column]]:
    """Columns to add one after the other; the last, ``name``, is the fingerprint: an array of hashes, null where empty."""
    table = F.from_json(F.lit(json.dumps(words)), "array<array<bigint>>")  # folded to a constant before execution
    known = F.filter(F.col(f"{name}_all"), lambda t: F.array_contains(F.element_at(table, F.pmod(t, F.lit(len(words))).cast("int") + 1), t))
    whole = F.array(F.xxhash64(F.lit("text"), F.col(text)))
    used = f"case when size({name}_known) >= {FEW} then {name}_known when size({name}_all) > 0 then {name}_all else {name}_whole end"
    return [
        (f"{name}_all", F.expr(terms(text))),
        (f"{name}_known", known),
        (f"{name}_whole", whole),
        (f"{name}_used", F.array_sort(F.expr(used))),
        (name, F.expr(_subset_hashes(f"{name}_used"))),
    ]


def _subset_hashes(used: str) -> str:
    """SQL: for each subset the hash of the terms in it, or null.

    One pass over the terms per density: a term belongs to subset e of density d if that
    density's hash of it is e modulo EACH x d, so the EACH subsets of a density are disjoint.
    """
    groups = []
    for i, d in enumerate(DENSITIES):
        width = max(d, EACH)
        numbered = f"filter(transform({used}, t -> struct(pmod(xxhash64(t, {i}), {width}) as e, t as t)), s -> s.e < {EACH})"
        groups.append(f"element_at(transform(array({numbered}), g -> transform(sequence(0, {EACH - 1}), e -> element_at(transform(array(transform(filter(g, s -> s.e = e), s -> s.t)), h -> if(size(h) = 0, cast(null as bigint), xxhash64(h))), 1))), 1)")
    return f"concat({', '.join(groups)})"


def shown(fingerprint: Column) -> Column:
    """A fingerprint as a string: 8 hex digits for each part, - for an empty one."""
    return F.array_join(F.transform(fingerprint, lambda h: F.coalesce(F.lower(F.lpad(F.hex(F.pmod(h, F.lit(1 << 32))), 8, "0")), F.lit("-"))), ".")


def likeness(a: str, b: str) -> Column:
    """The share of equal parts among those that one of both has; 1 for equal fingerprints without any."""
    both = f"zip_with({a}, {b}, (x, y) -> struct(x <=> y and x is not null as same, x is not null or y is not null as any))"
    return F.expr(f"coalesce(try_divide(size(filter({both}, s -> s.same)), size(filter({both}, s -> s.any))), 1D)")


def fingerprints(docs: DataFrame, words: list[list[int]], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of each document."""
    df = docs.select(key, F.coalesce(text, F.lit("")).alias("_text"))
    for name, column in parts("_text", words, "_print"):
        df = df.withColumn(name, column)
    return df.select(key, shown(F.col("_print")).alias("fingerprint"))


def _bounds(keyed: DataFrame, ranges: int) -> list[tuple]:
    """Where the ranges of (k, _g) but the first begin: Spark's own range partitioning of the keys, without texts."""
    if ranges < 2:
        return []
    firsts = keyed.repartitionByRange(ranges, F.col("k").asc_nulls_first(), "_g").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("k", "_g")).alias("first"))
    return [tuple(r["first"]) for r in firsts.orderBy("p").collect()][1:]  # a row for each range


def _plain(key):
    """A key as JSON; a bound need not be exact, only the same everywhere."""
    return key if isinstance(key, (int, float, str, type(None))) else float(key) if isinstance(key, Decimal) else key.isoformat()


def neighbours(docs: DataFrame, bucket_rows: int = 2000, most_buckets: int = 20_000) -> DataFrame:
    """The rows (k, t) with columns _g, _bucket and _ghost, so that a window by _bucket, descending k and _g, has each row's next row.

    A range's next row lies in another one; that row is sent there too, as a ghost. The
    last row's next one is the first. Ranges hold ``bucket_rows`` rows, more from
    ``bucket_rows * most_buckets`` rows on; the driver gets one key for each.
    """
    kind = docs.schema["k"].dataType
    if not isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.StringType)):
        raise TypeError(f"no ranges for keys of type {kind.simpleString()}")
    rows = docs.count()
    each = max(bucket_rows, rows // most_buckets)
    keyed = docs.withColumn("_g", F.xxhash64("t"))
    bounds = _bounds(keyed.select("k", "_g"), -(-rows // each))
    text = json.dumps([{"k": _plain(k), "g": g} for k, g in bounds])
    table = f"from_json({_quoted(text)}, 'array<struct<k:{kind.simpleString()},g:bigint>>')"  # folded to a constant before execution
    middle = "cast((s.l + s.h) div 2 as int)"
    step = f"if(element_at({table}, {middle} + 1) <= struct(k, _g as g), named_struct('l', {middle} + 1, 'h', s.h), named_struct('l', s.l, 'h', {middle}))"
    range_of = f"aggregate(sequence(1, {len(bounds).bit_length() + 1}), named_struct('l', 0, 'h', {len(bounds)}), (s, i) -> if(s.l >= s.h, s, {step}), s -> s.l)" if bounds else "0"
    dealt = keyed.withColumn("_bucket", F.lit(len(bounds)).cast("bigint") - F.expr(range_of)).select("k", "t", "_g", "_bucket")
    if not rows:
        return dealt.withColumn("_ghost", F.lit(False))
    tops = dealt.groupBy("_bucket").agg(F.max(F.struct("k", "_g")).alias("top"))  # a row for each range
    order = sorted(collect_bounded(tops, 2 * most_buckets, "key ranges"))
    target = [(order[(i + 1) % len(order)][1][0], order[(i + 1) % len(order)][1][1], order[i][0]) for i in range(len(order))]
    ghosts = docs.sparkSession.createDataFrame(target, T.StructType([T.StructField("gk", kind), T.StructField("gg", T.LongType()), T.StructField("_to", T.LongType())]))
    extra = dealt.join(F.broadcast(ghosts), F.col("k").eqNullSafe(F.col("gk")) & (F.col("_g") == F.col("gg"))).groupBy("_to").agg(F.first("k").alias("k"), F.min("t").alias("t"), F.first("_g").alias("_g"))
    whole = dealt.withColumn("_ghost", F.lit(False)).unionByName(extra.select("k", "t", "_g", F.col("_to").alias("_bucket"), F.lit(True).alias("_ghost")))
    # as many tasks as ranges, so that none grows with the table
    return whole.repartition(len(order), "_bucket")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def compare(docs: DataFrame, *, key: str = "doc_id", text: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness, and that to the next document's.

    The edited text: the last third of the characters replaced by as many first ones (or
    all) of the next document, by descending key; after the last comes the first.
    """
    mine = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    words = lexicon(mine, text="t", low=low, high=high)
    # a ghost sorts behind all rows of its range: it is the next of the last one
    by = Window.partitionBy("_bucket").orderBy(F.col("_ghost").asc(), F.col("k").desc(), F.col("_g").desc(), F.col("t"))
    df = neighbours(mine).withColumn("n_chars", F.length("t").cast("long")).withColumn("_next", F.lead("t").over(by))
    df = df.withColumn("e", F.expr("concat(substr(t, 1, cast(n_chars - n_chars div 3 as int)), substr(coalesce(_next, t), 1, cast(n_chars div 3 as int)))"))
    for name, column in parts("t", words, "_print") + parts("e", words, "_edited"):
        df = df.withColumn(name, column)
    df = df.select("_bucket", "_ghost", "k", "t", "_g", "n_chars", F.sha2("e", 256).alias("edited_sha256"), "_print", "_edited").withColumn("_after", F.lead("_print").over(by)).where(~F.col("_ghost"))
    return df.select(
        F.col("k").alias(key), "n_chars", "edited_sha256", shown(F.col("_print")).alias("fingerprint"), shown(F.col("_edited")).alias("edited_fingerprint"),
        likeness("_print", "_edited").alias("near_edited"), likeness("_print", "coalesce(_after, _print)").alias("near_next"),
    )
