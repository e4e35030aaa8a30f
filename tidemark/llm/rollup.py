"""Token counts kept as additive totals by source, language and tokenizer version.

Documents are counted once, when they come in, by a tokenizer of a known version; the
counts are a table (``counts``), from which deletions and revisions take what was counted
then, whatever the text is now. A batch of changes becomes signed rows, these are added
up by key before anything is shuffled, and the few sums are written as one attempt of a
batch of a ledger. The batch counts from when its mark is written; a second commit of the
same batch id does nothing, and raises if its sums are others. An attempt that broke off
has no mark and is never read; of two writers' marks one counts. Totals are sums over
the marked attempts.

``fold`` writes what all batches so far add up to, with their ids and digests, so that
totals read one table and the batches since; a folded batch that is sent again still does
nothing. A fold counts from when its list of batches is written; ``sweep`` takes away
what it has made superfluous.

Defined cases: null sources and languages are keys of their own; a null text has no
tokens but is a document; a text of any length is counted whole; repeated rows count each
time; an empty batch is committed and changes nothing; an empty ledger has no totals;
keys whose documents and tokens have all gone are left out; extra columns stay in
``counts``, whatever they are called, and are ignored by the batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import packing
from . import textarrays as TA
from .runtime import materialize

KEYS = ("source", "lang", "tokenizer_version")
#: Counters by version that are one expression: runs of anything but white space; words and single marks.
COUNTERS = {"runs-1": r"[^ \t\n\r\f]+", "words-2": r"[A-Za-z0-9\x{80}-\x{10FFFF}]+|[^A-Za-z0-9\x{80}-\x{10FFFF} \t\n\r\f]"}
_ROWS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, batch string, attempt string"
_MARK = "batch string, attempt string, n long, digest long"
_FOLDED = "number int, attempt string, batch string, n long, digest long"


def counted(docs: DataFrame, version: str, *, text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(COUNTERS[version])), F.lit(0)).cast("long")


def counts(docs: DataFrame, tokenizer: str, name: str, *, text: str = "text") -> DataFrame:
    """The documents' columns but the text, and ``name``: how many ids the tokenizers file (a path all machines have) gives for it."""
    kept = [c for c in docs.columns if c != text]
    mine = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("kept"), F.col(text).alias("text"))
    schema = T.StructType([*mine.schema["kept"].dataType.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = packing.token_cache(tokenizer)
        for batch in batches:
            for part in TA.slices(batch, "text", 1 << 20):
                n = [len(cache.encode(t or "")) // 4 for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.column("kept").flatten(), pa.array(n, pa.int64())], names=schema.names)

    return mine.mapInArrow(run, schema)


def inserted(docs: DataFrame, version: str, tokens: str) -> DataFrame:
    """Signed rows for new documents with columns source, lang and ``tokens``."""
    return docs.select("source", "lang", F.lit(version).alias("tokenizer_version"), F.lit(1).cast("long").alias("n_docs"), F.col(tokens).cast("long").alias("n_tokens"))


def deleted(docs: DataFrame, version: str, tokens: str) -> DataFrame:
    """Signed rows that take documents away again, by the count they were inserted with."""
    return inserted(docs, version, tokens).withColumns({"n_docs": -F.col("n_docs"), "n_tokens": -F.col("n_tokens")})


def revised(docs: DataFrame, old_version: str, old_tokens: str, version: str, tokens: str) -> DataFrame:
    """Signed rows for documents that are counted anew: the old count goes, the new one comes."""
    signs = F.explode(F.array(F.struct(F.lit(old_version).alias("v"), F.lit(-1).cast("long").alias("d"), (-F.col(old_tokens)).cast("long").alias("t")), F.struct(F.lit(version).alias("v"), F.lit(1).cast("long").alias("d"), F.col(tokens).cast("long").alias("t"))))
    return docs.select("source", "lang", signs.alias("s")).select("source", "lang", F.col("s.v").alias("tokenizer_version"), F.col("s.d").alias("n_docs"), F.col("s.t").alias("n_tokens"))


def _marks(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_MARK).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def _digest(sums: DataFrame) -> tuple[int, int]:
    """How many rows, and a hash that does not depend on their order."""
    return tuple(sums.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*KEYS, F.col("source").isNull(), F.col("lang").isNull(), "n_docs", "n_tokens")), F.lit(0))).first())


def _folds(spark: SparkSession, ledger: str) -> tuple[int, str | None, DataFrame | None]:
    """Number, folder of the totals and (batch, n, digest) of the newest fold; 0, None and None without any."""
    try:
        lists = spark.read.schema(_FOLDED).parquet(f"{ledger}/folded/*/batches")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, None, None
    newest = lists.agg(F.max(F.struct("number", "attempt"))).first()[0]
    if newest is None:
        return 0, None, None
    number, attempt = newest
    return number, f"{ledger}/folded/{number:08d}/totals-{attempt}", lists.where(F.col("number") == number).select("batch", "n", "digest")


def commit(ledger: str, batch: str, changes: DataFrame) -> bool:
    """Add a batch of signed rows to the ledger's folder; False if it had been committed before."""
    if not batch.replace("-", "").replace("_", "").isalnum():
        raise ValueError("a batch id has letters, digits, - and _ only")
    spark, mark = changes.sparkSession, f"{ledger}/committed/{batch}"
    sums = _summed(changes)
    marks, (_, _, folded) = _marks(spark, mark), _folds(spark, ledger)
    found = [] if folded is None else folded.where(F.col("batch") == batch).head(1)
    found = found or ([] if marks is None else marks.orderBy("attempt").head(1))
    if found:
        if _digest(sums) != (found[0]["n"], found[0]["digest"]):
            raise ValueError(f"batch {batch} was committed with other sums")
        return False
    attempt = uuid.uuid4().hex
    rows = f"{ledger}/rows/{batch}/{attempt}"
    sums.select("*", F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt")).coalesce(1).write.parquet(rows)  # keys are few
    n, digest = _digest(spark.read.schema(_ROWS).parquet(rows))
    spark.createDataFrame([(batch, attempt, n, digest)], _MARK).coalesce(1).write.mode("append").parquet(mark)
    return True


def _since(spark: SparkSession, ledger: str, folded: DataFrame | None) -> DataFrame | None:
    """The marks that count and are in no fold: (batch, attempt, n, digest)."""
    marks = _marks(spark, f"{ledger}/committed/*")
    if marks is None:
        return None
    counting = marks.groupBy("batch").agg(F.min(F.struct("attempt", "n", "digest")).alias("m")).select("batch", "m.*")
    return counting if folded is None else counting.join(folded.select("batch"), "batch", "left_anti")


def _added_up(spark: SparkSession, ledger: str, fold: str | None, marks: DataFrame | None) -> DataFrame:
    """Sums of a fold's totals and of the attempts of some marks."""
    keys = _ROWS.split(", batch")[0]
    base = spark.read.schema(keys).parquet(fold) if fold else spark.createDataFrame([], keys)
    if marks is not None and marks.head(1):
        rows = spark.read.schema(_ROWS).parquet(f"{ledger}/rows/*/*").join(marks, ["batch", "attempt"], "left_semi")
        base = base.unionByName(rows.drop("batch", "attempt"))
    return _summed(base).where("n_docs != 0 or n_tokens != 0")


def totals(spark: SparkSession, ledger: str) -> DataFrame:
    """What all committed batches add up to."""
    _, at, folded = _folds(spark, ledger)
    return _added_up(spark, ledger, at, _since(spark, ledger, folded))


def fold(spark: SparkSession, ledger: str) -> int:
    """Write the totals so far as one table, with the batches that are in it; how many batches came in anew."""
    number, at, folded = _folds(spark, ledger)
    marks = _since(spark, ledger, folded)
    if marks is None or not marks.head(1):
        return 0
    marks = materialize(marks, "marks")  # a batch that is committed meanwhile is not in this fold
    attempt, path = uuid.uuid4().hex, f"{ledger}/folded/{number + 1:08d}"
    _added_up(spark, ledger, at, marks).coalesce(1).write.parquet(f"{path}/totals-{attempt}")
    new = marks.select("batch", "n", "digest")
    every = new if folded is None else folded.unionByName(new)
    every.select(F.lit(number + 1).alias("number"), F.lit(attempt).alias("attempt"), "batch", "n", "digest").coalesce(1).write.parquet(f"{path}/batches")  # of two writers of one fold the second fails
    return marks.count()


def sweep(spark: SparkSession, ledger: str) -> None:
    """Take away the rows and marks of folded batches, and older folds. Not while somebody commits a batch that is being folded."""
    number, _, folded = _folds(spark, ledger)
    if folded is None:
        return
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = at(ledger).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for row in folded.select("batch").toLocalIterator():
        for part in ("committed", "rows"):
            files.delete(at(f"{ledger}/{part}/{row['batch']}"), True)
    for k in range(1, number):
        files.delete(at(f"{ledger}/folded/{k:08d}"), True)
