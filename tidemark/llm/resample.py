"""Importance resampling towards the distribution of a target corpus, by hashed n-grams.

1. Identical texts are collapsed by grouping the full text; what follows is done once for
   each different text, and counts are multiplied by its number of copies.
2. Features (runs of 1 to n words) are hashed into buckets; the buckets of each text are
   written, two or four bytes a feature.
3. A bucket's gain compares its smoothed share in the target with that in all documents;
   a text's weight is the floored mean of its features' gains.
4. Weights are joined back to the documents, and each document gets noise of its own
   (Gumbel's, from a hash of its key): the highest scores are a draw without replacement
   in proportion to the exponential of the weights.

The draw's ranks need no single task: the least score that can be drawn follows from the
numbers of documents by score (whole numbers within some ten thousands), and the rows from
there on are sorted by ranges and numbered by the sizes of the ranges before them. Texts
with many copies are grouped map-side; the join back is a sort-merge join, whose large
keys Spark splits.

Defined cases: a null or empty text has no features and weight 0; repeated rows count and
are drawn one by one, all with the same score; ties go to the smaller key (null last),
then to the smaller hash of the text; a null key is hashed as an empty string; texts of any
length are read whole; an empty target leaves gains to the smoothing; an empty table gives
no rows; extra columns are ignored or, if asked for, carried along in ``row``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as TA
from .runtime import collect_bounded, materialize

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall
#: Words a worker remembers the buckets of.
KEPT_WORDS = 500_000
#: Different scores there can be: gains and noise are logarithms in thousandths.
MOST_SCORES = 1 << 20


class _Buckets(dict):
    """Buckets of words, made when first asked for."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        out = self[word] = zlib.crc32(word) % self.buckets
        return out


def text_buckets(text: str, n: int, of: _Buckets) -> tuple[int, list[int]]:
    """Number of words, and the buckets of all features."""
    words = _WORDS(text.encode().translate(_LOWER))
    if len(of) > KEPT_WORDS:
        of.clear()
    found = list(map(of.__getitem__, words))
    for k in range(2, n + 1):
        found += [zlib.crc32(b" ".join(words[i : i + k])) % of.buckets for i in range(len(words) - k + 1)]
    return len(words), found


def _digest(text: str) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def features(docs: DataFrame, *, text: str = "text", n: int = 1, buckets: int = 10_000) -> DataFrame:
    """(digest, copies, n_words, buckets) of each different text."""
    different = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies")).withColumn("digest", _digest("text"))
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Buckets(buckets)
        for batch in batches:
            for part in TA.slices(batch, "text", 4 << 20):
                found = [text_buckets(t, n, of) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("digest"), part.column("copies"), pa.array([w for w, _ in found], pa.int64()), pa.array([np.array(b, kind).tobytes() for _, b in found], pa.binary())], names=["digest", "copies", "n_words", "buckets"])

    return different.mapInArrow(run, "digest binary, copies long, n_words long, buckets binary")


def _flat(batch: pa.RecordBatch, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    data, offs = TA.utf8_binary(batch.column("buckets"))
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    return np.frombuffer(data.tobytes(), kind), offs // kind.itemsize


def bucket_counts(found: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """Features in each bucket over all documents: one row for each bucket comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            flat, offs = _flat(batch, buckets)
            total += np.bincount(flat, np.repeat(batch.column("copies").to_numpy(), np.diff(offs)), minlength=buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = collect_bounded(found.select("copies", "buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")), buckets, "buckets")
    out = np.zeros(buckets, np.int64)
    for bucket, count in rows:
        out[bucket] = count
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share in the target over that in the source, floored."""
    m = float(len(source))
    return np.floor(1000 * np.log((target + 1.0) * (source.sum() + m) / ((source + 1.0) * (target.sum() + m)))).astype(np.int64)


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(digest, n_words, n_features, weight) of each different text."""
    shared, buckets = found.sparkSession.sparkContext.broadcast(gain), len(gain)  # one number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offs = _flat(batch, buckets)
            sums = np.concatenate([[0], np.cumsum(shared.value[flat])])
            count = np.diff(offs)
            weight = (sums[offs[1:]] - sums[offs[:-1]]) // np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("n_words"), pa.array(count), pa.array(weight)], names=["digest", "n_words", "n_features", "weight"])

    return found.select("digest", "n_words", "buckets").mapInArrow(run, "digest binary, n_words long, n_features long, weight long")


def noise(key: F.Column, seed: str) -> F.Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of SHA-256 of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _ranked(rows: DataFrame, order: list[F.Column]) -> DataFrame:
    """The rows with their rank from 1 on, by ranges of the order."""
    spark = rows.sparkSession
    place = F.monotonically_increasing_id()  # the number of the range above 33 bits, the row's in it below
    numbered = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", place), "ranked")
    sizes = sorted(numbered.groupBy(F.shiftright("_at", 33).alias("range")).count().collect())  # one row for each task of the sort
    before = spark.createDataFrame([(r, b) for (r, _), b in zip(sizes, accumulate([n for _, n in sizes], initial=0), strict=False)], "range long, before long")
    joined = numbered.withColumn("range", F.shiftright("_at", 33)).join(F.broadcast(before), "range")
    return joined.withColumn("rank", F.col("before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("range", "before", "_at")


def draw(docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024", keep: bool = False) -> DataFrame:
    """(key, n_features, weight, score, rank) of every document; rank is 1, 2, 3 ... for the drawn ones, else null.

    Of the N documents with at least ``least_words`` words, ``percent`` of a hundred (floored)
    are drawn. With ``keep`` the whole row comes along in the struct ``row``.
    """
    found = materialize(features(docs, text=text, n=n, buckets=buckets), "features")
    wanted = materialize(features(target, text=target_text, n=n, buckets=buckets), "features")
    gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets))
    row = [F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("row")] if keep else []
    mine = docs.select(F.col(key).alias("key"), _digest(text).alias("digest"), *row)
    joined = mine.join(weights(found, gain).hint("shuffle_merge"), "digest").withColumn("score", F.col("weight") + noise(F.col("key"), seed))
    scored = materialize(joined.withColumn("_n", F.monotonically_increasing_id()), "scored")

    may = F.col("n_words") >= least_words
    counts = np.array(sorted(collect_bounded(scored.where(may).groupBy("score").count(), MOST_SCORES, "different scores"), reverse=True), np.int64).reshape(-1, 2)
    many = int(counts[:, 1].sum()) * percent // 100
    least = int(counts[np.searchsorted(np.cumsum(counts[:, 1]), many), 0]) if many else None
    near = may & (F.col("score") >= least) if many else F.lit(False)
    order = [F.col("score").desc(), F.col("key").asc_nulls_last(), F.col("digest"), F.col("_n")]
    ranked = _ranked(scored.where(near), order).withColumn("rank", F.when(F.col("rank") <= many, F.col("rank")))
    whole = ranked.unionByName(scored.where(~near).withColumn("rank", F.lit(None).cast("long")))
    return whole.select(F.col("key").alias(key), "n_features", "weight", "score", "rank", *(["row"] if keep else []))


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents, all columns as they are."""
    return draw(docs, target, keep=True, **options).where("rank is not null").select("row.*")
