"""The event feed as a stream: quarter-hour counts, first sight only, and idempotent landing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def quarter_hours(stream: DataFrame, at: str = "ts", kind: str = "event_type", value: str = "value", late: str = "30 minutes") -> DataFrame:
    """(start, kind, n, total) of tumbling windows of 15 minutes; later rows than the watermark allows are dropped. Works on batches, too."""
    df = stream.withColumn(at, F.col(at).cast("timestamp"))
    df = df.withWatermark(at, late) if stream.isStreaming else df
    return df.groupBy(F.window(at, "15 minutes").alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def first_seen(stream: DataFrame, key: str = "event_id", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each event once, as long as its copies come within the watermark."""
    df = stream.withColumn(at, F.col(at).cast("timestamp"))
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark([key]) if stream.isStreaming else df.dropDuplicates([key])


def land(stream: DataFrame, store: Store, table: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch by primary key: a batch that is run again adds nothing; late versions are new rows."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: store.append(table, df)).start()
