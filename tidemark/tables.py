"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset on a single machine a local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set; rounds need a folder that all executors share")
    return (found or f"file://{tempfile.gettempdir()}/checkpoints").rstrip("/")


def cut(df: DataFrame, name: str = "round") -> DataFrame:
    """The same rows, written and read back: rounds neither repeat work nor lengthen plans, and a lost executor costs no more than reading again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str, each: int = 1_000_000) -> DataFrame:
    """The same rows, dealt by keys into parts of about ``each`` of ``rows``, so that one task's share does not grow with the table; left to the session's number of parts where that suffices."""
    parts = -(-rows // each)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
