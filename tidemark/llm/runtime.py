"""What the operators share: durable intermediate tables and bounded collects."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK = os.path.join(tempfile.gettempdir(), "checkpoints")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset on a single machine (tests) a folder of our own is used; on a
    cluster that would be lost between machines, so it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set; intermediate tables need a folder that all executors share")
    return (found or f"file://{_FALLBACK}").rstrip("/")


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, so work is not repeated, and a lost executor costs
    no more than reading the table again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def collect_bounded(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table that must be small; more than ``limit`` rows is an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; raise the bound knowingly")
    return rows
