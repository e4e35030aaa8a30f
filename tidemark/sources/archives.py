"""Lines out of zipped files, in tasks.

``binaryFile`` brings each archive to a task; its first file is read as a stream, and
lines leave in batches of bounded size, so a large file inside never stands in memory
whole (the packed bytes do; Spark's source takes up to 2 GB of them).

An archive that cannot be read, from the start or from some line on, is reported with
what is wrong, and gives none of its lines: half a file is no file.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Drift

ROWS, CHARS = 10_000, 4 << 20


def _stream(content: bytes) -> Iterator[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(archive.namelist()[0]) as raw:
        for line in io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline="\n"):
            yield line.rstrip("\r\n")


def _problem(content: bytes) -> str | None:
    """What is wrong; the whole file is read once, without keeping it, as its checksum is known at its end."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(archive.namelist()[0]) as raw:
            while raw.read(1 << 20):
                pass
    except (zipfile.BadZipFile, zlib.error, IndexError, EOFError, NotImplementedError, RuntimeError) as e:
        return f"{type(e).__name__}: {e}"
    return None


def lines(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """(path, k, value, problem): every line of every archive in a folder; of a broken one a row with what is wrong."""
    names = ["path", "k", "value", "problem"]

    def batch(path: str, first: int, values: list[str]) -> pa.RecordBatch:
        n = len(values)
        return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(range(first, first + n), pa.int64()), pa.array(values, pa.string()), pa.nulls(n, pa.string())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                path, content = rows.column("path")[i].as_py(), rows.column("content")[i].as_py()
                problem = _problem(content)
                if problem:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.array([problem])], names=names)
                    continue
                held, size, first = [], 0, 0
                for line in _stream(content):
                    held.append(line)
                    size += len(line)
                    if len(held) == ROWS or size > CHARS:
                        yield batch(path, first, held)
                        held, size, first = [], 0, first + len(held)
                if held:
                    yield batch(path, first, held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(run, "path string, k long, value string, problem string")


def whole(found: DataFrame) -> DataFrame:
    """The lines, if no archive was broken."""
    broken = [f"{r['path']}: {r['problem']}" for r in found.where("problem is not null").select("path", "problem").limit(5).collect()]
    if broken:
        raise Drift("; ".join(broken))
    return found.drop("problem")


def account(found: DataFrame) -> DataFrame:
    """(path, n_lines, problem) of each archive that had lines or was broken."""
    return found.groupBy("path").agg(F.count("k").alias("n_lines"), F.max("problem").alias("problem"))
