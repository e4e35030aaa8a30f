"""Sources of payloads as a Spark data source.

An adapter is a class with ``fetch(request)`` and ``smoke() -> (golden, live)``, the only
code that may reach out; one that gives its answers in pages has ``page(request, cursor)``
and says with ``enough`` when no more are needed. Spark reads one request per partition,
so pulls are spread over tasks and a failed one is tried again by itself:

    spark.dataSource.register(FeedSource)
    spark.read.format("tidemark_feed").option("adapter", "package.module:Class").option("requests", json).load()

What became of a request is told apart (``outcome``):

- ``found``: a payload, one row for each page;
- ``absent``: the source says that there is none (a real gap): a row without a payload;
- ``unreachable``: nothing that can be read, though it was tried again. This fails the
  read, unless the option ``unreachable`` is ``report``; ``whole`` then refuses it later.

A limit on the rate is waited out, doubling the wait; a passing failure is tried again
after growing waits; whatever else fails is unreachable at once. Nothing is made up for
what did not come.
"""

from __future__ import annotations

import importlib
import io
import json
import random
import time
import zipfile
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import Drift, Refused
from .store import differences


class RateLimited(Refused):
    """The source asks to wait."""


class Transient(Refused):
    """A failure that may pass: a timeout, a server's error. OSError, and so a lost connection, counts as one."""


class Absent(Refused):
    """The source has no such thing, and says so."""


class Unreachable(Refused):
    """The source gave nothing that can be read."""


class Page(NamedTuple):
    payload: str | bytes
    #: what the request after this one needs; None on the last page
    next: object = None


class Adapter:
    """What a source has to offer."""

    name = "unknown"
    #: payloads may be markup; of any other source markup is a page of excuses
    markup = False
    #: pages of one request that are asked for at most
    most_pages = 1000

    def fetch(self, request: dict) -> str | bytes:
        """The payload of one request as text, or as a zip archive of one file; raises RateLimited, Transient, Absent or any error."""
        raise NotImplementedError

    def page(self, request: dict, cursor: object) -> Page:
        """One page; the cursor is what the page before gave as ``next``, None at first."""
        return Page(self.fetch(request))

    def enough(self, request: dict, payload: str) -> bool:
        """Whether this page decides, so that no further one is asked for."""
        return False

    def smoke(self) -> tuple[object, object]:
        """A known payload, and the same slice as it is now."""
        raise NotImplementedError


def unzipped(data: bytes) -> str:
    """The text of an archive's first file; stray bytes are replaced."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            return archive.read(archive.namelist()[0]).decode("utf-8", errors="replace")
    except (zipfile.BadZipFile, IndexError) as e:
        raise Drift(f"not an archive of one file: {e}") from e


def _readable(adapter: Adapter, payload: str | bytes) -> str:
    text = unzipped(payload) if isinstance(payload, bytes) else payload
    if not isinstance(text, str) or not text.strip() or not adapter.markup and text.lstrip()[:1] == "<":
        raise Refused("no payload")
    return text


def patient_page(adapter: Adapter, request: dict, cursor: object = None, tries: int = 4, wait: float = 1.0, sleep=time.sleep) -> Page:
    """A page, tried again where that may help: waits double under a limit, a little apart between tasks, and grow evenly after failures."""
    last: Exception = Refused("not tried")
    for k in range(tries):
        try:
            payload, following = adapter.page(request, cursor)
            return Page(_readable(adapter, payload), following)
        except Absent:
            raise
        except RateLimited as e:
            last, pause = e, wait * 2**k * (1 + random.random() / 4)
        except (Transient, OSError) as e:
            last, pause = e, wait * (k + 1)
        except Exception as e:
            raise Unreachable(f"{adapter.name}: {request}: {e}") from e
        if k + 1 < tries:
            sleep(pause)
    raise Unreachable(f"{adapter.name}: {request}: {last}, still after {tries} tries") from last


def patient(adapter: Adapter, request: dict, tries: int = 4, wait: float = 1.0, sleep=time.sleep) -> str:
    """The payload of a request of one page."""
    return patient_page(adapter, request, None, tries, wait, sleep).payload


def pages(adapter: Adapter, request: dict, tries: int = 4, wait: float = 1.0, sleep=time.sleep) -> Iterator[tuple[int, str, str | None, str | None]]:
    """(page, outcome, payload, ended) until a page decides or is the last; ``ended`` says why none follows: enough, end, most, absent or unreachable."""
    cursor, k = None, 0
    while True:
        try:
            payload, cursor = patient_page(adapter, request, cursor, tries, wait, sleep)
        except Absent:
            yield k, "absent", None, "absent"
            return
        k += 1
        ended = "enough" if adapter.enough(request, payload) else "end" if cursor is None else "most" if k >= adapter.most_pages else None
        yield k - 1, "found", payload, ended
        if ended:
            return


def smoke_check(adapter: Adapter) -> None:
    """Raises if a known slice has changed."""
    gold, live = adapter.smoke()
    if found := differences(gold, live):
        raise Drift(f"{adapter.name}: {'; '.join(found[:5])}")


def _made(path: str) -> Adapter:
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)()


class _Request(InputPartition):
    def __init__(self, value: dict):
        self.value = value


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.adapter, self.requests = options["adapter"], json.loads(options["requests"])
        self.tries, self.wait = int(options.get("tries", 4)), float(options.get("wait", 1.0))
        self.report = options.get("unreachable", "fail") == "report"

    def partitions(self) -> list[_Request]:
        return [_Request(r) for r in self.requests]

    def read(self, partition: _Request) -> Iterator[tuple]:
        adapter, request, k = _made(self.adapter), json.dumps(partition.value, sort_keys=True), 0
        try:
            for k, outcome, payload, ended in pages(adapter, partition.value, self.tries, self.wait):
                yield adapter.name, request, k, outcome, payload, ended, None
                k += 1
        except Unreachable as e:
            if not self.report:
                raise
            yield adapter.name, request, k, "unreachable", None, "unreachable", str(e)


class FeedSource(DataSource):
    """(source, request, page, outcome, payload, ended, detail) of each page of each request."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_feed"

    def schema(self) -> str:
        return "source string, request string, page int, outcome string, payload string, ended string, detail string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def account(feed: DataFrame) -> DataFrame:
    """(source, n_requests, n_found, n_absent, n_unreachable, n_pages, n_capped): what became of the requests; one that fell silent behind its first pages is unreachable."""
    one = feed.groupBy("source", "request").agg(F.count_if(F.col("outcome") == "found").alias("pages"), F.bool_or(F.col("outcome") == "unreachable").alias("lost"), F.bool_or(F.col("outcome") == "absent").alias("absent"), F.bool_or(F.coalesce(F.col("ended"), F.lit("")) == "most").alias("capped"))
    lost, n = F.col("lost"), lambda c: F.count_if(c)
    return one.groupBy("source").agg(F.count("*").alias("n_requests"), n(~lost & (F.col("pages") > 0)).alias("n_found"), n(~lost & (F.col("pages") == 0) & F.col("absent")).alias("n_absent"), n(lost).alias("n_unreachable"), F.sum("pages").alias("n_pages"), n(F.col("capped")).alias("n_capped"))


def whole(feed: DataFrame) -> DataFrame:
    """The payloads that came. Gaps are left out; a request that could not be reached is refused, for there may be something."""
    lost = [r[0] for r in feed.where("outcome = 'unreachable'").select("detail").limit(5).collect()]
    if lost:
        raise Unreachable("; ".join(lost))
    return feed.where("outcome = 'found'")
