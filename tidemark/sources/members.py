"""The list of member companies as dated snapshots, fetched anew when the newest is too old.

A snapshot is appended, or takes the place of one of the same day, in one commit of the
store: readers see the list of before or the new one, and a failed fetch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Refused
from ..operators.pit import visible
from .store import Store

TABLE = "listed_members"
#: A snapshot of so many days counts as current.
MAX_AGE = 7


def snapshot_day(store: Store, as_of: str) -> date | None:
    """Of the newest snapshot that was known."""
    return visible(store.read(TABLE), as_of).agg(F.max("knowledge_date")).first()[0]


def members(store: Store, *, as_of: str, fetch: Callable[[], DataFrame] | None = None, max_age: int = MAX_AGE, refresh: bool = False) -> DataFrame:
    """(code, ticker, name, member_type, knowledge_date) of the list as known on a day.

    Where the newest snapshot is older than ``max_age`` days, or ``refresh`` is asked for,
    ``fetch`` is called once and what it gives becomes the snapshot of the day; members
    without a code are left out, of several rows with a code the greatest counts. Without
    ``fetch`` the newest one counts, however old.
    """
    known = snapshot_day(store, as_of)
    today = date.fromisoformat(as_of)
    if fetch and (refresh or known is None or (today - known).days > max_age):
        rows = fetch().where("code is not null and trim(code) != ''").withColumn("knowledge_date", F.lit(today))
        one = rows.groupBy("code").agg(F.max(F.struct(*(c for c in rows.columns if c != "code"))).alias("r")).select("code", "r.*")
        if not one.head(1):
            raise Refused("the member list came back empty")
        old = store.read(TABLE)
        if known == today:
            store.replace(TABLE, old.where(F.col("knowledge_date") != F.lit(today)).unionByName(one, allowMissingColumns=True))
        else:
            store.append(TABLE, one)
        known = today
    if known is None:
        raise Refused(f"no member list was known on {as_of}")
    return store.read(TABLE).where(F.col("knowledge_date") == F.lit(known))

