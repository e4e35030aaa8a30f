"""Parquet tables with a primary key, changed in one step by a manifest, and reports.

A write goes to folders of its own (``month=.../commit=...``) that nobody reads yet; then a
manifest with the next number is put in place, which lists the folders that count from
now on. Readers take the newest manifest, so they see the state before or after a
change, and a write that was killed leaves the old state. A number that is there already
is never written over: of two writers the second one is refused.

A manifest also says which steps of the schema (``schemas.STEPS``) its table has been
through. Columns that older files lack are read as NULL, so a step needs no rewriting.
"""

from __future__ import annotations

import json
import uuid
from datetime import date, datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Refused
from ..operators.pit import append_new
from ..schemas import SCHEMA_VERSION, STEPS, STORED
from ..tables import cut

EMPTY = {"number": 0, "schema": 1, "steps": [], "parts": []}


class Store:
    """One folder for each table, dealt by the month of its day where it has one. Known keys are left out before a write."""

    def __init__(self, spark: SparkSession, root: str, version: int = SCHEMA_VERSION):
        """``version``: of the schema; a reader of an older one takes only the columns it knows."""
        self.spark, self.root, self.version = spark, root.rstrip("/"), version

    def _path(self, table: str) -> str:
        if table not in STORED:
            raise Refused(f"no stored table is called {table!r}")
        return f"{self.root}/{table}"

    @property
    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _exists(self, path: str) -> bool:
        files, at = self._files
        return files.exists(at(path))

    @staticmethod
    def _day(table: str) -> str | None:
        """The day by whose month a table is dealt."""
        return next((d for d in ("bar_date", "event_date", "window_end") if f"{d} date" in STORED[table][0]), None)

    def schema(self, table: str) -> str:
        """The columns at this store's version."""
        self._path(table)
        return ", ".join([STORED[table][0], *(f"{c} {kind}" for v, t, c, kind in STEPS if t == table and v <= self.version)])

    # manifests

    def _manifest(self, table: str) -> dict:
        """The newest one; without any, all a folder of an older layout holds."""
        log = f"{self._path(table)}/_log"
        files, at = self._files
        if not self._exists(log):
            return EMPTY | {"plain": self._exists(self._path(table))}
        newest = max((f.getPath().getName() for f in files.listStatus(at(log)) if f.getPath().getName().endswith(".json")), default=None)
        if newest is None:
            return EMPTY | {"plain": False}
        stream = files.open(at(f"{log}/{newest}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) | {"plain": False}

    def _commit(self, table: str, before: dict, parts: list, steps: list | None = None) -> None:
        """Put the manifest that follows ``before`` in place, unless somebody else has."""
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        files, at = self._files
        log, number = f"{self._path(table)}/_log", before["number"] + 1
        steps = before["steps"] if steps is None else steps
        manifest = {"number": number, "schema": max([before["schema"], *(s[0] for s in steps)]), "steps": steps, "parts": sorted(parts, key=str)}
        hidden = at(f"{log}/.{uuid.uuid4().hex}")
        stream = files.create(hidden, True)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), sc._jsc.hadoopConfiguration())
        try:
            context.rename(hidden, at(f"{log}/{number:08d}.json"), sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception as e:
            files.delete(hidden, False)
            raise Refused(f"{table}: another writer was first") from e

    def _begin(self, table: str) -> tuple[dict, list]:
        """The state to change, and the steps its columns have been through once this version has written; files of the layout without manifests become a commit."""
        before = self._manifest(table)
        if before["schema"] > self.version:
            raise Refused(f"{table} is at version {before['schema']} of the schema, this writer at {self.version}")
        if before["plain"]:
            files, at = self._files
            parts = []
            for month in [f.getPath() for f in files.listStatus(at(self._path(table))) if f.getPath().getName().startswith("month=")] or [at(self._path(table))]:
                own = [f.getPath() for f in files.listStatus(month) if f.getPath().getName().endswith(".parquet")]
                files.mkdirs(at(month, "commit=first"))
                for f in own:
                    files.rename(f, at(at(month, "commit=first"), f.getName()))
                parts.append([month.getName().removeprefix("month=") if month.getName().startswith("month=") else None, "first"])
            self._commit(table, before, parts)
            before = self._manifest(table)
        known = {(v, c) for v, c, _ in before["steps"]}
        today = datetime.now(timezone.utc).date().isoformat()
        return before, before["steps"] + [[v, c, today] for v, t, c, _ in STEPS if t == table and v <= self.version and (v, c) not in known]

    def _folder(self, table: str, part: list) -> str:
        month, commit = part
        return f"{self._path(table)}/" + (f"month={month}/" if month else "") + f"commit={commit}"

    def _write(self, table: str, df: DataFrame) -> list:
        """Rows in folders nobody reads yet; the parts they are."""
        commit, day = uuid.uuid4().hex, self._day(table)
        rows = df.withColumn("commit", F.lit(commit))
        if day:  # dealt by month first, so that a task writes few files; a large month goes to several tasks
            rows.withColumn("month", F.date_format(day, "yyyy-MM")).hint("rebalance", F.col("month")).write.mode("append").partitionBy("month", "commit").parquet(self._path(table))
            files, at = self._files
            found = files.globStatus(at(f"{self._path(table)}/month=*/commit={commit}")) or []
            return [[f.getPath().getParent().getName().removeprefix("month="), commit] for f in found]
        rows.write.mode("append").partitionBy("commit").parquet(self._path(table))
        return [[None, commit]] if self._exists(f"{self._path(table)}/commit={commit}") else []

    # reads

    def read(self, table: str, where: str | Column | None = None, months: list[str] | None = None, number: int | None = None) -> DataFrame:
        """The rows; of the named months (yyyy-MM) only, where the table has them; at an earlier manifest's number if asked for."""
        df = self._of(table, self._manifest(table) if number is None else self._numbered(table, number), months)
        return df.where(where) if where is not None else df

    def _of(self, table: str, manifest: dict, months: list[str] | None = None) -> DataFrame:
        """The rows that a manifest lists."""
        schema = self.schema(table)
        if manifest["plain"]:
            df = self.spark.read.schema(schema + ", month string" * bool(self._day(table))).parquet(self._path(table))
            df = (df.where(F.col("month").isin(months)) if self._day(table) and months is not None else df).drop("month")
        else:
            paths = [self._folder(table, p) for p in manifest["parts"] if months is None or p[0] is None or p[0] in months]
            df = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return df

    def _numbered(self, table: str, number: int) -> dict:
        path = f"{self._path(table)}/_log/{number:08d}.json"
        if not self._exists(path):
            raise Refused(f"{table} has no manifest {number}")
        text = self.spark.read.text(path, wholetext=True).first()[0]
        return json.loads(text) | {"plain": False}

    def number(self, table: str) -> int:
        """Of the newest manifest; 0 before the first change."""
        return self._manifest(table)["number"]

    def tables(self) -> list[str]:
        return [t for t in STORED if self._exists(f"{self.root}/{t}")]

    # changes

    def _shaped(self, table: str, df: DataFrame) -> tuple[DataFrame, int, list[str] | None]:
        """The rows in the table's columns, written once; how many they are, and their months (a few for each year)."""
        fields, day = [c.strip().split(" ") for c in self.schema(table).split(",")], self._day(table)
        shaped = cut(df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields)), "incoming")
        without = F.count_if(F.expr(" or ".join(f"{k} is null" for k in STORED[table][1])))
        n, bad, months = shaped.agg(F.count("*"), without, F.collect_set(F.date_format(day, "yyyy-MM") if day else F.lit(None).cast("string"))).first()
        if bad:
            raise Refused(f"{table}: a key column is null")
        return shaped, n, sorted(months) if day else None

    def append(self, table: str, df: DataFrame) -> int:
        """Rows with new keys, by column name; sending rows again changes nothing. Known keys are looked for in the months that come in. How many rows came in is returned."""
        before, steps = self._begin(table)
        shaped, n, months = self._shaped(table, df)
        parts = self._write(table, append_new(self._of(table, before, months), shaped, list(STORED[table][1]))) if n else []
        if parts or steps != before["steps"]:
            self._commit(table, before, before["parts"] + parts, steps)
        return n

    def replace(self, table: str, df: DataFrame) -> None:
        """``df`` in the place of all rows, in one step."""
        before, steps = self._begin(table)
        shaped, n, _ = self._shaped(table, df)
        self._commit(table, before, self._write(table, append_new(shaped.limit(0), shaped, list(STORED[table][1]))) if n else [], steps)

    def _rewritten(self, table: str, before: dict, steps: list, months: list[str], rows: DataFrame) -> None:
        """``rows`` in the place of all of these months."""
        self._commit(table, before, [p for p in before["parts"] if p[0] not in months] + self._write(table, rows), steps)

    def overwrite_span(self, table: str, df: DataFrame, symbols: DataFrame, start: str, end: str, day: str = "bar_date") -> None:
        """Replace the stored rows of these symbols in a span by ``df``, in one step; only the span's months are written anew."""
        if day != self._day(table):
            raise Refused(f"{table} is not dealt by {day}")
        before, steps = self._begin(table)
        months = [m for m in sorted({p[0] for p in before["parts"]}) if start[:7] <= m <= end[:7]]
        old, gone = self._of(table, before, months), F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        keep = old.where(~gone).unionByName(old.where(gone).join(symbols.select("symbol").distinct(), "symbol", "left_anti"))
        if df.where(~gone).head(1):
            raise Refused("new rows lie outside the span")
        self._rewritten(table, before, steps, months, keep.unionByName(df, allowMissingColumns=True).select(*keep.columns))

    def overwrite_recomputed(self, table: str, df: DataFrame, by: str = "symbol") -> int:
        """A derived table computed anew: of each symbol in ``df`` the stored rows from its first to its last day there give way to its rows, in one step.

        Other symbols, days before and after, and months outside stay. How many rows came in is returned.
        """
        day = self._day(table)
        if not day:
            raise Refused(f"{table} has no day")
        before, steps = self._begin(table)
        new, n, months = self._shaped(table, df)
        if not n:
            return 0
        spans = new.groupBy(by).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
        months = sorted({p[0] for p in before["parts"] if months[0] <= p[0] <= months[-1]} | set(months))
        outside = F.col("_lo").isNull() | ~F.col(day).between(F.col("_lo"), F.col("_hi"))
        old = self._of(table, before, months)
        keep = old.join(spans, by, "left").where(outside).select(*old.columns)
        self._rewritten(table, before, steps, months, keep.unionByName(append_new(old.limit(0), new, list(STORED[table][1]))))
        return n

    def clear(self, table: str) -> None:
        """No rows from now on; what was there stays to be read by its manifest's number until it is swept."""
        before, steps = self._begin(table)
        self._commit(table, before, [], steps)

    def bootstrap(self) -> list[str]:
        """Every table of the schema, empty where it is not there yet; those that were made now. A second time there are none."""
        made = [t for t in STORED if not self._exists(f"{self.root}/{t}")]
        for table in made:
            before, steps = self._begin(table)
            self._commit(table, before, [], steps)
        return made

    def migrate(self) -> list[tuple[str, int, str]]:
        """Bring all stored tables to this version; the (table, version, column) that were applied now. A second time there are none."""
        done = []
        for table in self.tables():
            before, steps = self._begin(table)
            if steps != before["steps"]:
                self._commit(table, before, before["parts"], steps)
                done += [(table, v, c) for v, c, _ in steps[len(before["steps"]) :]]
        return done

    def ledger(self) -> DataFrame:
        """(table, version, column, applied) of the steps the stored tables have been through."""
        rows = [(t, v, c, day) for t in self.tables() for v, c, day in self._manifest(t)["steps"]]
        return self.spark.createDataFrame(rows, "table string, version int, column string, applied string")

    def compact(self, table: str, least: int = 8) -> int:
        """Months with at least so many commits are written as one, in one step; how many there were."""
        before, steps = self._begin(table)
        many = sorted({p[0] for p in before["parts"] if sum(q[0] == p[0] for q in before["parts"]) >= least}, key=str)
        if many:
            self._rewritten(table, before, steps, many, self._of(table, before, many if many != [None] else None))
        return len(many)

    def sweep(self, table: str, keep: int = 1) -> int:
        """Take away folders that none of the newest ``keep`` manifests lists; how many. Not while somebody writes or reads what is older."""
        newest = self.number(table)
        used = {self._folder(table, p).rsplit("/", 1)[1] + "@" + str(p[0]) for n in range(max(1, newest - keep + 1), newest + 1) for p in self._numbered(table, n)["parts"]}
        files, at = self._files
        gone = 0
        for pattern in ("commit=*", "month=*/commit=*"):
            for f in files.globStatus(at(f"{self._path(table)}/{pattern}")) or []:
                month = f.getPath().getParent().getName()
                name = f.getPath().getName() + "@" + (month.removeprefix("month=") if month.startswith("month=") else "None")
                if name not in used:
                    files.delete(f.getPath(), True)
                    gone += 1
        return gone


def plain_json(x):
    if isinstance(x, dict):
        return {str(k): plain_json(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [plain_json(v) for v in x]
    if isinstance(x, float) and (x != x or abs(x) == float("inf")):
        return None
    if isinstance(x, (date, datetime)):
        return x.isoformat()
    return x if isinstance(x, (str, int, float, bool, type(None))) else str(x)


def write_report(folder: str, name: str, payload: dict) -> str:
    """A small JSON file, in a local folder or, by a path with a scheme, in any store that Spark reaches."""
    text = json.dumps({**plain_json(payload), "written_at": datetime.now(timezone.utc).isoformat()}, ensure_ascii=False, indent=2)
    if ":/" in folder:
        spark = SparkSession.getActiveSession()
        if spark is None:
            raise Refused(f"no session to reach {folder} by")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}.json")
        stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
        stream.write(text.encode())
        stream.close()
        return str(at.toString())
    path = Path(folder) / f"{name}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def differences(gold, live, path: str = "", tolerance: float = 1e-6) -> list[str]:
    """What of a known payload is not in a live one: dictionaries by key, lists of records by id, numbers within a tolerance."""
    if isinstance(gold, dict):
        if not isinstance(live, dict):
            return [f"{path}: no object"]
        return [d for k, v in gold.items() for d in ([f"{path}/{k}: missing"] if k not in live else differences(v, live[k], f"{path}/{k}", tolerance))]
    if isinstance(gold, list):
        if not isinstance(live, list):
            return [f"{path}: no list"]
        key = next((k for k in ("id", "date", "symbol", "period", "name", "code") if gold and all(isinstance(g, dict) and k in g for g in gold)), None)
        if key:
            have = {x.get(key): x for x in live if isinstance(x, dict)}
            return [d for g in gold for d in ([f"{path}[{g[key]}]: missing"] if g[key] not in have else differences(g, have[g[key]], f"{path}[{g[key]}]", tolerance))]
        return [f"{path}: {g!r} missing" for g in gold if g not in live]
    if isinstance(gold, (int, float)) and not isinstance(gold, bool) and isinstance(live, (int, float)):
        return [] if abs(gold - live) <= tolerance * max(1.0, abs(gold)) else [f"{path}: {live} instead of {gold}"]
    return [] if gold == live else [f"{path}: {live!r} instead of {gold!r}"]
