"""Conversation structure repair: the cheapest edits that give each conversation the form s?(ua)+, or none at all.

A conversation's turns, in order, go through a forward Viterbi pass over four states of the
grammar: nothing yet (E), after the system turn (S), after a user's (U), after an
assistant's (A). Each state carries its least (cost, audit string); a turn is kept,
reroled or deleted, and its layer is closed by inserts, at most two in a row (one more
would come back to a state that costs less). Of equal costs the ASCII-least audit string
wins. No audit string of a layer begins another one of the same cost, so comparing them
early is exact. An audit string tells the output: what a rerole or an insert writes
follows from the state.

The pass is a product of 4 x 4 matrices of (cost, audit), so a conversation can be cut:
turns are sorted by ranges over all tasks, and each task goes through its stretch in
chunks of at most ``CHUNK_ROWS`` different rows and ``CHUNK_CHARS`` characters. A
conversation that begins and ends inside a task is finished there. The few at a task's
edges, or of several chunks, however large, keep a matrix and the rows of each chunk:
the matrices are multiplied in order (without texts), each chunk is repaired with the
states it got, and the digest runs over the repaired chunks in order, which SHA-256
demands, holding one chunk at a time. Equal rows are one row and a number from the start, so neither
they nor a large conversation gather in one task.

Defined cases: a null role or text is one space (never a legal role, always blank); an
empty role is no legal one either; null turns come first; turns of equal number go by role,
then text, equal rows being one followed by its duplicates; a null id is a conversation;
texts of any length are read whole; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .runtime import materialize

KEEP, REROLE, DELETE, INSERT = (0, "K"), (2, "R"), (3, "D"), (2, "I")
TRUNCATED = 1
LEGAL = {"su", "ua", "au"}
SPACE = "\t\n\x0b\x0c\r "
E, S, U, A = range(4)
FAR = (1 << 60, "")
CHUNK_ROWS = 4096
CHUNK_CHARS = 8 << 20
#: Rows of results that a task gives at once, and their characters.
OUT_ROWS, OUT_CHARS = 1000, 8 << 20

Best = tuple[int, str]
Layer = tuple[Best, Best, Best, Best]


def _plus(best: Best, edit: Best, more: int = 0) -> Best:
    return best[0] + edit[0] + more, best[1] + edit[1]


def closed(layer: Layer) -> Layer:
    """With inserted turns behind it."""
    e, s, u, a = layer
    u = min(u, _plus(min(e, s, a), INSERT))
    return e, s, u, min(a, _plus(u, INSERT))


def after(layer: Layer, initial: str, fault: str, times: int) -> Layer:
    """The layer behind a turn and its duplicates (``times`` rows altogether); fault is blank, duplicate, truncated or empty."""
    deleted = times if fault in ("blank", "duplicate") else times - 1
    if deleted < times:
        e, s, u, a = layer
        more = TRUNCATED if fault == "truncated" else 0
        before_u = min(e, s, a)
        layer = closed((
            _plus(e, DELETE),
            min(_plus(s, DELETE), _plus(e, KEEP, more)) if initial == "s" else _plus(s, DELETE),
            min(_plus(u, DELETE), _plus(before_u, KEEP if initial == "u" else REROLE, more)),
            min(_plus(a, DELETE), _plus(u, KEEP if initial == "a" else REROLE, more)),
        ))
    if deleted:  # in one go: an insert between deletes is never the ASCII-least
        layer = closed(tuple((c + DELETE[0] * deleted, p + DELETE[1] * deleted) for c, p in layer))
    return layer


def start(state: int) -> Layer:
    return closed(tuple((0, "") if k == state else FAR for k in range(4)))


def fault_of(text: str, first: bool) -> str:
    bare = text.rstrip(SPACE)
    if not bare:
        return "blank"
    if not first:
        return "duplicate"
    return "" if bare[-1] in ".!?" else "truncated"


Row = tuple[str, str, int, str]  # role, text, times, fault


def repaired_rows(rows: list[Row], audit: str, state: int) -> Iterator[tuple[str, str]]:
    """Role and text of the repaired turns."""
    edits = iter(audit)

    def write(edit: str, role: str, text: str) -> tuple[str, str]:
        nonlocal state
        if edit == "K":
            state = {"s": S, "u": U, "a": A}[role[0]]
            return role, text
        state = A if state == U else U
        return ("assistant" if state == A else "user"), text

    for role, text, times, _ in rows:
        done = 0
        while done < times:
            edit = next(edits)
            if edit == "I":
                yield write(edit, "", "")
            else:
                done += 1
                if edit != "D":
                    yield write(edit, role, text)
    for edit in edits:
        yield write(edit, "", "")


def _summary(rows: list[Row], turns: list[int | None]) -> dict:
    """Counts of a chunk, and what its neighbours need."""
    out = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first": None, "last": None, "low": None, "high": None, "turns": 0}
    for (role, _, times, fault), turn in zip(rows, turns, strict=True):
        if not times:
            continue
        initial = role[:1]
        if fault in ("blank", "duplicate"):
            out[fault] += times
        else:
            out["truncated"] += fault == "truncated"
            out["duplicate"] += times - 1
        out["illegal"] += times - 1 if initial * 2 not in LEGAL else 0
        if out["last"] is not None and out["last"] + initial not in LEGAL:
            out["illegal"] += 1
        out["first"] = initial if out["first"] is None else out["first"]
        out["last"] = initial
        if turn is not None and turn != out["high"]:
            out["low"] = turn if out["low"] is None else out["low"]
            out["high"], out["turns"] = turn, out["turns"] + 1
    return out


def _joined(x: dict, y: dict) -> dict:
    """The summary of two chunks, one behind the other."""
    out = {c: x[c] + y[c] for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += x["last"] is not None and y["first"] is not None and x["last"] + y["first"] not in LEGAL
    out["turns"] -= x["high"] is not None and x["high"] == y["low"]
    for c, (one, two) in {"first": (x, y), "last": (y, x), "low": (x, y), "high": (y, x)}.items():
        out[c] = one[c] if one[c] is not None else two[c]
    return out


def _gaps(summary: dict) -> int:
    return summary["high"] - summary["low"] + 1 - summary["turns"] if summary["turns"] else 0


SUMMARY = "blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _result(summary: dict, best: Best) -> dict:
    return {"gaps": _gaps(summary), **{c: summary[c] for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": best[0], "audit": best[1]}


def _given(rows: Iterator[tuple[dict, int]], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size from rows and their characters."""
    arrow, held, size = to_arrow_schema(schema), [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if len(held) >= OUT_ROWS or size >= OUT_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=arrow)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            yield from batch.slice(i, 64).to_pylist()


def _sorted_turns(chats: DataFrame, conv: str, turn: str, role: str, text: str, times: Column) -> DataFrame:
    """(c, at, role, text, n, first): each different row once, sorted by ranges."""
    there = times > 0
    rows = chats.select(F.struct(F.col(conv).alias("id")).alias("c"), F.struct(F.when(there, F.col(turn)).cast("long").alias("turn")).alias("at"), F.when(there, F.coalesce(F.col(role), F.lit(" "))).otherwise("").alias("role"), F.when(there, F.coalesce(F.col(text), F.lit(" "))).otherwise("").alias("text"), times.cast("long").alias("n"))
    own = ["c", "at", "role", "mark"]
    grouped = rows.withColumn("mark", F.unhex(F.sha2("text", 256))).groupBy(*own).agg(F.sum("n").alias("n"), F.first("text").alias("text"))
    # of the same role and text the first one is that of the least turn; the join is by the whole row, so no text of many turns gathers
    firsts = grouped.where("n > 0").groupBy("c", "role", "mark").agg(F.min("at").alias("at")).withColumn("first", F.lit(True))
    flagged = materialize(grouped.join(firsts, own, "left").select("c", "at", "role", "text", "n", F.coalesce("first", F.lit(False)).alias("first")), "turns")
    return flagged.repartitionByRange("c", "at", "role", F.substring("text", 1, 256)).sortWithinPartitions("c", "at", "role", "text")


def _chunks(turns: DataFrame, with_rows: bool) -> DataFrame:
    """A row for each chunk. ``done``: the conversation's result, if it is whole; else ``paths`` (by state before and after) and ``rows``."""
    schema = T.StructType([turns.schema["c"], *T._parse_datatype_string(f"part int, seq long, summary struct<{SUMMARY.replace(' ', ':').replace(',:', ',')}>, done struct<{RESULT.replace(' ', ':').replace(',:', ',')}>, sha256 string, paths array<struct<cost:long,audit:string>>, rows array<struct<role:string,text:string,times:long,fault:string>>").fields])

    def chunk(part: int, seq: int, c: dict, rows: list[Row], ats: list, whole: bool) -> tuple[dict, int]:
        summary = _summary(rows, ats)
        out = {"c": c, "part": part, "seq": seq, "summary": summary, "done": None, "sha256": None, "paths": None, "rows": None}
        size = sum(len(r[1]) for r in rows)
        layers = [start(k) for k in ((E,) if whole else range(4))]
        for role, _, times, fault in rows:
            if times:
                layers = [after(x, role[:1], fault, times) for x in layers]
        if whole:
            best = min(layers[0][E], layers[0][A])
            out["done"] = _result(summary, best)
            out["sha256"] = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired_rows(rows, best[1], E)).encode()).hexdigest()
        else:
            out["paths"] = [{"cost": cost, "audit": audit if cost < FAR[0] else ""} for x in layers for cost, audit in x]
        if with_rows or not whole:
            out["rows"] = [dict(zip(("role", "text", "times", "fault"), r, strict=True)) for r in rows if r[2]]
            size *= 2
        return out, size + 16 * len(rows)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        part, seq, now, rows, ats, size, edge = TaskContext.get().partitionId(), 0, None, [], [], 0, True
        for r in _lines(batches):
            other = now is not None and r["c"] != now
            if other or len(rows) >= CHUNK_ROWS or size >= CHUNK_CHARS:
                yield chunk(part, seq, now, rows, ats, other and not edge)
                # what comes next is whole only if it begins here
                seq, rows, ats, size, edge = seq + 1, [], [], 0, not other
            now = r["c"]
            rows.append((r["role"], r["text"], r["n"], fault_of(r["text"], r["first"]) if r["n"] else ""))
            ats.append(r["at"]["turn"])
            size += len(r["text"])
        if rows:
            yield chunk(part, seq, now, rows, ats, False)

    return turns.mapInArrow(lambda batches: _given(chunks(batches), schema), schema)


def _by_conversation(rows: Iterator[dict]) -> Iterator[tuple[dict, Iterator[dict]]]:
    """Rows come sorted by c; a group is read as it comes."""
    row = next(rows, None)
    while row is not None:
        c = row["c"]

        def group(c=c):
            nonlocal row
            while row is not None and row["c"] == c:
                yield row
                row = next(rows, None)

        own = group()
        yield c, own
        for _ in own:
            pass


def _multiplied(chunks: DataFrame) -> DataFrame:
    """(c, done, steps) of the conversations that were cut; steps are the states before and the audit string of each chunk."""
    schema = T.StructType([chunks.schema["c"], chunks.schema["done"], *T._parse_datatype_string("steps array<struct<part:int,seq:long,state:int,audit:string>>").fields])

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        for c, own in _by_conversation(_lines(batches)):
            total, best = None, [(0, "", None), (*FAR, None), (*FAR, None), (*FAR, None)]  # and the way there, shared from the back
            for x in own:
                total = x["summary"] if total is None else _joined(total, x["summary"])
                new = []
                for to in range(4):
                    ways = [(best[k][0] + p["cost"], best[k][1] + p["audit"], k, p["audit"]) for k in range(4) for p in (x["paths"][4 * k + to],)]
                    cost, audit, k, own_audit = min(ways)
                    new.append((cost, audit, (best[k][2], {"part": x["part"], "seq": x["seq"], "state": k, "audit": own_audit})))
                best = new
            cost, audit, way = min((best[E], best[A]), key=lambda b: b[:2])
            steps = []
            while way:
                way, step = way
                steps.append(step)
            yield {"c": c, "done": _result(total, (cost, audit)), "steps": steps[::-1]}, 2 * len(audit)

    rows = chunks.where("done is null").select("c", "part", "seq", "summary", "paths").repartition("c").sortWithinPartitions("c", "part", "seq")
    return rows.mapInArrow(lambda batches: _given(results(batches), schema), schema)


def _steps(chunks: DataFrame, cut: DataFrame) -> DataFrame:
    """The rows, state before and audit string of each chunk of the conversations that were cut."""
    steps = cut.select("c", F.explode("steps").alias("s")).select("c", "s.*")
    return chunks.where("done is null").select("c", "part", "seq", "rows").join(steps, ["c", "part", "seq"])


def _rows_of(line: dict) -> list[Row]:
    return [(r["role"], r["text"], r["times"], r["fault"]) for r in line["rows"]]


def report(chats: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", times: Column | None = None) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    ``times`` says how often a row is there; a conversation of rows that are there no
    time at all is reported with an empty audit.
    """
    chunks = materialize(_chunks(_sorted_turns(chats, conv, turn, role, text, F.lit(1) if times is None else times), False), "chunks")
    cut = materialize(_multiplied(chunks), "cut")
    texts = T.StructType([chunks.schema["c"], *T._parse_datatype_string("part int, seq long, text string").fields])

    def repaired_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        for x in _lines(batches):
            lines = [f"{r}:{t}" for r, t in repaired_rows(_rows_of(x), x["audit"], x["state"])]
            out = "\n".join(lines) if lines else None
            yield {"c": x["c"], "part": x["part"], "seq": x["seq"], "text": out}, len(out or "")

    digests = T.StructType([chunks.schema["c"], *T._parse_datatype_string("sha256 string").fields])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        for c, own in _by_conversation(_lines(batches)):
            digest, begun = hashlib.sha256(), False
            for x in own:
                if x["text"] is not None:
                    digest.update((b"\n" if begun else b"") + x["text"].encode())
                    begun = True
            yield {"c": c, "sha256": digest.hexdigest()}, 64

    written = _steps(chunks, cut).mapInArrow(lambda batches: _given(repaired_chunks(batches), texts), texts)
    sums = written.repartition("c").sortWithinPartitions("c", "part", "seq").mapInArrow(lambda batches: _given(hashed(batches), digests), digests)
    whole = chunks.where("done is not null").select("c", "done", "sha256").unionByName(cut.select("c", "done").join(sums, "c"))
    return whole.select(F.col("c.id").alias(conv), "done.*", F.col("sha256").alias("repaired_sha256"))


def repaired(chats: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", times: Column | None = None) -> DataFrame:
    """The repaired conversations: (conv, place, role, text); place is a struct by which a conversation's turns are sorted."""
    chunks = materialize(_chunks(_sorted_turns(chats, conv, turn, role, text, F.lit(1) if times is None else times), True), "chunks")
    whole = chunks.where("done is not null").select("c", "part", "seq", "rows", F.lit(E).alias("state"), F.col("done.audit").alias("audit"))
    every = whole.unionByName(_steps(chunks, materialize(_multiplied(chunks), "cut")))
    schema = T.StructType([chunks.schema["c"], *T._parse_datatype_string("place struct<part:int,chunk:long,k:long>, role string, text string").fields])

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        for x in _lines(batches):
            for k, (r, t) in enumerate(repaired_rows(_rows_of(x), x["audit"], x["state"])):
                yield {"c": x["c"], "place": {"part": x["part"], "chunk": x["seq"], "k": k}, "role": r, "text": t}, len(t)

    out = every.mapInArrow(lambda batches: _given(turns(batches), schema), schema)
    return out.select(F.col("c.id").alias(conv), "place", "role", "text")
