"""Secret scans: all rules in one minimal automaton, one pass over the bytes.

The automaton marks stretches in which some rule may match and ends at an accepting
state; only these few stretches are read again by the rule's own expression, to get
groups and leftmost, non-overlapping spans. Spans are in code points, end exclusive.

Defined cases: a null text is an empty one and has no spans; texts of any length are
scanned whole; copies get the same spans; of spans that begin at one place the rule
listed first comes first; an empty table gives no rows; extra columns are kept by
``redact`` and ignored by ``report``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textarrays as TA
from .automaton import Automaton, compile_rules, run


@dataclass(frozen=True)
class Rule:
    """pattern finds leftmost, non-overlapping matches; those whose ``group`` has fewer than ``least`` characters are dropped.

    scan goes into the automaton: the same expression, with the length built in only where
    matches of too few characters would be everywhere, as counters multiply the states.
    """

    kind: str
    pattern: str
    scan: str
    group: int = 0
    least: int = 0


_KEY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE = (
    Rule("assign", rf"({_KEY})([A-Za-z0-9+/_.=-]+)", rf"{_KEY}[A-Za-z0-9+/_.=-]+", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{24,}", 0, 24),
)
#: Added by this operator to the base kinds.
MORE = (
    Rule("pem", r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----", r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE


@lru_cache(maxsize=8)
def machine(rules: tuple[Rule, ...]) -> Automaton:
    return compile_rules([r.scan for r in rules])


def find(column, rules: tuple[Rule, ...], automaton: Automaton) -> dict[int, list[tuple[int, int, int]]]:
    """For each row with secrets: (start, end, rule number), by start, then rule; code points."""
    data, offs = TA.utf8(column)
    states = run(automaton, data, offs[:-1])
    ends = np.flatnonzero(automaton.accepts[states])
    if not len(ends):
        return {}
    idle = TA.unique(np.concatenate([np.flatnonzero(states == 0), offs[1:] - 1]))  # a stretch ends with a byte back at the start, or with its document
    stop = idle[np.minimum(np.searchsorted(idle, ends), len(idle) - 1)] + 1
    row = np.searchsorted(offs, ends, "right") - 1
    stop = np.maximum(np.minimum(stop, offs[row + 1]), ends + 1)
    start = np.searchsorted(idle, ends)
    start = np.where(start > 0, idle[np.maximum(start - 1, 0)] + 1, 0)
    start = np.maximum(start, offs[row])
    expressions = [re.compile(r.pattern.encode()) for r in rules]
    bits: dict[tuple[int, int, int], int] = {}
    for r, a, b, m in zip(row.tolist(), start.tolist(), stop.tolist(), automaton.accepts[states[ends]].tolist(), strict=True):
        bits[r, a, b] = bits.get((r, a, b), 0) | m
    found: dict[int, list[tuple[int, int, int]]] = {}
    for (r, a, b), mask in bits.items():
        piece = data[a:b].tobytes()
        for k, rule in enumerate(rules):
            if mask >> k & 1:
                for m in expressions[k].finditer(piece):
                    if len(m.group(rule.group)) >= rule.least:
                        found.setdefault(r, []).append((a + m.start(), a + m.end(), k))
    for r, spans in found.items():
        text = data[offs[r] : offs[r + 1]]
        point = np.cumsum((text & 0xC0) != 0x80)  # code points up to and with each byte
        at = lambda x: int(point[x - 1]) if x else 0  # noqa: B023, E731
        found[r] = sorted((at(a - int(offs[r])), at(b - int(offs[r])), k) for a, b, k in spans)
        found[r].sort(key=lambda s: (s[0], s[2]))
    return found


def _joined(spans, rules) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, b, k in spans)


def report(docs: DataFrame, *, key: str = "doc_id", text: str = "text", base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """For each document: matches by base kind, a hash of the base spans, and all spans."""
    rules, mine = base + more, docs.select(key, text)
    schema = T.StructType([mine.schema[key], *(T.StructField(f"n_{r.kind}", T.LongType()) for r in base), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    shared = docs.sparkSession.sparkContext.broadcast(machine(rules))  # a table of at most compile_rules' max_states states

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in TA.slices(batch, text):
                found = find(part.column(text), rules, shared.value)
                rows = [found.get(i, ()) for i in range(part.num_rows)]
                counts = [pa.array([sum(s[2] == k for s in spans) for spans in rows], pa.int64()) for k in range(len(base))]
                hashes = [hashlib.sha256(_joined([s for s in spans if s[2] < len(base)], rules).encode()).hexdigest() for spans in rows]
                yield pa.RecordBatch.from_arrays([part.column(key), *counts, pa.array(hashes, pa.string()), pa.array([_joined(s, rules) for s in rows], pa.string())], names=schema.names)

    return mine.mapInArrow(scan, schema)


def redact(docs: DataFrame, *, text: str = "text", n_chars: str | None = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents, all rows and columns, with each secret replaced by its kind in brackets; overlapping spans become one."""
    shared = docs.sparkSession.sparkContext.broadcast(machine(rules))
    counted = n_chars if n_chars in docs.columns else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in TA.slices(batch, text):
                found = find(part.column(text), rules, shared.value)
                if found:
                    texts, changed = part.column(text).to_pylist(), {}
                    for i, spans in found.items():
                        out, at = [], 0
                        for a, b, k in spans:
                            if a >= at:
                                out += [texts[i][at:a], f"[{rules[k].kind}]"]
                            at = max(at, b)
                        texts[i] = "".join([*out, texts[i][at:]])
                        changed[i] = len(texts[i])
                    columns = {f.name: part.column(f.name) for f in part.schema}
                    columns[text] = pa.array(texts, part.schema.field(text).type)
                    if counted:
                        old = part.column(counted).to_pylist()
                        columns[counted] = pa.array([changed.get(i, x) for i, x in enumerate(old)], part.schema.field(counted).type)
                    part = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
                yield part

    return docs.mapInArrow(scan, docs.schema)
