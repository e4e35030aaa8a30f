"""N-gram Jaccard self-join by chosen paths.

Sets of k-word shingles are embedded by MinHash: coordinate c of a sketch is a sampled
token that two sets share with probability equal to their similarity. The join recurses
on sampled shared coordinates: each of some repetitions splits all sets by one
coordinate; a node that is still large splits its sets by more coordinates drawn from
its path, down to ``DEPTH``; small nodes are brute-forced. A pair of the least similarity
shares none of r coordinates with probability (1 - least)**r; ``repetitions`` takes the r
for which a split loses no more than its share of 1 - recall (at 0.8 and the default
recall of 0.995: four for each split, 0.0016 lost in each of at most three).

A pair meets in many nodes but is *owned* by one: the node in which no coordinate tried
earlier on the path agrees. Only there it is counted, so links need not be listed to be
counted once, and no pairs leave a task: a node gives for each of its sets the number of
its links there and the smallest set it is connected to. Equal sets are one set
throughout. A node of n sets that no coordinate splits (many near copies of one text)
becomes a grid: about sqrt(n / BLOCK) blocks, and every pair of blocks is a unit of work
of its own. Each set goes to as many units as there are blocks, so rows grow far slower
than pairs, and a unit's memory grows with sqrt(n); only comparisons, which an exact
number of links needs, grow with the square, spread over the units.

Sketches only choose candidates; links are decided on the whole texts' shingles (as
32-bit values: for two texts of 20,000 words these are expected to differ from the
shingles themselves in about a tenth of one shingle).

Defined cases: a text of fewer than k words is one shingle; a text without words, or
null, or with a null key, is a class of its own without links; repeated rows get equal
answers, one each, and so do different texts with equal keys, each by its own text; ties
go to the smallest key; an empty table gives no rows; extra columns are ignored by
``classes`` and kept by ``one_of_each``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textarrays as TA
from .runtime import materialize

COORDINATES = 32
DEPTH = 3
SMALL = 256
BLOCK = 400
#: A block has no more tokens than this on average, so that a unit of long texts fits in memory.
BLOCK_TOKENS = 4_000_000
#: Pairs are compared in squares of so many rows a side.
EDGE = 512
#: A table of ids of up to so many bytes may be broadcast; a larger one is shuffled.
BROADCAST_BYTES = 32 << 20

_MULTIPLY = TA.mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = TA.mix64(np.arange(101, COORDINATES + 101, dtype=np.uint64))


def repetitions(least: float, recall: float) -> int:
    """Coordinates for a split, so that all splits of a path together lose at most 1 - recall of the least similar pairs."""
    return max(1, math.ceil(math.log((1 - recall) / DEPTH) / math.log(1 - least))) if least < 1 else 1


def agreeing(least: float) -> int:
    """Agreeing coordinates a candidate must have: the mean at the least similarity less 4.7 deviations (one pair in a million has fewer)."""
    return max(1, math.ceil(COORDINATES * least - 4.7 * math.sqrt(COORDINATES * least * (1 - least))))


def sketches(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """COORDINATES 32-bit minima for each non-empty set; zeros for an empty one."""
    out = np.zeros((len(first) - 1, COORDINATES), np.uint32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        wide, at = tokens.astype(np.uint64), first[:-1][full]
        for c in range(COORDINATES):
            hashed = wide * _MULTIPLY[c]
            hashed += _ADD[c]
            hashed ^= hashed >> np.uint64(29)
            hashed *= _ADD[c] | np.uint64(1)
            out[full, c] = np.minimum.reduceat((hashed >> np.uint64(32)).astype(np.uint32), at)
    return out


def set_ids(tokens: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """128 bits of each set's contents; None for an empty one."""
    count = np.diff(first)
    full = np.flatnonzero(count)
    out: list[bytes | None] = [None] * len(count)
    if len(full):
        at = first[:-1][full]
        halves = [np.add.reduceat(TA.mix64(tokens.astype(np.uint64) + np.uint64(seed)), at) for seed in (1 << 40, 3 << 50)]
        raw = np.column_stack(halves).astype(">u8").tobytes()
        for k, i in enumerate(full.tolist()):
            out[i] = raw[16 * k : 16 * k + 16]
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1, dtype=np.int32) * width).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _matrix(column, dtype, width: int) -> np.ndarray:
    data, offs = TA.utf8_binary(column)
    return np.frombuffer(data.tobytes(), dtype).reshape(len(offs) - 1, width)


def signatures(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    mine = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))
    schema = T.StructType([mine.schema["key"], *T._parse_datatype_string("mark long, sid binary, size int, sketch binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in TA.slices(batch, "text"):
                tokens, first = TA.shingles(*TA.words(*TA.utf8(part.column("text"))), k)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("mark"), pa.array(set_ids(tokens, first), pa.binary()), pa.array(np.diff(first).astype(np.int32)), _binary(sketches(tokens, first))], names=schema.names)

    return mine.mapInArrow(run, schema)


def _nodes(reps: DataFrame, runs: int) -> DataFrame:
    """Units of brute-force work in the final nodes of the recursion: each of their sets, with its block and the coordinates that must differ for a pair to be owned."""
    now = reps.selectExpr("*", f"explode(sequence(0, {runs - 1})) as j").selectExpr("rep", "sid", "size", "sketch", "xxhash64(j, substring(sketch, 4 * j + 1, 4)) as path", "shiftleft(1L, j) - 1 as before", "cast(null as bigint) as parent")
    done: list[DataFrame] = []
    for depth in range(DEPTH):
        # the counts are a table of their own, so that the join may split a path with many rows; nodes of one set are dropped by it
        counts = materialize(now.groupBy("path").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"), F.max("parent").alias("parent_n")).where("n > 1"), "counts")
        live = materialize(now.drop("parent").join(counts.hint("shuffle_merge"), "path"), "nodes")  # alike at every size
        final = (F.col("n") <= SMALL) | (F.col("n") > F.col("parent_n") / 2) if depth < DEPTH - 1 else F.lit(True)
        final = F.coalesce(final, F.lit(False))
        done.append(live.where(final).drop("parent_n"))
        if depth == DEPTH - 1 or not live.where(~final).head(1):
            break
        spare = COORDINATES - runs
        step = next(s for s in (7, 11, 13) if spare % s)
        at = f"({runs} + pmod(pmod(path, {spare}) + {step} * {{}}, {spare}))"
        earlier = " | ".join(f"if({i} < j, shiftleft(1L, cast({at.format(i)} as int)), 0L)" for i in range(runs))
        now = live.where(~final).selectExpr("*", f"explode(sequence(0, {runs - 1})) as j").selectExpr("rep", "sid", "size", "sketch", f"xxhash64(path, j, substring(sketch, 4 * cast({at.format('j')} as int) + 1, 4)) as path", f"before | {earlier} as before", "n as parent")
    nodes = done[0]
    for d in done[1:]:
        nodes = nodes.unionByName(d)
    blocks = f"if(n <= {SMALL}, 1, 1 + cast(greatest(sqrt(n / {BLOCK}), tokens / {BLOCK_TOKENS}) as int))"
    return nodes.selectExpr("*", f"{blocks} as blocks").selectExpr("*", "cast(pmod(xxhash64(sid, path), blocks) as int) as block").selectExpr("*", "explode(sequence(0, blocks - 1)) as other").selectExpr("path", "least(block, other) as low", "greatest(block, other) as high", "block", "before", "rep", "sid", "size", "sketch")


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and where each group starts (with the end), from rows sorted by ``columns``."""
    held: list[pa.RecordBatch] = []

    def starts(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, bool)
        change[:1] = True
        for c in columns:
            x = t.column(c).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        last = tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in columns)
        if held and tuple(held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in columns) == last:
            held.append(batch)  # the group goes on
            continue
        held.append(batch)
        t = pa.Table.from_batches(held).combine_chunks()
        at = starts(t)
        if len(at) > 1:
            yield t.slice(0, at[-1]), at
            t = t.slice(at[-1])
        held = t.combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, np.append(starts(t), t.num_rows)


def _within(at: np.ndarray, some: np.ndarray, step: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within each of ``some`` small groups, groups of one size together."""
    size = np.diff(at)[some]
    for n in TA.unique(size[size > 1]).tolist():
        begin = at[some][size == n]
        a, b = np.triu_indices(n, 1)
        many = max(1, step // len(a))
        for i in range(0, len(begin), many):
            yield (begin[i : i + many, None] + a).ravel(), (begin[i : i + many, None] + b).ravel()


def _candidates(at: np.ndarray, sketch: np.ndarray, size: np.ndarray, before: np.ndarray, block: np.ndarray, crossed: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Owned pairs that may be similar: within each unit, or between its two blocks where it is crossed. Rows are sorted by block."""
    need = agreeing(least)
    bit = np.uint64(1) << np.arange(COORDINATES, dtype=np.uint64)
    large = (np.diff(at) > SMALL) | crossed[at[:-1]]
    for a, b in _within(at, np.flatnonzero(~large)):
        ok = np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b])
        a, b = a[ok], b[ok]
        same = sketch[a] == sketch[b]
        ok = same.sum(1) >= need
        a, b, same = a[ok], b[ok], same[ok]
        ok = (same.astype(np.uint64) @ bit & before[a].astype(np.uint64)) == 0
        if ok.any():
            yield a[ok], b[ok]
    for u in np.flatnonzero(large).tolist():
        lo, hi = int(at[u]), int(at[u + 1])
        across = bool(crossed[lo])
        middle = lo + int((block[lo:hi] == block[lo]).sum()) if across else hi
        tried = [c for c in range(COORDINATES) if int(before[lo]) >> c & 1]
        left = np.ascontiguousarray(sketch[lo:hi].T)
        for i in range(lo, middle, EDGE):
            stop = min(i + EDGE, middle)
            for j in range(middle if across else i, hi, EDGE):
                end = min(j + EDGE, hi)
                one, two = left[:, i - lo : stop - lo, None], left[:, None, j - lo : end - lo]
                agree = np.zeros((stop - i, end - j), np.uint8)
                for c in range(COORDINATES):
                    agree += one[c] == two[c]
                ok = agree >= need
                for c in tried:
                    ok &= one[c] != two[c]
                x, y = size[i:stop, None], size[None, j:end]
                ok &= np.minimum(x, y) >= least * np.maximum(x, y)
                a, b = np.nonzero(np.triu(ok, 1) if i == j else ok)
                if len(a):
                    yield a + i, b + j


def _shared(tokens: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets."""
    out = np.zeros(len(a), np.int64)
    (left, i), (right, j) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
    if len(a) > 4 * (len(left) + len(right)) and len(left) <= EDGE and len(right) <= EDGE:
        union = TA.unique(np.concatenate([tokens[r] for r in (*left, *right)]))
        width = max(1, (2 << 20) // (len(left) + len(right)))
        both = np.zeros((len(left), len(right)), np.float64)
        for low in range(0, len(union), width):
            part = union[low : low + width]
            there = []
            for rows in (left, right):
                table = np.zeros((len(rows), len(part)), np.float32)
                for k, r in enumerate(rows):
                    t = tokens[r]
                    t = t[np.searchsorted(t, part[0]) : np.searchsorted(t, part[-1], "right")]
                    table[k, np.searchsorted(part, t)] = 1
                there.append(table)
            both += there[0] @ there[1].T
        return np.rint(both[i, j]).astype(np.int64)
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = tokens[i], tokens[j]
        place = np.searchsorted(y, x)
        out[k] = int((y[np.minimum(place, len(y) - 1)] == x).sum())
    return out


def _linked(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row each row is connected to, from those so far and more pairs."""
    apart = root[a] != root[b]
    a, b = a[apart], b[apart]
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _arrays(t: pa.Table) -> dict[str, np.ndarray]:
    return {c: t.column(c).to_numpy() for c in t.column_names if c in ("path", "low", "high", "block", "before", "size")}


def _join_small(left: DataFrame, small: DataFrame, on: str | list[str], how: str, row_bytes: F.Column) -> DataFrame:
    """Broadcast the written table if its rows' bytes add up to BROADCAST_BYTES at most, else let both be shuffled."""
    size = small.agg(F.coalesce(F.sum(row_bytes), F.lit(0))).first()[0]
    return left.join(F.broadcast(small) if size <= BROADCAST_BYTES else small, on, how)


def links(docs: DataFrame, reps: DataFrame, key: str, text: str, k: int, least: float, recall: float) -> DataFrame:
    """(sid, root, n_links): for each set its links in one unit of work, and the smallest set it is connected to there."""
    unit = ["path", "low", "high"]
    nodes = _nodes(reps, repetitions(least, recall)).repartition(*unit).sortWithinPartitions(*unit, "block")
    member_schema = T.StructType([*(nodes.schema[c] for c in (*unit, "block", "before")), reps.schema["rep"], nodes.schema["sid"]])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _groups(batches, unit):
            x = _arrays(t)
            sketch = _matrix(t.column("sketch"), "<u4", COORDINATES)
            chosen = np.zeros(t.num_rows, bool)
            for a, b in _candidates(at, sketch, x["size"], x["before"], x["block"], x["low"] != x["high"], least):
                chosen[a] = chosen[b] = True
            if chosen.any():
                yield from t.select(member_schema.names).filter(pa.array(chosen)).combine_chunks().to_batches()

    members = materialize(nodes.mapInArrow(choose, member_schema).groupBy("rep").agg(F.collect_list(F.struct(*unit, "block", "before", "sid")).alias("units")), "members")
    wanted = docs.select(F.col(key).alias("rep"), F.col(text).alias("text")).where(F.col("rep").isNotNull())
    chosen = _join_small(wanted, members, "rep", "inner", 64 + 72 * F.size("units"))
    set_schema = T._parse_datatype_string("path long, low int, high int, block int, before long, sid binary, tokens binary")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in TA.slices(batch, "text", 2 << 20):
                tokens, first = TA.shingles(*TA.words(*TA.utf8(part.column("text"))), k)
                own = set_ids(tokens, first)
                units = part.column("units")
                flat, row = units.flatten(), np.repeat(np.arange(part.num_rows), np.diff(units.offsets.to_numpy()))
                sid = flat.field("sid").to_pylist()
                good = np.array([own[r] == s for r, s in zip(row.tolist(), sid, strict=True)], bool)  # a key may be on several texts
                data = [tokens[first[r] : first[r + 1]].tobytes() for r in row[good].tolist()]
                keep = pa.array(good)
                yield pa.RecordBatch.from_arrays([*(flat.field(c).filter(keep) for c in set_schema.names[:-1]), pa.array(data, pa.binary())], names=set_schema.names)

    # a repeated row would come twice
    sets = chosen.mapInArrow(expand, set_schema).repartition(*unit).sortWithinPartitions(*unit, "block", "sid")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _groups(batches, unit):
            sids = t.column("sid").to_pylist()
            x = _arrays(t)
            twice = np.array([False] + [sids[i] == sids[i - 1] for i in range(1, len(sids))], bool)
            twice[at[:-1]] = False
            if twice.any():
                keep = np.flatnonzero(~twice)
                at = np.searchsorted(keep, at)
                t, sids, x = t.take(pa.array(keep)), [sids[i] for i in keep], {c: v[keep] for c, v in x.items()}
            tokens = [np.frombuffer(b.as_py(), "<u4") for b in t.column("tokens")]
            size = np.array([len(s) for s in tokens], np.int64)
            sketch = sketches(np.concatenate(tokens), np.concatenate([[0], np.cumsum(size)]))
            count, root = np.zeros(len(sids), np.int64), np.arange(len(sids))
            for a, b in _candidates(at, sketch, size, x["before"], x["block"], x["low"] != x["high"], least):
                both = _shared(tokens, a, b)
                ok = both >= least * (size[a] + size[b] - both) - 1e-9
                a, b = a[ok], b[ok]
                count += np.bincount(a, minlength=len(count)) + np.bincount(b, minlength=len(count))
                root = _linked(root, a, b)
            if count.any():
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array([sids[i] for i in some], pa.binary()), pa.array([sids[i] for i in root[some]], pa.binary()), pa.array(count[some])], names=["sid", "root", "n_links"])

    return sets.mapInArrow(verify, "sid binary, root binary, n_links long")


def components(edges: DataFrame) -> DataFrame:
    """(sid, root) with each set's smallest connected set, from edges (sid, root); by large and small stars in turn.

    Each round writes its edges, so a lost executor costs one round at most; rounds grow
    with the logarithm of the longest path.
    """
    now = materialize(edges.where("sid > root").select(F.col("sid").alias("u"), F.col("root").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()
        now = materialize(small, "edges")
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.countDistinct("u")).first())
        if state[:2] == before and state[0] == state[2] or not state[0]:
            return now.select(F.col("u").alias("sid"), F.col("v").alias("root"))
        before = state[:2]


def _sets(docs: DataFrame, key: str, text: str, k: int, least: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """The documents' signatures, and a row for each different set: its first document, class, links and copies."""
    if not 0.5 < least <= 1:
        raise ValueError("the repetitions are made for similarities above 0.5")
    signed = materialize(signatures(docs, key, text, k), "signatures")
    reps = materialize(signed.where(F.col("sid").isNotNull() & F.col("key").isNotNull()).groupBy("sid").agg(F.min(F.struct("key", "mark")).alias("head"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.count("*").alias("n_copies")).withColumn("rep", F.col("head.key")), "sets")
    found = materialize(links(docs, reps, key, text, k, least, recall), "links")
    linked = found.groupBy("sid").agg(F.sum("n_links").alias("n_links")).join(components(found), "sid", "left")
    named = reps.select("sid", "head", "n_copies").join(linked, "sid", "left")
    return signed, materialize(named.select("sid", "head", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "sid").alias("root")), "named")


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = 5, least: float = 0.8, recall: float = 0.995) -> DataFrame:
    """For each document its class (the smallest key among all that are connected to it), its links and copies.

    n_links counts the different sets of shingles that are similar to this document's;
    n_copies the documents with the very same set, itself among them.
    """
    signed, named = _sets(docs, key, text, k, least, recall)
    smallest = named.where("n_links > 0").groupBy("root").agg(F.min("head.key").alias("class_id"))
    known = named.join(smallest, "root", "left").select("sid", F.coalesce("class_id", "head.key").alias("class_id"), "n_links", "n_copies")
    return signed.select(F.col("key").alias(key), F.when(F.col("key").isNotNull(), F.col("sid")).alias("sid")).join(known, "sid", "left").select(key, F.coalesce("class_id", key).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = 5, least: float = 0.8, recall: float = 0.995) -> DataFrame:
    """The documents, all columns as they are, one row of each class: that of the smallest key.

    Rows are told apart by key and text: of equal keys with different texts each stands
    for itself, and of rows with equal key and text one stays (the least by a hash of the
    whole row). Rows without words or with a null key all stay.
    """
    signed, named = _sets(docs, key, text, k, least, recall)
    heads = materialize(named.groupBy("root").agg(F.min("head").alias("head")).select("head.key", "head.mark"), "heads")
    there = signed.where(F.col("sid").isNotNull() & F.col("key").isNotNull()).groupBy("key", "mark").agg(F.count("*").alias("n"))
    gone = materialize(there.join(heads, ["key", "mark"], "left_anti").select("key", "mark"), "gone")
    twice = materialize(there.where("n > 1").join(heads, ["key", "mark"], "left_semi").select("key", "mark"), "twice")
    # the documents' columns travel in one struct, so that no name can clash
    rows = docs.select(F.struct(*(F.col(_quoted(c)) for c in docs.columns)).alias("row"), F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("mark"))
    on, size = ["key", "mark"], F.lit(48)
    kept = _join_small(rows, gone, on, "left_anti", size)
    if twice.head(1):
        once = _join_small(kept, twice, on, "left_semi", size).groupBy("key", "mark").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        kept = _join_small(kept, twice, on, "left_anti", size).select("row").unionByName(once.select("row"))
    return kept.select("row.*")


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"
