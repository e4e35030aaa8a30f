"""Best-fit packing with Martello-Toth dominance reduction.

Bin packing with whole-number sizes depends only on how many pieces have each size, so
the plan is made from a histogram of at most ``capacity`` rows, whatever the corpus:

1. reduction: as long as the largest size left has a companion set that dominates every
   other one (alone, an exact complement, or the largest single companion where no pair
   fits or every fitting set is no larger), these bins are fixed for good;
2. the remainder is packed best-fit decreasing, many equal bins at a time.

The plan has at most a few patterns for each size. Pieces take their place in it by
their rank among the pieces of their size, sizes with many pieces in several runs
(``RUN_ROWS``). A full piece is a sequence by itself and needs no place.

Defined cases: a null text is an empty one and still is one end token; a text of any
length is tokenized whole; what the file lists as an added token is one token wherever
its text occurs, as the library has it; repeated rows are packed once each; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textarrays as TA
from .runtime import materialize

END_ID = 2
#: Pieces of one size that are ranked in one window, on average.
RUN_ROWS = 100_000

Pattern = tuple[tuple[int, ...], int]


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Bins that some optimal packing has, and what is left of the instance."""
    left = {s: n for s, n in counts.items() if n}
    fixed: list[Pattern] = []

    def take(pattern: tuple[int, ...], times: int) -> None:
        fixed.append((pattern, times))
        for s in pattern:
            left[s] -= times
            if not left[s]:
                del left[s]

    def second_smallest_sum(without: int) -> float:
        """The least two other sizes together."""
        found: list[int] = []
        for s in sorted(left):
            found += [s] * min(2, left[s] - (s == without))
            if len(found) >= 2:
                return found[0] + found[1]
        return float("inf")

    def best_set(room: int, without: int) -> int:
        """The largest sum up to room of two or more other pieces, unlimited copies: no less than the true one."""
        sizes = [s for s in left if s <= room and left[s] - (s == without) > 0]
        sums = 0  # bit x: x is a sum of two or more
        frontier = sum(1 << s for s in sizes)
        while frontier:
            longer = 0
            for s in sizes:
                longer |= frontier << s
            longer &= (1 << (room + 1)) - 1
            frontier = longer & ~sums
            sums |= longer
        return sums.bit_length() - 1

    for size in sorted(counts, reverse=True):
        while left.get(size):
            room = capacity - size
            others = [s for s in left if s <= room and (s != size or left[s] > 1)]
            if not others:
                take((size,), left[size])
            elif room in left and (room != size or left[size] > 1):
                take((size, room), left[size] // 2 if room == size else min(left[size], left[room]))
            else:
                companion = max(others)
                if second_smallest_sum(size) > room or best_set(room, size) <= companion:
                    take((size, companion), max(1, left[size] // 2) if companion == size else min(left[size], left[companion]))
                else:
                    break
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over counts: the same bins as one piece after the other, many equal bins at once."""
    open_bins: dict[int, list[list]] = {}  # by room: [pattern, times]
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            room = min((r for r in open_bins if r >= size), default=capacity)
            fit = room // size
            if room in open_bins:
                group = open_bins[room][-1]
                times, each = (min(group[1], n // fit), fit) if n >= fit else (1, n)
                group[1] -= times
                if not group[1]:
                    open_bins[room].pop()
                    if not open_bins[room]:
                        del open_bins[room]
                base = group[0]
            else:
                times, each = (n // fit, fit) if n >= fit else (1, n)
                base = ()
            n -= times * each
            open_bins.setdefault(room - each * size, []).append([base + (size,) * each, times])
    return [(tuple(p), t) for groups in open_bins.values() for p, t in groups]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: bins that any packing needs."""
    best = 0
    for k in {0, *(s for s in counts if s <= capacity // 2)}:
        big = sum(n for s, n in counts.items() if s > capacity - k)
        half = {s: n for s, n in counts.items() if capacity // 2 < s <= capacity - k}
        rest = sum(s * n for s, n in counts.items() if k <= s <= capacity // 2)
        free = sum(half.values()) * capacity - sum(s * n for s, n in half.items())
        best = max(best, big + sum(half.values()) + max(0, -(-(rest - free) // capacity)))
    return best


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    fixed, left = reduce_dominated(counts, capacity)
    return fixed + best_fit(left, capacity)


def slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Runs of places for each size: ranks from lo on go to sequences from sequence on, at offset."""
    lo: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        at = 0
        for s in pattern:
            rows.append((s, lo.get(s, 0), sequence, at))
            lo[s] = lo.get(s, 0) + times
            at += s
        sequence += times
    rows.sort()
    size, first, seq, at = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4
    return {"key": size << 44 | first, "lo": first, "sequence": seq, "offset": at}


#: White space as the pre-tokenizer has it; the pieces of a text never hold other characters before white space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RARE = SPACE.replace(" ", "").replace("\n", "")
_PARTS = re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall


def _bytes_of_characters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as itself if it is printable, else as the next character from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenCache(dict):
    """Token ids (little-endian, unsigned 32-bit) of parts of texts, made when first asked for.

    The file is one of byte-level BPE of the tokenizers library. The pre-tokenizer never
    joins a character that is not white space with white space behind it, so a text may
    be cut there, and equal parts are tokenized once. Where the vocabulary is in the
    order of its merges, the same merges are run on the same vocabulary by tiktoken's
    core, which is several times faster for single words; else by the library itself.
    The number of kept parts is bounded; a full cache starts anew.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.most = most
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        split = whole.get("pre_tokenizer") or {}
        #: texts may be cut at white space by the rule above
        self.cut = not whole.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.added = tuple(t["content"] for t in whole.get("added_tokens", []))
        self.word = self._core(whole["model"]) if self.cut else self.whole
        self.word = self.word or self.whole

    @staticmethod
    def _core(model: dict):
        import tiktoken

        byte, vocabulary = _bytes_of_characters(), model["vocab"]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [vocabulary[m] for m in merged]
        if ids != sorted(set(ids)) or len(vocabulary) < 256 + len(ids) or ids and min(ids) < 256:
            return None
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if i <= (ids[-1] if ids else 255)}
        core = tiktoken.Encoding("own", pat_str=r"\p{L}+|[^\p{L}]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        return lambda s: array("I", core.encode_single_piece(s.encode())).tobytes()

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, part: str) -> bytes:
        """part is a text's beginning after a mark \\r, or what followed a space, or a line feed and what followed it."""
        lead = part[:1]
        own = part[1:] if lead in ("\r", "\n") else part
        before = {"\r": "", "\n": ""}.get(lead, " ")
        if own.isalpha():
            out = self.word(before + own)
        elif own[-1:] in (".", ",") and own[:-1].isalpha():
            out = self.word(before + own[:-1]) + self.word(own[-1])
        else:
            out = self.whole(before + own if lead != "\n" else part)
            lead = ""
        if lead == "\n":
            out = self.word("\n") + out
        self[part] = out
        return out

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.cut or any(t in text for t in self.added):
            return self.whole(text)
        if len(self) > self.most:
            self.clear()
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(c in text for c in _RARE) or text[0] in SPACE or text[-1] in SPACE:
            return b"".join([self["\r" + p] if p[0] not in SPACE else self[p[1:]] if p[0] == " " and len(p) > 1 and p[1] not in SPACE else self.whole(p) for p in _PARTS(text)])
        return b"".join(map(self.__getitem__, ("\r" + text).replace("\n", " \n").split(" ")))


_CACHES: dict[str, TokenCache] = {}


def token_cache(path: str) -> TokenCache:
    """This worker's cache for a tokenizers file; it is kept as long as the worker lives."""
    if path not in _CACHES:
        _CACHES[path] = TokenCache(path)
    return _CACHES[path]


def pieces(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """The documents' pieces of at most ``capacity`` tokens; only the first piece of a longer document may be shorter.

    ``tokenizer`` is the path of a tokenizers file that every machine has.
    """
    mine = docs.select(key, text)
    schema = T.StructType([mine.schema[key], *T._parse_datatype_string("piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids).fields])
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = token_cache(tokenizer)
        for batch in batches:
            for part in TA.slices(batch, text, 1 << 20):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, t in enumerate(part.column(text).to_pylist()):
                    data = cache.encode(t or "") + end
                    n = len(data) // 4
                    cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        own = data[4 * a : 4 * b]
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(own))
                        ids.append(own if with_ids else None)
                arrays = [part.column(key).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(ids, pa.binary())] * with_ids, names=schema.names)

    return mine.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and its place there; places are gapless from 0."""
    numbered = pieces(docs, tokenizer, key=key, text=text, capacity=capacity, with_ids=with_ids).withColumn("_n", F.monotonically_increasing_id())
    cut = materialize(numbered, "pieces")  # with their numbers, so that they do not change
    total = {r[0]: r[1] for r in cut.where(F.col("length") < capacity).groupBy("length").count().collect()}  # fewer than capacity rows
    runs = [1 + total.get(n, 0) // RUN_ROWS for n in range(1, capacity + 1)]
    salted = cut.withColumn("_salt", F.expr(f"cast(pmod(xxhash64(_n), element_at(array({', '.join(map(str, runs))}), cast(length as int))) as int)"))
    # capacity rows, and one more for every RUN_ROWS pieces
    counts = salted.where(F.col("length") < capacity).groupBy("length", "_salt").count().collect()
    base = np.concatenate([[0, 0], np.cumsum(runs)])[: capacity + 1].astype(np.int64)
    before, seen = np.zeros(int(sum(runs)) + 1, np.int64), {}
    for n, salt, count in sorted(counts):
        before[base[n] + salt] = seen.get(n, 0)
        seen[n] = seen.get(n, 0) + count
    patterns = plan(total, capacity)
    shared = docs.sparkSession.sparkContext.broadcast((slots(patterns), base, before))  # bounded by capacity and the runs, see above
    ranked = salted.where(F.col("length") < capacity).withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(key, "piece", "_n")))
    names = [f for f in cut.schema.fields if f.name != "_n"]
    schema = T.StructType([*names, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, first, ahead = shared.value
        for batch in batches:
            length, salt, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_salt", "_rank"))
            rank = ahead[first[length] + salt] + rank - 1
            run = np.searchsorted(where["key"], length << 44 | rank, "right") - 1
            sequence = where["sequence"][run] + rank - where["lo"][run]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in names), pa.array(sequence), pa.array(where["offset"][run])], names=schema.names)

    full = cut.where(F.col("length") == capacity).select(*(f.name for f in names), (F.col("_n") + sum(n for _, n in patterns)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.mapInArrow(place, schema).unionByName(full)
