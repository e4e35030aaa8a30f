"""Benchmark decontamination with word-level suffix arrays over shards of the corpus.

Every task builds, for each shard of some megabytes of whole documents, a suffix
array of its words; every suffix of every benchmark item is binary-searched in it, equal
beginnings of a window once. What is found is an interval of the array: intervals of one
depth never overlap, so places are visited once for each depth and never listed in pairs
with the suffixes. Items are gathered by sets of items, longest matches by the neighbours
of a place among the sorted benchmark suffixes.

Suffixes that cannot match (fewer benchmark words ahead than the shortest window)
are left out of the array: a sparse suffix array with the same answers. How far a match
goes on is decided by two 31-bit prefix hashes of word numbers.

The benchmark travels to the tasks in broadcasts of at most ``block_chars`` characters
each, all searched in the same pass over a shard; more than ``MAX_BENCHMARK_CHARS`` is
refused, so what is broadcast has a checked bound.

Defined cases: a null or wordless text has no words and is clean; a text of one word
over and over costs no more than another; items without words are ignored; rows with the
same item id are one item, a null item id is the empty string; equal documents get equal
answers; of equally long matches the first place counts, then the smallest item id
(numbers by value); an empty table gives no rows, an empty benchmark leaves every
document clean; extra columns are kept by ``clean`` and ignored by ``report``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textarrays as TA

REPORT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_item string, longest_at long"
#: More benchmark text than this in one driver collect is refused; split it into several calls.
MAX_BENCHMARK_CHARS = 256 << 20
#: Bytes of text in one suffix array.
SHARD_BYTES = 8 << 20

_NONE = np.zeros(0, np.int64)
_PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
_BASES = (1_284_865_837, 2_058_613_421)


def sorted_suffixes(tokens: np.ndarray, suffixes: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes (all places but end marks) in order, by prefix doubling until all ranks differ or ``depth`` words are compared. Tokens are below 2**31."""
    n, rank, k = len(tokens), tokens.astype(np.int64), 1
    if not len(suffixes):
        return suffixes
    while True:
        second = np.zeros(n, np.int64)
        second[:-k] = rank[k:] if k < n else 0
        key = rank[suffixes] << 32 | second[suffixes]
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[1], 1 + np.cumsum(np.diff(key[order]) != 0)])
        rank = np.zeros(n, np.int64)
        rank[suffixes[order]] = new
        k *= 2
        if k >= depth or new[-1] == len(suffixes) or k >= n:
            return suffixes[order]


class Prefixes:
    """Prefix hashes of a sequence of word numbers."""

    def __init__(self, tokens: np.ndarray):
        self.sums, self.powers = [], []
        mixed = TA.mix64(tokens.astype(np.uint64) + np.uint64(1)) >> np.uint64(2)
        for prime, base in zip(_PRIMES, _BASES, strict=True):
            powers = np.ones(len(tokens) + 1, np.int64)
            k, step = 1, base % prime
            while k < len(powers):
                more = powers[:k][: len(powers) - k]
                powers[k : k + len(more)] = more * step % prime
                k, step = 2 * k, step * step % prime
            total = np.cumsum((mixed % np.uint64(prime)).astype(np.int64) * powers[:-1] % prime)
            self.sums.append(np.concatenate([[0], total % prime]))
            self.powers.append(powers)


def _same(x: Prefixes, a: np.ndarray, y: Prefixes, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether n words from a in x are those from b in y."""
    out = np.ones(len(a), bool)
    for i, prime in enumerate(_PRIMES):
        one = (x.sums[i][a + n] - x.sums[i][a]) % prime
        two = (y.sums[i][b + n] - y.sums[i][b]) % prime
        # both are carried on to place a + b
        out &= one * _power(x, y, i, b) % prime == two * _power(x, y, i, a) % prime
    return out


def _power(x: Prefixes, y: Prefixes, i: int, k: np.ndarray) -> np.ndarray:
    powers = x.powers[i] if len(x.powers[i]) >= len(y.powers[i]) else y.powers[i]
    return powers[k]


def common_words(x: Prefixes, a: np.ndarray, y: Prefixes, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many words from a in x and b in y agree, between low (known to) and high."""
    low, high = low.copy(), high.copy()
    while len(live := np.flatnonzero(low < high)):
        mid = (low[live] + high[live] + 1) // 2
        ok = _same(x, a[live], y, b[live], mid)
        low[live[ok]] = mid[ok]
        high[live[~ok]] = mid[~ok] - 1
    return low


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, member) of all members of the ranges."""
    count = high - low
    which = np.repeat(np.arange(len(low)), count)
    return which, np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class TestSuffixes:
    """The words of the items as small numbers, and every suffix at least a window long, sorted.

    Suffixes with the same first window are a group; an item shorter than the window is
    one window, and equal ones are a group.
    """

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int):
        hashes, first = TA.words(*TA.utf8(pa.array([t for _, t in items], pa.string()))) if items else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        self.vocabulary = TA.unique(hashes)
        self.names = sorted({i for i, _ in items}, key=_item_order)
        number = {name: k for k, name in enumerate(self.names)}
        owner = np.array([number[i] for i, _ in items], np.int64)
        count = np.diff(first)
        row = np.repeat(np.arange(len(items)), count)
        place = np.arange(len(hashes)) - first[row] if len(hashes) else _NONE
        # words are numbered from 1; 0 ends each item
        self.tokens = np.zeros(len(hashes) + len(items) + 1, np.int32)
        where = np.arange(len(hashes)) + row
        self.tokens[where] = np.searchsorted(self.vocabulary, hashes) + 1
        left = np.zeros(len(self.tokens), np.int64)
        left[where] = count[row] - place
        item = np.zeros(len(self.tokens), np.int64)
        item[where] = owner[row] if len(items) else 0
        short = (count[row] < window) & (place == 0) if len(hashes) else np.zeros(0, bool)
        self.deepest = int(left.max()) if len(left) else 0
        first_of_short = np.zeros(len(self.tokens), bool)
        first_of_short[where] = short
        starts = sorted_suffixes(self.tokens, where, self.deepest)
        starts = starts[(left[starts] >= window) | first_of_short[starts]]
        self.start, self.left, self.item = starts.astype(np.int32), left[starts].astype(np.int32), item[starts].astype(np.int32)
        need = np.minimum(self.left, window)
        self.shortest = int(need.min()) if len(need) else 0
        # a group begins where the first window differs from the suffix before
        new = np.ones(len(starts), bool)
        if len(starts) > 1:
            new[1:] = need[1:] != need[:-1]
            for k in range(window):
                new[1:] |= (need[1:] > k) & (self.tokens[np.minimum(starts[1:] + k, len(self.tokens) - 1)] != self.tokens[np.minimum(starts[:-1] + k, len(self.tokens) - 1)])
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], len(starts))
        self.need = need[self.first].astype(np.int64)
        self.window = window
        self.prefixes = Prefixes(self.tokens)
        # groups with the same items share one list of them
        group = np.repeat(np.arange(len(self.first)), self.last - self.first)
        pair = TA.unique(group * max(1, len(self.names)) + self.item)
        group, item = np.divmod(pair, max(1, len(self.names)))
        begin = np.searchsorted(group, np.arange(len(self.first)))
        mark = np.add.reduceat(TA.mix64(item.astype(np.uint64) + np.uint64(7)), begin) if len(pair) else np.zeros(0, np.uint64)
        _, example, self.items_of = np.unique(mark, return_index=True, return_inverse=True)
        end = np.append(begin[1:], len(pair))
        self.item_sets = [item[begin[g] : end[g]].tolist() for g in example]


class Shard:
    """A sparse suffix array of the documents' words."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, test: TestSuffixes):
        at = np.searchsorted(test.vocabulary, hashes)
        at[at == len(test.vocabulary)] = 0
        ids = np.where(test.vocabulary[at] == hashes, at + 1, 0)
        edge = np.zeros(len(ids) + 1, bool)
        edge[first] = True
        breaks = edge.copy()
        breaks[:-1] |= ids == 0
        breaks = np.flatnonzero(breaks)
        head = np.flatnonzero((ids > 0) & (np.concatenate([[True], (ids == 0)[:-1]]) | edge[:-1]))
        length = breaks[np.searchsorted(breaks, head, "right")] - head
        head, length = head[length >= test.shortest], length[length >= test.shortest]
        # only the runs of benchmark words that are long enough, one after the other, each with a 0 behind it
        base = np.cumsum(length + 1) - (length + 1)
        inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        self.tokens = np.zeros(int((length + 1).sum()) + 1, np.int64)
        where = np.repeat(base, length) + inner
        self.word = np.full(len(self.tokens), -1, np.int64)
        self.word[where] = np.repeat(head, length) + inner
        self.tokens[where] = ids[self.word[where]]
        self.left = np.zeros(len(self.tokens), np.int64)
        self.left[where] = np.repeat(length, length) - inner
        # no search looks further than a window
        array = sorted_suffixes(self.tokens, where, test.window)
        self.array = array[self.left[array] >= test.shortest]

    def _bound(self, test: TestSuffixes, upper: bool) -> np.ndarray:
        """For each group of test suffixes the place in the array before (behind) all suffixes that begin with its window."""
        low, high = np.zeros(len(test.need), np.int64), np.full(len(test.need), len(self.array))
        while len(live := np.flatnonzero(low < high)):
            mid = (low[live] + high[live]) // 2
            mine, theirs, depth = self.array[mid], test.start[test.first[live]].astype(np.int64), test.need[live]
            order, rest, k = np.zeros(len(live), np.int64), np.arange(len(live)), 0
            while len(rest := rest[depth[rest] > k]):
                difference = np.sign(self.tokens[np.minimum(mine[rest] + k, len(self.tokens) - 1)] - test.tokens[theirs[rest] + k])
                order[rest] = difference
                rest = rest[difference == 0]
                k += 1
            right = order <= 0 if upper else order < 0
            low[live[right]] = mid[right] + 1
            high[live[~right]] = mid[~right]
        return low

    def occurrences(self, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
        """(group, place in tokens) of all windows found; a place is there once for each depth."""
        if not len(self.array) or not len(test.start):
            return _NONE, _NONE
        group, mid = _ranges(self._bound(test, False), self._bound(test, True))
        return group, self.array[mid]

    def longest(self, test: TestSuffixes, group: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Words in common with the nearest suffix of the group, for windows of full length; else the window."""
        out = test.need[group].copy()
        full = np.flatnonzero(out == test.window)
        if not len(full):
            return out
        own = Prefixes(self.tokens)
        g, a = group[full], place[full]

        def common(t: np.ndarray, some: np.ndarray) -> np.ndarray:
            b = test.start[t].astype(np.int64)
            return common_words(own, a[some], test.prefixes, b, np.full(len(some), test.window), np.minimum(self.left[a[some]], test.left[t]))

        # where the place would stand among the group's suffixes
        low, high = test.first[g].copy(), test.last[g].copy()
        while len(live := np.flatnonzero((low < high) & (test.last[g] - test.first[g] > 1))):
            mid = (low[live] + high[live]) // 2
            n = common(mid, live)
            mine = self.tokens[a[live] + n]
            theirs = test.tokens[test.start[mid] + n]
            right = theirs < mine
            low[live[right]] = mid[right] + 1
            high[live[~right]] = mid[~right]
        every = np.arange(len(full))
        best = common(np.minimum(low, test.last[g] - 1), every)
        out[full] = np.maximum(best, common(np.maximum(low - 1, test.first[g]), every))
        return out

    def item_at(self, test: TestSuffixes, group: int, place: int, length: int) -> str:
        """The first item of the group that goes on for ``length`` words from ``place``."""
        lo, hi = int(test.first[group]), int(test.last[group])
        mine = self.tokens[place : place + length]

        def order(t: int) -> int:
            b = int(test.start[t])
            theirs = test.tokens[b : b + length]
            n = min(len(theirs), length)
            differ = np.flatnonzero(theirs[:n] != mine[:n])
            return 0 if not len(differ) and n == length else int(np.sign(int(theirs[differ[0]]) - int(mine[differ[0]]))) if len(differ) else -1

        def bound(upper: bool) -> int:
            x, y = lo, hi
            while x < y:
                mid = (x + y) // 2
                if order(mid) < 0 or upper and order(mid) == 0:
                    x = mid + 1
                else:
                    y = mid
            return x

        return test.names[int(test.item[bound(False) : bound(True)].min())]


def scan(columns: list, tests: list[TestSuffixes]) -> dict[str, list]:
    """One row of the report for each text of the columns, which are one shard."""
    read = [TA.words(*TA.utf8(c)) for c in columns]
    hashes = np.concatenate([h for h, _ in read]) if read else np.zeros(0, np.uint64)
    count = np.concatenate([np.diff(f) for _, f in read]) if read else _NONE
    del read
    n, first = len(count), np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    change = np.zeros(len(hashes) + 1, np.int64)
    names: dict[int, set[str]] = {}
    longest, longest_item, longest_at = np.zeros(n, np.int64), [None] * n, [None] * n
    for test in tests:
        if not len(hashes) or not len(test.start):
            continue
        shard = Shard(hashes, first, test)
        group, place = shard.occurrences(test)
        if not len(group):
            continue
        word = shard.word[place]
        doc = np.searchsorted(first, word, "right") - 1
        np.add.at(change, word, 1)
        np.add.at(change, word + test.need[group], -1)
        for pair in TA.unique(doc * len(test.item_sets) + test.items_of[group]).tolist():
            names.setdefault(pair // len(test.item_sets), set()).update(test.names[i] for i in test.item_sets[pair % len(test.item_sets)])
        common = shard.longest(test, group, place)
        best = np.lexsort((word, -common, doc))
        for i in best[np.concatenate([[True], np.diff(doc[best]) > 0])].tolist():
            d, at = int(doc[i]), int(word[i] - first[doc[i]])
            if common[i] > longest[d] or common[i] == longest[d] and at <= longest_at[d]:
                name = shard.item_at(test, int(group[i]), int(place[i]), int(common[i]))
                if common[i] > longest[d] or at < longest_at[d] or _item_order(name) < _item_order(longest_item[d]):
                    longest[d], longest_item[d], longest_at[d] = common[i], name, at
    hit = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    n_hit = hit[first[1:]] - hit[first[:-1]]
    items = [sorted(names.get(d, ()), key=lambda s: s.encode()) for d in range(n)]
    return {
        "n_words": np.diff(first).tolist(),
        "n_hit": n_hit.tolist(),
        "n_items": [len(x) for x in items],
        "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items],
        "contaminated": (n_hit > 0).tolist(),
        "longest_match": longest.tolist(),
        "longest_item": longest_item,
        "longest_at": longest_at,
    }


def _item_order(name: str) -> tuple:
    """Numbers by value, before other ids."""
    return (0, int(name), name) if name.isascii() and name.isdigit() else (1, 0, name)


def _shards(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows with SHARD_BYTES of text, in small record batches."""
    held, size = [], 0
    for batch in batches:
        for part in TA.slices(batch, text):
            held.append(part)
            size += part.column(text).nbytes
            if size >= SHARD_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _tests(benchmark: DataFrame, item: str, text: str, window: int, block_chars: int):
    """Broadcasts of the test suffixes, one for each block of the benchmark."""
    size = benchmark.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    if size > MAX_BENCHMARK_CHARS:
        raise ValueError(f"the benchmark has {size} characters; at most {MAX_BENCHMARK_CHARS} are searched for in one call")
    rows = [(str(r[0]) if r[0] is not None else "", r[1]) for r in benchmark.where(F.col(text).isNotNull()).select(item, text).toLocalIterator()]
    blocks, block, chars = [], [], 0
    for r in rows:
        if block and chars + len(r[1]) > block_chars:
            blocks.append(block)
            block, chars = [], 0
        block.append(r)
        chars += len(r[1])
    if block:
        blocks.append(block)
    return [benchmark.sparkSession.sparkContext.broadcast(TestSuffixes(b, window)) for b in blocks]


def report(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, block_chars: int = 8 << 20) -> DataFrame:
    """For each document: its words, how many lie in a window shared with the benchmark, the items, and its longest verbatim match with its place."""
    tests = _tests(benchmark, item, item_text, window, block_chars)
    mine = docs.select(key, text)
    schema = T.StructType([mine.schema[key], *T._parse_datatype_string(REPORT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = [t.value for t in tests]
        for shard in _shards(batches, text):
            out, at = scan([part.column(text) for part in shard], suffixes), 0
            for part in shard:
                rows = slice(at, at := at + part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(key), *(pa.array(out[f.name][rows], _ARROW[f.dataType.typeName()]) for f in schema.fields[1:])], names=schema.names)

    return mine.mapInArrow(run, schema)


_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, block_chars: int = 8 << 20) -> DataFrame:
    """The documents, all columns as they are, that share no window with the benchmark."""
    tests = _tests(benchmark, item, item_text, window, block_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = [t.value for t in tests]
        for shard in _shards(batches, text):
            bad, at = scan([part.column(text) for part in shard], suffixes)["contaminated"], 0
            for part in shard:
                yield part.filter(pa.array([not x for x in bad[at : at + part.num_rows]], pa.bool_()))
                at += part.num_rows

    return docs.mapInArrow(run, docs.schema)
