"""Token ids of all documents as files: one stream in the order of the keys, coded by a static rANS.

A folder written by ``write`` holds three Parquet tables (so any store of Spark's will do,
and only whole attempts of a task are ever seen):

- ``table``: each id that occurs and its frequency; one table, counted over all documents,
  for all blocks;
- ``blocks``: a row for each block of ``BLOCK`` ids (the last of a shard may be shorter):
  its shard and first id there, the documents in it, and its bytes (``rans``). A block is
  read without any other; from one of its checkpoints on also in part;
- ``shards``: how many ids come before each shard; written last, so without it the
  folder is not whole.

Shards are ranges of the sorted keys. ``documents`` reads all blocks side by side; what a
document has in several blocks comes together by its parts' CRC-32 values, which add up by
exclusive or, so no ids are shuffled. ``ids`` reads a stretch of the stream: other blocks
are left out by the scan, and blocks are entered at the last checkpoint before it.

Defined cases: a null text is an empty one and still is one end id; a null key comes
first; rows with equal keys follow each other by a hash of the text, repeated rows in any
order (all alike); texts of any length are tokenized whole; an added token in a text is
what the library makes of it; an empty table gives no blocks and no rows; extra columns
are ignored. Damaged bytes are an error, never other ids.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rans
from . import textarrays as TA
from .packing import _bytes_of_characters
from .runtime import collect_bounded, materialize

END_ID = 2
BLOCK = 16384
#: Blocks coded side by side in a task.
TOGETHER = 32
#: Bytes of ids that a task has in hand at once, a document at least.
SLICE = 1 << 20


def same_by_bytes(merges: list[tuple[str, str]]) -> bool:
    """Whether a merge core that joins any two neighbours whose bytes are a token makes the same tokens as these merges.

    It does if each token, alone, falls to just the two parts of its merge by the merges
    before it: then no other two neighbours with its bytes can ever come up.
    """
    rank = {pair: r for r, pair in enumerate(merges)}
    for r, (a, b) in enumerate(merges):
        word = a + b
        final = word.endswith("</w>")
        parts = list(word.removesuffix("</w>"))
        parts[-1] += "</w>" * final
        while len(parts) > 2:
            known = [(rank.get(pair, r), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False))]
            least, i = min(known)
            if least >= r:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if parts != [a, b]:
            return False
    return True


def _file(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@cache
def by_bytes(path: str) -> bool:
    """Whether words of this file may go through tiktoken's merge core: see ``same_by_bytes``; ids must also be in the order of merges."""
    model = _file(path)["model"]
    merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
    ids = [model["vocab"].get(a + b) for a, b in merges]
    ends = model.get("end_of_word_suffix") == "</w>" and all(model["vocab"].get(c + "</w>", len(ids)) < (ids or [0])[0] for c in _bytes_of_characters())
    return bool(ids) and ends and None not in ids and ids == sorted(set(ids)) and same_by_bytes(merges)


class WordTokens(dict):
    """Token ids (little-endian, unsigned, of ``width``) of parts of texts between white space, made when first asked for.

    The file is one whose pre-tokenizer drops white space, so a text's ids are those of its
    parts; any other file is run over whole texts. Words of plain Latin letters are
    lower-cased and go to the model's merges at once, without the steps before it, which
    would leave them as they are: by tiktoken's core if ``core`` says that it makes the
    same ids (a space, that no part holds, stands for the end of a word there), else by
    the library. The number of kept parts is bounded; a full cache starts anew.
    """

    #: letters, and signs behind them, which the pre-tokenizer parts from them (but for an apostrophe)
    LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch

    def __init__(self, path: str, width: str = "<u4", core: bool = False, most: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.most, self.width = most, width
        self.code = {"<u2": "H", "<u4": "I"}[width]
        self.tokenizer = Tokenizer.from_file(path)
        whole = _file(path)
        normal = [n["type"] for n in (whole.get("normalizer") or {}).get("normalizers", [])]
        split = (whole.get("pre_tokenizer") or {}).get("pretokenizers", [])
        dropped = bool(split) and split[0].get("type") == "Split" and split[0].get("behavior") == "Removed" and split[0].get("invert") and r"[^\s\p{L}\p{N}]+" in split[0]["pattern"].get("Regex", "")
        #: white space parts words
        self.cut = dropped and normal == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in split[1:]] == ["ByteLevel"] and not split[1].get("add_prefix_space")
        self.added = tuple(t["content"] for t in whole.get("added_tokens", []))
        byte = _bytes_of_characters()
        character = {b: c for c, b in byte.items()}
        self.byte_level = {i: "".join(character[b] for b in chr(i).encode()) for i in range(0xC0, 0x100)}
        self.core = None
        if core and self.cut:
            import tiktoken

            ranks = {bytes(byte[c] for c in token.removesuffix("</w>")) + b" " * token.endswith("</w>"): i for token, i in whole["model"]["vocab"].items()}
            self.core = tiktoken.Encoding("own", pat_str=r"\p{L}+|[^\p{L}]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, low: str) -> bytes:
        if self.core:
            return self._bytes(self.core(f"{low} ".encode()))
        return self._bytes([t.id for t in self.tokenizer.model.tokenize(low.translate(self.byte_level))])

    def __missing__(self, part: str) -> bytes:
        letters = self.LETTERS(part)
        if letters:
            word, mark = letters.groups()
            low = word.lower()
            out = self.get(low)
            if out is None:
                out = self[low] = self._word(low)
            if mark:
                out += self[mark]
        else:
            out = self.whole(part)
        self[part] = out
        return out

    def encode(self, text: str) -> bytes:
        if not self.cut or any(t in text for t in self.added):
            return self.whole(text)
        if len(self) > self.most:
            self.clear()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_CACHES: dict[tuple, WordTokens] = {}


def _words(path: str, width: str, core: bool) -> WordTokens:
    """This worker's cache; it is kept as long as the worker lives."""
    if (path, width, core) not in _CACHES:
        _CACHES[path, width, core] = WordTokens(path, width, core)
    return _CACHES[path, width, core]


def tokens(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, mark, ids) with the end id behind each document's; ids are unsigned 32-bit, little-endian, or 16-bit where all of the file's fit."""
    mine = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))
    schema = T.StructType([mine.schema["key"], *T._parse_datatype_string("mark long, ids binary").fields])
    width, core = _width(tokenizer), by_bytes(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = _words(tokenizer, width, core), np.array([END_ID], width).tobytes()
        for batch in batches:
            for part in TA.slices(batch, "text", 1 << 20):
                ids = [words.encode(t or "") + end for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("mark"), pa.array(ids, pa.binary())], names=schema.names)

    return mine.mapInArrow(run, schema)


@cache
def _width(tokenizer: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def _count(ids: DataFrame, width: str) -> DataFrame:
    """(token_id, n) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in TA.slices(batch, "ids", SLICE):
                data, _ = TA.utf8_binary(part.column("ids"))
                own = np.bincount(np.frombuffer(data.tobytes(), width), minlength=len(total))
                own[: len(total)] += total
                total = own
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["token_id", "n"])

    return ids.select("ids").mapInArrow(run, "token_id int, n long").groupBy("token_id").agg(F.sum("n").alias("n"))


class _Shard:
    """The documents of one task in order, cut into blocks."""

    def __init__(self, number: int, table: rans.Table, keys: pa.DataType, schema: T.StructType):
        self.number, self.table, self.names = number, table, schema.names
        self.ids, self.at = np.zeros(0, np.uint32), 0  # ids not written yet, and where they begin in the shard
        self.keys, self.ends = pa.array([], keys), np.zeros(0, np.int64)
        self.starts, self.seq = np.zeros(0, np.int64), 0  # of the documents that reach into them; the first one's number

    def add(self, keys: pa.Array, ids: np.ndarray, count: np.ndarray) -> None:
        ends = self.at + len(self.ids) + np.cumsum(count)
        self.keys = pa.concat_arrays([self.keys, keys])
        self.starts, self.ends = np.append(self.starts, ends - count), np.append(self.ends, ends)
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])

    def blocks(self, last: bool) -> Iterator[pa.RecordBatch]:
        n = len(self.ids) // BLOCK
        n -= 0 if last else n % TOGETHER
        for a in range(0, n, TOGETHER):
            b = min(a + TOGETHER, n)
            yield self._batch(self.at + a * BLOCK, BLOCK, self.ids[a * BLOCK : b * BLOCK].reshape(b - a, BLOCK))
        rest = self.ids[n * BLOCK :]
        if last and len(rest):
            yield self._batch(self.at + n * BLOCK, len(rest), rest[None])
            n, rest = n + 1, rest[:0]
        self.at += len(self.ids) - len(rest)
        self.ids = rest
        gone = int(np.searchsorted(self.ends, self.at, "right"))
        self.keys, self.starts, self.ends, self.seq = self.keys.slice(gone), self.starts[gone:], self.ends[gone:], self.seq + gone

    def _batch(self, begin: int, n: int, ids: np.ndarray) -> pa.RecordBatch:
        starts = begin + n * np.arange(len(ids))
        first, stop = np.searchsorted(self.ends, starts, "right"), np.searchsorted(self.starts, starts + n, "left")
        inside = np.concatenate([np.arange(a, b) for a, b in zip(first, stop, strict=True)])
        block = np.repeat(np.arange(len(ids)), stop - first)
        lo, hi = np.maximum(self.starts[inside], starts[block]), np.minimum(self.ends[inside], starts[block] + n)
        docs = pa.StructArray.from_arrays([self.keys.take(pa.array(inside)), pa.array(self.seq + inside), pa.array(self.starts[inside]), pa.array(self.ends[inside] - self.starts[inside]), pa.array(lo - starts[block]), pa.array(hi - starts[block])], names=["key", "seq", "doc_start", "n_tokens", "lo", "hi"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(stop - first)]).astype(np.int32)), docs)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), self.number, np.int32)), pa.array(starts), pa.array(np.full(len(ids), n, np.int32)), lists, pa.array(rans.encode(ids, self.table), pa.binary())], names=self.names)


def write(docs: DataFrame, path: str, tokenizer: str, *, key: str = "doc_id", text: str = "text") -> None:
    """The files of all documents' ids in a new folder; ``tokenizer`` is the path of a tokenizers file that every machine has."""
    spark, width = docs.sparkSession, _width(tokenizer)
    known = materialize(tokens(docs, tokenizer, key=key, text=text).withColumn("_n", F.monotonically_increasing_id()), "tokens")
    counted = collect_bounded(_count(known, width), 1 << rans.MAX_BITS - 2, "the ids that occur")
    ids = np.array([r[0] for r in counted], np.int64)
    freq = rans.quantize(np.array([r[1] for r in counted], np.int64)) if counted else ids
    spark.createDataFrame(list(zip(ids.tolist(), freq.tolist(), strict=True)), "token_id int, freq long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast((ids, freq))  # one row for each id of the vocabulary
    fields = T._parse_datatype_string("shard int, start long, n_ids int, docs array<struct<key:long, seq:long, doc_start:long, n_tokens:long, lo:long, hi:long>>, data binary")
    fields["docs"].dataType.elementType["key"].dataType = known.schema["key"].dataType
    order = [F.col("key").asc_nulls_first(), F.col("mark"), F.col("_n")]  # the last one lets any number of repeated rows be dealt to several shards

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            if shard is None:
                shard = _Shard(TaskContext.get().partitionId(), rans.Table(*shared.value), batch.column("key").type, fields)
            for part in TA.slices(batch, "ids", SLICE):
                data, offs = TA.utf8_binary(part.column("ids"))
                flat = np.frombuffer(data.tobytes(), width)
                shard.add(part.column("key"), flat, np.diff(offs) // flat.itemsize)
                yield from shard.blocks(False)
        if shard:
            yield from shard.blocks(True)

    sorted_rows = known.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows.mapInArrow(run, fields).write.parquet(f"{path}/blocks")
    # one row for each task of the sort
    sizes = sorted(spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids")).collect())
    first = accumulate([n for _, n in sizes], initial=0)
    spark.createDataFrame([(s, f, n) for (s, n), f in zip(sizes, first, strict=False)], "shard int, first long, n_ids long").coalesce(1).write.parquet(f"{path}/shards")


def _open(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, object]:
    shards = spark.read.parquet(f"{path}/shards").select("shard", "first")
    rows = collect_bounded(spark.read.parquet(f"{path}/table"), 1 << rans.MAX_BITS - 2, "the table of frequencies")
    table = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)))
    # shards has one row for each task that wrote
    return spark.read.parquet(f"{path}/blocks"), F.broadcast(shards), table


def documents(spark: SparkSession, path: str, *, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document, from the decoded ids."""
    blocks, shards, table = _open(spark, path)
    key_type = blocks.schema["docs"].dataType.elementType["key"]
    schema = T.StructType([blocks.schema["shard"], *T._parse_datatype_string("seq long, doc_start long, n long, crc long").fields, key_type])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or rans.Table(*table.value)
            for a in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(a, TOGETHER)
                docs = part.column("docs")
                flat, block = docs.flatten(), np.repeat(np.arange(part.num_rows), np.diff(docs.offsets.to_numpy()))
                raw = [ids.astype("<u4").tobytes() for ids in rans.decode(part.column("data").to_pylist(), coder)]
                lo, hi, start, n = (flat.field(c).to_numpy() for c in ("lo", "hi", "doc_start", "n_tokens"))
                after = start + n - part.column("start").to_numpy()[block] - hi  # ids of the document in later blocks
                crc = [zlib.crc32(memoryview(raw[b])[4 * i : 4 * j]) for b, i, j in zip(block.tolist(), lo.tolist(), hi.tolist(), strict=True)]
                crc = [rans.crc_shifted(c, 4 * m) if m else c for c, m in zip(crc, after.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("shard").take(pa.array(block)), flat.field("seq"), pa.array(start), pa.array(hi - lo), pa.array(crc, pa.int64()), flat.field("key")], names=schema.names)

    parts = blocks.select("shard", "start", "docs", "data").mapInArrow(run, schema)
    whole = parts.groupBy("shard", "seq").agg(F.first("key").alias(key), F.first("doc_start").alias("doc_start"), F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    return whole.join(shards, "shard").select(key, (F.col("first") + F.col("doc_start")).alias("start"), "n_tokens", "ids_crc32")


def ids(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(start, ids) of the stream from one place up to another, a row for each block that it touches."""
    blocks, shards, table = _open(spark, path)
    some = blocks.select("shard", "start", "n_ids", "data").join(shards, "shard").selectExpr("start + first as start", "n_ids", "data").where((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coder = rans.Table(*table.value)
            for a in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(a, TOGETHER)
                begin, n = part.column("start").to_numpy(), part.column("n_ids").to_numpy().astype(np.int64)
                lo, hi = np.maximum(start - begin, 0), np.minimum(stop - begin, n)
                found = rans.decode(part.column("data").to_pylist(), coder, list(zip(lo.tolist(), hi.tolist(), strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(begin + lo), pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))], names=["start", "ids"])

    return some.mapInArrow(run, "start long, ids array<int>")
