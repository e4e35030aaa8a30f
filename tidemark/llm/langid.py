"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram is the product of its letters'
vectors, each rotated by its place (binding); a text is the sum of its n-grams
(bundling); a language is the sum of its texts, each of unit length. Prototypes have
the mean over the languages taken away, so what all share does not count. A text goes
to the prototype with the largest cosine.

A word's edges count as a letter of their own. Letters are lower-cased. Vectors come
from a letter's code point by a fixed hash, so no alphabet has to be known.

Defined cases: a null text, or one without letters, is ``und`` with score 0; of equally
near languages the first by name is taken; repeated rows get one answer each; an empty
table gives no rows; if no
language could be learned, all are ``und``; texts of any length are read whole; equal
texts get equal answers; rows with a null language teach nothing; extra columns are
kept by ``keep`` and ignored by ``predict``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textarrays as TA
from .runtime import collect_bounded

DIMENSIONS = 512
GRAM = 3
#: Languages that may be learned at most.
MAX_LANGUAGES = 2000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _vectors(points: np.ndarray, place: int, dimensions: int) -> np.ndarray:
    """A row of +1 and -1 for each code point, rotated by its place in the n-gram."""
    words = TA.mix64(points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(dimensions // 64, dtype=np.uint64) + np.uint64(1))
    bits = np.unpackbits(words.view(np.uint8).reshape(len(points), -1), axis=1)
    return np.roll(bits.astype(np.int8) * 2 - 1, place, axis=1)


def _distinct(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values below limit, and each value's place among them; by a table where that is small."""
    if limit <= 1 << 22:
        there = np.zeros(limit, bool)
        there[values] = True
        found = np.flatnonzero(there)
        place = np.zeros(limit, np.int32)
        place[found] = np.arange(len(found), dtype=np.int32)
        return found, place[values]
    found = TA.unique(values)
    return found, np.searchsorted(found, values)


def bundles(texts: list[str | None], dimensions: int = DIMENSIONS, gram: int = GRAM) -> np.ndarray:
    """One vector for each text; zero for a text without letters."""
    out = np.zeros((len(texts), dimensions), np.float32)
    coded = [(t or "").lower().encode("utf-32-le", "surrogatepass") for t in texts]
    points = np.frombuffer(b"".join(coded), "<u4").astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(c) // 4 for c in coded])
    letter = _letters()[np.minimum(points, 0x10FFFF)]
    if not letter.any():
        return out
    # one edge mark before each word and one behind the last of each document
    first = letter & ~(np.concatenate([[False], letter[:-1]]) & np.concatenate([[False], doc[1:] == doc[:-1]]))
    size = letter.astype(np.int64) + first
    ends = np.flatnonzero(letter & ~(np.concatenate([letter[1:], [False]]) & np.concatenate([doc[1:] == doc[:-1], [False]])))
    size[ends] += 1
    to = np.cumsum(size) - size
    symbols = np.zeros(int(size.sum()), np.int64)
    at = np.flatnonzero(letter)
    symbols[to[at] + first[at]] = points[at]
    owner = np.repeat(doc, size)
    # letters get small numbers within this call; n-grams are numbers to that base
    alphabet, number = _distinct(symbols, 0x110000)
    base, n = len(alphabet), len(symbols) - gram + 1
    if n < 1:
        return out
    code = np.zeros(n, np.int64)
    for j in range(gram):
        code = code * base + number[j : j + n]
    edge = np.searchsorted(alphabet, 0)
    whole = owner[:n] == owner[gram - 1 :]
    for j in range(1, gram - 1):  # an n-gram does not reach over a word's edge
        whole &= number[j : j + n] != edge
    code, owner = code[whole], owner[:n][whole]
    grams, column = _distinct(code, base**gram)
    for low in range(0, len(grams), 4096):
        part = grams[low : low + 4096]
        bound = np.ones((len(part), dimensions), np.int8)
        rest = part.copy()
        for j in range(gram - 1, -1, -1):
            bound *= _vectors(alphabet[rest % base], gram - 1 - j, dimensions)
            rest //= base
        mine = slice(None) if len(part) == len(grams) else (column >= low) & (column < low + len(part))
        counts = np.bincount(owner[mine] * len(part) + column[mine] - low, minlength=len(texts) * len(part)).reshape(len(texts), len(part))
        out += counts.astype(np.float32) @ bound.astype(np.float32)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _rows(part: pa.RecordBatch, text: str, step: int = 96) -> Iterator[tuple[int, list]]:
    texts = part.column(text).to_pylist()
    for i in range(0, len(texts), step):
        yield i, texts[i : i + step]


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, list[float]]:
    """A prototype for each language, from all rows of ``docs`` with a language.

    Each task sums its texts' vectors by language; the sums are added up by Spark. The
    driver gets ``dimensions`` numbers for each language.
    """
    mine = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in TA.slices(batch, "text", 1 << 20):
                langs = part.column("lang").to_pylist()
                for i, texts in _rows(part, "text"):
                    unit = _unit(bundles(texts, dimensions))
                    own = np.array(langs[i : i + len(texts)], object)
                    for name in set(own.tolist()):
                        sums[name] = sums.get(name, 0) + unit[own == name].sum(0, dtype=np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "vector"])

    # decimal sums do not depend on the order of addition
    added = mine.mapInArrow(add, "lang string, vector array<double>").select("lang", F.posexplode("vector").alias("place", "value")).groupBy("lang", "place").agg(F.sum(F.col("value").cast("decimal(28,9)")).cast("double").alias("value"))
    rows = added.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("vector"))
    return {r["lang"]: list(r["vector"]) for r in sorted(collect_bounded(rows, MAX_LANGUAGES, "the languages to learn"))}


class Model:
    def __init__(self, prototypes: dict[str, list[float]]):
        self.names = sorted(prototypes)
        profiles = _unit(np.array([prototypes[n] for n in self.names] or np.zeros((0, DIMENSIONS)), np.float64))
        self.centre = profiles.mean(0) if len(self.names) > 1 else np.zeros(profiles.shape[1])
        self.profiles = _unit(profiles - self.centre).astype(np.float32)
        self.centre = self.centre.astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        vectors = bundles(texts, len(self.centre))
        empty = ~vectors.any(axis=1)
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        cosine = _unit(_unit(vectors) - self.centre) @ self.profiles.T
        best = cosine.argmax(axis=1)
        score = np.where(empty, 0.0, np.clip(np.round(cosine[np.arange(len(texts)), best].astype(np.float64), 6), 0, 1))
        return [UNKNOWN if e else self.names[b] for e, b in zip(empty, best, strict=True)], score


def predict(docs: DataFrame, prototypes: dict[str, list[float]], *, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of each document with its language and score, from nothing but its text."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(prototypes))  # MAX_LANGUAGES x DIMENSIONS at most
    # rows come as one struct of what is kept and the text, so that no name can clash
    mine = docs.select(F.struct(*(F.col(c) for c in keep)).alias("kept"), F.col(text).alias("text"))
    schema = T.StructType([*mine.schema["kept"].dataType.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in TA.slices(batch, "text", 1 << 20):
                names, scores = [], []
                for _, texts in _rows(part, "text"):
                    n, s = shared.value.predict(texts)
                    names += n
                    scores += s.tolist()
                yield pa.RecordBatch.from_arrays([*part.column("kept").flatten(), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return mine.mapInArrow(run, schema)


def keep(docs: DataFrame, prototypes: dict[str, list[float]], *, languages: list[str] | None = None, least: float = 0.0, text: str = "text") -> DataFrame:
    """The documents, all columns as they are, in one of ``languages`` (any known one if None) with a score of at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(prototypes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in TA.slices(batch, text, 1 << 20):
                good = []
                for _, texts in _rows(part, text):
                    n, s = shared.value.predict(texts)
                    good += [x != UNKNOWN and (languages is None or x in languages) and y >= least for x, y in zip(n, s.tolist(), strict=True)]
                yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
