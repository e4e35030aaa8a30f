"""All five stages on a small folder, against the brute-force versions of their operators."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tests.llm import test_decontam, test_langid, test_nearjoin, test_secretscan
from tests.llm.conftest import words
from tidemark.llm import secretscan
from tidemark.llm.queries import tokenizer_path

GERMAN = ["haus", "straße", "gehört", "zwischen", "niemals", "wörter", "schrift", "jährlich", "zurück", "möglich"]
PASSAGE = words(50, 30)


def german(seed, n):
    return " ".join(GERMAN[(seed * 7 + i * i + i // 3) % 10] + "xyz"[(seed + i) % 3] for i in range(n))


def rows():
    out = [(i, words(i, 20 + i), "en") for i in range(12)] + [(20 + i, german(i, 25 + i), "de") for i in range(8)]
    out += [(40, words(3, 23), "en"), (41, words(5, 25) + " tail", "en"), (5, words(5, 25), "en"), (42, german(2, 27) + " ende", None)]  # copies, near copies, a repeated row
    out += [(43, None, "en"), (44, "", "de"), (45, "!!! 42", "en"), (None, words(60, 30), "en"), (None, words(60, 30), "en")]
    out += [(46, words(61, 10) + " " + PASSAGE + " " + words(62, 9), "en"), (47, "x " + german(9, 40), "de"), (48, words(63, 3000), "en")]
    out += [(49, words(64, 20) + ' password = "hunter22hunter" ' + words(65, 8), "en"), (50, "AKIA" + "Z" * 20 + " " + german(70, 20), "de"), (51, "q", None)]
    out += [(7, german(31, 22), "de"), (52, "<|endoftext|> " + words(66, 12), "en")]  # a key that another text has
    return out


def folder(path, docs, items):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("kept", pa.string()), ("mark", pa.int32())])
    table = [{"doc_id": i, "text": t, "lang": lang, "source": "s", "n_chars": len(t or ""), "kept": "e", "mark": 1} for i, t, lang in docs]
    pq.write_table(pa.Table.from_pylist(table, schema=schema), path / "documents.parquet")
    pq.write_table(pa.Table.from_pylist([{"item_id": i, "text": t} for i, t in items], schema=pa.schema([("item_id", pa.int64()), ("text", pa.string())])), path / "benchmark.parquet")
    return str(path)


def in_language(docs):
    sums = {}
    for i, t, lang in docs:
        if lang is not None and (i is None or zlib.crc32(str(i).encode()) % 4 != 2):
            sums[lang] = sums.get(lang, 0) + test_langid.unit(test_langid.bundle(t))
    profiles = np.array([test_langid.unit(sums[n]) for n in sorted(sums)])
    centre = profiles.mean(0)
    profiles = np.array([test_langid.unit(p - centre) for p in profiles])
    kept = []
    for row in docs:
        b = test_langid.bundle(row[1])
        if b.any() and (profiles @ test_langid.unit(test_langid.unit(b) - centre)).max() >= corpus_pipeline.LEAST_LANGUAGE_SCORE:
            kept.append(row)
    return kept


def without_copies(docs):
    classes = test_nearjoin.brute([(i, t) for i, t, _ in docs])
    rank = {}
    for i, c, *_ in classes:
        rank.setdefault(i, set()).add(c)
    seen, out = set(), []
    for i, t, lang in docs:
        if i is None or i in rank[i] and (i, t) not in seen:
            out.append((i, t, lang))
        seen.add((i, t))
    return out


def masked(text):
    out, at = [], 0
    for a, b, k in test_secretscan.brute(text):
        if a >= at:
            out += [text[at:a], f"[{secretscan.RULES[k].kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_all_stages_are_brute_force(spark, tmp_path, tokenizer):
    items = [(1, "z " + PASSAGE + " y"), (2, None), (3, "never seen anywhere")]
    docs = rows()
    got = corpus_pipeline.run(spark, folder(tmp_path, docs, items)).collect()
    left = without_copies(in_language(docs))
    bad = {(r[0], r[2] > 0) for r in test_decontam.brute([(i, t) for i, t, _ in left], items)}
    left = [(i, masked(t)) for i, t, _ in left if (i, True) not in bad]
    assert {46} == {i for i, hit in bad if hit} and {i for i, _ in left} >= {0, 7, 20, 48, 49, 50, None} and not {40, 41, 42, 43, 44, 45} & {i for i, _ in left}
    want = []
    for i, t in left:
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr) == sorted(want, key=repr)


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    (tmp_path / "full").mkdir()
    (tmp_path / "empty").mkdir()
    for path, docs in ((folder(tmp_path / "full", rows(), [(1, PASSAGE)]), None), (folder(tmp_path / "empty", [], []), 0)):
        table = spark.read.parquet(f"{path}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, table, path)
            assert after.columns == table.columns, name
            assert docs is None or after.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
