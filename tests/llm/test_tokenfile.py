from __future__ import annotations

import zlib

import numpy as np
import pytest

from tidemark.llm import queries, rans, tokenfile

from .conftest import words


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, tokenfile.END_ID]


@pytest.mark.parametrize("n,symbols", [(1, 1), (31, 5), (32, 2), (33, 2), (rans.CHECKPOINT, 7), (rans.CHECKPOINT + 1, 300), (16384, 40_000), (16384, 1)])
def test_blocks_come_back(n, symbols):
    r = np.random.default_rng(n)
    share = 1 / (np.arange(symbols) + 3.0)
    blocks = r.choice(symbols, size=(3, n), p=share / share.sum()).astype(np.uint32) * 7
    seen, count = np.unique(blocks, return_counts=True)
    table = rans.Table(seen, rans.quantize(count))
    coded = rans.encode(blocks, table)
    mixed = [coded[0], *rans.encode(blocks[1:2, : max(1, n // 3)], table)]
    assert all((a == b).all() for a, b in zip(rans.decode(coded, table), blocks, strict=True))
    whole, part = rans.decode(mixed, table)
    assert (whole == blocks[0]).all() and (part == blocks[1, : max(1, n // 3)]).all()
    (middle,) = rans.decode(coded[:1], table, [(n // 3, n // 2)])
    assert (middle == blocks[0, n // 3 : n // 2]).all()
    if n > 1000:
        entropy = -(count / count.sum() * np.log2(count / count.sum())).sum()
        fixed = (rans.HEADER.size + -(-n // rans.CHECKPOINT) * (4 + 8 * rans.LANES)) * 8
        assert len(coded[0]) * 8 - fixed <= 1.02 * n * entropy + 32 * rans.LANES + 0.02 * n


def test_damage_shows():
    blocks = np.arange(6000, dtype=np.uint32)[None] % 50
    table = rans.Table(*(lambda u, c: (u, rans.quantize(c)))(*np.unique(blocks, return_counts=True)))
    good = rans.encode(blocks, table)[0]
    for at in (0, 20, rans.HEADER.size + 1, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            rans.decode([bytes(bad)], table)
    with pytest.raises(ValueError, match="frequency"):
        rans.encode(blocks + 1, table)


def test_frequencies():
    f = rans.quantize(np.array([1, 10**12, 3, 1]))
    assert f.sum() == 1 << 12 and f.min() == 1
    assert rans.quantize(np.array([5])).tolist() == [1 << 12]


def test_cores():
    """A token that its own bytes cannot become by the merges before its own rules the core out."""
    assert tokenfile.same_by_bytes([("a", "b"), ("ab", "c")]) and not tokenfile.same_by_bytes([("a", "b"), ("b", "c"), ("a", "bc")])


@pytest.mark.parametrize("core", [True, False])
def test_parts_are_the_library_s(path, library, core):
    assert tokenfile.by_bytes(path)
    cache = tokenfile.WordTokens(path, core=core)
    assert cache.cut
    r = np.random.default_rng(5)
    syllables = ["th", "e", "ing", "ö", "ñ", "ei", "qu", "s", "t", "re", "x", "ç", "É", "Sch", "an", "ß", "z"]
    for part in {"".join(r.choice(syllables, r.integers(1, 9))) for _ in range(3000)}:
        assert np.frombuffer(cache.encode(part) + b"\x02\0\0\0", "<u4").tolist() == library(part), part
    texts = ["", " ", "Plain words, and more.", "don't I'll we've 's", "Größe Straße ÉTÉ ÿ Ÿ", "é å ́x", "x y z\tq\r\n w\x1cv", "İstanbul ΣΑΣ ς", "<|endoftext|> tail", "a<|startoftext|>b", "12 345,6 ½ ²", "東京 тест 😀 a", "...!!!", "A" * 5000, words(3, 400), "\n\n a  b \n", "naïve.", "que.%%% wo### a$+<b `x` y~_ z[]{} it's x'##", "fin,", "﻿bom", "ﬁ ligature ǅ"]
    for t in texts:
        assert np.frombuffer(cache.encode(t) + b"\x02\0\0\0", "<u4").tolist() == library(t), t


def brute(rows, library):
    """(key, start, n, crc) of rows in order."""
    out, at = [], 0
    for key, text in rows:
        ids = library(text)
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_against_the_library(spark, small, library):
    docs = queries.table(spark, small, "documents")
    want = brute(sorted(docs.select("doc_id", "text").collect()), library)
    got = queries.op13_rans_token_files(spark, small)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == want


def test_odd_rows(spark, odd, none, path, library, tmp_path):
    target = f"file://{tmp_path}/files"
    long = odd.unionByName(spark.createDataFrame([(99, words(7, 60_000), "xx", 1)], odd.schema))  # over several blocks
    tokenfile.write(long, target, path)
    got = sorted(map(tuple, tokenfile.documents(spark, target).collect()), key=lambda r: r[1])
    rows = [(r.doc_id, r.text) for r in long.collect()]
    assert got[0][0] is None and [r[0] for r in got[1:]] == sorted(k for k, _ in rows if k is not None)
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    plain = lambda found: sorted(((-1 if k is None else k), n, c) for k, _, n, c in found)
    assert plain(got) == plain(brute(rows, library))
    # any stretch of the stream, across blocks and shards
    stream = {r[1]: library(t) for r, t in zip(got, [next(t for k, t in rows if k == r[0] and len(library(t)) == r[2] and zlib.crc32(np.array(library(t), "<u4").tobytes()) == r[3]) for r in got], strict=True)}
    whole = [i for at in sorted(stream) for i in stream[at]]
    for a, b in [(0, 10), (5, 5), (16_380, 16_390), (4095, 40_000), (len(whole) - 3, len(whole) + 100)]:
        read = sorted(map(tuple, tokenfile.ids(spark, target, a, b).collect()))
        assert [i for _, part in read for i in part] == whole[a:b]
    tokenfile.write(none, f"{target}-none", path)
    assert tokenfile.documents(spark, f"{target}-none").count() == 0


def test_repeated_rows_and_names(spark, path, library, tmp_path):
    rows = [("k", "same words here")] * 500 + [("a", "x"), ("z", None)]
    target = f"file://{tmp_path}/files"
    tokenfile.write(spark.createDataFrame(rows, "start string, n_tokens string"), target, path, key="start", text="n_tokens")
    got = tokenfile.documents(spark, target, key="name")
    assert sorted((r["name"], r["n_tokens"], r["ids_crc32"]) for r in got.collect()) == sorted((k, n, c) for k, _, n, c in brute(rows, library))
