"""The url model against the same model written with NumPy."""

from __future__ import annotations

import glob
import re
import struct
import time

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import queries, urlfilter

ALPHABET = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(ALPHABET), m[2]) if m else ("", "")


def buckets(host, path):
    out = []
    for part, mark in ((host, "h"), (path, "p")):
        for n in urlfilter.GRAMS:
            whole = f"^{part}$"
            for i in range(max(len(part) - n + 3, 1)):
                h = xxhash.xxh64_intdigest(whole[i : i + n].encode(), xxhash.xxh64_intdigest(mark.encode(), 42))
                out.append(struct.unpack("<q", struct.pack("<Q", h))[0] % urlfilter.BUCKETS)
    return out


def features(url):
    x, b = np.zeros(urlfilter.BUCKETS + 1), buckets(*split(url))
    np.add.at(x, b, 1 / np.sqrt(len(b)))
    x[-1] = 1
    return x


def fitted(rows):
    x, y = np.array([features(u) for u, _ in rows]), np.array([b for _, b in rows])
    w = np.zeros(urlfilter.BUCKETS + 1)
    for _ in range(urlfilter.ROUNDS):
        w = w * (1 - urlfilter.RATE * urlfilter.DECAY) + urlfilter.RATE * x.T @ (y - 1 / (1 + np.exp(-x @ w))) * 8 / len(rows)
    return w


def verdict(host, path, rules):
    fits = [(len(r.host + r.path), -i, r) for i, r in enumerate(rules) if f".{host}".endswith(f".{r.host}") and path.startswith(r.path)]
    return max(fits)[2] if fits else None


URLS = ["http://www.free-casino-bets.example.com/en/1", "HTTPS://WWW.Botany.Example.ORG/fr/x?q#f", None, "", "no scheme", "x://" + "Long" * 5000 + "/" + "p/" * 3000, "x://" + "Long" * 5000 + "/" + "p/" * 3000, "ftp://a.b.example.com/de/", "://net", "http://é.example.net/en/ü"]


def test_weights_and_verdicts_are_numpys(spark):
    rows = [(r["url"], r["bad"]) for r in urlfilter.labelled(spark).collect()]
    weights = urlfilter.train(urlfilter.labelled(spark))
    want = fitted(rows)
    assert np.abs(np.array(weights) - want).max() < 1e-6
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, bad string, verdict string")
    got = {r["page_id"]: r for r in urlfilter.judge(pages, queries.URL_RULES, weights).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = split(u)
        bad, rule = 1 / (1 + np.exp(-features(u) @ want)), verdict(host, path, queries.URL_RULES)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule and rule.host + rule.path)
        assert abs(got[i]["bad"] - bad) < 1e-5
        assert got[i]["verdict"] == (rule.verdict if rule else "block" if bad >= 0.5 else "allow")


def test_no_labelled_url_is_a_page_of_the_tables(spark):
    urls = {u for group in urlfilter.LABELLED.values() for u in group.split()}
    for path in glob.glob("/root/testdata/sf*/pages.parquet"):
        assert not spark.read.parquet(path).where("url is not null").where(F.col("url").isin(sorted(urls))).count()


def test_an_empty_labelled_table_says_half(spark):
    weights = urlfilter.train(spark.createDataFrame([], "url string, bad double"))
    assert set(weights) == {0.0}
    assert urlfilter.judge(spark.createDataFrame([(1, "http://a/b")], "page_id long, url string"), [], weights).first()["bad"] == 0.5


def test_very_long_urls_take_seconds(spark):
    weights = urlfilter.train(urlfilter.labelled(spark))
    urls = ["http://" + "a-b." * 500 + "net/" + "pä/" * 100_000 + "?q", "x" * 300_000, "http://h/" + "😀" * 1000]
    began = time.time()
    got = {r["page_id"]: r for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), queries.URL_RULES, weights).collect()}
    assert time.time() - began < 30
    for i, u in enumerate(urls):
        host, path = split(u)
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        b = np.array(buckets(host, path))
        assert abs(got[i]["bad"] - 1 / (1 + np.exp(-(np.array(weights)[b].sum() / np.sqrt(len(b)) + weights[-1])))) < 2e-6
    assert got[0]["rule"] == "net/"


def test_ties_of_rules_go_to_the_first(spark):
    rules = [urlfilter.Rule("allow", "net", "/ab"), urlfilter.Rule("block", "a.net", "/"), urlfilter.Rule("block", "net", "/ab")]
    pages = spark.createDataFrame([(1, "http://a.net/abc"), (2, "http://a.net/x")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(pages, rules, [0.0] * (urlfilter.BUCKETS + 1)).collect()}
    assert got == {1: ("net/ab", "allow"), 2: ("a.net/", "block")}
