from __future__ import annotations

import random

import pytest

WORDS = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliet", "kilo", "lima", "mike", "november", "oscar", "papa", "quebec", "romeo", "sierra", "tango", "Über", "éclair", "x1", "42"]


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


#: Nulls, empty, long, repeated and equal texts.
ODD = [
    (1, words(1, 60)), (2, words(1, 60)), (2, words(1, 60)), (3, None), (4, ""), (5, "   \n "), (6, "one two"), (7, "one two"), (8, "!!! ??? ..."),
    (9, words(9, 30_000)), (10, "x" * 200_000), (None, words(5, 40)), (11, words(5, 40)), (12, "Größe Ünïcode 東京 тест 😀 a"), (13, words(1, 60) + " tail"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """With extra columns whose names the operators use themselves."""
    rows = [(i, t, "xx", k) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, rep int").withColumnsRenamed({})


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
