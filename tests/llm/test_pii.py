"""Pseudonyms against a Feistel network written in Python, and their way back."""

from __future__ import annotations

import datetime
import hashlib
import random
import re

from tidemark.llm import pii

KEY = "a key"


def mixed(tag, i, x):
    return int(hashlib.sha256(f"{KEY}|{tag}|{i}|{x}".encode()).hexdigest()[:11], 16)


def network(left, right, a, b, tag):
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = (left + mixed(tag, i, right)) % a
        else:
            right = (right + mixed(tag, i, left)) % b
    return left, right


def refilled(m, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in m)


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d // 10 + d % 10
    return str(-total % 10)


def card(m):
    d = re.sub(r"\D", "", m)
    p = d[:-1]
    if luhn(p) != d[-1]:
        return m
    h = len(p) // 2
    left, right = network(int(p[:h]), int(p[h:]), 10**h, 10 ** (len(p) - h), "card")
    q = f"{left:0{h}d}{right:0{len(p) - h}d}"
    return refilled(m, q + luhn(q))


def phone(m):
    d = re.sub(r"\D", "", m)
    p = d[-10:]
    area, exchange = int(p[:3]), int(p[3:6])
    if area < 200 or exchange < 200:
        code, line = network(area * 1000 + exchange if area < 200 else 200_000 + (area - 200) * 200 + exchange, int(p[6:]), 360_000, 10_000, "phone0")
        area, exchange = divmod(code, 1000) if code < 200_000 else (200 + (code - 200_000) // 200, (code - 200_000) % 200)
        return refilled(m, d[:-10] + f"{area:03d}{exchange:03d}{line:04d}")
    left, right = network((area - 200) * 800 + exchange - 200, int(p[6:]), 640000, 10000, "phone")
    return refilled(m, d[:-10] + f"{200 + left // 800}{200 + left % 800}{right:04d}")


def address(m):
    o = [int(x) for x in m.split(".")]
    if max(o) > 255:
        return m
    left, right = network(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "address")
    return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"


def security(m):
    a, b, c = (int(x) for x in m.split("-"))
    if a in (0, 666) or a >= 900 or b == 0 or c == 0:
        return m
    left, right = network((a - 1 - (a > 666)) * 99 + b - 1, c - 1, 88902, 9999, "security")
    area = left // 99 + 1
    return f"{area + (area >= 666):03d}-{left % 99 + 1:02d}-{right + 1:04d}"


def day(m):
    oldest, first = datetime.date(1, 1, 1), datetime.date(1900, 1, 1)
    x = [int(v) for v in re.split("[-/]", m)]

    def made(y, mo, d):
        try:
            return datetime.date(y, mo, d)
        except ValueError:
            return None

    if "-" in m:
        kind, date, digits = "y", made(*x), (2, 2)
    else:
        digits = tuple(len(v) for v in m.split("/")[:2])
        kind, date = "d", made(x[2], x[1], x[0])
        if date is None:
            kind, date = "M", made(x[2], x[0], x[1])
    if date is None:
        return m
    span, before = pii.DAY_SIDE**2, (first - oldest).days
    n = (date - first).days
    recent = 0 <= n < span
    side, start, n = (pii.DAY_SIDE, first, n) if recent else (pii.ALL_SIDE, oldest, n + before)
    for _ in range(pii.WALK):
        left, right = network(n // side, n % side, side, side, f"day{side}")
        n = left * side + right
        if not recent and (n >= pii.ALL_DAYS or before <= n < before + span):
            continue
        out = start + datetime.timedelta(n)
        one, two = (out.day, out.month) if kind == "d" else (out.month, out.day)
        if kind == "y":
            return out.isoformat()
        if (kind == "d" or out.day > 12) and (digits[0] == 2 or one < 10) and (digits[1] == 2 or two < 10):
            return f"{one:0{digits[0]}d}/{two:0{digits[1]}d}/{out.year:04d}"
    return m


def made_up(r):
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    p = d(r.choice([12, 13, 15, 18]))
    number = p + (luhn(p) if r.random() < 0.8 else d(1))
    date = datetime.date(1, 1, 1) + datetime.timedelta(r.choice([r.randrange(3_652_059), 693_595 + r.randrange(72_900)]))
    one, two = r.choice([(date.day, date.month), (date.month, date.day)])
    return [
        (number, card), (f"{r.randrange(1000):03d}-{r.randrange(1000):03d}-{d(4)}", phone), (f"+1 ({d(3)}) {d(3)}-{d(4)}", phone), (".".join(str(r.randrange(300)) for _ in range(4)), address),
        (f"{d(3)}-{d(2)}-{d(4)}", security), (date.isoformat(), day), (f"{one:02d}/{two:02d}/{date.year:04d}", day), (f"{one}/{two}/{date.year:04d}", day), (f"{r.randrange(40)}/{r.randrange(15)}/{r.randrange(1900, 2100)}", day),
    ]


def test_every_kind_is_the_network_and_comes_back(spark):
    r = random.Random(12)
    values = [x for _ in range(60) for x in made_up(r)]
    df = spark.createDataFrame([(i, f"<{v}>") for i, (v, _) in enumerate(values)], "doc_id long, text string")
    out = pii.pseudonymize(df, KEY)
    got = {row["doc_id"]: row["text"][1:-1] for row in out.collect()}
    wrong = [(v, f(v), got[i]) for i, (v, f) in enumerate(values) if f(v) != got[i]]
    assert not wrong
    back = {row["doc_id"]: row["text"][1:-1] for row in pii.reveal(out, KEY).collect()}
    assert [v for i, (v, _) in enumerate(values) if back[i] != v] == []


def test_month_first_dates_come_back_and_keep_their_digits(spark):
    dates = [f"{m}/{d}/{y}" for m in ("1", "07", "12") for d in (13, 22, 28) for y in (1850, 1999, 2222)] + ["1/2/2020", "01/02/2020", "9/10/1999", "0099-01-01"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(dates)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.pseudonymize(df, KEY).collect()}
    assert all(out[i] != d and re.sub(r"\d", "9", out[i]) == re.sub(r"\d", "9", d) for i, d in enumerate(dates))
    assert all(int(out[i].split("/")[1]) > 12 for i, d in enumerate(dates) if d.count("/") == 2 and int(d.split("/")[1]) > 12)
    back = {r["doc_id"]: r["text"] for r in pii.reveal(pii.pseudonymize(df, KEY), KEY).collect()}
    assert [back[i] for i in range(len(dates))] == dates


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, "call 743-555-3824", 5, 6, 7, "z"), (2, None, 5, 6, 7, "z")], "doc_id long, text string, _new int, _found int, _out int, `a.b` string")
    out = pii.pseudonymize(df, KEY)
    assert out.columns == df.columns and out.schema == df.schema
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[1][2:] == (5, 6, 7, "z") and rows[1]["text"] == "call " + phone("743-555-3824") and rows[2]["text"] is None
    assert sorted(map(tuple, pii.reveal(out, KEY).collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_phones_of_any_code_are_replaced_within_their_class(spark):
    codes = ["+1 (017) 555-5036", "+1 (152) 555-8590", "000-000-0000", "199-999-9999", "200-199-0001", "999-000-1234", "200-200-0000", "999-999-9999", "1 212.155.0100"]
    df = spark.createDataFrame([(i, f"call {c} or {c}") for i, c in enumerate(codes)], "doc_id long, text string")
    report = pii.report(df, KEY).collect()
    assert all((r["n_found"], r["n_replaced"]) == (2, 2) for r in report)
    out = pii.pseudonymize(df, KEY)
    real = lambda c: all(int(x) >= 200 for x in (re.sub(r"\D", "", c)[-10:-7], re.sub(r"\D", "", c)[-7:-4]))
    for r in out.collect():
        one, two = r["text"].removeprefix("call ").split(" or ")
        was = codes[r["doc_id"]]
        assert one == two == phone(was) != was and re.sub(r"\d", "9", one) == re.sub(r"\d", "9", was) and real(one) == real(was)
    assert sorted(map(tuple, pii.reveal(out, KEY).collect())) == sorted(map(tuple, df.collect()))


def test_very_long_texts(spark):
    long = "no number here " * 100_000 + "+1 (017) 555-5036 " + "1" * 200_000 + " a@b.example" + " 4" * 100_000
    got = pii.report(spark.createDataFrame([(1, long)], "doc_id long, text string"), KEY).first()
    assert phone("+1 (017) 555-5036") in got["text"] and "a@b.example" not in got["text"] and len(got["text"]) > 1_700_000
