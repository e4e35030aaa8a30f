"""Format-preserving pseudonyms for personal numbers and dates.

A number's digits are split in two halves that a keyed Feistel network permutes within
the ranges the format allows; what comes out is a valid number of the same format, and
equal values become equal pseudonyms in all documents. Whoever has the key can turn
them back (``reveal``). Formats:

- payment cards of 13 to 19 digits with a right check digit, which is made anew;
- North American phone numbers: area code and exchange from 200 to 999, any line; and
  numbers so written with other codes, which are no real ones but may stand for one: they
  become such numbers again;
- IPv4 addresses; social security numbers in groups of 3, 2 and 4 that can be assigned;
- dates as year-month-day or day/month/year (read month first only where day first is
  no date). What comes out is written with as many digits, and is read the same way: a
  month-first date becomes one that is no date day first. Dates in the 72,900 days from
  1900-01-01 on become such dates, others (years 1 to 9999) become others.

Where a format's values are not all pairs of two ranges, the network is applied again
until its result is one of them (cycle walking). At least one in five results is, so
``WALK`` steps do not suffice for one date in 10**24; that one would stay.

Other numbers of a right form that are not valid stay as they are. E-mail addresses have no
such format: they become keyed hashes of the address and of its domain, which keeps
equal ones linked but cannot be turned back.

Everything is DataFrame and SQL functions. Expressions are anchored at the start of a
run of word characters and possessive, so time grows with the text's length only.

Defined cases: a null text stays null, an empty one empty; texts are read whole;
repeated rows get equal answers; an empty table gives no rows; a column of another name
is never touched, whatever it is called (helper columns take names that are free).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
PHONE = r"(?<![A-Za-z0-9+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9])"
ADDRESS = r"(?<![A-Za-z0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9]|\.[0-9])"
SECURITY = r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"
DAY = r"(?<![A-Za-z0-9/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![A-Za-z0-9/-])"
CARD = r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])"
#: The kind listed first wins where several begin at a place.
FORMS = (("mail", MAIL), ("address", ADDRESS), ("day", DAY), ("security", SECURITY), ("phone", PHONE), ("card", CARD))
ANY = "|".join(f"(?:{form})" for _, form in FORMS)
FIRST_DAY, DAY_SIDE = "1900-01-01", 270
#: All days of the years 1 to 9999, and a square that holds them.
OLDEST_DAY, ALL_DAYS, ALL_SIDE = "0001-01-01", 3_652_059, 1912
WALK = 256


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with name standing for value, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def feistel(left: str, right: str, a: str, b: str, tag: str, key: str, back: bool = False) -> str:
    """SQL for a struct (l, r): the pair permuted within [0, a) x [0, b)."""
    mixed = lambda x: f"cast(conv(substr(sha2(concat({_quoted(key + '|' + tag + '|')}, i, '|', cast({x} as string)), 256), 1, 11), 16, 10) as bigint)"
    sign = "-" if back else "+"
    step = f"if(i % 2 = 0, named_struct('l', pmod(s.l {sign} {mixed('s.r')}, {a}), 'r', s.r), named_struct('l', s.l, 'r', pmod(s.r {sign} {mixed('s.l')}, {b})))"
    order = f"sequence({ROUNDS - 1}, 0)" if back else f"sequence(0, {ROUNDS - 1})"
    return f"aggregate({order}, named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, i) -> {step})"


def _refilled(m: str, digits: str) -> str:
    """SQL: the characters of m with its digits replaced, one after the other."""
    return f"aggregate(split({m}, ''), named_struct('o', '', 'k', 1), (s, c) -> if(c between '0' and '9', named_struct('o', concat(s.o, substr({digits}, s.k, 1)), 'k', s.k + 1), named_struct('o', concat(s.o, c), 'k', s.k)), s -> s.o)"


def _luhn(digits: str) -> str:
    """SQL: what the digits of a number without its check digit add up to, doubling from the last."""
    return f"aggregate(split(reverse({digits}), ''), named_struct('t', 0L, 'k', 0), (s, c) -> named_struct('t', s.t + if(s.k % 2 = 0, cast(c as bigint) * 2 div 10 + cast(c as bigint) * 2 % 10, cast(c as bigint)), 'k', s.k + 1), s -> s.t)"


def replacement(m: str, key: str, back: bool = False) -> str:
    """SQL: what becomes of one match; itself if it is not valid."""

    def permuted(left, right, a, b, tag):
        return feistel(left, right, a, b, tag, key, back)

    digits = f"regexp_replace({m}, '[^0-9]', '')"
    check = lambda p: f"cast(pmod(10 - {_luhn(p)} % 10, 10) as string)"
    card = _let("d", digits, _let("p", "left(d, length(d) - 1)", f"if({check('p')} = right(d, 1), " + _let(
        "h", "length(p) div 2",
        _let("f", permuted("left(p, h)", "substr(p, h + 1)", "cast(power(10, h) as bigint)", "cast(power(10, length(p) - h) as bigint)", "card"),
             _let("q", "concat(lpad(cast(f.l as string), h, '0'), lpad(cast(f.r as string), length(p) - h, '0'))", _refilled(m, f"concat(q, {check('q')})"))),
    ) + f", {m})"))
    # area and exchange as one number of a class: both from 200 on; else by the area below 200, then by the exchange
    line = lambda area, exchange: _refilled(m, f"concat(left(d, length(d) - 10), lpad(cast({area} as string), 3, '0'), lpad(cast({exchange} as string), 3, '0'), lpad(cast(f.r as string), 4, '0'))")
    known = _let("f", permuted("(a - 200) * 800 + x - 200", "right(d, 4)", "640000", "10000", "phone"), line("200 + f.l div 800", "200 + f.l % 800"))
    other = _let("f", permuted("if(a < 200, a * 1000 + x, 200000 + (a - 200) * 200 + x)", "right(d, 4)", "360000", "10000", "phone0"), f"if(f.l < 200000, {line('f.l div 1000', 'f.l % 1000')}, {line('200 + (f.l - 200000) div 200', '(f.l - 200000) % 200')})")
    phone = _let("d", digits, _let("a", "cast(left(right(d, 10), 3) as bigint)", _let("x", "cast(left(right(d, 7), 3) as bigint)", f"if(a >= 200 and x >= 200, {known}, {other})")))
    address = _let("o", f"transform(split({m}, '[.]'), x -> cast(x as bigint))", f"if(exists(o, x -> x > 255), {m}, " + _let(
        "f", permuted("o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536", "65536", "address"),
        "concat_ws('.', f.l div 256, f.l % 256, f.r div 256, f.r % 256)",
    ) + ")")
    security = _let("n", f"transform(split({m}, '-'), x -> cast(x as bigint))", f"if(n[0] = 0 or n[0] = 666 or n[0] >= 900 or n[1] = 0 or n[2] = 0, {m}, " + _let(
        "f", permuted("(n[0] - 1 - cast(n[0] > 666 as int)) * 99 + n[1] - 1", "n[2] - 1", "88902", "9999", "security"),
        "concat(lpad(cast(f.l div 99 + 1 + cast(f.l div 99 >= 665 as int) as string), 3, '0'), '-', lpad(cast(f.l % 99 + 1 as string), 2, '0'), '-', lpad(cast(f.r + 1 as string), 4, '0'))",
    ) + ")")
    day = _day(m, permuted)
    mail = m if back else f"concat(substr(sha2(concat({_quoted(key + '|mail|')}, lower({m})), 256), 1, 12), '@', substr(sha2(concat({_quoted(key + '|domain|')}, lower(substring_index({m}, '@', -1))), 256), 1, 8), '.invalid')"
    branches = {"mail": mail, "address": address, "day": day, "security": security, "phone": phone, "card": card}
    tests = {
        "mail": f"{m} like '%@%'",
        "address": f"{m} rlike '^([0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}}$'",
        "day": f"{m} like '%/%' or {m} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$'",
        "security": f"{m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$'",
        "phone": f"{m} rlike {_quoted('^(?:[+]?1[ .-]?)?(?:[(][0-9]{3}[)] ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}$')}",
    }
    return "case " + " ".join(f"when {tests[k]} then {branches[k]}" for k, _ in FORMS if k in tests) + f" else {card} end"


def _day(m: str, permuted) -> str:
    """SQL: a date within the dates of its span that are written and read the same way."""
    reading = f"case when {m} like '____-%' then 'yyyy-MM-dd' when try_to_timestamp({m}, 'd/M/yyyy') is not null then 'd/M/yyyy' else 'M/d/yyyy' end"
    # two digits stand for any day or month, one digit for those below ten
    digits = f"if(r like 'y%', array(2, 2), transform(slice(split({m}, '/'), 1, 2), x -> length(x)))"
    written = "case when r like 'y%' then r when r like 'd%' then concat(repeat('d', w[0]), '/', repeat('M', w[1]), '/yyyy') else concat(repeat('M', w[0]), '/', repeat('d', w[1]), '/yyyy') end"

    def walked(start: str, side: int, first: str, inside: str) -> str:
        date = f"date_add(date'{first}', cast(x.n as int))"
        of = _let("d", date, "(r not like 'M%' or day(d) > 12) and (r like 'y%' or (w[if(r like 'd%', 0, 1)] = 2 or day(d) < 10) and (w[if(r like 'd%', 1, 0)] = 2 or month(d) < 10))")
        step = _let("f", permuted(f"x.n div {side}", f"x.n % {side}", str(side), str(side), f"day{side}"), f"f.l * {side} + f.r")
        good = f"case when x.k = 0 then false when not ({inside}) then false else {of} end"
        end = f"aggregate(sequence(1, {WALK}), named_struct('n', cast({start} as bigint), 'k', 0, 'ok', false), (x, i) -> if(x.ok, x, {_let('x', f'named_struct({chr(39)}n{chr(39)}, {step}, {chr(39)}k{chr(39)}, 1)', f'named_struct({chr(39)}n{chr(39)}, x.n, {chr(39)}k{chr(39)}, 1, {chr(39)}ok{chr(39)}, {good})')}))"
        return _let("e", end, f"if(e.ok, date_format(date_add(date'{first}', cast(e.n as int)), {written}), {m})")

    before = f"datediff(date'{FIRST_DAY}', date'{OLDEST_DAY}')"
    span = DAY_SIDE * DAY_SIDE
    recent = walked("n", DAY_SIDE, FIRST_DAY, "true")
    other = walked(f"n + {before}", ALL_SIDE, OLDEST_DAY, f"x.n < {ALL_DAYS} and x.n not between {before} and {before} + {span - 1}")
    valid = f"if(n is null or n < -{before} or n >= {ALL_DAYS} - {before}, {m}, if(n between 0 and {span - 1}, {recent}, {other}))"
    return _let("r", reading, _let("w", digits, _let("n", f"datediff(cast(try_to_timestamp({m}, r) as date), date'{FIRST_DAY}')", valid)))


def _free(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column has."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name in taken:
            name = "_" + name
        out.append(name)
    return out


def _changed(docs: DataFrame, text: str, key: str, back: bool) -> tuple[DataFrame, str, str, str]:
    """With three more columns, whose names come too: the matches before and after, and the text."""
    found, new, out = _free(docs.columns, "_found", "_new", "_out")
    column = _column(text)
    # every form has a digit or an @, which most texts have not
    df = docs.withColumn(found, F.expr(f"case when {column} is null then null when {column} rlike '[0-9@]' then regexp_extract_all({column}, {_quoted(ANY)}, 0) else cast(array() as array<string>) end"))
    df = df.withColumn(new, F.expr(f"transform({found}, m -> {replacement('m', key, back)})"))
    joined = f"array_join(zip_with(split({column}, {_quoted(ANY)}), concat({new}, array('')), (a, b) -> concat(a, b)), '')"
    return df.withColumn(out, F.expr(f"if(size({found}) > 0, {joined}, {column})")), found, new, out


def _column(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _replaced(docs: DataFrame, secret: str, text: str, back: bool) -> DataFrame:
    changed, _, _, out = _changed(docs, text, secret, back)
    return changed.select(*(F.col(out).alias(c) if c == text else F.col(_column(c)) for c in docs.columns))


def pseudonymize(docs: DataFrame, secret: str, *, text: str = "text") -> DataFrame:
    """The documents, all columns as they are, with personal data in the text replaced."""
    return _replaced(docs, secret, text, False)


def reveal(docs: DataFrame, secret: str, *, text: str = "text") -> DataFrame:
    """The way back, for all kinds but e-mail addresses."""
    return _replaced(docs, secret, text, True)


def report(docs: DataFrame, secret: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: its text with pseudonyms, how many places have a personal form and how many were valid and replaced."""
    changed, found, new, out = _changed(docs.select(F.col(key), F.col(text)), text, secret, False)
    size: Column = F.expr(f"size(filter(zip_with({found}, {new}, (a, b) -> a != b), x -> x))")
    return changed.select(key, F.col(out).alias("text"), F.coalesce(F.size(found), F.lit(0)).cast("long").alias("n_found"), F.coalesce(size, F.lit(0)).cast("long").alias("n_replaced"))
