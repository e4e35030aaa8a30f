"""URL filters: rules for hosts and paths, and logistic regression where no rule fits.

The model's features are hashed character n-grams of host and path. It is trained by
gradient descent from zero weights on a small labelled table. Such weights stay sums of
the samples' features, so the descent runs on one coefficient for each sample and the
table of their inner products, inside one SQL expression; everything is DataFrame and
SQL functions.

The labelled urls are made up; none is a page of a table that is judged.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule
fits it, and the model judges it; a url of any length is read whole; equal urls get equal
verdicts and repeated rows one each; of several rules that fit, the longest wins (of
equally long ones, the first listed); an empty table gives no rows, an empty labelled
table a model that says 0.5; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import collect_bounded

BUCKETS = 2048
GRAMS = (3, 4)
#: The labelled table may have so many rows; the table of inner products has their square.
MAX_LABELLED = 400
MAX_RULES = 1000
#: All of the model's numbers.
ROUNDS, RATE, DECAY = 150, 1.0, 0.002

LABELLED = {
    "block": """
https://www.casino-royal.example.com/en/1 http://casino-spin.example.net/play https://m.best-casino.example.org/de/7 http://online-casino.example.com/bonus?x=1
https://cheap-meds.example.com/buy http://www.cheap-pills-shop.example.net/en/3 https://pills-direct.example.org/fr/12 http://m.pills24.example.com/order https://www.cheap-viagra.example.org/es/9
http://free-bets-now.example.com/de/5 https://m.bets-live.example.net/odds https://www.sports-bets.example.org/en/40 http://free-bets-club.example.net/fr/8
https://adult-cams.example.com/en/2 http://m.adult-x-videos.example.net/watch https://www.adult-dating.example.org/de/4 http://xxx-adult.example.com/es/11
http://spam-mailer.example.net/send https://www.spam-farm-links.example.org/en/6 http://link-spam.example.com/fr/3 https://link-farm.example.net/de/19
https://ads-server.example.com/click?id=7 http://ads-tracker.example.org/pixel.gif https://track-ads.example.net/en/21 http://www.ads-click.example.org/es/5 https://ads.popup-track.example.com/fr/6
http://www.poker-win.example.com/en/15 https://slots-win.example.org/de/2 http://jackpot-win.example.net/play https://www.win-money.example.org/en/99
https://payday-loans.example.com/apply http://fast-loans.example.net/en/12 https://replica-watches.example.org/fr/1 http://m.hot-singles.example.com/de/13
""",
    "allow": """
https://www.library.example.com/en/1 http://catalogue.library.example.net/search https://m.museum.example.org/de/7 http://history.example.com/archive?x=1
https://weather.example.com/today http://www.garden-notes.example.net/en/3 https://recipes.example.org/fr/12 http://m.kitchen.example.com/order https://www.science-daily.example.org/es/9
http://blog.mountain.example.com/de/5 https://m.sports-news.example.net/scores https://www.cycling.example.org/en/40 http://chess-club.example.net/fr/8
https://university.example.com/en/2 http://m.lectures.example.net/watch https://www.mathematics.example.org/de/4 http://physics.example.com/es/11
http://mail.example.net/help https://www.farm-market.example.org/en/6 http://links.example.com/fr/3 https://village.example.net/de/19
https://roads.example.com/map?id=7 http://trains.example.org/timetable.html https://harbour.example.net/en/21 http://www.theatre.example.org/es/5 https://blog.music.example.com/fr/6
http://www.poetry.example.com/en/15 https://forest.example.org/de/2 http://puzzles.example.net/play https://www.winter.example.org/en/99
https://bank.example.com/apply http://housing.example.net/en/12 https://clocks.example.org/fr/1 http://m.travel.example.com/de/13 https://rivers.example.org/en/31
http://blog.bakery.example.net/en/86 https://m.orchard.example.net/en/25#top http://www.lighthouse.example.com/fr/64?page=2&ref=x https://blog.telescope.example.com/en/18/ http://m.carpentry.example.com/en/47.html
""",
}


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) behind the first ``://`` up to ``/``, ``?``, ``#`` or the end; path from there up to ``?``, ``#`` or the end."""
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, form, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(url, form, 2)


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with name standing for value, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def buckets(host: str, path: str) -> str:
    """SQL for the array of bucket numbers (from 1) of all n-grams, edges marked, host and path told apart.

    A string is split once; an n-gram is put together from its characters, so time grows
    with the length.
    """
    parts = []
    for c, mark in ((host, "h"), (path, "p")):
        grams = []
        for n in GRAMS:
            gram = ", ".join(f"coalesce(get(a, i + {k}), '')" for k in range(n))
            grams.append(f"transform(sequence(0, greatest(size(a) - {n}, 0)), i -> pmod(xxhash64('{mark}', concat({gram})), {BUCKETS}) + 1)")
        parts.append(_let("a", f"regexp_extract_all(concat('^', {c}, '$'), '(?s).', 0)", f"concat({', '.join(grams)})"))
    return f"concat({', '.join(parts)})"


def labelled(spark: SparkSession) -> DataFrame:
    """The small labelled table: (url, bad)."""
    rows = [(url, float(label == "block")) for label, urls in LABELLED.items() for url in urls.split()]
    return spark.createDataFrame(rows, "url string, bad double")


def train(samples: DataFrame) -> list[float]:
    """The weights of BUCKETS buckets and, last, the intercept, from (url, bad)."""
    count = samples.count()
    if count > MAX_LABELLED:
        raise ValueError(f"{count} labelled rows; at most {MAX_LABELLED}")
    host, path = host_and_path(F.col("url"))
    numbered = samples.select("url", "bad", host.alias("host"), path.alias("path")).selectExpr("url", "bad", f"{buckets('host', 'path')} as grams").selectExpr("bad", "grams", "row_number() over (order by url, bad) as i")
    features = numbered.selectExpr("i", "bad", "1 / sqrt(size(grams)) as one", "explode(grams) as bucket").groupBy("i", "bad", "bucket").agg(F.sum("one").alias("x"))
    # every sample has the intercept as one more feature
    features = features.unionByName(numbered.selectExpr("i", "bad", f"{BUCKETS + 1} as bucket", "1D as x"))
    other = features.selectExpr("i as j", "bucket", "x as z")
    products = features.join(other, "bucket").groupBy("i", "bad", "j").agg(F.sum(F.col("x") * F.col("z")).alias("k"))
    rows = products.groupBy("i", "bad").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "k"))), lambda s: s["k"]).alias("row"))
    table = rows.agg(F.array_sort(F.collect_list(F.struct("i", "bad", "row"))).alias("table"))  # one row of MAX_LABELLED squared numbers at most
    step = f"transform(table, (s, n) -> a[n] * (1 - {RATE} * {DECAY}) + {RATE} * (s.bad - 1 / (1 + exp(-aggregate(zip_with(s.row, a, (k, c) -> k * c), 0D, (t, v) -> t + v)))) * 8 / {max(1, count)})"
    fitted = table.selectExpr("table", f"aggregate(sequence(1, {ROUNDS}), transform(table, s -> 0D), (a, r) -> {step}) as a").selectExpr("posexplode(a) as (n, c)").selectExpr("n + 1 as i", "c")
    weights = features.join(fitted, "i").groupBy("bucket").agg(F.sum(F.round(F.col("c") * F.col("x"), 12)).alias("w"))
    found = {int(r[0]): r[1] for r in collect_bounded(weights, BUCKETS + 1, "the weights")} if count else {}
    return [round(found.get(b, 0.0), 9) for b in range(1, BUCKETS + 2)]


def probability(weights: list[float], host: str = "host", path: str = "path") -> Column:
    """That a url is bad."""
    array = f"array({', '.join(f'{w!r}D' for w in weights[:-1])})"
    total = _let("g", buckets(host, path), f"aggregate(g, 0D, (t, b) -> t + element_at({array}, cast(b as int))) / sqrt(size(g))")
    return F.expr(f"1 / (1 + exp(-({total} + {weights[-1]!r}D)))")


def judge(pages: DataFrame, rules: list[Rule], weights: list[float], *, key: str = "page_id", url: str = "url") -> DataFrame:
    """For each page: host, path, the longest rule that fits, the model's probability that it is bad, and the verdict."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES}")
    host, path = host_and_path(F.col(url))
    split = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    ordered = sorted(enumerate(rules), key=lambda x: (-len(x[1].host + x[1].path), x[0]))
    for _, r in reversed(ordered):
        fits = (F.concat(F.lit("."), F.col("host")).endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.host + r.path).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    scored = split.withColumns({"rule": rule, "_ruled": verdict, "bad": F.round(probability(weights), 6)})
    return scored.select(key, "host", "path", "rule", F.coalesce("_ruled", F.when(F.col("bad") >= 0.5, "block").otherwise("allow")).alias("verdict"), "bad")
