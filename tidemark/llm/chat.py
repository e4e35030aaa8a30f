"""Chat formatting after collapsing cumulative snapshots.

Logs often hold a conversation again after every turn. A rolling hash over the turns
gives each prefix of each conversation a value; a conversation whose whole value is a
strict prefix's of a longer one is dropped by an anti-join, and of equal conversations
the one with the smallest id stays. What remains is rendered.

The hash of a prefix is the exclusive or of its turns' hashes, each salted with its
place, in two independent halves (128 bits). Prefix values are running ones within
blocks of ``BLOCK`` turn numbers plus those of the blocks before, so that a conversation
with a large share of all turns is spread over tasks; for the same reason it is rendered
in one part for each block (nearly all conversations have one). No text is shuffled
before it is known which conversations stay. Everything is DataFrame and SQL functions.

Defined cases: turns are ordered by number, then by content; a null turn number comes
first; null roles and texts differ from empty ones in comparisons and are rendered
empty; rows with a null id are one conversation; a repeated row is a repeated turn; of
equal conversations the smallest id stays; texts of any length are rendered whole; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize

BLOCK = 256


def _turns(chats: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    content = [F.col(role), F.col(role).isNull(), F.col(text), F.col(text).isNull()]
    return chats.select(F.struct(F.col(conv)).alias("c"), F.col(turn).alias("turn"), F.coalesce(F.floor(F.col(turn) / BLOCK), F.lit(-1)).alias("block"), F.xxhash64(F.lit(1), *content).alias("h"), F.xxhash64(F.lit(2), *content).alias("g"), F.col(role).alias("role"), F.col(text).alias("text"))


def maximal(chats: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, n_turns, n_copies) of the conversations that stay; c is a struct of the id."""
    turns = _turns(chats, conv, turn, role, text).select("c", "turn", "block", "h", "g")
    sizes = turns.groupBy("c", "block").agg(F.count("*").alias("n"))
    ahead = sizes.select("c", "block", F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("c", "block").orderBy(F.col("turn").asc_nulls_first(), "h", "g")
    placed = turns.withColumn("k", F.row_number().over(inside)).join(ahead, ["c", "block"]).withColumn("k", F.col("k") + F.col("ahead"))
    salted = placed.select("c", "block", "k", F.xxhash64("k", "h").alias("h"), F.xxhash64("k", "g").alias("g"))
    running = Window.partitionBy("c", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    within = salted.select("c", "block", "k", F.bit_xor("h").over(running).alias("h"), F.bit_xor("g").over(running).alias("g"))
    within = materialize(within, "prefixes")
    # the last prefix of each block, carried on to the blocks behind it
    ends = within.groupBy("c", "block").agg(F.max_by(F.struct("h", "g"), "k").alias("e"), F.max("k").alias("k"))
    before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("c", "block", F.coalesce(F.bit_xor("e.h").over(before), F.lit(0)).alias("ch"), F.coalesce(F.bit_xor("e.g").over(before), F.lit(0)).alias("cg"), F.max("k").over(Window.partitionBy("c")).alias("n"))
    prefixes = within.join(carried, ["c", "block"]).select("c", "k", "n", F.col("h").bitwiseXOR(F.col("ch")).alias("h"), F.col("g").bitwiseXOR(F.col("cg")).alias("g"))
    whole = prefixes.where("k = n").groupBy("k", "h", "g").agg(F.min("c").alias("c"), F.count("*").alias("n_copies"))
    strict = prefixes.where("k < n").select("k", "h", "g").distinct()
    return whole.join(strict, ["k", "h", "g"], "left_anti").select("c", F.col("k").cast("long").alias("n_turns"), "n_copies")


def render(chats: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, part, n_turns, n_copies, rendered) of the maximal conversations; parts of one conversation follow each other.

    A turn is written as ``<|role|>``, a line feed, its text, ``<|end|>`` and a line feed;
    a ``<|`` in a text gets a space in between, so that no text can look like a turn.
    """
    stay = materialize(maximal(chats, conv=conv, turn=turn, role=role, text=text), "maximal")
    turns = _turns(chats, conv, turn, role, text).join(stay, "c")
    plain = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("<|"), F.lit("< |"))
    piece = F.concat(F.lit("<|"), plain("role"), F.lit("|>\n"), plain("text"), F.lit("<|end|>\n"))
    parts = turns.groupBy("c", "block", "n_turns", "n_copies").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("there"), F.coalesce("turn", F.lit(0)).alias("turn"), "h", "g", piece.alias("piece")))).alias("list"))
    return parts.select(F.col(f"c.{conv}").alias(conv), F.col("block").cast("long").alias("part"), "n_turns", "n_copies", F.array_join(F.transform("list", lambda s: s["piece"]), "").alias("rendered"))
