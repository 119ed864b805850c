"""Chat formatting: collapse cumulative snapshots of logged conversations, render the maximal ones.

A log often holds a conversation once per turn, each time from its start. Every turn gets a hash of its place, role
and text, and the running exclusive-or of two such 64-bit hashes is the hash of the prefix that ends there. A
conversation whose whole-length hash is an inner prefix hash of another is a snapshot of a longer one: an anti-join on
the distinct inner hashes drops it. Of conversations equal throughout, the smallest conv_id stays. Hashes are made
distinct before the join, so a first turn that a third of all conversations share is one row of it.

Defined results: turns order by (turn, role, text), nulls first; a repeated row is a turn of its own; a null role or
text counts as empty; a turn without a conv_id is a conversation of its own, as nothing ties it to others; an empty
table gives no rows; further columns are ignored. A conversation is one row of the result, so its rendered text has to
fit in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waybill.llm.common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    """A marker inside a text must not read as a turn boundary."""
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("<|im_start |>")), F.lit(CLOSE), F.lit("<|im_end |>"))


def _hashes(place: Column) -> tuple[Column, Column]:
    said = (place, F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return F.xxhash64(F.lit(1), *said), F.xxhash64(F.lit(2), *reversed(said))


def prefixes(turns: DataFrame) -> DataFrame:
    """Turns that have a conv_id, with their place (from 1) and the prefix hashes h1, h2 that end at each."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h1, h2 = _hashes(F.col("place"))
    return (
        turns.where("conv_id is not null").select("conv_id", "turn", "role", "text")
        .withColumn("place", F.row_number().over(order))
        .withColumn("h1", F.bit_xor(h1).over(running))
        .withColumn("h2", F.bit_xor(h2).over(running))
    )


def loose(turns: DataFrame) -> DataFrame:
    """Distinct turns without a conv_id, conversations of one turn: h1, h2, copies and their line. No group gathers them."""
    h1, h2 = _hashes(F.lit(1))
    return turns.where("conv_id is null").select(h1.alias("h1"), h2.alias("h2"), line().alias("line")).groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("line").alias("line"))


def maximal(hashed: DataFrame, alone: DataFrame) -> DataFrame:
    """Conversations that are no prefix of another: conv_id, n_turns, copies (equal conversations it stands for), h1, h2."""
    ends = hashed.groupBy("conv_id").agg(F.max_by(F.struct("place", "h1", "h2"), "place").alias("e")).select("conv_id", "e.*", F.lit(1).cast("long").alias("copies"))
    ends = ends.unionByName(alone.select(F.lit(None).cast(dict(hashed.dtypes)["conv_id"]).alias("conv_id"), F.lit(1).alias("place"), "h1", "h2", "copies"))
    classes = ends.groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.sum("copies").alias("copies"))
    last = Window.partitionBy("conv_id").orderBy(F.desc("place"))
    inner = hashed.withColumn("from_end", F.row_number().over(last)).where("from_end > 1").select("place", "h1", "h2").distinct()
    return classes.join(inner, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"), "copies", "h1", "h2")


def line() -> Column:
    return F.concat(F.lit(OPEN), escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), escaped(F.coalesce("text", F.lit(""))), F.lit(CLOSE))


def render(hashed: DataFrame, alone: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per kept conversation: conv_id, n_turns, copies, chat (its turns as marked text)."""
    named = (
        hashed.join(kept.where("conv_id is not null").drop("h1", "h2"), "conv_id")
        .select("conv_id", "n_turns", "copies", "place", line().alias("line"))
        .groupBy("conv_id", "n_turns", "copies")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("chat"))
    )
    single = kept.where("conv_id is null").join(alone.select("h1", "h2", F.col("line").alias("chat")), ["h1", "h2"])
    return named.unionByName(single.select("conv_id", "n_turns", "copies", "chat"))


def format_chats(turns: DataFrame) -> DataFrame:
    hashed, alone = prefixes(turns), loose(turns)
    return render(hashed, alone, maximal(hashed, alone))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations")).select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), "copies", F.length("chat").cast("long").alias("n_chars"), F.sha2("chat", 256).alias("chat_sha256")
    )


SQL = r"""
WITH placed AS (
  SELECT conv_id, key, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM (SELECT *, coalesce('c' || conv_id, 'r' || row_number() OVER ()) AS key FROM conversations)),
prefixed AS (
  SELECT *, string_agg(length(role) || ':' || role || length(text) || ':' || text, '')
            OVER (PARTITION BY key ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS said,
         count(*) OVER (PARTITION BY key) AS n_turns
  FROM placed),
classes AS (SELECT said, n_turns, min(conv_id) AS conv_id, first(key ORDER BY conv_id NULLS LAST) AS key, count(*) AS copies FROM prefixed WHERE place = n_turns GROUP BY said, n_turns),
kept AS (
  SELECT * FROM classes c WHERE NOT EXISTS (SELECT 1 FROM prefixed p WHERE p.place < p.n_turns AND p.place = c.n_turns AND p.said = c.said)),
chats AS (
  SELECT k.conv_id, k.n_turns::BIGINT AS n_turns, k.copies,
         string_agg('<|im_start|>' || replace(replace(p.role, '<|im_start|>', '<|im_start |>'), '<|im_end|>', '<|im_end |>') || chr(10)
                    || replace(replace(p.text, '<|im_start|>', '<|im_start |>'), '<|im_end|>', '<|im_end |>') || '<|im_end|>', chr(10) ORDER BY p.place) AS chat
  FROM kept k JOIN placed p ON k.key = p.key
  GROUP BY k.key, k.conv_id, k.n_turns, k.copies)
SELECT conv_id, n_turns, copies, length(chat)::BIGINT AS n_chars, sha256(chat) AS chat_sha256 FROM chats
"""
