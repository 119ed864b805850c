"""Joins that delivery data needs: first match, best match, containment, interval overlap, nearest by order."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Latest-wins view of a change log: one row per key, the last by ``order``."""
    w = Window.partitionBy(*key).orderBy(*[c.desc() for c in order])
    return log.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def first_rows(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key by ``order``: a deterministic dropDuplicates."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


#: White space as it is left aside in names and texts (fixed value).
SPACE = "[\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: Tables of names up to this length become one expression; longer ones are met by the first characters of a name.
LITERAL_NAMES = 200
KEY = 3
BUCKET_ROWS = 50_000


def first_contained(df: DataFrame, text: Column, names: DataFrame, name: str, value: str, ord: str, literal: int = LITERAL_NAMES) -> DataFrame:
    """Adds (name, value) of the first entry, by ``ord``, whose name is part of ``text``, white space aside.

    The value is that of the first entry with the found name. A short table (a configuration of fees) is one expression of
    plain comparisons, evaluated within the row. A longer one is joined: every place of a distinct text gives its next
    KEY characters, which a name that starts there begins with, so only entries of that beginning are compared and the
    entries are never multiplied by the texts.
    """
    rows = names.select(name, value, ord).orderBy(ord).limit(literal + 1).collect()
    kind = dict(names.dtypes)[value]
    bare = lambda c: F.coalesce(F.regexp_replace(c, SPACE, ""), F.lit(""))
    compact = df.withColumn("_compact", bare(text))
    if len(rows) <= literal:
        first: dict = {}
        for r in rows:
            first.setdefault(r[0], r[1])
        hits = [F.when(F.contains(F.col("_compact"), F.lit(re.sub(SPACE, "", r[0] or ""))), F.lit(i)) for i, r in enumerate(rows)]
        at = F.coalesce(*hits) if hits else F.lit(None).cast("int")
        pick = lambda xs, t: F.get(F.array(*[F.lit(x).cast(t) for x in xs]), F.col("_at")) if xs else F.lit(None).cast(t)
        return compact.withColumn("_at", at).withColumn(name, pick([r[0] for r in rows], "string")).withColumn(value, pick([first[r[0]] for r in rows], kind)).drop("_compact", "_at")
    lead = Window.partitionBy(name).orderBy(ord)
    entries = names.select(name, ord, F.first(value).over(lead).alias(value), bare(F.col(name)).alias("_needle"))
    entries = entries.withColumn("_key", F.substring("_needle", 1, KEY))
    texts = compact.select("_compact").distinct()
    # names shorter than the key have shorter keys, so every place gives all lengths up to it
    places = F.transform(F.sequence(F.lit(1), F.greatest(F.length("_compact"), F.lit(1))), lambda i: F.transform(F.sequence(F.lit(0), F.lit(KEY)), lambda n: F.substring(F.col("_compact"), i, n)))
    met = texts.select("_compact", F.explode(F.array_distinct(F.flatten(places))).alias("_key")).join(entries, "_key").where(F.contains(F.col("_compact"), F.col("_needle")))
    found = met.groupBy("_compact").agg(F.min_by(F.struct(name, value), ord).alias("_hit"))
    return compact.join(found, "_compact", "left").withColumn(name, F.col("_hit")[name]).withColumn(value, F.col("_hit")[value]).drop("_compact", "_hit")


def interval_overlaps(items: DataFrame, start: str, end: str, id: str, width_seconds: int | None = None) -> DataFrame:
    """Ids of intervals that overlap another one (half-open, nulls never, any two rows of the table).

    An interval overlaps an earlier one, by start, if it starts before the running maximum of their ends, and a later one
    if the next start is before its end. Time is cut into buckets, and each bucket is a task's worth of rows in order of
    start. What a bucket needs of those before it is one number, the greatest end, and of those after it one, the least
    start: both come from one row per bucket. No interval is copied into the buckets it spans, and no pairs are made. The
    width follows from the span of the starts and their number, unless given: a bucket has BUCKET_ROWS rows on average. A
    zero-length interval overlaps what it lies strictly within; one that ends before it starts is no interval.
    """
    good = items.where(f"{start} is not null and {end} is not null").select(id, F.unix_seconds(start).alias("_s"), F.unix_seconds(end).alias("_e")).where("_s <= _e")
    if width_seconds is None:
        r = good.agg(F.min("_s").alias("a"), F.max("_s").alias("b"), F.count("*").alias("n")).first()
        width_seconds = max(1, (r.b - r.a) * BUCKET_ROWS // r.n) if r.n else 1
    good = good.withColumn("_b", F.floor(F.col("_s") / width_seconds))
    ends = good.groupBy("_b").agg(F.max("_e").alias("_x"), F.min("_s").alias("_y"))
    # one row per bucket, which stand for BUCKET_ROWS rows each
    all_before, all_after = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("_b", F.desc("_b")))
    ends = ends.select("_b", F.max("_x").over(all_before).alias("_before"), F.min("_y").over(all_after).alias("_after"))
    by = Window.partitionBy("_b").orderBy("_s", "_e", id)
    marked = good.withColumn("_m", F.max("_e").over(by.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_n", F.lead("_s").over(by)).join(ends, "_b")
    return marked.where("_s < _m or _s < _before or _n < _e or _after < _e").select(id).distinct()


def by_all_cores(df: DataFrame, *key: str) -> DataFrame:
    """``df`` dealt by a key over all cores, for work that costs much more than the rows weigh: adaptive execution, which
    goes by bytes, leaves a number that is asked for as it is."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *key)


def top_k(df: DataFrame, key: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("place") <= k)


def score_band(df: DataFrame, key: Sequence[str], score: str, band: float, limit: int, order: Sequence[Column]) -> DataFrame:
    """Rows within ``band`` of the best score of their key, at most ``limit``."""
    best = F.max(score).over(Window.partitionBy(*key))
    return top_k(df.withColumn("_best", best).where(F.col("_best") - F.col(score) <= band).drop("_best"), key, order, limit)
