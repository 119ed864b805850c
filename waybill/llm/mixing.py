"""Mixing sources to target weights: hash-random order within each source, distributed prefix sums, exact cuts.

Documents of a source get a hash-random key. The key range is cut into equal buckets, which is a range sort of a
uniform key without sampling; (source, bucket) sums are scanned in key order, so that the prefix of a document is the
sum before its bucket plus the sum before it within the bucket. About sqrt(documents) buckets per source keep both
scans short, also for a source with a third of all rows: no task takes a whole source.

Defined results: a null source is a source of its own and comes last; a null text has size 0; documents of size 0 take
nothing; rows equal in doc_id and text are taken as often as their
number allows, whichever of them; an empty table gives no rows; further columns are ignored by ``mix`` and kept by
``mixed``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waybill.llm.common import Scratch, free, table, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
#: Sources are broadcast up to this many; beyond it they are joined by shuffle.
BROADCAST_SOURCES = 50_000


def random_key(doc_id: Column, text: Column, seed: int) -> Column:
    """48 hash bits of the id and the text as a long: uniform also where ids repeat or are null, and the same on every
    engine that has md5."""
    said = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}:"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 12), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Target of each source: ``sources`` (no_source, source, source_size) is the small table of sources.

    Weights repeat over the sources in code point order, null last. The total is ``share`` of all sizes, and a source
    stops at ``max_epochs`` times its size; what it can't take is shared by weight among the others until none is
    above. Sorted by cap per weight, the stopped sources come first, so prefix sums give the final level at once.
    """
    everything = Window.partitionBy(F.lit(0))
    ordered = sources.withColumn("rank", F.row_number().over(everything.orderBy("no_source", "source")) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * float(max_epochs)
    by_level = everything.orderBy(F.col("cap") / F.col("w"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    leveled = (
        ordered.withColumn("w", w)
        .withColumn("cap", cap)
        .withColumn("goal", F.least(F.sum("source_size").over(everything) * float(share), F.sum("cap").over(everything)))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("goal") - F.col("cap_before")) / F.col("w_left"))
    )
    # the level of the first source that isn't stopped holds for all after it
    level = F.min(F.when(F.col("cap") > F.col("w") * F.col("level"), F.struct("cap_before", "rank", "level"))).over(everything)["level"]
    return leveled.withColumn("final", level).select(
        "no_source", "source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("final"))).alias("target")
    )


def mix(
    spark: SparkSession,
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_epochs: float = MAX_EPOCHS,
    seed: int = 17,
    whole: bool = False,
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies (full epochs), taken (words, repeats counted).

    Each epoch takes a source's documents in key order; the last epoch ends at the exact budget (the target rounded
    down), inside a document unless ``whole``, where a document is taken if its middle lies before the cut.
    """
    return _placed(spark, docs, weights, share, max_epochs, seed, whole).select(
        "doc_id",
        F.when(~F.col("no_source"), F.col("source")).alias("source"),
        "size",
        "source_size",
        "target",
        F.col("epochs").alias("copies"),
        (F.col("epochs") * F.col("size") + F.col("last")).cast("long").alias("taken"),
    )


def _placed(spark: SparkSession, docs: DataFrame, weights: Sequence[float], share: float, max_epochs: float, seed: int, whole: bool) -> DataFrame:
    scratch = Scratch(spark)
    sized = scratch.put(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), random_key(F.col("doc_id"), F.col("text"), seed).alias("key"))
        .withColumn("no_source", F.col("source").isNull())
        .withColumn("source", F.coalesce("source", F.lit("")))
    )
    buckets = max(1, math.isqrt(sized.count()))
    placed = sized.withColumn("bucket", F.floor(F.col("key") / 2.0**48 * buckets).cast("long"))
    sums = scratch.put(placed.groupBy("no_source", "source", "bucket").agg(F.sum("size").alias("bucket_size")))
    plan = targets(sums.groupBy("no_source", "source").agg(F.sum("bucket_size").alias("source_size")), weights, share, max_epochs)
    running = Window.partitionBy("no_source", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("bucket_size").over(running), F.lit(0))).drop("bucket_size").join(plan, ["no_source", "source"])
    within = Window.partitionBy("no_source", "source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - F.col("epochs") * F.col("source_size") - F.col("prefix")
    last = F.when(rest * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0)) if whole else F.greatest(F.lit(0), F.least("size", rest))
    return (
        placed.join(starts, ["no_source", "source", "bucket"])
        .withColumn("prefix", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
        .withColumn("epochs", epochs)
        .withColumn("last", last.cast("long"))
    )


def mixed(
    spark: SparkSession,
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_epochs: float = MAX_EPOCHS,
    seed: int = 17,
) -> DataFrame:
    """``docs`` as the mix has them: whole documents, a row for each time one is taken.

    The last epoch of a source ends at one place of its order, so a row decides for itself by its place: no join on ids,
    and no text is dealt out.
    """
    scratch = Scratch(spark)
    place = F.struct("key", "doc_id", "size")
    placed = scratch.put(_placed(spark, docs, weights, share, max_epochs, seed, whole=True).select("no_source", "source", place.alias("place"), "epochs", (F.col("last") > 0).alias("more")))
    by = ["no_source", "source"]
    cuts = placed.groupBy(*by).agg(F.max("epochs").alias("epochs"), F.max(F.when(F.col("more"), F.col("place"))).alias("cut"))
    # rows equal in id and text have one place; of those at the cut, only some may have the last epoch
    tied = placed.join(cuts.select(*by, "cut"), by).where(F.col("place") == F.col("cut")).groupBy(*by).agg(F.count_if("more").alias("some"), F.count("*").alias("all"))
    cuts = scratch.put(cuts.join(tied, by, "left"))
    scratch.drop(placed)
    none, source, epochs, cut, some, every, at, rank, time = (free(x, docs.columns) for x in ("_none", "_source", "_epochs", "_cut", "_some", "_all", "_at", "_rank", "_time"))
    side = cuts.select(F.col("no_source").alias(none), F.col("source").alias(source), F.col("epochs").alias(epochs), F.col("cut").alias(cut), F.col("some").alias(some), F.col("all").alias(every))
    side = F.broadcast(side) if side.count() <= BROADCAST_SOURCES else side
    keyed = docs.withColumn(at, F.struct(random_key(F.col("doc_id"), F.col("text"), seed).alias("key"), F.col("doc_id"), word_count(F.col("text")).alias("size")))
    met = keyed.join(side, (F.col("source").isNull() == F.col(none)) & (F.coalesce(F.col("source"), F.lit("")) == F.col(source)))
    times = F.col(epochs) + F.when(F.col(at) <= F.col(cut), 1).otherwise(0)
    if not cuts.where(F.col("some") < F.col("all")).isEmpty():
        split = (F.col(at) == F.col(cut)) & (F.col(some) < F.col(every))
        numbered = met.where(split).withColumn(rank, F.row_number().over(Window.partitionBy(none, source).orderBy(F.xxhash64(*[F.col(c).cast("string") for c in docs.columns]))))
        met = met.where(~F.coalesce(split, F.lit(False))).withColumn(rank, F.lit(0)).unionByName(numbered)
        times = F.when(F.col(rank) > F.col(some), F.col(epochs)).otherwise(times)
    return met.withColumn(time, F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':17:' || md5(coalesce(text, ''))), 1, 12))::BIGINT AS key
  FROM documents),
totals AS (SELECT no_source, source, sum(size)::BIGINT AS source_size FROM sized GROUP BY no_source, source),
sources AS (SELECT *, row_number() OVER (ORDER BY no_source, source) - 1 AS rnk FROM totals),
weighed AS (
  SELECT *, CASE rnk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM sources),
leveled AS (
  SELECT *, ((SELECT sum(source_size) FROM weighed)::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / ((SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS level
  FROM weighed),
final AS (SELECT level FROM leveled WHERE cap > w * level ORDER BY cap / w, rnk LIMIT 1),
plan AS (
  SELECT no_source, source, source_size,
         CASE WHEN NOT EXISTS (SELECT 1 FROM final) THEN cap ELSE least(cap, w * (SELECT level FROM final)) END AS target
  FROM leveled),
prefixed AS (
  SELECT s.*, p.source_size, p.target, floor(p.target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY s.no_source, s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prefix
  FROM sized s JOIN plan p ON s.no_source = p.no_source AND s.source = p.source),
cut AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM prefixed)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - prefix)))::BIGINT AS taken
FROM cut
"""
