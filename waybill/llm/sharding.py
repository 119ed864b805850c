"""Sharding by proportional stratified interleaving: every shard has the mixture of the whole.

Rows of a source are ranked in a seeded shuffle; the rank over the source's rows, plus an offset of the source's own, is
the row's fraction. Sorted by fraction, any stretch of the order holds each source in proportion, one row more or less,
so cuts at equal counts (or equal bytes) give shards that match the mixture.

Both orders go by buckets of a known even spread: hash keys within a source, fractions over all rows. A bucket's start is
a prefix sum over some sqrt(rows) counts, its rows are numbered on their own, and no task sees a whole source or a whole
shard. The offset keeps sources of one row each from meeting at one fraction.

Defined results: a null source is a source of its own and comes last; a null text has no bytes and the checksum 0; rows
that are equal in all columns may change places; ties go by the hash of all columns; an empty table gives no rows;
further columns are kept, whatever their names; columns named shard or slot are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waybill.llm.common import Scratch, free, table
from waybill.llm.mixing import random_key

SHARDS, SEED = 16, 29
LAWS = ("rows", "bytes")


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text plus 1; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def checksum(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes, unsigned."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def offset(source: Column, seed: int) -> Column:
    """A source's place within the step between two of its rows, 0 to below 1."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), source).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def place(
    spark: SparkSession,
    docs: DataFrame,
    shards: int = SHARDS,
    law: str = "rows",
    seed: int = SEED,
    key: Column | None = None,
    size: Column | None = None,
) -> DataFrame:
    """``docs`` with shard (int) and slot (long, gapless from 0 within the shard).

    ``rows``: counts of shards are at most one apart. ``bytes``: a row goes to the shard that its middle byte falls into,
    so sizes are one row apart at most. ``key`` and ``size`` replace what is taken from doc_id and text.
    """
    if law not in LAWS or shards < 1:
        raise ValueError(f"law {law}, {shards} shards")
    scratch = Scratch(spark)
    none, source, k, tie, by, bucket, start, total, rank, part, at, sized, width = (
        free(x, [*docs.columns, "shard", "slot"]) for x in ("_none", "_source", "_key", "_tie", "_bytes", "_bucket", "_start", "_total", "_rank", "_part", "_at", "_sized", "_width")
    )
    n = docs.count()
    buckets = max(1, math.isqrt(n))
    keyed = (
        docs.withColumn(none, F.col("source").isNull())
        .withColumn(source, F.coalesce("source", F.lit("")))
        .withColumn(k, random_key(F.col("doc_id"), F.col("text"), seed) if key is None else key)
        .withColumn(by, size_of(F.col("text")) if size is None else size)
        .withColumn(tie, F.xxhash64(*[F.col(c).cast("string") for c in docs.columns]))
        .withColumn(bucket, F.floor(F.col(k) / 2.0**48 * buckets).cast("long"))
    )
    cell = [none, source, bucket]
    counts = scratch.put(keyed.groupBy(*cell).agg(F.count("*").alias(width)))
    of_source = Window.partitionBy(none, source)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn(start, F.coalesce(F.sum(width).over(before(of_source.orderBy(bucket))), F.lit(0))).withColumn(total, F.sum(width).over(of_source)).drop(width)
    ranked = (
        keyed.join(starts, cell)
        .withColumn(rank, F.col(start) + F.row_number().over(Window.partitionBy(*cell).orderBy(k, "doc_id", tie)) - 1)
        .withColumn(at, (F.col(rank) + offset(F.col(source), seed)) / F.col(total))
        .withColumn(part, F.floor(F.col(at) * buckets).cast("long"))
    )
    # written once: the order is read for its counts and again for the rows
    ranked = scratch.put(ranked.select(*docs.columns, none, source, by, rank, at, part))
    scratch.drop(counts)
    sums = ranked.groupBy(part).agg(F.count("*").alias(width), F.sum(by).alias(sized))
    # sqrt(rows) rows: the only window without a key
    all_before = before(Window.partitionBy(F.lit(0)).orderBy(part))
    sums = scratch.put(sums.select(part, F.coalesce(F.sum(width).over(all_before), F.lit(0)).alias(start), F.coalesce(F.sum(sized).over(all_before), F.lit(0)).alias(sized)))
    order = Window.partitionBy(part).orderBy(at, none, source, rank)
    found = ranked.join(sums, part).withColumn(k, F.col(start) + F.row_number().over(order) - 1)
    if law == "rows":
        shard = F.expr(f"`{k}` * {shards} div {max(n, 1)}")
        return found.withColumn("shard", shard.cast("int")).withColumn("slot", F.expr(f"`{k}` - (shard * {n}L + {shards - 1}) div {shards}")).select(*_kept(docs), "shard", "slot")
    whole = ranked.agg(F.sum(by)).first()[0] or 1
    middle = (F.col(sized) + F.coalesce(F.sum(by).over(before(order)), F.lit(0))) * 2 + F.col(by)
    found = scratch.put(found.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle / (2.0 * whole) * shards)).cast("int")))
    first = found.groupBy("shard").agg(F.min(k).alias(start))
    return found.drop(start).join(F.broadcast(first) if shards <= 100_000 else first, "shard").withColumn("slot", F.col(k) - F.col(start)).select(*_kept(docs), "shard", "slot")


def _kept(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c.lower() not in ("shard", "slot")]


def write(placed: DataFrame, path: str, files: int | None = None) -> None:
    """One folder for each shard, its rows in slot order over files that are ranges of slots: large shards are many tasks."""
    ranged = placed.repartitionByRange(files, "shard", "slot") if files else placed.repartitionByRange("shard", "slot")
    ranged.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    # whole texts give key, size and checksum in the scan; only these are dealt out
    slim = docs.select("doc_id", "source", random_key(F.col("doc_id"), text, SEED).alias("key"), size_of(text).alias("size"), checksum(text).alias("text_crc32"))
    slim = Scratch(spark).put(slim)
    placed = place(spark, slim, key=F.col("key"), size=F.col("size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The checksum is the table-driven CRC-32: entries by the rule of the polynomial, then a fold over the bytes.
SQL = r"""
WITH RECURSIVE crc_step AS (
  SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM crc_step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM crc_step WHERE k = 8),
texts AS (
  SELECT doc_id, source, text, md5(coalesce(text, '')) AS digest,
         CASE WHEN text IS NULL OR text = '' THEN 0
              ELSE xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
                                               lambda a, b: xor(t[xor(a & 255, b) + 1], a >> 8))) END::BIGINT AS text_crc32
  FROM documents, crc),
keyed AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source, text_crc32,
         coalesce(strlen(text), 0)::BIGINT + 1 AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':29:' || digest), 1, 12))::BIGINT AS key
  FROM texts),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY no_source, source ORDER BY key, doc_id NULLS FIRST, size) - 1 AS rnk,
         count(*) OVER (PARTITION BY no_source, source) AS total,
         ('0x' || substr(md5('29:' || source), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS shift
  FROM keyed),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (rnk + shift) / total, no_source, source, rnk) - 1 AS pos, count(*) OVER () AS n FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * 16 // n)::INTEGER AS shard,
       (pos - ((pos * 16 // n) * n + 15) // 16)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""
