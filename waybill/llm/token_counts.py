"""Token counts: the exact histogram of encoded lengths, and suffix sums that answer every context limit.

Every whole text is encoded; documents are then aggregated by length, so what is sorted and scanned has one row per
distinct length however many documents there are. Suffix sums go by blocks of lengths: sums of blocks, then within the
block, so no task scans all lengths.

Defined results: a null or empty text has length 0; repeated rows count each; an empty table gives no rows; texts are
encoded whole, special token strings as ordinary text, runs of white space of any length included.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waybill.llm.common import Scratch, table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenisation of this vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 64

#: White space as the pattern's \\s has it.
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Runs of white space from this length are taken out before the pattern sees a text, whose search would go too deep.
LONG_RUN = 2000

_BUILT: dict[bytes, object] = {}
LONG = re.compile(f"{SPACE}{{{LONG_RUN},}}")


def _encoding(data: bytes):
    key = hashlib.sha256(data).digest()
    if key not in _BUILT:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _BUILT[key] = tiktoken.Encoding("waybill", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _BUILT[key]


def count_tokens(enc, text: str, long_run: re.Pattern = LONG) -> int:
    """Tokens of a whole text.

    The pattern makes of a run of white space before another character one piece of all but its last character, which
    goes with what follows, and one piece of the whole run at the end of a text. Long runs are cut out by that rule and
    merged on their own, which gives the same tokens.
    """
    total = at = 0
    for m in long_run.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        total += len(enc.encode_ordinary(text[at : m.start()])) + len(enc._encode_single_piece(text[m.start() : end]))
        at = end
    return total + len(enc.encode_ordinary(text[at:] if at else text))


def lengths(spark: SparkSession, docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id and n_tokens of every document."""
    with open(ranks, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(data.value)
        for batch in batches:
            counts = [count_tokens(enc, x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """One row per distinct length, with what documents at or above it and below it hold.

    n_docs, n_tokens: at this length. docs_at_least, tokens_at_least: from this length up. truncated_total: tokens left
    if every document is cut to this length.
    """
    # written once: the suffix sums read it twice, and the encoding behind it must not run twice
    hist = Scratch(counted.sparkSession).put(counted.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs")))
    hist = hist.withColumns({"n_tokens": F.col("length") * F.col("n_docs"), "block": F.floor(F.col("length") / BLOCK)})
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    # one row per block of lengths: few even for book-long documents
    below, above = (Window.partitionBy(F.lit(0)).orderBy(k).rowsBetween(Window.unboundedPreceding, -1) for k in ("block", F.desc("block")))
    zero = F.lit(0)
    blocks = blocks.select(
        "block", F.coalesce(F.sum("d").over(above), zero).alias("d_above"), F.coalesce(F.sum("t").over(above), zero).alias("t_above"), F.coalesce(F.sum("t").over(below), zero).alias("t_below")
    )
    up = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    return (
        hist.join(blocks, "block")
        .withColumn("docs_at_least", F.sum("n_docs").over(up) + F.col("d_above"))
        .withColumn("tokens_at_least", F.sum("n_tokens").over(up) + F.col("t_above"))
        .withColumn("truncated_total", F.coalesce(F.sum("n_tokens").over(down), zero) + F.col("t_below") + F.col("length") * F.col("docs_at_least"))
        .select("length", "n_docs", "n_tokens", "docs_at_least", "tokens_at_least", "truncated_total")
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """For each limit: total_tokens, truncated_total, docs_cut (documents longer than it) and tokens_over (all their tokens),
    tokens_cut. Exact for any limit."""
    spark = hist.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "limit long")
    over = F.col("length") > F.col("limit")
    return (
        hist.join(F.broadcast(asked))  # a stated, short list of limits
        .groupBy("limit")
        .agg(
            F.sum("n_tokens").alias("total_tokens"),
            F.sum(F.when(over, F.col("limit") * F.col("n_docs")).otherwise(F.col("n_tokens"))).alias("truncated_total"),
            F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias("docs_cut"),
            F.coalesce(F.sum(F.when(over, F.col("n_tokens"))), F.lit(0)).alias("tokens_over"),
        )
        .withColumn("tokens_cut", F.col("total_tokens") - F.col("truncated_total"))
    )


def quantiles(hist: DataFrame, fractions: list[float]) -> DataFrame:
    """Smallest length such that a fraction of the documents is no longer than it: (fraction, length)."""
    spark = hist.sparkSession
    asked = spark.createDataFrame([(float(x),) for x in fractions], "fraction double")
    total = hist.agg(F.sum("n_docs").alias("total"))
    ranked = hist.select("length", (F.col("docs_at_least") - F.col("n_docs")).alias("longer")).join(F.broadcast(total))
    return (
        ranked.join(F.broadcast(asked))
        .where(F.col("total") - F.col("longer") >= F.greatest(F.lit(1), F.ceil(F.col("fraction") * F.col("total"))))
        .groupBy("fraction")
        .agg(F.min("length").alias("length"))
    )


#: Context limits and quantiles that the query answers beside the lengths that occur.
LIMITS, FRACTIONS = tuple(1 << i for i in range(7, 18)), (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)


def answers(hist: DataFrame, limits: Sequence[int] = LIMITS, fractions: Sequence[float] = FRACTIONS) -> DataFrame:
    """The histogram with a row also for limits that no document has as its length, and the quantiles that a length answers."""
    asked = at_limits(hist, list(limits)).join(hist.select(F.col("length").alias("limit")), "limit", "left_anti")
    zero = F.lit(0).cast("long")
    between = asked.select(F.col("limit").alias("length"), zero.alias("n_docs"), zero.alias("n_tokens"), F.col("docs_cut").alias("docs_at_least"), F.col("tokens_over").alias("tokens_at_least"), "truncated_total")
    found = quantiles(hist, list(fractions)).groupBy("length").agg(F.array_sort(F.collect_list("fraction")).alias("quantiles"))
    return hist.unionByName(between).join(found, "length", "left").withColumn("quantiles", F.coalesce("quantiles", F.array().cast("array<double>")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(Scratch(spark).put(histogram(lengths(spark, table(spark, sf_dir, "documents")))))
