"""A training corpus from ``documents``: toxic documents go, one of each group of near copies stays, secrets are masked,
sources are mixed to target weights, and texts become token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the docs of the next.
All but the last return the columns of ``documents``. No stage drops a document for another reason than its own: a null
or empty text passes the filters, and the mix, which is no filter, takes it where its place in the order is taken. Of
repeated rows one stays (they are near copies); of ties in doc_id within a group the smallest text digest stays. An empty
table passes every stage and gives no rows. Further columns go along, whatever their names; the last stage drops the text
and replaces columns named n_tokens or ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm import jaccard_join, mixing, pieces, secret_scan, toxicity
from waybill.llm.common import Scratch, free, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores 0.5 or more go."""
    return toxicity.reject(spark, docs, toxicity.train(spark, docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word shingles, the one with the smallest doc_id stays."""
    return jaccard_join.deduplicate(spark, docs, k=5, at_least=80, of=100)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked where they stand; no document goes. n_chars follows a changed text."""
    before = free("_before", docs.columns)
    clean = secret_scan.redact(secret_scan.scan(docs.withColumn(before, F.col("text")), secret_scan.learn(spark, docs)))
    changed = ~F.col("text").eqNullSafe(F.col(before))
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their targets; a document that is taken twice is two rows."""
    return mixing.mixed(spark, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become ids: doc_id, lang, source, n_chars, n_tokens, ids."""
    # the workers still hold what earlier stages left, so this one remembers little
    out = pieces.encode(spark, docs, cache=60_000)
    return out.withColumn("n_tokens", F.size("ids").cast("long")).select(*[c for c in docs.columns if c not in ("text", "n_tokens", "ids")], "n_tokens", "ids")


STAGES = [("toxicity", toxic), ("near_copies", near_copies), ("secrets", secrets), ("mix", mix), ("tokens", tokens)]

#: A learned model and a tokenizer are no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        done = scratch.put(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = done
    return docs
