"""The plans of the secret scan stay small: the driver holds them in every stage of the pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from waybill.llm import secret_scan


def analyzed(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_plans_stay_small(spark):
    seeds = secret_scan.seed_findings(spark, 20, ["shadow", "garden"])
    assert analyzed(seeds).count("Range (") == 1
    assert seeds.count() % 20 == 0 and seeds.where("value is null or label is null").count() == 0
    rows = spark.range(1).select(F.struct(*[F.lit(0.5).alias(x) for x in secret_scan.FEATURES]).alias("f"))
    cached = seeds.localCheckpoint()
    forest, leaves = secret_scan.fit(cached, trees=5), secret_scan.fit(cached.withColumn("label", F.lit(0.0)), trees=2)
    score = rows.select(secret_scan.as_expression(forest)(F.col("f")).alias("score"))
    assert analyzed(score).count("CASE WHEN") == 1
    assert 0 <= score.first().score <= 1
    # trees that are a single leaf
    assert rows.select(secret_scan.as_expression(leaves)(F.col("f")).alias("score")).first().score == 0
