"""Regression gates: what a candidate measures on a data set against the limits of a level, and an exit code for builds.

A run table has a row for each sample and variant of a candidate. It is brought down to one row of measures per candidate,
which meets the limits, a table of (level, measure, most), by equality of the measure's name.

Defined results: a measure that was never taken passes no gate; a candidate without runs has no rows; a level without
limits has nothing to pass and fails; null flags count as false, null times and sizes as not taken.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Measure and its place in a file of limits: the names of the levels are the file's own.
MEASURES = {
    "original_empty_rate": ("rawText", "originalImages", "maxEmptyResultRate"),
    "original_cer": ("rawText", "originalImages", "maxNormalizedCer"),
    "rotated_empty_rate": ("rawText", "rotationVariants", "maxEmptyResultRate"),
    "rotated_cer_regression": ("rawText", "rotationVariants", "maxNormalizedCerRegressionFromOriginal"),
    "warm_latency_ms": ("runtime", "maxWarmLatencyMsPerReceipt"),
    "cold_latency_ms": ("runtime", "maxColdLatencyMsPerReceipt"),
    "peak_memory_mb": ("runtime", "maxPeakMemoryMb"),
    "size_increase_mb": ("runtime", "maxAppSizeIncreaseMb"),
}
RUN = "candidate string, sample string, rotated boolean, empty boolean, distance long, golden_chars long, cold boolean, latency_ms double, memory_mb double, size_increase_mb double"


def measures(runs: DataFrame, by: Sequence[str] = ("candidate",)) -> DataFrame:
    """candidate, measure, value: rates and character error rates (micro) of upright and rotated samples, how much worse
    rotation makes them, the slowest warm and cold sample, the largest memory and size."""
    rotated, cold = F.coalesce("rotated", F.lit(False)), F.coalesce("cold", F.lit(False))
    rate = lambda of: F.avg(F.when(of, F.coalesce(F.col("empty"), F.lit(False)).cast("double")))
    cer = lambda of: F.sum(F.when(of, F.col("distance"))) / F.nullif(F.sum(F.when(of, F.col("golden_chars"))), F.lit(0))
    values: dict[str, Column] = {
        "original_empty_rate": rate(~rotated),
        "original_cer": cer(~rotated),
        "rotated_empty_rate": rate(rotated),
        "rotated_cer_regression": cer(rotated) - cer(~rotated),
        "warm_latency_ms": F.max(F.when(~cold, F.col("latency_ms"))),
        "cold_latency_ms": F.max(F.when(cold, F.col("latency_ms"))),
        "peak_memory_mb": F.max("memory_mb"),
        "size_increase_mb": F.max("size_increase_mb"),
    }
    one = runs.groupBy(*by).agg(*[v.cast("double").alias(k) for k, v in values.items()])
    return one.unpivot(list(by), list(values), "measure", "value")


def read_limits(spark: SparkSession, path: str) -> DataFrame:
    """level, measure, most of a JSON file of limits; parts of it that hold none of the measures are passed over."""
    # configuration of a few dozen numbers
    said = json.loads("\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect()))
    rows = []
    for level, parts in said.items():
        for measure, place in MEASURES.items():
            at = parts
            for name in place:
                at = at.get(name) if isinstance(at, dict) else None
            if isinstance(at, (int, float)) and not isinstance(at, bool):
                rows.append((level, measure, float(at)))
    return spark.createDataFrame(rows, "level string, measure string, most double")


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """candidate, level, measure, value, most, passed: every limit for every candidate; Catalyst sizes the short table."""
    met = measured.join(limits, "measure")
    return met.withColumn("passed", F.coalesce(F.col("value") <= F.col("most"), F.lit(False)))


def verdicts(judged: DataFrame, by: Sequence[str] = ("candidate",)) -> DataFrame:
    """Per candidate and level: number of gates, whether all passed, and the measures that did not, by name."""
    failed = F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("measure"))))
    return judged.groupBy(*by, "level").agg(F.count("*").alias("gates"), F.bool_and("passed").alias("passed"), failed.alias("failed"))


def exit_code(judged: DataFrame, candidate: str, level: str) -> int:
    """0 if the candidate passes all gates of the level, 1 if it fails one, or if there is none to pass."""
    row = verdicts(judged.where((F.col("candidate") == candidate) & (F.col("level") == level))).first()
    return 0 if row and row.passed else 1


def main(arguments: Sequence[str]) -> int:
    """``RUNS.parquet LIMITS.json CANDIDATE LEVEL``: prints the gates, returns the exit code."""
    runs, limits, candidate, level = arguments
    spark = SparkSession.builder.getOrCreate()
    judged = judge(measures(spark.read.parquet(runs)), read_limits(spark, limits))
    for r in judged.where((F.col("candidate") == candidate) & (F.col("level") == level)).orderBy("measure").collect():
        print(f"{'pass' if r.passed else 'FAIL'}  {r.measure}: {r.value} (most {r.most})")
    return exit_code(judged, candidate, level)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
