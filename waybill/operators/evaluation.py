"""Offline evaluation: error rates, coverage, provenance of values, grid sweeps, leave-one-out, candidate choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.functions.semantics import composed, trim_all


def strip_unknown(text: Column, token: str = "[불명]") -> Column:
    return F.regexp_replace(F.replace(text, F.lit(token), F.lit("")), r"\[[^\]\n]+\]", "")


def for_errors(text: Column) -> Column:
    """A text without marks of the unreadable, composed, as the error rate has it: lower case, no white space, bars and bullets."""
    return F.regexp_replace(F.lower(text), r"[\s|·•]", "")


def for_coverage(text: Column) -> Column:
    """The same text as token coverage has it: runs of letters and digits."""
    return trim_all(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def score_samples(samples: DataFrame, golden: str = "golden", prediction: str = "prediction") -> DataFrame:
    """Adds empty, golden_chars, distance, cer, coverage of each sample; a missing prediction is an empty one."""
    a, b = F.col("_a"), F.col("_b")
    tokens = F.filter(F.split(for_coverage(a), r"\s+"), lambda t: t != "")
    return (
        samples.withColumns({"_a": composed(strip_unknown(F.col(golden))), "_b": composed(strip_unknown(F.coalesce(F.col(prediction), F.lit(""))))})
        .withColumns({"_g": for_errors(a), "_p": for_errors(b), "_t": tokens, "_c": for_coverage(b)})
        .withColumn("empty", F.col("_p") == "").withColumn("golden_chars", F.length("_g").cast("long")).withColumn("distance", F.levenshtein("_p", "_g").cast("long"))
        .withColumn("cer", F.when(F.col("golden_chars") > 0, F.round(F.col("distance") / F.col("golden_chars"), 4)).otherwise(0.0))
        .withColumn("coverage", F.when(F.size("_t") > 0, F.round(F.size(F.filter("_t", lambda t: F.contains(F.col("_c"), t))) / F.size("_t"), 4)).otherwise(1.0))
        .drop("_a", "_b", "_g", "_p", "_t", "_c")
    )


def summarize(scored: DataFrame, most_cer: float | None = None) -> DataFrame:
    """One row: samples, empty rate, error rate by characters (micro) and by samples (macro), mean coverage, gate."""
    out = scored.agg(
        F.count("*").alias("samples"), F.round(F.avg(F.col("empty").cast("double")), 4).alias("empty_rate"),
        F.coalesce(F.round(F.sum("distance") / F.nullif(F.sum("golden_chars"), F.lit(0)), 4), F.lit(0.0)).alias("cer_micro"), F.round(F.avg("cer"), 4).alias("cer_macro"), F.round(F.avg("coverage"), 4).alias("coverage"),
    )
    return out.withColumn("passed", F.lit(True) if most_cer is None else F.col("cer_micro") <= most_cer)


def first_prediction(*sources: Column) -> Column:
    """Prediction text by precedence of its sources."""
    return F.coalesce(*sources, F.lit(""))


def provenance(value: Column, source: Column, raw: Column) -> Column:
    """Where a value comes from: missing, its source text, the raw text, or nowhere."""
    v = trim_all(F.coalesce(value, F.lit("")))
    return F.when(v == "", "missing").when(F.contains(F.coalesce(source, F.lit("")), v), "sourceText").when(F.contains(F.coalesce(raw, F.lit("")), v), "rawFallback").otherwise("unsupported")


def sweep(results: DataFrame, config: Sequence[str]) -> DataFrame:
    """Totals and score of each configuration over samples (required, populated, hits, confidence)."""
    return results.groupBy(*config).agg(F.sum("required").alias("required"), F.sum("populated").alias("populated"), F.sum("hits").alias("hits"), F.round(F.avg("confidence"), 6).alias("confidence")).withColumn(
        "score", F.round(F.col("required") * 120 + F.col("populated") * 18 + F.col("hits") * 28 + F.col("confidence"), 6)
    )


def leave_one_out(results: DataFrame, config: str = "config", sample: str = "sample", score: str = "score", ord: str = "ord") -> DataFrame:
    """For each sample the configuration that is best without it (earliest among equals) and what it scores on it.

    Training totals are the configuration's total minus the sample's own, instead of a run for each fold. The totals are one
    row for each configuration, summed before they are dealt out, and the best of a sample is a minimum: no task takes all
    samples of a configuration.
    """
    totals = results.groupBy(F.col(config).alias("_config")).agg(F.sum(score).alias("_total"))
    rest = results.join(totals, F.col(config).eqNullSafe(F.col("_config"))).withColumn("_train", F.col("_total") - F.col(score))
    first = F.struct(F.col("_train").isNull().alias("none"), (-F.col("_train")).alias("least"), F.col(ord).alias("ord"), F.col(config).alias("config"), F.col("_train").alias("train"), F.col(score).alias("score"))
    best = rest.groupBy(sample).agg(F.min(first).alias("_b"))
    return best.select(sample, F.col("_b.config").alias("chosen"), F.col("_b.train").alias("train_score"), F.col("_b.score").alias("test_score"))


def fold_stability(folds: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values chosen over the folds for each constant."""
    return folds.agg(*[F.count_distinct(c).alias(c) for c in columns])


def choose(candidates: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The best candidate of each key by staged tie-breaks."""
    w = Window.partitionBy(*key).orderBy(*order)
    return candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def orientation_scores(lines: DataFrame) -> DataFrame:
    """Score of each orientation of an image from lines (image, orientation, text, confidence, region_score), and whether it is good.

    Confidences are summed as decimals: a sum of doubles depends on the order of the rows, and a mean of just 0.45 would be
    good or not by chance.
    """
    exact = lambda c: F.col(c).try_cast("decimal(38,18)")
    mean = lambda c: F.try_divide(F.sum(exact(c)).cast("double"), F.count(exact(c)))
    sure = F.sum(exact("confidence")) >= F.count(exact("confidence")) * F.lit(0.45).cast("decimal(3,2)")
    return (
        lines.groupBy("image", "orientation")
        .agg(F.count("*").alias("lines"), F.sum(F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]+", ""))).alias("chars"), mean("confidence").alias("conf"), mean("region_score").alias("region"), sure.alias("_sure"))
        .withColumn("score", F.col("lines") * 5 + F.col("chars") * 0.8 + F.col("conf") * 12 + F.coalesce("region", F.lit(0.0)) * 4)
        .withColumn("good", (F.col("lines") >= 6) & (F.col("chars") >= 28) & F.col("_sure"))
        .drop("_sure")
    )


def choose_orientation(scores: DataFrame) -> DataFrame:
    """Upright if it is good, else the best of all."""
    upright = F.max((F.col("orientation") == 0) & F.col("good")).over(Window.partitionBy("image"))
    left = scores.withColumn("_u", upright).where(~F.col("_u") | (F.col("orientation") == 0)).drop("_u")
    return choose(left, ["image"], [F.desc("score"), F.desc("lines"), F.desc("chars"), F.col("orientation")])
