"""Places in the order of a whole table, without a task that takes it all."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from waybill.operators import registration


def test_places_of_distinct_values(spark):
    rng = random.Random(4)
    values = [rng.choice([None, "hot", f"v{rng.randint(0, 400):03}"]) for _ in range(3000)]
    got = registration.global_places(spark.createDataFrame([(v, 1) for v in values], "v string, place_of int").repartition(6), "v").collect()
    order = sorted(set(values), key=lambda v: (v is not None, v))
    assert len(got) == len(values) and all(r.place == order.index(r.v) + 1 for r in got)
    assert registration.global_places(spark.createDataFrame([], "v string"), "v").count() == 0


def test_places_by_locale(spark):
    labels = ["van 2", "Van 10", "alpha", "Beta", "gamma", "Delta", "éclair", "eclair", "fig"]
    got = registration.by_locale(spark.createDataFrame([(x,) for x in labels], "label string"), "label").orderBy("place").collect()
    assert [r.label for r in got] == ["alpha", "Beta", "Delta", "eclair", "éclair", "fig", "gamma", "Van 10", "van 2"] and [r.place for r in got] == list(range(1, 10))


def test_no_task_takes_all_values(spark):
    ranked = registration.global_places(spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v")), "v")
    assert ranked.where("place <> v + 1").count() == 0
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    # one row for each range is all that meets in one place
    assert plan.count("SinglePartition") <= 1 and "rangepartitioning" not in plan.lower()
