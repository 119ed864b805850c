"""Regression gates: measures, limits of a file, exit codes."""

from __future__ import annotations

import json

import pytest

from waybill.operators import gates

ROWS = [
    ("good", "a", False, False, 1, 10, True, 900.0, 100.0, 5.0), ("good", "b", False, None, 1, 10, False, 400.0, None, None), ("good", "a", True, False, 3, 10, False, 500.0, 120.0, None), ("good", "b", True, True, 0, 0, None, None, None, None),
    ("bad", "a", False, True, 9, 10, False, 5000.0, 100.0, 5.0),
]
SAID = {"schemaVersion": 1, "notes": ["x"], "level": {"rawText": {"originalImages": {"maxEmptyResultRate": 0, "maxNormalizedCer": 0.1}, "rotationVariants": {"maxEmptyResultRate": 0.5, "maxNormalizedCerRegressionFromOriginal": 0.25}}, "runtime": {"maxWarmLatencyMsPerReceipt": 500, "maxColdLatencyMsPerReceipt": True}}}


@pytest.fixture
def files(spark, tmp_path):
    spark.createDataFrame(ROWS, gates.RUN).write.parquet(str(tmp_path / "runs"))
    (tmp_path / "limits.json").write_text(json.dumps(SAID, indent=1))
    return str(tmp_path / "runs"), str(tmp_path / "limits.json")


def test_measures(spark):
    got = {(r.candidate, r.measure): r.value for r in gates.measures(spark.createDataFrame(ROWS, gates.RUN)).collect()}
    want = {"original_empty_rate": 0.0, "original_cer": 0.1, "rotated_empty_rate": 0.5, "rotated_cer_regression": 0.2, "warm_latency_ms": 500.0, "cold_latency_ms": 900.0, "peak_memory_mb": 120.0, "size_increase_mb": 5.0}
    assert {m: v for (c, m), v in got.items() if c == "good"} == pytest.approx(want)
    assert got["bad", "rotated_empty_rate"] is None and got["bad", "cold_latency_ms"] is None and len(got) == 16


def test_limits_and_exit_codes(spark, files, capsys):
    limits = gates.read_limits(spark, files[1])
    assert {r.measure for r in limits.collect()} == set(list(gates.MEASURES)[:5]) and {r.level for r in limits.collect()} == {"level"}
    judged = gates.judge(gates.measures(spark.read.parquet(files[0])), limits)
    said = {r.candidate: (r.gates, r.passed, r.failed) for r in gates.verdicts(judged).collect()}
    assert said["good"] == (5, True, []) and said["bad"][:2] == (5, False) and "rotated_empty_rate" in said["bad"][2]
    assert gates.main([*files, "good", "level"]) == 0 and "pass  original_cer: 0.1" in capsys.readouterr().out
    assert gates.main([*files, "bad", "level"]) == 1 and gates.main([*files, "good", "other"]) == 1 and gates.main([*files, "none", "level"]) == 1


def test_no_runs(spark):
    assert gates.measures(spark.createDataFrame([], gates.RUN)).count() == 0
