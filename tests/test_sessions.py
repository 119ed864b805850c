"""Stateful live sessions: the stream gives what the table of all frames gives, goes on after a restart, and forgets."""

from __future__ import annotations

import random


from waybill.streaming import live, sessions

FRAME = "session string, frame_id string, captured_ms long, passed boolean, processing_ms long, reset boolean, found array<struct<key:string,value:string,confidence:double,status:string,errors:array<string>>>"
START = 1_700_000_000_000


def frames_of(seed, session, n, start=START, step=400):
    rng = random.Random(seed)
    out, at = [], start
    for i in range(n):
        at += rng.randint(0, 2 * step)
        found = [(k, rng.choice(v), float(rng.randint(70, 99)), rng.choice(("confirmed", "review", "warning")), rng.choice(([], [], ["bad"]))) for k, v in (("venueName", "AB"), ("orderingVendorName", " A"), ("deliveryAddress", ("x 1", "X-1")), ("recipientTel", ("010-1234-5678", "12")))]
        out.append((session, f"{i:03}", at, rng.random() > 0.2, rng.choice((0, 10, 900, None)), rng.random() < 0.03, found))
    return out


def put(spark, rows, path):
    spark.createDataFrame(rows, FRAME).coalesce(1).write.mode("append").parquet(path)


def run(spark, folder, **how):
    frames = spark.readStream.schema(FRAME).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = sessions.decide(frames, **how).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return sorted((r.session, r.captured_ms, r.frame_id, r.decision, r.locked, r.ready) for r in spark.read.parquet(f"{folder}/out").collect()), q.recentProgress


def want(spark, rows):
    return sorted((r.session, r.captured_ms, r.frame_id, r.decision, r.locked, r.ready) for r in live.batch(spark.createDataFrame(rows, FRAME)).collect())


def test_stream_is_the_batch_in_any_order_and_after_a_restart(spark, tmp_path):
    rows = [r for s in range(4) for r in frames_of(s, f"s{s}", 40)]
    rows.sort(key=lambda r: r[2])
    odd = [(None, "x", START, True, 1, False, []), ("s0", "y", None, True, 1, False, []), ("s0", "z", START, None, None, None, None)]
    first, second = rows[:80], rows[80:]
    random.Random(1).shuffle(first)
    put(spark, first[:40] + odd, str(tmp_path / "in"))
    put(spark, first[40:], str(tmp_path / "in"))
    one, _ = run(spark, str(tmp_path), late="1 hours", idle="10 days")
    assert one == []  # nothing is behind the watermark yet
    # a new query on the same checkpoint: what waits and what is known is still there
    put(spark, second, str(tmp_path / "in"))
    put(spark, [("end", "e", START + 10 * 86_400_000, True, 0, False, [])], str(tmp_path / "in"))
    two, _ = run(spark, str(tmp_path), late="1 hours", idle="10 days")
    assert two == want(spark, rows + [odd[2]])
    assert {"ready", "accepted", "skipped-interval", "skipped-busy", "rejected-quality", "reset"} >= {r[3] for r in two} >= {"accepted", "skipped-interval", "rejected-quality"}


def test_watermark_removes_idle_sessions(spark, tmp_path):
    for i in range(3):
        put(spark, frames_of(i, f"s{i}", 5, START + i * 3_600_000), str(tmp_path / "in"))
    put(spark, [("end", "e", START + 9 * 3_600_000, True, 0, False, [])], str(tmp_path / "in"))
    got, progress = run(spark, str(tmp_path), late="1 seconds", idle="5 minutes")
    assert {r[0] for r in got} >= {"s0", "s1", "s2"}
    state = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "clock").load()
    assert {r.key.session for r in state.select("key").collect()} <= {"end"}
    # a session that comes back starts afresh
    put(spark, frames_of(0, "s0", 5, START + 10 * 3_600_000), str(tmp_path / "in"))
    put(spark, [("end", "f", START + 19 * 3_600_000, True, 0, False, [])], str(tmp_path / "in"))
    again, _ = run(spark, str(tmp_path), late="1 seconds", idle="5 minutes")
    assert [r[2:] for r in again if r[0] == "s0" and r[1] > START + 9 * 3_600_000] == [r[2:] for r in want(spark, frames_of(0, "s0", 5, START + 10 * 3_600_000))]


def test_reduced_frames_keep_what_counts(spark):
    rows = frames_of(7, "s", 60)
    for r in sessions.reduced(spark.createDataFrame(rows, FRAME)).collect():
        found = [dict(zip(("key", "value", "confidence", "status", "errors"), x, strict=True)) for x in rows[int(r.frame_id)][6]]
        fields = live.fresh()["fields"]
        live.update(fields, found)
        assert {n: (x["value"], x["confidence"]) for n, x in fields.items() if x["value"]} == {n: (r[f"{n}_value"], r[f"{n}_confidence"]) for n in live.FIELDS if r[f"{n}_value"] is not None}
    assert sessions.reduced(spark.createDataFrame([], FRAME)).count() == 0 and sessions.milliseconds("2 hours") == 7_200_000
