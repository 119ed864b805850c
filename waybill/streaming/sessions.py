"""Live frames as a stateful stream on event time: typed state, timers, and state that the watermark removes.

Each frame is first brought down to what can count: per field the strongest value, if it is sure and valid. That is done
in columns, before the stream's state. A session then keeps a clock and counters (one value), its fields (a map) and the
frames that wait. A frame waits until the watermark has passed its time, so frames are taken in the order of their
times however they arrive, and the result is the same as that of the table of all frames: ``live.batch``. Frames that
arrive behind the watermark are dropped by Spark. When the watermark passes a session's last frame by ``idle``, its
state goes; a later frame starts it afresh.

State is kept by the RocksDB store, so it may be larger than memory, and is part of the checkpoint: a restarted query goes
on where it stood.

Defined results: frames without a session or a time are dropped; frames of equal time go by frame_id; repeated frames are
frames; a null ``passed`` counts as not passed, a null ``processing_ms`` as 0; an empty stream gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from waybill.functions.semantics import trim_all
from waybill.functions.text import VALID_PHONE
from waybill.streaming import live

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Whether a field's value is acceptable, as a column; fields without an entry take any.
VALID: dict[str, Callable[[Column], Column]] = {"phone": lambda v: v.rlike(VALID_PHONE)}

_CLOCK = ("last", "busy_until", "frames", "rejected", *live.COUNTERS)
_CLOCK_TYPE = ", ".join(f"{c} bigint" for c in (*_CLOCK, "latest"))
_FIELD_TYPE = "status string, value string, confidence double, support int"
OUT = "session string, frame_id string, captured_ms bigint, decision string, locked bigint, ready boolean, sampled bigint, accepted bigint, fields map<string,struct<status:string,value:string,confidence:double,support:int>>"


def strongest(found: Column, keys: tuple[str, ...], least: int, valid: Callable[[Column], Column] | None) -> Column:
    """struct(value, confidence) of the surest value that isn't blank (the first of equals), if it may be taken; else null."""
    own = F.filter(F.transform(found, lambda f, i: F.struct(f["confidence"].alias("c"), (-i).alias("o"), f.alias("f"))), lambda x: x["f"]["key"].isin(*keys) & (trim_all(F.coalesce(x["f"]["value"], F.lit(""))) != ""))
    # arrays of errors can't be ordered in all cases, so the place is found first
    top = F.array_max(F.transform(own, lambda x: F.struct(x["c"], x["o"])))
    f = F.get(found, -top["o"])
    sure = f["status"].isin("confirmed", "review") & (F.size(F.coalesce(f["errors"], F.array())) == 0) & (f["confidence"] >= least)
    return F.when(sure & (valid(f["value"]) if valid else F.lit(True)), F.struct(f["value"].alias("value"), f["confidence"].alias("confidence")))


def reduced(frames: DataFrame, valid: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Frames with a time stamp and, for each field of a session, its value and confidence."""
    checks = VALID if valid is None else valid
    best = {name: strongest(F.col("found"), keys, least, checks.get(name)) for name, (keys, least, _) in live.FIELDS.items()}
    reset = F.coalesce(F.col("reset"), F.lit(False)) if "reset" in frames.columns else F.lit(False)
    flat = frames.select(
        F.col("session").cast("string"),
        F.col("frame_id").cast("string"),
        F.col("captured_ms").cast("long"),
        F.timestamp_millis("captured_ms").alias("captured"),
        F.coalesce("passed", F.lit(False)).alias("passed"),
        F.coalesce(F.col("processing_ms"), F.lit(0)).cast("long").alias("processing_ms"),
        reset.alias("reset"),
        *[b.alias(name) for name, b in best.items()],
    )
    return flat.where("session is not null and captured_ms is not null").select(
        "session", "frame_id", "captured_ms", "captured", "passed", "processing_ms", "reset", *[F.col(name)[part].alias(f"{name}_{part}") for name in best for part in ("value", "confidence")]
    )


_WAITING = ("frame_id", "captured_ms", "passed", "processing_ms", "reset", *[f"{name}_{part}" for name in live.FIELDS for part in ("value", "confidence")])
_WAITING_TYPE = "frame_id string, captured_ms bigint, passed boolean, processing_ms bigint, reset boolean, " + ", ".join(f"{name}_value string, {name}_confidence double" for name in live.FIELDS)


class Session(StatefulProcessor):
    """Takes the frames of one session in the order of their times."""

    def __init__(self, interval_ms: int, need_quality: bool, idle_ms: int):
        self.interval_ms, self.need_quality, self.idle_ms = interval_ms, need_quality, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", _CLOCK_TYPE)
        self.fields = handle.getMapState("fields", "name string", _FIELD_TYPE)
        self.waiting = handle.getListState("waiting", _WAITING_TYPE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [tuple(r[c] for c in _WAITING) for r in rows]
        if new:
            self.waiting.appendList(new)
            # one timer for all: once the watermark is at the last of them, all are there that can come before it
            self.handle.registerTimer(max(r[1] for r in new))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = [Row(*_WAITING)(*r) for r in self.waiting.get()]
        due = sorted((r for r in waiting if r.captured_ms <= passed), key=lambda r: (r.captured_ms, r.frame_id or ""))
        if due:
            yield from self._take(key[0], due)
            waiting = [r for r in waiting if r.captured_ms > passed]
            self.waiting.put([tuple(r) for r in waiting]) if waiting else self.waiting.clear()
        if not waiting and self.clock.exists():
            # frames may be taken long after their time, so a session can be idle as soon as they are
            until = self.clock.get()[-1] + self.idle_ms
            if until <= passed:
                self.clock.clear()
                self.fields.clear()
            elif due:
                self.handle.registerTimer(until)

    def _take(self, session: str, frames: list[Row]) -> Iterator[Row]:
        state = self._load()
        for f in frames:
            if f.reset:
                state = live.fresh()
                decision = "reset"
            else:
                found = [{"key": keys[0], "value": f[f"{name}_value"], "confidence": f[f"{name}_confidence"], "status": "confirmed", "errors": ()} for name, (keys, *_) in live.FIELDS.items() if f[f"{name}_value"] is not None]
                decision = live.step(state, {"captured_ms": f.captured_ms, "passed": f.passed, "processing_ms": f.processing_ms, "found": found}, self.interval_ms, self.need_quality)
            locked = sum(x["status"] == "locked" for x in state["fields"].values())
            yield Row(
                session=session, frame_id=f.frame_id, captured_ms=f.captured_ms, decision=decision, locked=locked, ready=locked == len(live.FIELDS), sampled=state["sampled"], accepted=state["accepted"],
                fields={name: Row(status=x["status"], value=x["value"], confidence=float(x["confidence"]), support=x["support"]) for name, x in state["fields"].items()},
            )
        for name, x in state["fields"].items():
            self.fields.updateValue((name,), (x["status"], x["value"], float(x["confidence"]), x["support"]))
        self.clock.update((*[state[c] for c in _CLOCK], frames[-1].captured_ms))

    def _load(self) -> dict[str, Any]:
        state = live.fresh()
        if self.clock.exists():
            state |= dict(zip(_CLOCK, self.clock.get(), strict=False))
            for (name,), (status, value, confidence, support) in self.fields.iterator():
                state["fields"][name] = {"status": status, "value": value, "confidence": confidence, "support": support}
        return state


def milliseconds(interval: str) -> int:
    """Of texts such as ``10 minutes``."""
    n, unit = interval.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.rstrip("s")] * 1000


def decide(frames: DataFrame, interval_ms: int = 500, need_quality: bool = True, late: str = "10 seconds", idle: str = "10 minutes") -> DataFrame:
    """Decision, counters and fields after each frame of a stream, once the watermark (the latest time less ``late``) has
    passed it. Sets the session's state store to RocksDB."""
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    timed = reduced(frames).withWatermark("captured", late)
    return timed.groupBy("session").transformWithState(Session(interval_ms, need_quality, milliseconds(idle)), OUT, "append", "eventTime")
