"""Live frames: a session locks its fields once two frames agree. One step function serves batch and stream.

Frames of a session come in the order of (captured_ms, frame_id). A frame is dropped while the sampling interval since the
last sampled one runs (so is a late one, whose gap is negative) or while the recogniser is busy, which is modelled by the
processing time of the frame before; a sampled frame that fails the quality gate has used up its interval. A frame whose
optional column ``reset`` is true is none: the session starts afresh.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.functions.text import VALID_PHONE

PHONE = re.compile(VALID_PHONE)
#: field -> (keys, least confidence, validation)
FIELDS: dict[str, tuple[tuple[str, ...], int, Callable[[str], bool] | None]] = {
    "merchant": (("orderingVendorName", "venueName"), 85, None),
    "address": (("deliveryAddress",), 80, None),
    "phone": (("orderingVendorTel", "fulfillingVendorTel", "recipientTel"), 80, lambda v: bool(PHONE.match(v))),
}
SUPPORT = 2
COUNTERS = ("sampled", "skipped_interval", "skipped_busy", "rejected_quality", "runs", "accepted", "promoted", "last_ms")
OUT = "session string, frame_id string, captured_ms long, decision string, locked long, ready boolean, state string"


def fresh() -> dict[str, Any]:
    return {"fields": {k: {"status": "missing", "value": "", "confidence": 0.0, "support": 0} for k in FIELDS}, "last": None, "busy_until": None, "frames": 0, "rejected": 0, **dict.fromkeys(COUNTERS, 0)}


def _same(v: str) -> str:
    return re.sub(r"[()\-\s]", "", v).lower()


def update(fields: dict[str, dict], found: list[dict]) -> bool:
    """Takes the recognised values of a frame into the session's fields; whether any was taken."""
    taken = False
    for name, (keys, least, valid) in FIELDS.items():
        cur = fields[name]
        if cur["status"] == "locked":
            continue
        strongest = max((f for f in found if f["key"] in keys and (f["value"] or "").strip()), key=lambda f: f["confidence"], default=None)  # the first of equals
        if not strongest or strongest["status"] not in ("confirmed", "review") or len(strongest["errors"] if strongest.get("errors") is not None else ()) or strongest["confidence"] < least or (valid and not valid(strongest["value"])):
            continue
        same = _same(strongest["value"]) == _same(cur["value"])
        if cur["value"] and not same and strongest["confidence"] <= cur["confidence"]:
            continue
        support = cur["support"] + 1 if same else 1
        fields[name] = {"status": "locked" if support >= SUPPORT else "candidate", "value": strongest["value"], "confidence": float(max(cur["confidence"], strongest["confidence"])), "support": support}
        taken = True
    return taken


def step(state: dict[str, Any], frame: dict[str, Any], interval_ms: int = 500, need_quality: bool = True) -> str:
    """Decision on one frame; ``state`` changes in place."""
    now = frame["captured_ms"]
    if state["last"] is not None and now - state["last"] < interval_ms:
        state["skipped_interval"] += 1
        return "skipped-interval"
    if state["busy_until"] is not None and now < state["busy_until"]:
        state["skipped_busy"] += 1
        return "skipped-busy"
    state["last"] = now
    state["sampled"] += 1
    if need_quality and not frame["passed"]:
        state["rejected_quality"] += 1
        return "rejected-quality"
    state["runs"] += 1
    state["last_ms"] = max(0, int(frame["processing_ms"] or 0))
    state["busy_until"] = now + state["last_ms"]
    locked = sum(f["status"] == "locked" for f in state["fields"].values())
    taken = update(state["fields"], frame["found"])
    state["frames"] += 1
    state["accepted"] += taken
    state["rejected"] += not taken
    after = sum(f["status"] == "locked" for f in state["fields"].values())
    state["promoted"] += after - locked
    return "ready" if after == len(FIELDS) else "accepted"


def _run(session: Any, frames: pd.DataFrame, state: dict[str, Any], interval_ms: int, need_quality: bool) -> pd.DataFrame:
    out = []
    for f in frames.sort_values(["captured_ms", "frame_id"], kind="stable").to_dict("records"):
        if f.get("reset") is True:
            state.update(fresh())
            out.append((session, f["frame_id"], f["captured_ms"], "reset", 0, False, json.dumps(state, sort_keys=True)))
            continue
        f["processing_ms"] = 0 if pd.isna(f["processing_ms"]) else f["processing_ms"]
        f["found"] = [dict(x) if isinstance(x, dict) else x.asDict() for x in (f["found"] if f["found"] is not None else [])]
        decision = step(state, f, interval_ms, need_quality)
        locked = sum(x["status"] == "locked" for x in state["fields"].values())
        out.append((session, f["frame_id"], f["captured_ms"], decision, locked, locked == len(FIELDS), json.dumps(state, sort_keys=True)))
    return pd.DataFrame(out, columns=["session", "frame_id", "captured_ms", "decision", "locked", "ready", "state"])


def batch(frames: DataFrame, interval_ms: int = 500, need_quality: bool = True) -> DataFrame:
    """Decision and state after each frame (session, frame_id, captured_ms, passed, processing_ms, found) of a table."""

    def fold(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return _run(key[0], g, fresh(), interval_ms, need_quality)

    return frames.groupBy("session").applyInPandas(fold, OUT)


def stream(frames: DataFrame, interval_ms: int = 500, need_quality: bool = True, idle: str = "10 minutes") -> DataFrame:
    """The same over a streaming table; the state of a session is kept as JSON until all its fields are locked or it has
    been idle for a while, so states don't pile up with the number of sessions. A frame of a session that is ready starts
    a new one.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = json.loads(state.get[0]) if state.exists else fresh()
        got = list(parts)
        out = _run(key[0], pd.concat(got) if got else pd.DataFrame(columns=["frame_id", "captured_ms", "passed", "processing_ms", "found"]), s, interval_ms, need_quality)
        if len(out) and bool(out["ready"].iloc[-1]):
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(s),))
            state.setTimeoutDuration(idle_ms)
        yield out

    return frames.groupBy("session").applyInPandasWithState(fold, OUT, "state string", "append", "ProcessingTimeTimeout")


def summary(decided: DataFrame) -> DataFrame:
    """Where each session stands: locked fields, ready, and numbers of frames by decision."""
    counts = [F.count_if(F.col("decision") == d).alias(d.replace("-", "_")) for d in ("skipped-interval", "skipped-busy", "rejected-quality", "accepted")]
    last = F.max_by(F.struct("locked", "ready"), F.struct("captured_ms", "frame_id")).alias("l")
    return decided.groupBy("session").agg(last, F.count("*").alias("frames"), *counts).select("session", "l.locked", "l.ready", "frames", "skipped_interval", "skipped_busy", "rejected_quality", "accepted")


def presentation(decided: DataFrame) -> DataFrame:
    """What a screen shows of each session: locked, total and remaining fields, and what to do next (texts are fixed values)."""
    s = summary(decided).withColumn("taken", F.col("accepted") > 0)
    total = len(FIELDS)
    frames = F.when(F.col("taken"), F.concat(F.col("accepted").cast("string"), F.lit("개 프레임 누적"))).when(F.col("rejected_quality") > 0, F.concat(F.col("rejected_quality").cast("string"), F.lit("개 프레임 재촬영 필요"))).otherwise("프레임 대기 중")
    left = F.greatest(F.lit(total) - F.col("locked"), F.lit(0))
    return s.select("session", "locked", F.lit(total).alias("total"), left.alias("remaining"), frames.alias("frames"), F.when(F.col("taken"), "다음 프레임 촬영").otherwise("첫 프레임 촬영").alias("capture"), F.concat(F.col("locked").cast("string"), F.lit(f"/{total}")).alias("step"))


def merge_fields(current: DataFrame, incoming: DataFrame, key: str = "key", by: Sequence[str] = ()) -> DataFrame:
    """Fields with incoming ones where those fill a blank or are surer.

    A field that only comes in is not added, unless its whole group (``by``, such as a session; without it the table) has
    no fields yet: then the incoming ones are taken as they are.
    """
    on = [*by, key]
    i = incoming.select(*on, F.col("value").alias("_v"), F.col("confidence").alias("_c"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    take = F.col("_c").isNotNull() & ((blank(F.col("value")) & ~blank(F.col("_v"))) | (F.col("_c") > F.col("confidence")))
    merged = current.join(i, on, "left").withColumn("_t", take).select(*[F.when(F.col("_t"), F.col({"value": "_v", "confidence": "_c"}[c])).otherwise(F.col(c)).alias(c) if c in ("value", "confidence") else F.col(c) for c in current.columns])
    groups = current.select(*by).distinct() if by else current.select(F.lit(1).alias("_g")).limit(1)
    fresh = (incoming if by else incoming.withColumn("_g", F.lit(1))).join(groups, list(by) or ["_g"], "left_anti")
    return merged.unionByName(fresh.select(*current.columns))


def merge_results(results: DataFrame, key: str = "session", ord: str = "ord") -> DataFrame:
    """Results of a session's frames as one: highest confidence, sums, everything listed, the later event type of equals."""
    inorder = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(ord, c))), lambda x: x[c]))
    return results.groupBy(key).agg(
        F.max("confidence").alias("confidence"), F.sum("processing_ms").alias("processing_ms"), F.sum("variants").alias("variants"), F.bool_or("fallback").alias("fallback"),
        inorder("unmapped").alias("unmapped"), F.max_by("event_type", F.struct("event_confidence", ord)).alias("event_type"),
    )
