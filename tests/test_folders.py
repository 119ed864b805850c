"""Streamed folders keep corrupt files as rows; a batch that comes again changes nothing."""

from __future__ import annotations

import json

import pytest

from waybill.sources import ledger
from waybill.streaming import folders

SCHEMA = "id string, fire_at_ms long, title string"


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)


def run(spark, tmp_path, store, now=1000):
    rows = folders.watch(spark, str(tmp_path / "in"), SCHEMA)
    q = rows.where("corrupt is null").writeStream.foreachBatch(folders.scheduler(store, "q", lambda: now)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return sorted(tuple(r) for r in store.read("scheduled").collect())


def test_folder_to_schedule(spark, tmp_path):
    store = ledger.Store(spark, str(tmp_path / "store"), folders.TABLES, buckets=2)
    put(tmp_path / "in", "a.json", json.dumps({"id": "a", "fire_at_ms": 2000, "title": "A"}, indent=2))
    put(tmp_path / "in", "b.json", '{"id": "b", "fire_at_ms": 500}')
    put(tmp_path / "in", "c.txt", '{"id": "c", "fire_at_ms": 3000}')
    put(tmp_path / "in", "d.json", '{"id": "d", ')
    assert run(spark, tmp_path, store) == [("a", 2000, "A")]
    number = store.version()[0]
    assert run(spark, tmp_path, store) == [("a", 2000, "A")] and store.version()[0] == number
    # the batch again, as after a crash before the checkpoint: nothing changes, not even a manifest
    take = folders.scheduler(store, "q", lambda: 1000)
    take(spark.createDataFrame([("z", 9000, "Z"), ("a", 1, "gone")], SCHEMA), 0)
    assert store.version()[0] == number and store.read("scheduled").count() == 1
    put(tmp_path / "in", "e.json", json.dumps({"id": "a", "fire_at_ms": 100, "title": "past"}))
    put(tmp_path / "in", "f.json", json.dumps({"id": "f", "fire_at_ms": 5000, "title": "F"}))
    assert run(spark, tmp_path, store) == [("f", 5000, "F")]


def test_a_batch_that_dies_counts_not_at_all(spark, tmp_path, monkeypatch):
    store = ledger.Store(spark, str(tmp_path / "store"), folders.TABLES, buckets=2)
    take, rows = folders.scheduler(store, "q", lambda: 0), spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z"), (None, 5, "n")], SCHEMA)
    commit = ledger.Transaction.commit
    monkeypatch.setattr(ledger.Transaction, "commit", lambda self: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        take(rows, 0)
    assert store.version()[0] == 0
    monkeypatch.setattr(ledger.Transaction, "commit", commit)
    take(rows, 0)
    take(rows.limit(0), 1)
    assert [tuple(r) for r in store.read("scheduled").collect()] == [("a", 2, "y")] and store.get("batches", "q").first().batch == 1


def test_corrupt_files_are_rows(spark):
    texts = [("1", '{"id": "a", "fire_at_ms": 1}'), ("2", "{"), ("3", ""), ("4", None), ("5", "[1]"), ("6", '{"fire_at_ms": 1}')]
    got = {r.path: (r.id, r.corrupt) for r in folders.records(spark.createDataFrame(texts, "path string, value string"), SCHEMA).collect()}
    assert got["1"] == ("a", None) and {k: c for k, (_, c) in got.items() if k != "1"} == {"2": "{", "3": "", "4": "", "5": "[1]", "6": '{"fire_at_ms": 1}'}
