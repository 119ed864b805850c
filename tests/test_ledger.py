"""Collections merged on read and commits over several of them, also where a writer dies."""

from __future__ import annotations

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from waybill.sources import ledger
from waybill.sources.files import _path

TABLES = {"orders": ("id long, day string, fee double", ["id"]), "receipts": ("id string, linked string", ["id"]), "images": ("id string, path string", ["id", "path"])}


@pytest.fixture
def store(spark, tmp_path):
    return ledger.Store(spark, str(tmp_path / "store"), TABLES, buckets=4)


def rows(spark, *r):
    return spark.createDataFrame(list(r), "id long, day string, fee double")


def held(store, name="orders"):
    return sorted(tuple(r) for r in store.read(name).collect())


def files(spark, path):
    p, fs = _path(spark, path)
    it, out = fs.listFiles(p, True), []
    while it.hasNext():
        out.append(it.next())
    return out


def test_random_changes_equal_a_dict(spark, store):
    rng, want = random.Random(3), {}
    for i in range(5):
        tx = store.begin()
        some = {rng.randrange(30): rng.choice("abc") for _ in range(8)}
        tx.upsert("orders", rows(spark, *[(k, v, float(i)) for k, v in some.items()]))
        want |= {k: (k, v, float(i)) for k, v in some.items()}
        gone = [rng.randrange(40) for _ in range(3)]
        tx.delete("orders", rows(spark, *[(k, None, None) for k in gone]))
        for k in gone:
            want.pop(k, None)
        tx.commit()
        if i == 2:
            assert 0 < store.compact("orders") <= 4 and store.compact("orders") == 0
        assert held(store) == sorted(want.values())
    k = next(iter(want))
    assert tuple(store.get("orders", k).first()) == want[k] and store.get("orders", 99).count() == 0


def test_a_small_write_writes_little(spark, store):
    store.begin().replace("orders", spark.range(20_000).selectExpr("id", "'day' day", "id * 1.0 fee")).commit()
    before = {str(f.getPath()) for f in files(spark, store.root)}
    store.begin().upsert("orders", rows(spark, (5, "new", 1.0), (30_000, "new", 1.0))).commit()
    new = [f for f in files(spark, store.root) if str(f.getPath()) not in before and f.getPath().getName().endswith(".parquet")]
    assert sum(f.getLen() for f in new) < 5_000 and store.read("orders").count() == 20_001
    state = store.version()[1]["orders"]
    assert store.compact("orders") <= 2
    after = store.version()[1]["orders"]
    assert sum(after.base[b] == state.base[b] for b in state.base) >= 2 and after.deltas == [] and store.read("orders").where("day = 'new'").count() == 2


def test_repeated_and_null_keys(spark, store):
    store.begin().upsert("orders", rows(spark, (1, "a", 1.0), (1, "b", 0.0), (None, "n", 0.0), (None, "m", 0.0))).commit()
    assert {(r.id, r.day) for r in store.read("orders").collect()} == {(1, "b"), (None, "n")}
    store.begin().upsert("orders", rows(spark, (1, "c", 9.0), (1, "d", 2.0), (None, "o", 0.0)), order=-F.col("fee")).commit()
    assert {(r.id, r.day) for r in store.read("orders").collect()} == {(1, "d"), (None, "o")}
    assert store.get("orders", None).first().day == "o" and store.read("images").count() == 0


def test_patch_needs_the_record(spark, store):
    store.begin().upsert("receipts", spark.createDataFrame([("r1", None), ("r2", "x")], "id string, linked string")).commit()
    store.begin().patch("receipts", spark.createDataFrame([("r1", "d9")], "id string, linked string")).commit()
    assert held(store, "receipts") == [("r1", "d9"), ("r2", "x")]
    with pytest.raises(Exception, match="r3 not found"):
        store.begin().patch("receipts", spark.createDataFrame([("r3", "d")], "id string, linked string"))
    assert held(store, "receipts") == [("r1", "d9"), ("r2", "x")]


def test_nothing_counts_before_the_commit(spark, store, monkeypatch):
    """A writer that dies between two collections, before its manifest, or while it writes it, leaves the old state."""
    linked, path = "id string, linked string", "id string, path string"
    store.begin().replace("receipts", spark.createDataFrame([("r", "old")], linked)).replace("images", spark.createDataFrame([("r", "old")], path)).commit()
    order = {"id": "r2", "status": "pending", "schedule": {}}
    said = {"app": "waybill", "schemaVersion": 1, "exportedAt": "2026-01-01T00:00:00Z", "orders": [order | {"linked": "new"}, order | {"linked": "newer"}], "fuelLogs": [], "mileageLogs": [], "contactLogs": [{"id": "r2", "path": "new"}], "settings": {}}
    good = spark.createDataFrame([(json.dumps(said),)], "json string")
    names = {"orders": "receipts", "contactLogs": "images"}
    both = lambda: (held(store, "receipts"), held(store, "images"))
    old, new = ([("r", "old")], [("r", "old")]), ([("r2", "newer")], [("r2", "new")])
    done, real = [], ledger.Transaction.replace

    def dies(self, name, df):
        if done:
            raise OSError("lost")
        done.append(name)
        return real(self, name, df)

    monkeypatch.setattr(ledger.Transaction, "replace", dies)
    with pytest.raises(OSError):
        ledger.restore(store, good, names)
    assert done and both() == old
    monkeypatch.setattr(ledger.Transaction, "replace", real)
    publish = ledger.Store._publish
    monkeypatch.setattr(ledger.Store, "_publish", lambda *x: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        ledger.restore(store, good, names)
    assert both() == old
    monkeypatch.setattr(ledger.Store, "_publish", publish)
    p, fs = _path(spark, f"{store.root}/manifest/{store.version()[0] + 1:012}.json")
    out = fs.create(p, False)
    out.write(bytearray(b'{"receipts": {"base"'))
    out.close()
    assert both() == old
    assert ledger.restore(store, good, names) is None
    assert both() == new
    assert ledger.restore(store, spark.createDataFrame([("no json",)], "json string"), names) is not None
    assert len(store.vacuum(1)) >= 3 and both() == new


def test_two_writers(spark, store):
    a, b, c = store.begin(), store.begin(), store.begin()
    a.upsert("orders", rows(spark, (1, "a", 1.0))).commit()
    b.upsert("receipts", spark.createDataFrame([("r", "b")], "id string, linked string")).commit()  # another collection
    with pytest.raises(ledger.Conflict):
        c.upsert("orders", rows(spark, (1, "c", 1.0))).commit()
    assert held(store) == [(1, "a", 1.0)] and held(store, "receipts") == [("r", "b")]
    many = [store.begin().upsert(n, spark.createDataFrame([("x", n)], f"id string, {'linked' if n == 'receipts' else 'path'} string")) for n in ("receipts", "images")]
    threads = [threading.Thread(target=t.commit) for t in many]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert ("x", "receipts") in held(store, "receipts") and held(store, "images") == [("x", "images")]


def test_archive_in_one_commit(spark, store):
    n = ledger.archive(store, spark.createDataFrame([("r1", None), ("r2", None)], "id string, linked string"), spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "c")], "id string, path string"))
    assert store.version()[0] == n and len(held(store, "images")) == 3
    ledger.delete_archived(store, spark.createDataFrame([("r1",), ("zz",)], "id string"))
    assert held(store, "receipts") == [("r2", None)] and held(store, "images") == [("r2", "c")]
