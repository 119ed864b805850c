"""Files, registration, settings, pixels and streams: round trips and worked examples."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from waybill.operators import finance, imaging, joins, pixels, receipts, registration, routing, settings, spatial, venues
from waybill.sources import files
from waybill.streaming import live


def test_collection_round_trip(spark, tmp_path):
    c = files.Collection(spark, str(tmp_path / "c"), "id string, n int")
    assert c.read().count() == 0
    c.overwrite(spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int"))
    c.upsert(spark.createDataFrame([("b", 3), ("c", 4)], "id string, n int"), ["id"])
    assert sorted(map(tuple, c.read().collect())) == [("a", 1), ("b", 3), ("c", 4)]
    c.delete(spark.createDataFrame([("a",), ("x",)], "id string"), ["id"])
    assert sorted(map(tuple, c.read().collect())) == [("b", 3), ("c", 4)] and len(c.versions()) == 2
    assert c.first(F.col("n") > 0, F.desc("n")).first().id == "c"
    broken = c.stage(c.read())  # staged and never published
    assert files.exists(spark, broken) and len(c.versions()) == 2


def test_records_of_texts(spark):
    t = spark.createDataFrame([('{"records":[{"id":"a"},{"id":"b"}]}',), ('{"records":3}',), ("{",), (None,)], "text string")
    assert [r.id for r in files.records_of(t, "id:string").collect()] == ["a", "b"]


def test_registry_falls_back(spark, tmp_path):
    default = spark.createDataFrame([("k", ["x"])], "key string, aliases array<string>")
    c = files.Collection(spark, str(tmp_path / "r"), default.schema)
    assert files.load_registry(c, default).first().key == "k"
    c.overwrite(spark.createDataFrame([("saved", ["y"])], default.schema))
    assert files.load_registry(c, default).first().key == "saved"
    for p in (tmp_path / "r").glob("v=*/*.parquet"):
        p.write_bytes(b"no parquet")
    assert files.load_registry(c, default).first().key == "k"


def test_json_folder_and_store(spark, tmp_path):
    d = tmp_path / "j"
    d.mkdir()
    for name, text in (("a.json", '{"id":"a","at":1}'), ("b.json", '{"id":"b","at":2}'), ("bad.json", '{"id":'), ("c.txt", '{"id":"c","at":3}')):
        (d / name).write_text(text)
    assert [r.id for r in files.scan_json(spark, str(d), "id string, at int", "at").collect()] == ["b", "a"]
    s = files.JsonStore(spark, str(tmp_path / "s"), "id string, n int")
    assert s.get("x").count() == 0
    s.put(spark.createDataFrame([("a/1", 1), ("b", 2)], "id string, n int"))
    s.put(spark.createDataFrame([("a/1", 5)], "id string, n int"))
    assert s.get("a/1").first().n == 5 and s.get("b").first().n == 2
    s.delete("a/1")
    s.delete("a/1")
    assert s.get("a/1").count() == 0 and s.get("b").count() == 1


def test_backup_round_trip(spark, tmp_path):
    orders = spark.createDataFrame([("o1", "pending", ("2026-01-01",))], "id string, status string, schedule struct<serviceDate:string>")
    fuel, mileage, contacts = (spark.createDataFrame([(x,)], "id string") for x in "fmc")
    b = files.build_backup(orders, fuel, mileage, contacts.limit(0), '{"a":1}', "2026-01-02")
    assert json.loads(b.first().json)["orders"][0]["schedule"]["serviceDate"] == "2026-01-01"
    into = {"orders": (files.Collection(spark, str(tmp_path / "o"), orders.schema), "id:string,status:string,schedule:struct<serviceDate:string>"), "fuelLogs": (files.Collection(spark, str(tmp_path / "f"), "id string"), "id:string")}
    assert files.restore(b, into) is None
    assert into["orders"][0].read().first().schedule.serviceDate == "2026-01-01" and into["fuelLogs"][0].read().first().id == "f"
    bad = spark.createDataFrame([('{"app":"x"}',)], "json string")
    assert files.restore(bad, into).startswith("This is not") and into["fuelLogs"][0].read().count() == 1
    photo = spark.sql("""SELECT parse_json('{"proofOfDelivery":{"photoUris":["a",1,null,"b"]}}') AS x, parse_json('{"proofOfDelivery":{"photoUris":"a"}}') AS y""")
    assert photo.select(files.sanitize_photos(F.col("x")), files.sanitize_photos(F.col("y"))).first()[:] == (["a", "b"], [])


def test_csv_in_and_out(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_bytes("﻿\"상호명\",영업상태명,도로명주소\r\n\"A \"\"x\"\", y\",영업,서울 강남구 1\r\n\r\n\"two\nlines\",폐업,b\r\n".encode())
    rows = files.read_csv(spark, str(p))
    assert rows.columns == ["상호명", "영업상태명", "도로명주소"] and [r["상호명"] for r in rows.collect()] == ['A "x", y', "two\nlines"]
    assert files.licences_to_json(spark, str(p), "wedding", str(tmp_path / "v")) == 1
    daily = spark.createDataFrame([("2026-01-02", 5, 1, 1, 4), ("2026-01-01", 3, 0, 2, 3)], "date string, revenue_cents long, fuel_cents long, deliveries long, net_cents long")
    files.write_profit_csv(daily, str(tmp_path / "out"))
    lines = [x for f in sorted((tmp_path / "out").glob("*.txt")) for x in f.read_text().splitlines()]
    assert lines == ["date,revenue,fuel,net,deliveries", "2026-01-01,3,0,3,2", "2026-01-02,5,1,4,1", "total,8,1,7,3"]


def test_dataset_sources(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "p").mkdir()
    (tmp_path / "m.json").write_text('{"samples":[{"image":"i/a.jpg","rawGoldenText":"g/a.txt","sha256":"1","notes":"n"},{"image":"i/b.jpg","rawGoldenText":"g/b.txt","sha256":"2"},{"image":"i/c.jpg","rawGoldenText":"g/c.txt","sha256":"3"}]}')
    for n in "abc":
        (tmp_path / "g" / f"{n}.txt").write_text(f"golden {n}\nline")
    (tmp_path / "p" / "a.txt").write_text("plain")
    (tmp_path / "p" / "a.json").write_text('{"fullText":"not this"}')
    (tmp_path / "p" / "b.json").write_text('{"fullText":3,"lines":["x",{"text":"y"},""]}')
    m = files.manifest(spark, str(tmp_path / "m.json"))
    g = files.golden_texts(m, files.texts(spark, str(tmp_path / "g")))
    assert sorted(r.text for r in g.collect()) == ["golden a\nline", "golden b\nline", "golden c\nline"]
    p = files.with_predictions(g, files.predictions(spark, str(tmp_path / "p")))
    assert {r.image: r.prediction for r in p.collect()} == {"i/a.jpg": "plain", "i/b.jpg": "x\ny", "i/c.jpg": ""}
    assert files.baseline_templates(m).where("stem = 'a'").first().text.count("#") == 2
    files.export_native(spark.createDataFrame([("d/a.jpg", "some\ntext"), ("b.jpg", None)], "file string, full_text string"), str(tmp_path / "e"))
    assert "".join(f.read_text() for f in (tmp_path / "e" / "stem=a").glob("*.txt")).strip() == "some\ntext"
    assert files.binary_files(spark, str(tmp_path / "g")).agg(F.sum("size")).first()[0] == 39


def test_gazetteer(spark, tmp_path):
    (tmp_path / "v.json").write_text('[{"name":"Grand Hotel Hall","aliases":["GHH place",""],"type":"wedding"},{"name":null},{"name":"Plain Hospital"}]')
    v = files.gazetteer(spark, str(tmp_path / "v.json"))
    assert sorted(r.form for r in v.collect()) == ["GHH place", "Grand Hotel Hall", "Plain Hospital"]
    q = spark.createDataFrame([(1, "the grand hotel hall 3F")], "id int, text string")
    assert [r.name for r in venues.match_venues(q, v).collect()] == ["Grand Hotel Hall"]


def test_archive_compensates(spark, tmp_path):
    c = files.Collection(spark, str(tmp_path / "a"), "id string, image_path string")
    rows = spark.createDataFrame([("r1", "p1")], "id string, image_path string")
    made, undone = [], []
    files.archive(c, rows, lambda df: made.append(df.count()), lambda df: undone.append(1))
    with pytest.raises(Exception):
        files.archive(c, rows.drop("image_path"), lambda df: made.append(1), lambda df: undone.append(1))
    gone = []
    files.delete_archived(c, spark.createDataFrame([("r1",), ("r9",)], "id string"), lambda df: gone.extend(r.id for r in df.collect()))
    assert (made, undone, gone, c.read().count()) == ([1, 1], [1], ["r1"], 0)


def test_notifications_sync(spark):
    plan = spark.createDataFrame([("a", 10), ("b", 30), ("c", 40)], "id string, fire_at_ms long")
    log = []
    n = files.sync_notifications(plan, 20, lambda: log.append("cancel"), lambda df: df.withColumn("done", F.col("id") != "c"))
    assert (n, log) == (1, ["cancel"]) and files.sync_notifications(plan, 50, lambda: log.append("no"), lambda df: df) == 0 and log == ["cancel"]


def test_settings(spark):
    rows = spark.createDataFrame([(1, '{"route":{"navApp":"waze"},"fees":{"defaultFee":"x","districtFees":{"custom":{"Z":5}}}}', None), (2, None, '{"vehicleModel":"","fuelEfficiency":9}'), (3, "[", None)], "user_id int, v2 string, v1 string")
    got = {r.user_id: r for r in settings.load(rows, {"Seoul": ("A",)}).collect()}
    assert (got[1].route_navApp, got[1].fees_defaultFee, got[1].fees_custom, got[1].migrated) == ("google", 15000.0, {"Z": 5.0}, False)
    assert (got[2].costs_vehicleModel, got[2].costs_fuelEfficiency, got[2].migrated) == ("현대 포터2", 9.0, True)
    assert got[3].fees_Seoul == {"A": 15000.0} and not got[3].migrated


def test_long_name_tables_are_joined(spark):
    """Beyond the literal the first characters of a name lead to it: the same result, for any length of name."""
    rng = np.random.default_rng(5)
    names = ["".join(rng.choice(list("abc"), int(rng.integers(1, 7)))) for _ in range(300)] + ["zz top"]
    fees = spark.createDataFrame([(n, i * 10, i) for i, n in enumerate(names)], "district string, fee long, ord int")
    texts = ["".join(rng.choice(list("abcd "), 12)) for _ in range(80)] + ["", None, "z z t o p", "dddd"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, address string")
    want = {}
    for k, t in enumerate(texts):
        c = "".join((t or "").split())
        hit = next((n for n in names if n.replace(" ", "") in c), None)
        want[k] = (hit, names.index(hit) * 10) if hit is not None else (None, None)
    for literal in (1000, 10):
        got = {r.k: (r.district, r.fee) for r in joins.first_contained(df, F.col("address"), fees, "district", "fee", "ord", literal).collect()}
        assert got == want


def test_overlaps_by_hand(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(s), int(s + d)) for i, (s, d) in enumerate(zip(rng.integers(0, 5000, 200), rng.choice([0, 3, 40, 900], 200), strict=True))]
    df = spark.createDataFrame(rows, "id int, s long, e long").select("id", F.timestamp_seconds("s").alias("start"), F.timestamp_seconds("e").alias("end"))
    want = {a for a, s, e in rows for b, t, f in rows if a != b and s < f and t < e}
    for width in (None, 50, 700):
        assert {r.id for r in joins.interval_overlaps(df, "start", "end", "id", width).collect()} == want


def test_read_receipts(spark):
    said = ["발주처: 한빛플라워", "상품명: 축하3단화환", "배달일시: 2026년 06월 14일", "배송주소: 서울 종로구 세종로 12"]
    assets = spark.createDataFrame([(1, "u", None), (2, None, None), (3, "u", None), (4, None, "\n".join(said)), (5, "u", None)], "doc_id int, uri string, raw_text string")
    recognised = spark.createDataFrame([(1, "first", "zz"), (3, "first", " "), (5, "first", "nothing here")], "doc_id int, variant string, full_text string")
    lines = spark.createDataFrame([(1, "first", i + 1, t, 40.0, 50.0 * i, 400.0, 30.0, 80.0) for i, t in enumerate(said)], "doc_id int, variant string, line_no int, text string, x double, y double, width double, height double, confidence double")
    results, fields = registration.read_receipts(assets, recognised, lines, 2026)
    got = {r.doc_id: r for r in results.collect()}
    assert {k: r.status for k, r in got.items()} == {1: "read", 2: "no-image", 3: "no-text", 4: "read", 5: "no-evidence"}
    assert "한빛플라워" in got[1].text and got[1].variants_compared == 1 and got[4].variant == "given"
    values = {(r.doc_id, r.key): r.value for r in fields.collect()}
    assert values[1, "deliveryDate"] == values[4, "deliveryDate"] == "2026-06-14" and not any(k == 5 for k, _ in values)


def test_chosen_variant(spark):
    rows = [(1, "first", 60, 2, 5), (1, "rotated", 59, 3, 8), (2, "first", 60, 2, 5), (2, "rotated", 50, 3, 17), (3, "first", 60, 2, 5), (3, "rotated", 60, 2, 5), (4, "first", 1, 0, 0)]
    got = registration.choose_variant(spark.createDataFrame(rows, "doc_id int, variant string, document_confidence int, required int, populated int"))
    assert {r.doc_id: (r.variant, r.variants_compared) for r in got.collect()} == {1: ("rotated", 2), 2: ("first", 2), 3: ("first", 2), 4: ("first", 1)}


def image(h=6, w=9, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 4)).astype(np.uint8)


def test_resize_and_crop():
    x = image()
    out = pixels.half_pixel_resize(x, 5, 4)
    for ty in range(4):
        for tx in range(5):
            sy, sx = min(5, (ty + 0.5) * 6 / 4 - 0.5), min(8, (tx + 0.5) * 9 / 5 - 0.5)
            y0, x0 = max(0, int(np.floor(sy))), max(0, int(np.floor(sx)))
            y1, x1, fy, fx = min(5, y0 + 1), min(8, x0 + 1), sy - y0, sx - x0
            p = x.astype(float)
            want = p[y0, x0] * (1 - fx) * (1 - fy) + p[y0, x1] * fx * (1 - fy) + p[y1, x0] * (1 - fx) * fy + p[y1, x1] * fx * fy
            assert (np.abs(out[ty, tx].astype(float) - np.trunc(want)) <= 1).all()
    assert (pixels.half_pixel_resize(x, 9, 6) == x).all()
    c = pixels.crop(x, -2, 4, 4, 5)
    assert (c[0, 0] == x[4, 0]).all() and (c[4, 3] == x[5, 1]).all() and c.shape == (5, 4, 4)
    assert pixels.fit_long_side(np.zeros((1440, 720, 4), np.uint8)).shape == (720, 360, 4)


def test_strips():
    x = image(20, 30)
    quad = np.array([[3, 2], [13, 2], [13, 7], [3, 7]], float)
    assert pixels.strip_width(quad, 10, 100) == 20 and pixels.strip_width(quad, 10, 15) == 15 and pixels.strip_width(quad, 1, 99) == 8
    assert (pixels.straighten(x, quad, 11, 6) == x[2:8, 3:14]).all()
    assert (pixels.straighten(x, quad + 100, 4, 3) == 255).all()
    assert (pixels.ordered_corners(quad[[2, 0, 3, 1]]) == quad).all()


def test_tensors_and_stretch():
    x = image()
    t = pixels.detector_tensor(x)
    assert t.shape == (3, 6, 9) and t[1, 2, 3] == pytest.approx((x[2, 3, 1] / 255 - 0.456) / 0.224, abs=1e-5)
    r = pixels.recogniser_tensor(x, 12)
    assert r.shape == (3, 6, 12) and (r[:, :, 9:] == 1).all() and r[0, 1, 1] == pytest.approx(x[1, 1, 0] / 255 * 2 - 1, abs=1e-6)
    assert 0 <= ((pixels.recogniser_tensor(x, 9, True) + 1) / 2).min() and (pixels.stretch(np.full((4, 4, 4), 9, np.uint8)) == 9).all()
    ramp = np.repeat(np.arange(100, 200, dtype=np.uint8)[None, :, None], 4, axis=2)
    s = pixels.stretch(ramp)
    assert s[0, 0, 0] == 0 and s[0, -1, 0] == 255 and s[0, 50, 3] == 255


def test_images_of_a_table(spark):
    ppm = b"P6\n# note\n2 1\n255\n" + bytes([1, 2, 3, 4, 5, 6])
    files_ = spark.createDataFrame([("a", bytearray(ppm)), ("b", bytearray(b"GIF"))], "uri string, content binary")
    got = {r.uri: r for r in pixels.over_images(files_, lambda im: [im[..., :3].mean()]).collect()}
    assert (got["a"].width, got["a"].height, got["a"].values) == (2, 1, [3.5]) and got["b"].values is None and got["b"].error


def test_tour_by_cells_equals_plain_tour():
    rng = np.random.default_rng(11)
    for n, clustered in ((0, False), (1, False), (700, False), (900, True)):
        lat, lon = rng.normal(37.5, 0.1, n), rng.normal(127, 0.1, n)
        if clustered:
            lat[: n // 2], lon[: n // 2] = 37.5 + rng.integers(0, 4, n // 2) * 1e-3, 127.0
            lat[5] = np.nan
        lat, lon, start = np.radians(lat), np.radians(lon), tuple(np.radians((37.5, 127.04)))
        assert routing.greedy_tour(lat, lon, start, 20) == routing.greedy_tour(lat, lon, start, 10**6)
        assert sorted(routing.greedy_tour(lat, lon, start, 20)) == list(range(n))


def test_ctc_text_is_composed(spark):
    steps = spark.createDataFrame([(1, i, x) for i, x in enumerate([0, 1, 1, 0, 2, 2, 3])], "sequence int, step int, label int")
    letters = F.array(F.lit("\u1112"), F.lit("\u1161"), F.lit("\u11ab"))
    assert imaging.ctc_collapse(steps, dictionary=letters).first().text == "\ud55c"


def test_session_reset(spark):
    found = [{"key": k, "value": v, "confidence": 95.0, "status": "confirmed", "errors": []} for k, v in (("venueName", "x"), ("deliveryAddress", "y"), ("recipientTel", "010-1234-5678"))]
    rows = [("s", str(i), 1000 * i, True, 10, found, i == 2) for i in range(1, 6)]
    kind = "session string, frame_id string, captured_ms long, passed boolean, processing_ms long, found array<struct<key:string,value:string,confidence:double,status:string,errors:array<string>>>, reset boolean"
    got = [(r.decision, r.locked) for r in live.batch(spark.createDataFrame(rows, kind)).orderBy("captured_ms").collect()]
    assert got == [("accepted", 0), ("reset", 0), ("accepted", 0), ("ready", 3), ("ready", 3)]


def test_empty_session_takes_incoming(spark):
    current = spark.createDataFrame([("s", "k", "", 5)], "session string, key string, value string, confidence int")
    incoming = spark.createDataFrame([("s", "k", "v", 1), ("s", "new", "w", 9), ("t", "k", "z", 2)], "session string, key string, value string, confidence int")
    assert sorted(map(tuple, live.merge_fields(current, incoming, by=["session"]).collect())) == [("s", "k", "v", 1), ("t", "k", "z", 2)]
    assert live.merge_fields(current.limit(0), incoming.where("session = 't'")).count() == 1
    assert finance.period_total(spark.createDataFrame([], "revenue_cents long, fuel_cents long, net_cents long, deliveries long")).first().deliveries == 0


def test_recognised_texts_are_parsed_by_all_cores(spark, monkeypatch):
    """Few bytes of text are much work: they don't end in one task, and their labels are known before."""
    class Seen(Exception):
        pass

    def spy(docs, known=None, **_):
        raise Seen(docs.rdd.getNumPartitions(), known is not None, docs.count())

    monkeypatch.setattr(receipts, "parse_receipts", spy)
    docs = spark.range(50).selectExpr("id as doc_id", "concat('발주처: 꽃집 ', id) as full_text")
    lines = spark.createDataFrame([], "doc_id long, line_no int, text string, x double, y double, width double, height double, confidence double")
    with pytest.raises(Seen) as seen:
        registration.parse_recognised(docs, lines, 2026)
    parts, known, n = seen.value.args
    assert parts >= spark.sparkContext.defaultParallelism and known and n == 50


def test_layout_is_spread_and_candidates_are_one_plan(spark):
    """Laying out is work by document, not by bytes; a further field adds no join to the plan of the candidates."""
    lines = spark.range(40).selectExpr("id % 10 as doc_id", "id as line_no", "concat('배송주소: 서울 종로구 ', id) as text", "if(id % 7 = 0, null, 1.0D) as x", "id * 9.0D as y", "5.0D as width", "4.0D as height", "80.0D as confidence")
    laid = spatial.reading_order(lines)
    assert laid.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and laid.count() == 10
    joins = lambda keys: spatial.field_candidates(lines, 2026, keys)._jdf.queryExecution().analyzed().toString().count("Join")
    assert joins(["deliveryAddress"]) == joins(["deliveryAddress", "memo", "productName", "recipientTel"])
