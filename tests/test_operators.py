"""Worked examples and invariants of the delivery operators."""

from __future__ import annotations

import difflib
import functools
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from waybill.functions import semantics as S
from waybill.functions import text as X
from waybill.operators import changes, evaluation, finance, imaging, joins, labels, receipts, routing, schedule, spatial, venues
from waybill.plans import catalog
from waybill.streaming import live


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


FEES = [("Seoul", "강남구", 1_800_000, 0), ("Gyeonggi", "수원시", 2_400_000, 1)]


def test_daily_profit(spark):
    orders = spark.createDataFrame([("2026-07-20", 3_000_000, "서울 강남구 1"), ("2026-07-20", 0, "경기 수원시 2"), (None, 0, "x"), ("2026-07-22", 0, "부산")], "service_date string, fee_cents long, address string")
    fuel = spark.createDataFrame([("2026-07-20", 1_700_000), ("2026-07-21", 900_000)], "date string, amount_cents long")
    fees = spark.createDataFrame(FEES, "region string, district string, fee_cents long, ord int")
    daily = finance.daily_profit(orders, fuel, fees)
    got = {r.date: (r.revenue_cents, r.fuel_cents, r.net_cents, r.deliveries) for r in daily.collect()}
    assert got == {"2026-07-20": (5_400_000, 1_700_000, 3_700_000, 2), "2026-07-21": (0, 900_000, -900_000, 0), "2026-07-22": (1_500_000, 0, 1_500_000, 1)}
    assert [r.label for r in finance.trend(daily, "2026-07-21", 2).collect()] == ["07/20", "07/21"]
    total = finance.period_total(daily).first()
    assert (total.revenue_cents, total.net_cents) == (6_900_000, 4_300_000)
    assert finance.period_total(daily.where("false")).first().net_cents == 0
    assert [r.line for r in finance.csv_rows(daily).orderBy("all", "ord").collect()][-1] == "total,6900000,2600000,4300000,3"


def test_fuel_log(spark):
    rows = [("a", "2026-01-01", 20.0, None, 32000.0, 180.0, "Porter"), ("b", "2026/01/01", 0.0, None, None, -1.0, " ")]
    logs = spark.createDataFrame(rows, "id string, date string, liters double, price_per_liter double, amount double, odometer_km double, vehicle string")
    assert [len(r.errors) for r in finance.validate_fuel(logs).orderBy("id").collect()] == [0, 4]
    built = finance.build_fuel(logs).collect()
    assert [(r.price_per_liter, r.amount, r.vehicle) for r in built] == [(1600.0, 32000.0, "Porter")]


def test_rounding_and_cells(spark):
    assert one(spark, S.round_half_up(F.lit(-2.5))) == -2.0
    assert one(spark, S.csv_cell(F.lit('a"b'))) == '"a""b"'
    assert one(spark, S.csv_cell(F.lit("a\rb"))) == '"a\rb"'
    assert one(spark, S.won(F.lit(12345.0))) == "12,345원"


@pytest.mark.parametrize(("day", "good"), [("2026-02-29", False), ("2028-02-29", True), ("2026-2-3", False), ("", False), (None, False)])
def test_service_dates(spark, day, good):
    assert one(spark, S.is_service_date(S.lit_str(day))) is good


def test_weeks(spark):
    at = lambda x: F.lit(x).cast("timestamp")
    assert one(spark, S.week_range_label(at("2026-06-10T09:00:00Z"))) == "2026.06.08 ~ 06.14"
    assert one(spark, S.week_range_label(at("2026-06-14T20:00:00Z"))) == "2026.06.15 ~ 06.21"
    assert one(spark, S.iso_week_key(at("2027-01-01T00:00:00Z"))) == "2026-W53"
    assert one(spark, S.iso_week_key(F.lit(None).cast("timestamp"))) == "unknown"


def test_calendar_risks(spark):
    rows = [("a", "2026-06-23T10:00:00Z", "2026-06-23T11:00:00Z", "2026-06-23T10:30:00Z", None, "2026-06-23T10:40:00Z"), ("b", "2026-06-23T10:45:00Z", "2026-06-23T11:30:00Z", None, None, "2026-06-23T10:20:00Z"), ("c", "2026-06-23T11:30:00Z", "2026-06-23T12:00:00Z", None, None, None), ("u", None, None, None, None, None)]
    items = spark.createDataFrame(rows, "id string, start_at string, end_at string, deadline_at string, event_at string, planned_at string")
    got = {r.id: (r.conflict, r.late) for r in schedule.risks(items).collect()}
    assert got == {"a": (True, True), "b": (True, False), "c": (False, False), "u": (False, False)}


def test_overlaps_match_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [(i, s := rng.randrange(0, 400_000), s + rng.choice([0, 1, 60, 4000, 200_000])) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, s long, e long").select("id", F.timestamp_seconds("s").alias("s"), F.timestamp_seconds("e").alias("e"))
    want = {a[0] for a in rows for b in rows if a[0] != b[0] and a[1] < b[2] and b[1] < a[2]}
    assert {r.id for r in joins.interval_overlaps(df, "s", "e", "id", 10_000).collect()} == want


def test_upsert_is_idempotent(spark):
    now = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int")
    once = changes.upsert(now, new, ["id"])
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 3), ("c", 4)] == sorted(map(tuple, changes.upsert(once, new, ["id"]).collect()))


def test_photo_paths(spark):
    assert one(spark, changes.photo_path(F.lit("receipt-photos"), F.lit("../x"), F.lit(""))) == "receipt-photos/___x-x.jpg"
    assert one(spark, changes.is_safe_photo_path(F.lit("receipt-photos/../../x.jpg"))) is False


@pytest.mark.parametrize(("raw", "want"), [("O1O-1234-S678", "010-1234-5678"), ("02 123 4567", "02-123-4567"), ("031-1234-5678", "031-1234-5678"), ("12345", "")])
def test_phones(spark, raw, want):
    assert one(spark, X.normalize_phone(X.repair_digits(F.lit(raw)))) == want


@pytest.mark.parametrize(("raw", "want"), [("오후 3시 5분", "15:05"), ("오전 12시", "00:00"), ("9:05", "09:05"), ("25:00", ""), ("12시20분", "12:20")])
def test_times(spark, raw, want):
    assert one(spark, X.normalize_time(F.lit(raw))) == want


def test_labels(spark):
    reg = labels.registry_literal(receipts.FIELDS)
    got = lambda x: one(spark, labels.match_field(F.lit(x), reg)["key"])
    assert got("배송 일자") == "deliveryDate"
    assert got("연락쳐") == "recipientTel"
    assert got("합계 금액") is None


def test_parser(spark):
    text = "인수증\n발주처: 한빛플라워\n품명: 축하 - 축하3단\n배달일시: 2026년 06월 14일(일요일) (예식: 12시20분)\n배달장소: 주소 서울 종로구 세종로 12\n받는분: 김민준 실장"
    rows = receipts.parse_receipts(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")).collect()
    got = {r.key: (r.value, r.status) for r in rows if r.doc_id == 1}
    assert got["orderingVendorName"] == ("한빛플라워", "review")
    assert got["deliveryDate"][0] == "2026-06-14"
    assert got["eventTime"][0] == "12:20"
    assert got["deliveryAddress"] == ("서울 종로구 세종로 12", "review")
    assert got["productQuantity"][0] == "3"
    assert got["recipientName"][0] == "김민준 실장"
    assert len(rows) == 51 and {r.value for r in rows if r.doc_id != 1} == {""}


def test_digits_are_repaired_once(spark):
    """A date reads several groups; the repaired text they come from is worked out once, and by runs instead of characters."""
    assert repr(X.normalize_receipt_date(F.col("t"))).count("regexp_extract_all(") == 1
    assert repr(X.normalize_date(F.col("t"))).count("regexp_extract_all(") == 1
    texts = ["배달일시 2O26-O6-l4 OK", "a\n2O26년 6월 9일", "2026년 13월 40일 2026.6.1", "IlO1", None]
    got = spark.createDataFrame([(x,) for x in texts], "t string").select(X.repair_digits(F.col("t")).alias("r"), X.normalize_receipt_date(F.col("t")).alias("d")).collect()
    assert [r.r for r in got] == ["배달일시 2026-06-14 OK", "a\n2026년 6월 9일", texts[2], "IlO1", None]
    assert [r.d for r in got][:4] == ["2026-06-14", "2026-06-09", "2026-06-01", ""] and not got[4].d


def test_learned_labels_change_no_field(spark):
    lines = [[f"{a}: {a}", f"{a}x：1", "zz: 2"] for _, _, aliases in receipts.FIELDS for a in aliases]
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(lines)], "doc_id int, text string")
    rows = lambda known: sorted(map(str, receipts.parse_receipts(docs, known=known).collect()))
    assert rows(receipts.learn(docs)) == rows(None)


def test_repeated_texts_are_parsed_once(spark, monkeypatch):
    """Documents share the rows of their text; the parser sees each text once, whatever the number of documents."""
    texts = ["발주처: 한빛플라워\n상품명: 축하3단화환 수량: 2", "배송지\n서울 강남구 테헤란로 7", "", None]
    docs = spark.createDataFrame([(i % 38, texts[i % 4]) for i in range(40)], "doc_id int, text string")
    want = sorted(map(str, receipts.parse_receipts(docs).collect()))
    seen, parse = [], receipts.parse_receipts

    def spy(df, *args, **kw):
        seen.append(df.count())
        return parse(df, *args, **kw)

    monkeypatch.setattr(receipts, "parse_receipts", spy)
    got = receipts.parse_texts_once(docs)
    assert sorted(map(str, got.select(*parse(docs).columns).collect())) == want and len(want) == 40 * 17 and seen == [3]


def test_lines_are_cut_at_embedded_labels(spark):
    lines = ["상품명: 화환 수량: 2", "수량: 2", "(수량: 2)", "가수량: 2", "주소 상품명：a\n수량 : 1", "없음", ""]
    got = [r.p for r in spark.createDataFrame([(x,) for x in lines], "t string").select(receipts.split_embedded(F.col("t")).alias("p")).collect()]
    assert got == [["상품명: 화환", "수량: 2"], ["수량: 2"], ["(수량: 2)"], ["가수량: 2"], ["주소", "상품명：a", "수량 : 1"], ["없음"], [""]]


def test_orientation_does_not_depend_on_the_order_of_lines(spark):
    """The mean is 0.45, though as a sum of doubles it is less in some orders."""
    conf, mean = [c / 100 for c in range(10, 81)], lambda xs: functools.reduce(lambda a, b: a + b, xs) / len(xs)
    orders = [random.Random(i).sample(conf, len(conf)) for i in range(20)]
    low = next(xs for xs in orders if mean(xs) < 0.45)
    for xs in (conf, low):
        rows = spark.createDataFrame([(1, 0, "line", c, None) for c in xs], "image int, orientation int, text string, confidence double, region_score double").coalesce(1)
        r = evaluation.orientation_scores(rows).first()
        assert r.good and r.conf == 0.45 and r.lines == 71


def test_line_fold_loses_nothing(spark):
    lines = ["Order shop: A", "Product", "roses", "", "hello", "Zone code: 7", "Product: tulips"]
    p = receipts.parse_lines(spark.createDataFrame([(1, lines)], "doc_id int, t array<string>"), "t", __import__("waybill.sources.bindings", fromlist=["REGISTRY"]).REGISTRY)
    fields, rest = receipts.fold_lines(p.select("doc_id", F.explode("parsed").alias("p")).select("doc_id", "p.*"))
    assert {(r.key, r.value) for r in fields.collect()} == {("orderingVendorName", "A"), ("productName", "roses")}
    assert {(r.label, r.value) for r in rest.collect()} == {("", "hello"), ("Zone code", "7"), ("Product", "tulips")}
    row = p.select(receipts.fold_in_row(F.col("parsed")).alias("f")).first().f
    assert row.fields == {"orderingVendorName": "A", "productName": "roses"} and len(row.unmapped) == 3


def test_tour_is_a_permutation(spark):
    rows = [(1, i, 37.5 + (i * 7 % 5) / 50, 127.0 + (i * 3 % 7) / 50) for i in range(9)] + [(2, 0, None, None), (2, 1, 37.5, 127.0)]
    got = routing.nearest_neighbor(spark.createDataFrame(rows, "route int, ord int, latitude double, longitude double")).orderBy("route", "visit").collect()
    assert sorted(r.ord for r in got if r.route == 1) == list(range(9)) and [r.ord for r in got if r.route == 2] == [1, 0]


def test_skew_of_a_grid(spark):
    import math

    rows = []
    for doc, deg in enumerate((0, 7, -9, 14)):
        t = math.radians(deg)
        rows += [(doc, x * math.cos(t) - y * math.sin(t) - 45, x * math.sin(t) + y * math.cos(t) - 12, 90.0, 24.0) for y in range(0, 400, 40) for x in range(0, 360, 120)]
    got = {r.doc_id: (r.degrees, r.confident) for r in spatial.skew(spark.createDataFrame(rows, "doc_id int, x double, y double, width double, height double")).collect()}
    assert got[0][1] is False
    for doc, deg in ((1, 7), (2, -9), (3, 14)):
        assert got[doc][1] and abs(got[doc][0] - deg) <= 2


def test_venue_join_equals_all_pairs(spark):
    names = ["중앙대학교병원 장례식장", "서울대학교병원", "그랜드 호텔", "grand hotel hall", "abc"]
    v = spark.createDataFrame([(n, n, i, None) for i, n in enumerate(names)], "name string, form string, ord int, type string")
    q = spark.createDataFrame([(1, "중앙대 학교병원 장례식장 5호"), (2, "Grand-Hotel"), (3, "zz")], "id int, text string")
    norm = lambda t: re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", t).lower())

    def score(x, y):
        m = difflib.SequenceMatcher(None, x, y, autojunk=False).find_longest_match().size
        return 1.0 if x == y else max(0.6, min(1.0, len(y) / 5)) if len(y) >= 4 and y in x else len(x) / len(y) if x in y else m / min(len(x), len(y)) if m >= 4 else 0.0

    want = {(i, n) for i, t in ((r.id, norm(r.text)) for r in q.collect()) for n in names if len(t) >= 4 and len(norm(n)) >= 4 and score(t, norm(n)) >= 0.6}
    assert {(r.id, r.name) for r in venues.match_venues(q, v).collect()} == want != set()
    full = spark.createDataFrame([(4, "ＧＲＡＮＤ　ＨＯＴＥＬ hall")], "id int, text string")
    assert [r.name for r in venues.match_venues(full, v).collect()] == ["grand hotel hall"]
    assert one(spark, X.compose_venue(F.lit("H"), F.lit("병원 장례식장 105 호실"))) == "H 105호실"


def test_golden_against_itself(spark):
    s = spark.createDataFrame([("발주처: [불명] A-1", "발주처: [불명] A-1"), ("x", None)], "golden string, prediction string")
    got = evaluation.summarize(evaluation.score_samples(s.limit(1))).first()
    assert (got.cer_micro, got.coverage) == (0.0, 1.0)


def test_regions(spark):
    p = [[0.0] * 40 for _ in range(40)]
    for y in (10, 11, 12):
        for x in [*range(5, 15), *range(18, 30)]:
            p[y][x] = 0.9
    maps = spark.createDataFrame([(1, [v for r in p for v in r], 40, 40, 400.0, 400.0)], "image int, map array<double>, width int, height int, source_w double, source_h double")
    regions = imaging.detect(maps).first().regions
    assert len(regions) == 1 and regions[0].score == pytest.approx(0.9)
    assert one(spark, imaging.step_probability(F.array(*[F.lit(x) for x in (0.1, 0.7, 0.2)]))["label"]) == 1


FOUND = [{"key": "venueName", "value": "A", "confidence": 90.0, "status": "review", "errors": []}, {"key": "deliveryAddress", "value": "B", "confidence": 85.0, "status": "confirmed", "errors": []}, {"key": "recipientTel", "value": "010-1234-5678", "confidence": 85.0, "status": "review", "errors": []}]
FRAME = "session string, frame_id string, captured_ms long, passed boolean, processing_ms long, found array<struct<key:string,value:string,confidence:double,status:string,errors:array<string>>>"


def frames(spark):
    rows = [("s", "1", 1000, True, 10, FOUND), ("s", "2", 1200, True, 10, FOUND), ("s", "3", 1600, False, 10, FOUND), ("s", "4", 2200, True, 10, FOUND)]
    return spark.createDataFrame([(a, b, c, d, e, [tuple(f.values()) for f in g]) for a, b, c, d, e, g in rows], FRAME)


def test_live_session(spark):
    got = live.batch(frames(spark)).orderBy("captured_ms").collect()
    assert [r.decision for r in got] == ["accepted", "skipped-interval", "rejected-quality", "ready"] and got[-1].locked == 3


def test_stream_equals_batch(spark, tmp_path):
    f = frames(spark)
    f.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = live.stream(spark.readStream.schema(f.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("live_out").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    want = sorted((r.frame_id, r.decision, r.locked) for r in live.batch(f).collect())
    assert sorted((r.frame_id, r.decision, r.locked) for r in spark.table("live_out").collect()) == want


def test_every_query_with_sql_is_registered():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
