"""Queries over registration, settings, reports and late changes, each with its SQL for checking."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.functions import text as X
from waybill.operators import changes, evaluation, gates, imaging, receipts, registration, reports, routing, settings, spatial, venues
from waybill.sources import bindings as B
from waybill.sources import files, ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _pick(k, *xs):
    return F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))


# settings and accounts

DISTRICTS = {"Seoul": ("Gangnam", "Mapo"), "Gyeonggi": ("Suwon",)}


def _stored(spark, d):
    k = F.col("c_custkey")
    n = (k % 7 * 1000).cast("string")
    v2 = F.concat(F.lit('{"fees":{"defaultFee":'), n, F.lit(',"districtFees":{"Seoul":{"Mapo":'), n, F.lit('}}},"route":{"navApp":"'), _pick(k, "tmap", "waze"), F.lit('"},"costs":"none"}'))
    v1 = F.concat(F.lit('{"districtFees":{"Suwon":'), n, F.lit(',"Elsewhere":1},"vehicleModel":"'), _pick(k, "", "Van"), F.lit('","fuelEfficiency":"high"}'))
    return B.read(spark, d, "customer").select(k.alias("user_id"), F.when(k % 4 == 0, v2).when(k % 4 == 1, "{broken").alias("v2"), F.when(k % 4 == 2, v1).alias("v1"))


@query(
    """SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 7 * 1000.0::DOUBLE ELSE 15000.0::DOUBLE END AS default_fee, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 7 * 1000.0::DOUBLE ELSE 15000.0::DOUBLE END AS mapo,
  15000.0::DOUBLE AS gangnam, CASE WHEN c_custkey % 4 = 2 THEN c_custkey % 7 * 1000.0::DOUBLE ELSE 15000.0::DOUBLE END AS suwon, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 2 = 0 THEN 'tmap' ELSE 'google' END AS nav_app,
  CASE WHEN c_custkey % 4 = 2 AND c_custkey % 2 = 1 THEN 'Van' ELSE '현대 포터2' END AS vehicle, 12.4::DOUBLE AS efficiency, c_custkey % 4 IN (2, 3) AS migrated FROM customer"""
)
def settings_load(spark, d):
    s = settings.load(_stored(spark, d), DISTRICTS)
    fee = lambda region, name: F.try_element_at(f"fees_{region}", F.lit(name))
    return s.select(
        "user_id", F.col("fees_defaultFee").alias("default_fee"), fee("Seoul", "Mapo").alias("mapo"), fee("Seoul", "Gangnam").alias("gangnam"), fee("Gyeonggi", "Suwon").alias("suwon"), F.col("route_navApp").alias("nav_app"),
        F.col("costs_vehicleModel").alias("vehicle"), F.col("costs_fuelEfficiency").alias("efficiency"), "migrated",
    )


@query(
    """SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 7 * 1000.0::DOUBLE ELSE 15000.0::DOUBLE END AS default_fee, CASE WHEN c_custkey % 4 = 2 THEN c_custkey % 7 * 1000.0::DOUBLE ELSE 15000.0::DOUBLE END AS suwon FROM customer"""
)
def settings_round_trip(spark, d):
    """Saved and loaded again: what was migrated is now of the current version."""
    again = settings.load(settings.save(settings.load(_stored(spark, d), DISTRICTS)).withColumn("v1", F.lit(None).cast("string")), DISTRICTS).where("not migrated")
    return again.select("user_id", F.col("fees_defaultFee").alias("default_fee"), F.try_element_at("fees_Gyeonggi", F.lit("Suwon")).alias("suwon"))


@query("SELECT c_custkey, c_custkey % 5 = 0 AS valid, CASE WHEN c_custkey % 5 = 0 THEN c_name END AS name FROM customer")
def account_validity(spark, d):
    k = F.col("c_custkey")
    text = F.when(k % 5 == 0, F.concat(F.lit('{"profile":{"name":"'), "c_name", F.lit('"},"vehicles":[1]}'))).when(k % 5 == 1, '{"profile":{}}').when(k % 5 == 2, '{"vehicles":[]}').when(k % 5 == 3, "{")
    a = B.read(spark, d, "customer").select(k, settings.account(text).alias("a"))
    return a.select("c_custkey", F.col("a").isNotNull().alias("valid"), F.try_variant_get("a", "$.profile.name", "string").alias("name"))


# registration


def _cards(spark, d):
    """Documents and their field rows, made of orders."""
    k = F.col("o_orderkey")
    o = B.orders(spark, d)
    k = F.col("order_key")
    selected = F.when(k % 5 != 0, F.struct(F.col("address").alias("display"), F.lit(37.5).alias("latitude"), F.lit(127.0).alias("longitude")))
    docs = o.select(k.alias("doc_id"), F.when(k % 7 == 0, " ").otherwise("read").alias("text"), selected.alias("selected"), F.concat(F.lit("delivery-"), k.cast("string")).alias("delivery_id"))
    rows = [
        ("orderingVendorName", "Vendor", False, F.concat(F.lit(" "), F.col("vendor_name"))), ("productName", "Product", True, F.when(k % 3 == 0, "").otherwise(F.coalesce("product_name", F.lit("wreath")))),
        ("productQuantity", "Quantity", False, _pick(k, "2", "x", "")), ("deliveryDate", "Date", True, F.when(k % 4 == 0, " ").otherwise(F.lit("2026-06-14"))), ("strictTime", "Time", False, _pick(k, "10:30", "")),
        ("deliveryAddress", "Address", True, F.col("address")), ("recipientTel", "Phone", False, _pick(k, "010-1234-5678", "")), ("venueName", "Venue", False, F.coalesce("venue_name", F.lit(""))),
    ]
    f = o.select(k.alias("doc_id"), F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(key).alias("key"), F.lit(label).alias("label"), F.lit(need).alias("required"), v.alias("value"), (k % 50 + i).cast("int").alias("confidence")) for i, (key, label, need, v) in enumerate(rows)])).alias("f"))
    return docs, f.select("doc_id", "f.*")


_GATE = B.with_ctes("b_orders") + """, g AS (SELECT *, CASE WHEN order_key % 7 = 0 THEN '인식' WHEN order_key % 3 = 0 OR order_key % 4 = 0 THEN concat_ws(', ', CASE WHEN order_key % 3 = 0 THEN 'Product' END, CASE WHEN order_key % 4 = 0 THEN 'Date' END) WHEN order_key % 5 = 0 THEN '주소' END AS broken FROM b_orders)"""


@query(
    _GATE
    + f""" SELECT order_key AS doc_id, CASE broken WHEN '인식' THEN '{registration.NOTHING_READ}' WHEN '주소' THEN '{registration.ADDRESS_NOT_CHOSEN}' ELSE broken || '{registration.MISSING_END}' END AS error FROM g"""
)
def registration_gate(spark, d):
    return registration.registration_errors(*_cards(spark, d))


@query(
    _GATE.replace("WITH ", "WITH b_fees AS (" + B.CTES["b_fees"] + "),\n", 1)
    + """, priced AS (SELECT g.*, (SELECT arg_min(f.district, f.ord) FROM b_fees f WHERE contains(replace(g.address, ' ', ''), f.district)) AS district, (SELECT arg_min(f.fee_cents, f.ord) FROM b_fees f WHERE contains(replace(g.address, ' ', ''), f.district)) AS configured FROM g WHERE broken IS NULL)
SELECT 'delivery-' || order_key AS id, vendor_name AS vendor, CASE WHEN order_key % 3 = 0 THEN 2 END AS quantity, '2026-06-14' AS service_date, CASE WHEN order_key % 2 = 0 THEN '2026-06-14T10:30:00+09:00' END AS deadline, address, coalesce(configured, 1500000) / 100.0::DOUBLE AS fee, district, 'ocr' AS source FROM priced"""
)
def registered_orders(spark, d):
    docs, f = _cards(spark, d)
    o = registration.register(docs, f, B.fees(spark, d), "2026-06-01T00:00:00Z")
    return o.select(
        "id", F.col("orderingVendor.name").alias("vendor"), F.col("product.quantity").alias("quantity"), F.col("schedule.serviceDate").alias("service_date"), F.col("schedule.strictDeadlineAt").alias("deadline"), "destination.address", "settlement.fee",
        "settlement.district", F.col("source.type").alias("source"),
    )


@query(
    B.with_ctes("b_orders")
    + """ SELECT order_key AS doc_id, address AS delivery_address, NULL::VARCHAR AS recipient_name, CASE WHEN order_key % 3 <> 0 THEN coalesce(product_name, 'wreath') END AS product_name, floor((order_key % 50) + 3 + 0.5 + (1 + 3 + 5 - 9) / 3.0::DOUBLE)::INT AS document_confidence FROM b_orders"""
)
def archive_summaries(spark, d):
    return registration.archive_summary(_cards(spark, d)[1])


@query(B.with_ctes("b_orders") + " SELECT order_key AS doc_id, trim(vendor_name) AS vendor_name, CASE WHEN order_key % 2 = 0 THEN '010-1234-5678' END AS vendor_phone FROM b_orders")
def review_queries(spark, d):
    return registration.review_query(_cards(spark, d)[1])


@query(
    """WITH s AS (SELECT event_id, user_id AS doc_id, event_id % 2 = 0 AS first, (event_id % 40)::INT AS c, (event_id % 4)::BIGINT AS r, (event_id % 9)::BIGINT AS p FROM events), a AS (SELECT doc_id, arg_min({'c': c, 's': c + r * 8 + p * 2}, event_id) FILTER (first) AS a, arg_min({'c': c, 's': c + r * 8 + p * 2}, event_id) FILTER (NOT first) AS b FROM s GROUP BY doc_id)
SELECT doc_id, CASE WHEN b.s > a.s AND b.c >= a.c - 2 THEN 'rotated' ELSE 'first' END AS variant, CASE WHEN b IS NOT NULL THEN 2 ELSE 1 END AS variants_compared FROM a"""
)
def deskew_choice(spark, d):
    from waybill.operators.joins import first_rows

    e = F.col("event_id")
    s = B.read(spark, d, "events").select(e.alias("e"), F.col("user_id").alias("doc_id"), F.when(e % 2 == 0, "first").otherwise("rotated").alias("variant"), (e % 40).cast("int").alias("document_confidence"), (e % 4).alias("required"), (e % 9).alias("populated"))
    return registration.choose_variant(first_rows(s, ["doc_id", "variant"], [F.col("e")]))


@query()
def receipt_pipeline(spark, d):
    """Recognised lines to results; the parser has no SQL, so unit tests and the tables it is made of stand for it."""
    k = F.col("o_orderkey")
    o = B.read(spark, d, "orders").select(k.alias("doc_id"))
    assets = o.select("doc_id", F.when(F.col("doc_id") % 5 != 0, "file").alias("uri"), F.when(F.col("doc_id") % 6 == 0, "발주처: 한빛플라워\n배달일시: 2026년 06월 14일").alias("raw_text"))
    said = F.array(F.lit("발주처: 한빛플라워"), F.lit("상품명: 축하3단화환"), F.concat(F.lit("배달일시: 2026년 06월 "), (F.col("doc_id") % 28 + 1).cast("string"), F.lit("일")), F.lit("배송주소: 서울 종로구 세종로 12"))
    recognised = o.select("doc_id", F.lit("first").alias("variant"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.array_join(said, "\n")).alias("full_text"))
    lines = o.where("doc_id % 4 = 1").select("doc_id", F.posexplode(said).alias("i", "text")).select("doc_id", F.lit("first").alias("variant"), (F.col("i") + 1).alias("line_no"), "text", F.lit(40.0).alias("x"), (F.col("i") * 50.0).alias("y"), F.lit(400.0).alias("width"), F.lit(30.0).alias("height"), F.lit(80.0).alias("confidence"))
    return registration.read_receipts(assets, recognised, lines, 2026)[0].select("doc_id", "status", "variant", "variants_compared", "document_confidence", "fallback", "core_fields")


# small projections


@query("WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 160 THEN substr(t, 1, 160) || '…' ELSE t END AS preview FROM t")
def text_previews(spark, d):
    return B.read(spark, d, "documents").select("doc_id", registration.preview(F.coalesce("text", F.lit(""))).alias("preview"))


@query("SELECT event_id, CASE WHEN event_id % 3 = event_id % 2 THEN ['a' || event_id % 3] ELSE ['a' || event_id % 3, 'a' || event_id % 2] END AS messages FROM events")
def message_dedupe(spark, d):
    e = F.col("event_id")
    m = lambda n: F.array(F.concat(F.lit("a"), (e % n).cast("string")))
    return B.read(spark, d, "events").select(e, registration.messages(m(3), m(2)).alias("messages"))


@query("SELECT n_name AS district FROM nation WHERE contains(replace(n_name, ' ', ''), 'TION_1')")
def district_search(spark, d):
    return registration.district_search(B.fees(spark, d), " TION _1 ").select("district")


@query(B.with_ctes("b_orders") + " SELECT service_date AS route, round(sum(distance_km), 6) AS distance_km FROM b_orders GROUP BY 1")
def route_lengths(spark, d):
    return registration.route_length(B.orders(spark, d).withColumnRenamed("service_date", "route"))


@query(
    B.with_ctes("b_orders")
    + """ SELECT id, row_number() OVER (PARTITION BY vendor_name ORDER BY fee_cents DESC, id) AS by_fee, row_number() OVER (PARTITION BY vendor_name ORDER BY order_key DESC, id) AS newest, row_number() OVER (PARTITION BY vendor_name ORDER BY strict_deadline_at NULLS LAST, id) AS by_time FROM b_orders"""
)
def delivery_lists(spark, d):
    o = B.orders(spark, d).withColumns({"driver": F.col("vendor_name"), "sort_key": F.col("strict_deadline_at")})
    for by, name in (("fee", "by_fee"), ("newest", "newest"), ("time", "by_time")):
        o = registration.delivery_list(o, by).withColumnRenamed("place", name)
    return o.select("id", "by_fee", "newest", "by_time")


@query("SELECT label, dense_rank() OVER (ORDER BY lower(label), label) AS place FROM (SELECT c_name AS label FROM customer UNION ALL SELECT p_name FROM part)")
def labels_by_locale(spark, d):
    names = B.read(spark, d, "customer").select(F.col("c_name").alias("label")).unionByName(B.read(spark, d, "part").select(F.col("p_name").alias("label")))
    return registration.by_locale(names, "label")


@query(
    """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'nobody' ELSE ' a' || c_custkey || '@b.cd ' END AS email, 'bug' AS kind, c_name AS subject, repeat('text ' || c_custkey || ' ', (c_custkey % 200)::INT) AS content, c_custkey % 3 AS images FROM customer),
h AS (SELECT *, '문의 유형: ' || kind || chr(10) || '회신 이메일: ' || trim(email) || chr(10) || chr(10) AS head, CASE WHEN images > 0 THEN chr(10) || chr(10) || '(첨부 이미지 ' || images || '장은 메일 작성 화면에서 직접 추가해 주세요.)' ELSE '' END AS tail, trim(content) AS said FROM c),
b AS (SELECT *, 1400 - length(head) - length(tail) AS room FROM h)
SELECT c_custkey, regexp_full_match(trim(email), '[^\\s@]+@[^\\s@]+\\.[^\\s@]+') AND length(said) >= 10 AS complete, length('mailto:to@x.yz?subject=') + length(url_encode('[waybill 문의] ' || kind || ' · ' || subject)) + length('&body=') + length(url_encode(head || CASE WHEN length(said) > room THEN substr(said, 1, room - 1) || '…' ELSE said END || tail)) AS link_length FROM b"""
)
def inquiry_links(spark, d):
    k = F.col("c_custkey")
    c = B.read(spark, d, "customer").select(k, F.when(k % 3 == 0, "nobody").otherwise(F.concat(F.lit(" a"), k.cast("string"), F.lit("@b.cd "))).alias("email"), F.lit("bug").alias("kind"), F.col("c_name").alias("subject"), F.repeat(F.concat(F.lit("text "), k.cast("string"), F.lit(" ")), (k % 200).cast("int")).alias("content"), (k % 3).alias("images"))
    x = [F.col(n) for n in ("email", "kind", "subject", "content")]
    return c.select("c_custkey", registration.inquiry_complete(*x).alias("complete"), F.length(registration.inquiry_link("to@x.yz", "waybill", *x, F.col("images"))).cast("long").alias("link_length"))


# reports


def _read(spark, d):
    """Texts and fields with sources, made of parts."""
    k = F.col("p_partkey")
    p = B.read(spark, d, "part")
    text = F.concat(F.lit("A12 010-9999-8888\nShop: "), "p_brand", F.lit("\nProduct | "), "p_name", F.lit("\nＮｏ ５"))
    texts = p.select(k.alias("doc_id"), text.alias("text"))
    field = lambda key, v, s: F.struct(F.lit(key).alias("key"), v.alias("value"), s.alias("source"))
    rows = F.array(
        field("orderingVendorName", F.col("p_brand"), F.when(k % 2 == 0, F.concat(F.lit("Shop: "), "p_brand")).otherwise("elsewhere")), field("productName", F.when(k % 3 == 0, "").otherwise(F.col("p_name")), F.lit("")),
        field("recipientTel", _pick(k, "010-9999-8888", "02-123", "010-1111-2222", ""), _pick(k, "", "", "tel", "")), field("memo", _pick(k, "no 5", "call 010-123-", "made up"), F.lit("")), field("recipientName", _pick(k, "kim", "플라워"), F.lit("Shop")),
    )
    return texts, p.select(k.alias("doc_id"), F.explode(rows).alias("f")).select("doc_id", "f.*")


_READ = """WITH f AS (
  SELECT p_partkey AS doc_id, p_brand, p_name, x.* FROM part, LATERAL (SELECT unnest([
    {'key': 'orderingVendorName', 'value': p_brand, 'p': CASE WHEN p_partkey % 2 = 0 THEN 'sourceText' ELSE 'rawFallback' END},
    {'key': 'productName', 'value': CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END, 'p': CASE WHEN p_partkey % 3 = 0 THEN 'missing' ELSE 'rawFallback' END},
    {'key': 'recipientTel', 'value': ['010-9999-8888', '02-123', '010-1111-2222', ''][p_partkey % 4 + 1], 'p': ['rawFallback', 'unsupported', 'unsupported', 'missing'][p_partkey % 4 + 1]},
    {'key': 'memo', 'value': ['no 5', 'call 010-123-', 'made up'][p_partkey % 3 + 1], 'p': ['rawFallback', 'unsupported', 'unsupported'][p_partkey % 3 + 1]},
    {'key': 'recipientName', 'value': ['kim', '플라워'][p_partkey % 2 + 1], 'p': 'sourceText'}]) AS x0) AS t(x0), LATERAL (SELECT x0.key AS key, x0.value AS value, x0.p AS provenance) AS x)"""


@query(_READ + " SELECT doc_id, key, value, provenance FROM f")
def field_provenance(spark, d):
    texts, f = _read(spark, d)
    return reports.field_provenance(f, texts).select("doc_id", "key", "value", "provenance")


@query(
    _READ
    + """ SELECT doc_id, count(*) FILTER (value <> '') AS populated, count(*) FILTER (provenance = 'unsupported') AS unsupported, count(*) FILTER (provenance = 'rawFallback') AS raw_fallback,
  CASE WHEN doc_id % 3 = 0 THEN ['deliveryDate', 'productName', 'deliveryAddress'] ELSE ['deliveryDate', 'deliveryAddress'] END AS missing_required FROM f GROUP BY doc_id"""
)
def parser_summaries(spark, d):
    texts, f = _read(spark, d)
    return reports.parser_summary(reports.field_provenance(f, texts))


_RISKS = ", r AS (SELECT doc_id, count(*) FILTER (value <> '') AS populated, count(*) FILTER (provenance = 'unsupported') AS unsupported, [1, 1, 0, 0][doc_id % 4 + 1] + [0, 1, 0][doc_id % 3 + 1] + doc_id % 2 AS false_data, 0 AS review FROM f GROUP BY doc_id)"


@query(_READ + _RISKS + " SELECT doc_id, populated, unsupported, false_data, review, []::VARCHAR[] AS leaked, unsupported = 0 AS passed FROM r")
def fabrication_check(spark, d):
    texts, f = _read(spark, d)
    return reports.anti_fabrication(reports.field_provenance(f, texts), texts, ["DEMO-1"])[0]


@query(_READ + _RISKS + " SELECT count(*) AS documents, count(*) FILTER (unsupported = 0) AS passed, 0 AS leaks, sum(unsupported)::BIGINT AS unsupported, sum(false_data)::BIGINT AS false_data, 0 AS review FROM r")
def fabrication_totals(spark, d):
    texts, f = _read(spark, d)
    return reports.anti_fabrication(reports.field_provenance(f, texts), texts, ["DEMO-1"])[1]


def _golden(spark, d):
    k = F.col("p_partkey")
    text = F.concat(F.lit("수량: "), (k % 9).cast("string"), F.lit("\n발주처: "), "p_brand", F.lit("\r\n배달일시: 2026년 6월 "), (k % 28 + 1).cast("string"), F.lit("일\n핸드폰: 010-1234-"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("\n발주처: second\n요구사항:"))
    return B.read(spark, d, "part").select(k.alias("doc_id"), text.alias("text"))


_GOLDEN = """WITH g AS (SELECT p_partkey AS doc_id, p_brand, unnest([{'key': 'productQuantity', 'expected': (p_partkey % 9)::VARCHAR}, {'key': 'orderingVendorName', 'expected': p_brand}, {'key': 'deliveryDate', 'expected': '2026년 6월 ' || (p_partkey % 28 + 1) || '일'}, {'key': 'recipientTel', 'expected': '010-1234-' || lpad((p_partkey % 10000)::VARCHAR, 4, '0')}]) AS x FROM part)"""


@query(_GOLDEN + " SELECT doc_id, x.key, x.expected FROM g")
def golden_fields(spark, d):
    return reports.golden_fields(_golden(spark, d))


@query(_GOLDEN + ", n AS (SELECT DISTINCT doc_id FROM g) SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS required, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 2 END AS populated, (doc_id % 2 = 0)::INT + (doc_id % 3 = 0)::INT + 1 AS hits FROM n")
def golden_hits(spark, d):
    k = F.col("p_partkey")
    field = lambda key, v: F.struct(F.lit(key).alias("key"), v.alias("value"))
    day = F.concat(F.lit("2026-06-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))
    rows = F.array(field("deliveryDate", F.when(k % 2 == 0, day).otherwise("")), field("recipientTel", F.when(k % 3 == 0, F.concat(F.lit("1234"), F.lpad((k % 10000).cast("string"), 4, "0"))).otherwise("02-777-8888")), field("orderingVendorName", F.concat(F.lit("the "), "p_brand", F.lit(" shop"))))
    f = B.read(spark, d, "part").select(k.alias("doc_id"), F.explode(rows).alias("f")).select("doc_id", "f.*")
    return reports.golden_summary(f, reports.golden_fields(_golden(spark, d)))


_HYP = """WITH s AS (SELECT doc_id, quality = 1 AS passed, doc_id % 5 = 0 AS empty, doc_id % 4 AS missing_required, doc_id % 7 AS populated, CASE WHEN doc_id % 3 > 0 THEN doc_id % 9 END AS previous FROM labels),
h AS (SELECT *, list_filter([CASE WHEN passed AND (empty OR missing_required >= 2) THEN 'QUALITY_GATE_FALSE_POSITIVE' END, CASE WHEN NOT empty AND missing_required >= 2 THEN 'PARSER_MAPPING_FAILURE' END, CASE WHEN NOT empty AND populated < previous THEN 'CURRENT_PARSER_REGRESSION' END], lambda x: x IS NOT NULL) AS labels FROM s)"""


def _hypotheses(spark, d):
    k = F.col("doc_id")
    s = B.read(spark, d, "labels").select(k, (F.col("quality") == 1).alias("passed"), (k % 5 == 0).alias("empty"), (k % 4).alias("missing_required"), (k % 7).alias("populated"), F.when(k % 3 > 0, k % 9).alias("previous"), (k % 10 / 10).alias("cer"), (k % 8 / 8).alias("coverage"))
    return s.withColumn("labels", reports.hypotheses(*[F.col(c) for c in ("passed", "empty", "missing_required", "populated", "previous")]))


@query(_HYP + " SELECT doc_id, labels FROM h")
def hypothesis_labels(spark, d):
    return _hypotheses(spark, d).select("doc_id", "labels")


@query(
    _HYP
    + """ SELECT count(*) AS samples, count(*) FILTER (passed) AS quality_passes, count(*) FILTER (NOT empty) AS non_empty, round(avg(doc_id % 10 / 10), 4) AS cer_macro, round(avg(doc_id % 8 / 8), 4) AS coverage, round(avg(populated), 2) AS populated,
  count(*) FILTER (missing_required >= 2) AS with_gaps, count(*) FILTER (list_contains(labels, 'QUALITY_GATE_FALSE_POSITIVE')) AS false_positives FROM h"""
)
def hypothesis_means(spark, d):
    return reports.hypothesis_summary(_hypotheses(spark, d))


@query("SELECT c_custkey AS config, (c_custkey * 7919 % 1000)::BIGINT AS score FROM customer ORDER BY score DESC, config LIMIT 10")
def top_configurations(spark, d):
    s = B.read(spark, d, "customer").select(F.col("c_custkey").alias("config"), (F.col("c_custkey") * 7919 % 1000).alias("score"))
    return reports.best_configurations(s, ["config"])


_ENGINES = """WITH i AS (SELECT s_suppkey AS image, CASE WHEN s_suppkey % 11 <> 0 THEN 'u' END AS uri FROM supplier), e AS (SELECT * FROM (VALUES ('a', 1, true), ('b', 2, true), ('c', 3, false)) AS t(engine, ord, available)),
r AS (SELECT i.image, e.engine, e.ord, CASE WHEN NOT available THEN 'skipped' WHEN uri IS NULL THEN 'unavailable' WHEN (image + ord) % 4 = 0 THEN 'no-text' WHEN (image + ord) % 9 = 0 THEN 'error' ELSE 'success' END AS status, available AND uri IS NOT NULL AS ran, image * ord % 6 AS populated, image * ord % 40 AS conf FROM i, e),
x AS (SELECT *, CASE WHEN ran THEN length('text ' || image) ELSE 0 END AS text_length FROM r)"""


def _engines(spark, d):
    k = F.col("s_suppkey")
    images = B.read(spark, d, "supplier").select(k.alias("image"), F.when(k % 11 != 0, "u").alias("uri"))
    engines = spark.createDataFrame([("a", 1, True, None), ("b", 2, True, None), ("c", 3, False, "not here")], "engine string, ord int, available boolean, reason string")
    m = F.col("image") + F.col("ord")
    runs = images.join(F.broadcast(engines.select("engine", "ord"))).select(  # three engines
        "image", "engine", F.when(m % 4 == 0, "no-text").when(m % 9 == 0, "error").otherwise("success").alias("outcome"), F.concat(F.lit(" text  "), F.col("image").cast("string")).alias("text"), F.lit(3).alias("line_count"), F.lit(5).alias("processing_ms"),
        (F.col("image") * F.col("ord") % 6).alias("populated"), F.lit(3).alias("required"), F.lit(0).alias("missing_required"), (F.col("image") * F.col("ord") % 40).alias("document_confidence"), F.lit("message").alias("message"),
    )
    return reports.compare_engines(images, engines, runs)


@query(_ENGINES + " SELECT image, engine, status, CASE WHEN ran THEN length(' text  ' || image) ELSE 0 END AS text_length, CASE WHEN ran THEN 'text ' || image ELSE '' END AS preview, CASE WHEN status = 'success' THEN populated ELSE 0 END AS populated FROM x")
def engine_outcomes(spark, d):
    return _engines(spark, d)[0].select("image", "engine", "status", "text_length", "preview", "populated")


@query(_ENGINES + ", b AS (SELECT image, arg_max(engine, (populated, conf, -ord)) AS best FROM x WHERE status = 'success' GROUP BY image) SELECT i.image, b.best, CASE WHEN b.best IS NULL THEN 'manual-review-required' ELSE 'use-best-candidate' END AS decision FROM i LEFT JOIN b ON b.image = i.image")
def engine_decisions(spark, d):
    return _engines(spark, d)[1]


@query("SELECT user_id AS stream, count(*) FILTER (event_id % 6 <> 0) AS received, count(*) FILTER (event_id % 6 = 0) AS dropped, max(event_id) FILTER (event_id % 6 <> 0) AS last_frame, arg_max('r' || event_id % 4, event_id) FILTER (event_id % 6 = 0) AS last_reason FROM events GROUP BY user_id")
def frame_telemetry(spark, d):
    e = F.col("event_id")
    return reports.stream_telemetry(B.read(spark, d, "events").select(F.col("user_id").alias("stream"), e.alias("ord"), e.alias("frame_id"), F.when(e % 6 == 0, F.concat(F.lit("r"), (e % 4).cast("string"))).alias("drop_reason")))


@query(
    """WITH m AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 10 = 0 THEN 'i' || (p_partkey - 1) ELSE 'i' || p_partkey END AS image FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY ord) AS nth FROM m)
SELECT coalesce(nullif(image, ''), '<missing image>') AS image, e AS error FROM (SELECT image, unnest(list_filter([CASE WHEN image = '' THEN 'image, rawGoldenText, and sha256 are required.' END, CASE WHEN image <> '' AND nth > 1 THEN 'duplicate image.' END,
  CASE WHEN image <> '' AND ord % 7 = 0 THEN 'raw golden text should preserve line-level structure.' END, CASE WHEN image <> '' AND ord % 5 = 0 THEN 'raw golden text contains TODO/FIXME.' END], lambda x: x IS NOT NULL)) AS e FROM n)"""
)
def dataset_validation(spark, d):
    k = F.col("p_partkey")
    p = B.read(spark, d, "part")
    name = F.when(k % 13 == 0, "").when(k % 10 == 0, F.concat(F.lit("i"), (k - 1).cast("string"))).otherwise(F.concat(F.lit("i"), k.cast("string")))
    content = lambda image: F.concat(F.lit("bytes of "), image).cast("binary")
    m = p.select(k.alias("ord"), name.alias("image"), F.concat(F.lit("g"), k.cast("string")).alias("golden"), F.sha2(content(name), 256).alias("sha256"))
    plain = F.concat(F.lit("i"), k.cast("string"))
    images = p.select(plain.alias("path"), content(plain).alias("content"))
    golden = p.select(F.concat(F.lit("g"), k.cast("string")).alias("path"), F.concat(F.lit("a"), F.when(k % 7 == 0, " ").otherwise("\r\n"), F.when(k % 5 == 0, "todo").otherwise("b")).alias("text"))
    return reports.dataset_errors(m, images, golden)


@query(
    """SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 9 END AS original_size, CASE WHEN c_custkey % 3 = 0 THEN 9 END AS prepared_size, CASE WHEN c_custkey % 3 = 0 THEN md5('p' || lpad(c_custkey::VARCHAR, 8, '0')) END AS prepared_md5,
  CASE WHEN c_custkey % 3 = 0 THEN 'prepared' WHEN c_custkey % 5 <> 0 THEN 'original' ELSE 'missing' END AS active, c_custkey % 7 <> 0 AS normalized FROM customer"""
)
def file_evidence(spark, d):
    k = F.col("c_custkey")
    c = B.read(spark, d, "customer").select(k)
    uri = lambda p: F.concat(F.lit(p), F.lpad(k.cast("string"), 8, "0"))
    wanted = c.select(k.alias("doc_id"), uri("o").alias("original"), F.when(k % 7 != 0, uri("p")).when(k % 3 == 0, uri("p")).alias("prepared")).withColumn("prepared", F.when(F.col("doc_id") % 7 == 0, F.when(F.col("doc_id") % 3 == 0, F.col("prepared"))).otherwise(F.col("prepared")))
    f = c.where("c_custkey % 5 <> 0").select(uri("o").alias("uri")).unionByName(c.where("c_custkey % 3 = 0").select(uri("p").alias("uri")))
    out = reports.file_evidence(wanted, f.select("uri", F.length("uri").alias("size"), F.col("uri").cast("binary").alias("content")))
    return out.select("doc_id", "original_size", "prepared_size", "prepared_md5", "active", (F.col("doc_id") % 7 != 0).alias("normalized"))


# late changes and untested corners of the operators


@query("SELECT 'r' || c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'd' || c_custkey WHEN c_custkey % 3 = 0 THEN 'old' END AS linked_delivery_id FROM customer")
def receipt_links(spark, d):
    k = F.col("c_custkey")
    c = B.read(spark, d, "customer")
    r = c.select(F.concat(F.lit("r"), k.cast("string")).alias("id"), F.when(k % 3 == 0, "old").alias("linked_delivery_id"))
    return changes.link(r, c.where(k % 4 == 0).select(F.concat(F.lit("r"), k.cast("string")).alias("id"), F.concat(F.lit("d"), k.cast("string")).alias("delivery_id")))


@query("SELECT n_name AS key, CASE WHEN n_nationkey = 3 THEN ['a', 'b', 'new'] ELSE ['a', 'b'] END AS aliases FROM nation")
def learned_aliases(spark, d):
    r = B.read(spark, d, "nation").select(F.col("n_name").alias("key"), F.concat(F.lit("label "), "n_name").alias("label"), F.array(F.lit("a"), F.lit("b")).alias("aliases"))
    once = changes.learn_alias(r, "NATION_3", "new")
    return changes.learn_alias(changes.learn_alias(once, "NATION_3", "new"), "NATION_4", "label NATION_4").select("key", "aliases")


@query(
    """SELECT l_orderkey || '-' || l_linenumber AS id, CASE WHEN l_orderkey % 5 = 0 THEN 'fixed' WHEN l_orderkey % 2 = 0 THEN '' ELSE 'v' END AS value, CASE WHEN l_orderkey % 5 = 0 THEN greatest(l_orderkey % 100, 85) ELSE l_orderkey % 100 END AS confidence,
  CASE WHEN l_orderkey % 5 = 0 THEN 'confirmed' ELSE 'review' END AS status, CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE 1 END AS errors FROM lineitem"""
)
def manual_corrections(spark, d):
    k = F.col("l_orderkey")
    f = B.read(spark, d, "lineitem").select(k, F.concat_ws("-", k, "l_linenumber").alias("id"), F.when(k % 2 == 0, "").otherwise("v").alias("value"), (k % 100).alias("confidence"), F.lit("review").alias("status"), F.array(F.lit("e")).alias("errors"))
    c = f.where("l_orderkey % 5 = 0").select("id", F.lit("fixed").alias("new_value")).distinct()
    return receipts.correct(f, c, ["id"]).select("id", "value", "confidence", "status", F.size("errors").alias("errors"))


@query(
    """WITH s AS (SELECT c_custkey, ['google', 'tmap', 'naver', 'other'][c_custkey % 4 + 1] AS app, CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE 37.5 END::DOUBLE AS lat, CASE WHEN c_custkey % 9 = 0 THEN 0 WHEN c_custkey % 7 = 0 THEN 181 ELSE 127.25 END::DOUBLE AS lon FROM customer)
SELECT c_custkey, CASE WHEN NOT (lat = 0 AND lon = 0) AND lon <= 180 THEN CASE app WHEN 'tmap' THEN 'tmap://route?goalx=127.25&goaly=37.5&goalname=a%20b' WHEN 'naver' THEN 'nmap://route/car?dlat=37.5&dlng=127.25&dname=a%20b' ELSE 'https://www.google.com/maps/dir/?api=1&destination=37.5%2C127.25' END END AS link FROM s"""
)
def navigation_links(spark, d):
    k = F.col("c_custkey")
    lat, lon = F.when(k % 9 == 0, 0.0).otherwise(37.5), F.when(k % 9 == 0, 0.0).when(k % 7 == 0, 181.0).otherwise(127.25)
    return B.read(spark, d, "customer").select(k, routing.navigation_link(_pick(k, "google", "tmap", "naver", "other"), lat, lon, F.lit("a b")).alias("link"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'c1' END AS selected, CASE WHEN c_custkey % 3 = 0 THEN 'verified' ELSE 'candidate' END AS status FROM customer")
def selected_candidates(spark, d):
    k = F.col("c_custkey")
    c = B.read(spark, d, "customer").select(k, F.lit("candidate").alias("status"), F.array(F.struct(F.lit("c0").alias("id")), F.struct(F.lit("c1").alias("id"))).alias("candidates"))
    return routing.select_candidate(c, F.when(k % 3 == 0, "c1").otherwise("nowhere")).select("c_custkey", "selected", "status")


@query(
    "SELECT o_orderkey AS k, 'pending' AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'd' END AS deadline, NULL::VARCHAR AS completed, true AS cleared, 'now' AS updated FROM orders"
)
def cleared_proofs(spark, d):
    k = F.col("o_orderkey")
    o = B.read(spark, d, "orders").select(k.alias("k"), F.lit("completed").alias("status"), F.struct(F.when(k % 2 == 0, "d").alias("strictDeadlineAt"), F.lit("then").alias("completedAt")).alias("schedule"), F.struct(F.lit("completed").alias("status")).alias("proofOfDelivery"), F.lit("then").alias("updatedAt"))
    c = changes.clear_proof(o, F.lit("now"))
    return c.select("k", "status", F.col("schedule.strictDeadlineAt").alias("deadline"), F.col("schedule.completedAt").alias("completed"), F.col("proofOfDelivery").isNull().alias("cleared"), F.col("updatedAt").alias("updated"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'b' ELSE 'old' END AS address, CASE WHEN c_custkey % 3 = 0 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS latitude FROM customer")
def applied_addresses(spark, d):
    k = F.col("c_custkey")
    c = B.read(spark, d, "customer")
    place = lambda i, a, x: F.struct(F.lit(i).alias("id"), F.lit(a).alias("display"), F.lit(x).alias("latitude"), F.lit(x).alias("longitude"))
    v = routing.select_candidate(c.select(k.alias("id"), F.lit("candidate").alias("status"), F.array(place("c0", "a", 1.0), place("c1", "b", 2.0)).alias("candidates")), F.when(F.col("id") % 3 == 0, "c1").otherwise("nowhere"))
    return routing.apply_selected(c.select(k.alias("id"), F.lit("old").alias("address"), F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude")), v).select("id", "address", "latitude")


@query("SELECT c_custkey, ['safe', 'safe', 'direct', 'direct', 'direct', NULL, NULL][c_custkey % 7 + 1] AS kind FROM customer")
def phone_kinds(spark, d):
    k = F.col("c_custkey")
    return B.read(spark, d, "customer").select(k, X.phone_kind(_pick(k, "1588-1234", "070-1", "010-1", "02-1", "031-1", "", "99")).alias("kind"))


@query(
    """WITH f AS (SELECT c_custkey AS doc_id, ['', 'old', 'old', 'old'][c_custkey % 4 + 1] AS value, ['missing', 'warning', 'warning', 'confirmed'][c_custkey % 4 + 1] AS status, [0, 60, 90, 95][c_custkey % 4 + 1] AS confidence FROM customer)
SELECT doc_id, CASE WHEN doc_id % 4 < 2 OR (doc_id % 4 = 2 AND doc_id % 8 = 2) THEN CASE WHEN doc_id % 8 = 2 THEN 'new longer' ELSE 'new' END ELSE value END AS value, CASE WHEN doc_id % 4 < 2 OR (doc_id % 4 = 2 AND doc_id % 8 = 2) THEN 'review' ELSE status END AS status,
  CASE WHEN doc_id % 4 < 2 OR (doc_id % 4 = 2 AND doc_id % 8 = 2) THEN 70 ELSE confidence END AS confidence FROM f"""
)
def spatial_merge(spark, d):
    k = F.col("c_custkey")
    f = B.read(spark, d, "customer").select(k.alias("doc_id"), F.lit("memo").alias("key"), _pick(k, "", "old", "old", "old").alias("value"), _pick(k, "missing", "warning", "warning", "confirmed").alias("status"), _pick(k, 0, 60, 90, 95).alias("confidence"), F.array().cast("array<string>").alias("alternatives"))
    c = B.read(spark, d, "customer").select(k.alias("doc_id"), F.lit("memo").alias("key"), F.when(k % 8 == 2, "new longer").otherwise("new").alias("value"), F.lit(70).alias("confidence"), F.lit(1).alias("place"))
    return spatial.merge_candidates(f, c).select("doc_id", "value", "status", "confidence")


@query("SELECT p_partkey, [p_name, p_brand, p_type, ''][CASE WHEN p_partkey % 2 = 0 THEN 1 WHEN p_partkey % 3 = 0 THEN 2 WHEN p_partkey % 5 = 0 THEN 3 ELSE 4 END] AS prediction FROM part")
def prediction_precedence(spark, d):
    k = F.col("p_partkey")
    return B.read(spark, d, "part").select(k, evaluation.first_prediction(F.when(k % 2 == 0, F.col("p_name")), F.when(k % 3 == 0, F.col("p_brand")), F.when(k % 5 == 0, F.col("p_type"))).alias("prediction"))


@query(B.with_ctes("b_orders") + " SELECT id, CASE WHEN order_key % 3 = 0 THEN 'p' || (order_key + 1) || '.jpg' WHEN order_key % 5 = 0 THEN 'kept' END AS receipt_photo_path FROM b_orders")
def late_photos(spark, d):
    o = B.orders(spark, d)
    now = o.select("id", F.when(F.col("order_key") % 5 == 0, "kept").alias("receipt_photo_path"))
    path = lambda n: F.concat(F.lit("p"), (F.col("order_key") + n).cast("string"), F.lit(".jpg"))
    late = o.where("order_key % 3 = 0").select("id", F.explode(F.array(F.struct(path(0).alias("path"), F.lit(1).alias("ord")), F.struct(path(1).alias("path"), F.lit(2).alias("ord")))).alias("p")).select("id", "p.*")
    gone = late.select(F.concat("id", F.lit("-gone")).alias("id"), "path", "ord")
    return files.attach_photos(now, late.unionByName(gone))


@query(B.with_ctes("b_orders") + " SELECT service_date, arg_min(id, order_key) AS id FROM b_orders WHERE service_date IS NOT NULL GROUP BY service_date")
def plan_by_date(spark, d):
    """Plans kept under their date: a later save of a date replaces the earlier one; here the least key is saved last."""
    plans = B.orders(spark, d).where("service_date is not null").select("service_date", "id", (-F.col("order_key")).alias("saved"))
    return changes.compact_log(plans, ["service_date"], [F.col("saved")]).select("service_date", "id")


@query("SELECT l_orderkey || '-' || l_linenumber AS id, CASE WHEN l_orderkey % 10 = 0 THEN 'V9' ELSE 'V1' END AS vehicle FROM lineitem")
def log_edits(spark, d):
    """An edited log is built anew and keeps its id."""
    k = F.col("l_orderkey")
    logs = B.read(spark, d, "lineitem").select(F.concat_ws("-", k, "l_linenumber").alias("id"), F.lit("V1").alias("vehicle"), k)
    return changes.upsert(logs.select("id", "vehicle"), logs.where("l_orderkey % 10 = 0").select("id", F.lit("V9").alias("vehicle")), ["id"])


@query("SELECT user_id AS file, n_name AS image FROM (SELECT DISTINCT user_id % 25 AS user_id FROM events) e JOIN nation ON n_nationkey = e.user_id")
def required_match(spark, d):
    e = B.read(spark, d, "events").select((F.col("user_id") % 25).alias("file")).distinct()
    return reports.require_all(e, B.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("file"), F.col("n_name").alias("image")), "file", "baseline")


@query("SELECT 'n/' || c_custkey || '.jpg' AS file, 'x' || c_custkey AS golden FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'n/' || c_custkey || '.jpg', NULL FROM customer WHERE c_custkey % 2 = 1")
def manifest_by_suffix(spark, d):
    k = F.col("c_custkey")
    c = B.read(spark, d, "customer")
    name = F.concat(F.lit("n/"), k.cast("string"), F.lit(".jpg"))
    m = c.where(k % 2 == 0).select(F.concat(F.lit("set/"), name).alias("image"), F.concat(F.lit("x"), k.cast("string")).alias("golden"))
    return reports.by_suffix(c.select(name.alias("file")), m).select("file", "golden")


@query(
    """WITH s AS (SELECT p_partkey, floor((p_size % 100) * 0.27::DOUBLE + (p_size * 3 % 100) * 0.19::DOUBLE + (p_size * 7 % 100) * 0.24::DOUBLE + (p_size * 11 % 100) * 0.15::DOUBLE + (p_size * 13 % 100) * 0.15::DOUBLE + 0.5) AS score FROM part)
SELECT p_partkey, score, score >= 62 AS passed FROM s"""
)
def report_quality_scores(spark, d):
    s = F.col("p_size")
    q = imaging.report_quality(*[(s * n % 100).cast("double") for n in (1, 3, 7, 11, 13)])
    return B.read(spark, d, "part").select("p_partkey", q[0].alias("score"), q[1].alias("passed"))


@query()
def venue_field_suggestions(spark, d):
    """Suggestions for venue fields: the matching behind them is checked against all pairs in the unit tests."""
    from waybill.plans.documents import _venues

    k = F.col("p_partkey")
    key = _pick(k, "venueName", "deliveryAddress", "memo")
    f = B.read(spark, d, "part").select(k.alias("doc_id"), key.alias("key"), F.concat(F.lit("hall of "), F.col("p_name")).alias("value"), F.array().cast("array<string>").alias("alternatives"))
    return venues.suggest_fields(f, _venues(spark, d)).select("doc_id", "key", "alternatives")


def _changed_orders(spark, d):
    """Orders in a store: a base, changes, compaction, and changes again in the same commit as those of another collection."""
    o = B.read(spark, d, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").cast("string").alias("day"))
    days = o.groupBy("day").agg(F.count("*").alias("n"))
    store = ledger.Store(spark, f"{files.shared_dir(spark)}/waybill-{uuid.uuid4().hex}", {"orders": (o.schema, ["order_key"]), "days": (days.schema, ["day"])}, buckets=16)
    k = F.col("order_key")
    store.begin().replace("orders", o).replace("days", days).commit()
    store.begin().upsert("orders", o.where(k % 10 == 0).withColumn("status", F.lit("changed"))).commit()
    store.begin().delete("orders", o.where(k % 7 == 0)).commit()
    store.compact("orders")
    back = o.where(k % 21 == 0).withColumn("status", F.lit("back"))
    new = o.where(k % 50 == 0).select((k + 1_000_000_000).alias("order_key"), F.lit("new").alias("status"), "day")
    gone = back.groupBy("day").agg(F.lit(0).cast("long").alias("n"))
    store.begin().upsert("orders", back.unionByName(new)).patch("days", gone).commit()
    return store


@query(
    """WITH o AS (SELECT o_orderkey AS order_key, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)
SELECT order_key, CASE WHEN order_key % 21 = 0 THEN 'back' WHEN order_key % 10 = 0 THEN 'changed' ELSE status END AS status, day FROM o WHERE order_key % 7 <> 0 OR order_key % 21 = 0
UNION ALL SELECT order_key + 1000000000, 'new', day FROM o WHERE order_key % 50 = 0"""
)
def merged_on_read(spark, d):
    """What reading makes of a base and the changes after it."""
    return _changed_orders(spark, d).read("orders")


@query(
    """WITH o AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)
SELECT day, CASE WHEN count(*) FILTER (k % 21 = 0) > 0 THEN 0 ELSE count(*) END AS n FROM o GROUP BY day"""
)
def patched_together(spark, d):
    """The collection that changed in the same commit: days of orders that came back are set to none."""
    return _changed_orders(spark, d).read("days")


#: Limits of two levels for the query below.
LIMITS = (
    ("trial", "original_empty_rate", 0.12), ("trial", "original_cer", 0.5), ("trial", "rotated_empty_rate", 0.12), ("trial", "rotated_cer_regression", 0.01), ("trial", "warm_latency_ms", 950.0), ("trial", "peak_memory_mb", 60.0),
    ("default", "original_empty_rate", 0.06), ("default", "original_cer", 0.4), ("default", "cold_latency_ms", 900.0), ("default", "size_increase_mb", 7.0),
)


@query(
    """WITH l AS (SELECT l_returnflag || l_linestatus AS candidate, l_orderkey % 2 = 1 AS rotated, l_quantity < 4 AS empty, l_partkey % 40 AS distance, 40 + l_suppkey % 9 AS golden, l_linenumber = 1 AS cold, (l_orderkey % 1000)::DOUBLE AS ms, CASE WHEN l_linenumber <> 2 THEN l_quantity END AS mb, CASE WHEN l_returnflag <> 'N' THEN l_linenumber END AS size FROM lineitem),
o AS (SELECT candidate, avg(empty::INT::DOUBLE) FILTER (NOT rotated) AS a, sum(distance) FILTER (NOT rotated) / sum(golden) FILTER (NOT rotated)::DOUBLE AS b, avg(empty::INT::DOUBLE) FILTER (rotated) AS c, sum(distance) FILTER (rotated) / sum(golden) FILTER (rotated)::DOUBLE AS e, max(ms) FILTER (NOT cold) AS warm, max(ms) FILTER (cold) AS cold, max(mb) AS mb, max(size) AS size FROM l GROUP BY candidate),
m AS (SELECT candidate, unnest(['original_empty_rate', 'original_cer', 'rotated_empty_rate', 'rotated_cer_regression', 'warm_latency_ms', 'cold_latency_ms', 'peak_memory_mb', 'size_increase_mb']) AS measure, unnest([a, b, c, e - b, warm, cold, mb, size]::DOUBLE[]) AS value FROM o),
j AS (SELECT candidate, level, measure, coalesce(value <= most, false) AS passed FROM m JOIN (VALUES """
    + ", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in LIMITS)
    + """) AS t(level, measure, most) USING (measure))
SELECT candidate, level, count(*) AS gates, bool_and(passed) AS passed, array_to_string(list_sort(list(measure) FILTER (NOT passed)), ',') AS failed FROM j GROUP BY candidate, level"""
)
def regression_gates(spark, d):
    """Flags and states of lines as candidates, the lines as samples."""
    k = F.col("l_linenumber")
    runs = B.read(spark, d, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("candidate"), (F.col("l_orderkey") % 2 == 1).alias("rotated"), (F.col("l_quantity") < 4).alias("empty"), (F.col("l_partkey") % 40).alias("distance"), (F.lit(40) + F.col("l_suppkey") % 9).alias("golden_chars"), (k == 1).alias("cold"),
        (F.col("l_orderkey") % 1000).cast("double").alias("latency_ms"), F.when(k != 2, F.col("l_quantity").cast("double")).alias("memory_mb"), F.when(F.col("l_returnflag") != "N", k.cast("double")).alias("size_increase_mb"),
    )
    judged = gates.judge(gates.measures(runs), spark.createDataFrame(LIMITS, "level string, measure string, most double"))
    return gates.verdicts(judged).withColumn("failed", F.nullif(F.array_join("failed", ","), F.lit("")))
