"""Queries over receipts, boxes, venues, evaluations, images and live frames, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.functions import text as X
from waybill.operators import evaluation, imaging, labels, receipts, routing, spatial, venues
from waybill.sources import bindings as B
from waybill.sources import files
from waybill.streaming import live, sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# labels as SQL knows them: ASCII, no particles
_NORM = r"regexp_replace(lower(trim({0})), '[\s:.\-_/\\\[\]()<>{{}}#*]', '', 'g')"
_SCORE = """CASE WHEN norm = target THEN 1.0::DOUBLE
  WHEN least(length(norm), length(target)) >= 2 AND (contains(norm, target) OR contains(target, norm)) THEN 0.85::DOUBLE * (least(length(norm), length(target)) / greatest(length(norm), length(target))::DOUBLE)
  WHEN least(length(norm), length(target)) < 0.6::DOUBLE * greatest(length(norm), length(target)) THEN NULL
  WHEN 1 - levenshtein(target, norm) / greatest(length(norm), length(target))::DOUBLE >= 0.6 THEN 0.6::DOUBLE * (1 - levenshtein(target, norm) / greatest(length(norm), length(target))::DOUBLE) END"""
_PARSED = B.with_ctes("b_lines", "b_registry") + rf""",
reg AS (SELECT key, ord, {_NORM.format("alias")} AS norm FROM b_registry),
base AS MATERIALIZED (SELECT order_key, line_no, trim(text) AS t FROM b_lines WHERE trim(text) <> ''),
cut AS (SELECT *, strpos(t, ':') AS pos, strpos(t, ':') > 1 AND NOT regexp_matches(substr(t, 1, strpos(t, ':') - 1), '[0-9]') AS colon, regexp_split_to_array(t, '\s+') AS w FROM base),
labels AS MATERIALIZED (
  SELECT order_key, line_no, NULL AS k, trim(substr(t, 1, pos - 1)) AS label, trim(substr(t, pos + 1)) AS value FROM cut WHERE colon
  UNION ALL SELECT order_key, line_no, k, array_to_string(w[1:k], ' '), array_to_string(w[k + 1:], ' ') FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM cut WHERE NOT colon)),
targets AS MATERIALIZED (SELECT DISTINCT label, {_NORM.format("label")} AS target, k IS NULL AS before_colon FROM labels),
fuzzy AS MATERIALIZED (SELECT label, key, ord, {_SCORE} AS score FROM (FROM targets WHERE before_colon AND target <> ''), reg),
strong AS (
  SELECT label, key, ord, 1.0::DOUBLE AS score FROM targets JOIN reg ON norm = target WHERE NOT before_colon
  UNION ALL SELECT label, key, ord, {_SCORE} FROM (FROM targets WHERE NOT before_colon AND length(target) BETWEEN 16 AND 30), (FROM reg WHERE length(norm) >= 16)),
matched AS MATERIALIZED (
  SELECT before_colon, label, arg_max(key, (score, -ord)) AS key, max(score) AS score
  FROM (SELECT true AS before_colon, * FROM fuzzy WHERE score IS NOT NULL UNION ALL SELECT false, * FROM strong WHERE score >= 0.8) GROUP BY before_colon, label),
hits AS (SELECT l.*, m.key, m.score FROM labels l JOIN matched m ON m.label = l.label AND m.before_colon = (l.k IS NULL)),
parsed AS (
  SELECT c.order_key, c.line_no, h.key, h.score, CASE WHEN c.colon THEN trim(substr(c.t, 1, c.pos - 1)) ELSE coalesce(h.label, '') END AS label, CASE WHEN c.colon THEN trim(substr(c.t, c.pos + 1)) ELSE coalesce(h.value, c.t) END AS value
  FROM cut c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY order_key, line_no ORDER BY k DESC) AS r FROM hits) h ON h.order_key = c.order_key AND h.line_no = c.line_no AND h.r = 1),
kinds AS (SELECT *, CASE WHEN key IS NOT NULL AND value <> '' THEN 'value' WHEN key IS NOT NULL THEN 'label' WHEN label = '' THEN 'orphan' ELSE 'unknown' END AS kind FROM parsed),
lagged AS (SELECT *, lag(kind) OVER w AS pk, lag(key) OVER w AS pkey, lag(label) OVER w AS pl FROM kinds WINDOW w AS (PARTITION BY order_key ORDER BY line_no)),
said AS (SELECT *, CASE WHEN kind = 'value' THEN key WHEN kind = 'orphan' AND pk = 'label' THEN pkey END AS dest, CASE WHEN kind = 'orphan' AND pk = 'label' THEN pl ELSE label END AS said_by FROM lagged WHERE kind <> 'label'),
placed AS (SELECT *, CASE WHEN dest IS NOT NULL THEN row_number() OVER (PARTITION BY order_key, dest ORDER BY line_no) END AS nth FROM said)"""


def _documents(spark, d):
    """Parsed lines of each order, within its row."""
    docs = B.spread(B.receipt_documents(spark, d)).withColumn("t", F.transform("lines", lambda x: x["text"]))
    return receipts.parse_lines(docs, "t", B.REGISTRY, known=labels.learn(docs, "t", B.REGISTRY))


def _parsed(spark, d):
    p = _documents(spark, d)
    # lines get their own numbers within the row: an array beside the exploded rows would go along with each of them
    own = F.transform("parsed", lambda x: F.struct(F.get("lines", x["line_no"] - 1)["line_no"].alias("line_no"), x["key"], x["score"], x["label"], x["value"]))
    # inline and not explode, whose struct Catalyst would take apart below it, working the lines out once for each field
    return p.select("order_key", F.inline(own))


@query(_PARSED + " SELECT order_key, line_no, key, round(score, 6) AS score, label, value FROM parsed")
def line_classification(spark, d):
    return _parsed(spark, d).withColumn("score", F.round("score", 6))


@query(_PARSED + " SELECT order_key, dest AS key, value, line_no FROM placed WHERE nth = 1")
def first_value_per_field(spark, d):
    return receipts.fold_lines(_parsed(spark, d), "order_key")[0]


@query(_PARSED + " SELECT order_key, said_by AS label, value, line_no FROM placed WHERE nth IS NULL OR nth > 1")
def unmapped_lines(spark, d):
    return receipts.fold_lines(_parsed(spark, d), "order_key")[1]


@query(_PARSED + " SELECT order_key, list(dest || '=' || value ORDER BY dest) AS fields FROM placed WHERE nth = 1 GROUP BY order_key")
def receipt_records(spark, d):
    """The fold within the row instead of over exploded lines."""
    p = _documents(spark, d).withColumn("f", receipts.fold_in_row(F.col("parsed")))
    return p.select("order_key", F.array_sort(F.transform(F.map_entries("f.fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("fields"))


@query(
    f"""WITH words AS (SELECT DISTINCT lower(c_mktsegment) || ' ' || n_name AS label FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT DISTINCT lower(p_type) FROM part UNION SELECT unnest(['Shp', 'delivry dat', 'quantty', 'adress', 'prodct name', 'recipient phon', 'xyz'])),
b_registry AS ({B.CTES["b_registry"]}), reg AS (SELECT key, ord, {_NORM.format("alias")} AS norm FROM b_registry), t AS (SELECT label, {_NORM.format("label")} AS target FROM words), scored AS (SELECT label, key, ord, {_SCORE} AS score FROM t, reg WHERE target <> '')
SELECT t.label, arg_max(s.key, (s.score, -s.ord)) AS key, round(max(s.score), 6) AS score FROM t LEFT JOIN (SELECT * FROM scored WHERE score IS NOT NULL) s ON s.label = t.label GROUP BY t.label"""
)
def alias_best_match(spark, d):
    a = B.read(spark, d, "customer").join(B.read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lower("c_mktsegment"), F.lit(" "), "n_name").alias("label"))
    b = B.read(spark, d, "part").select(F.lower("p_type").alias("label"))
    c = spark.createDataFrame([(x,) for x in ("Shp", "delivry dat", "quantty", "adress", "prodct name", "recipient phon", "xyz")], "label string")
    m = labels.match_field(F.col("label"), labels.registry_literal(B.REGISTRY))
    return a.unionByName(b).unionByName(c).distinct().withColumn("m", m).select("label", "m.key", F.round("m.score", 6).alias("score"))


_RAW = "SELECT o_orderkey AS k, ['010-1234-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0'), '02-' || (o_orderkey % 900 + 100) || '-1234', '031 ' || (o_orderkey % 900 + 100) || ' 4567', '0101234567', 'none'][o_orderkey % 5 + 1] AS phone, 'due ' || (o_orderkey % 3 + 2024) || ['-', '.', '/', ' '][o_orderkey % 4 + 1] || (o_orderkey % 14) || ['-', '.', '/', ' '][o_orderkey % 4 + 1] || (o_orderkey % 33) || ' x' AS day, 'at ' || (o_orderkey % 26) || ['시 ', ':', '시'][o_orderkey % 3 + 1] || lpad((o_orderkey % 70)::VARCHAR, 2, '0') || ['분', '', ''][o_orderkey % 3 + 1] AS clock, ['수량: ', 'x ', ''][o_orderkey % 3 + 1] || (o_orderkey % 130) || ['', '개', ' EA'][o_orderkey % 3 + 1] AS qty FROM orders"


def _raw(spark, d):
    k = F.col("o_orderkey")
    pick = lambda n, *xs: F.element_at(F.array(*[x if isinstance(x, type(k)) else F.lit(x) for x in xs]), (k % n + 1).cast("int"))
    s = lambda c: c.cast("string")
    sep = pick(4, "-", ".", "/", " ")
    return B.read(spark, d, "orders").select(
        k.alias("k"),
        pick(5, F.concat(F.lit("010-1234-"), F.lpad(s(k % 10000), 4, "0")), F.concat(F.lit("02-"), s(k % 900 + 100), F.lit("-1234")), F.concat(F.lit("031 "), s(k % 900 + 100), F.lit(" 4567")), "0101234567", "none").alias("phone"),
        F.concat(F.lit("due "), s(k % 3 + 2024), sep, s(k % 14), sep, s(k % 33), F.lit(" x")).alias("day"),
        F.concat(F.lit("at "), s(k % 26), pick(3, "시 ", ":", "시"), F.lpad(s(k % 70), 2, "0"), pick(3, "분", "", "")).alias("clock"),
        F.concat(pick(3, "수량: ", "x ", ""), s(k % 130), pick(3, "", "개", " EA")).alias("qty"),
    )


@query(
    f"""WITH raw AS ({_RAW}), d AS (SELECT k, phone, regexp_replace(phone, '\\D', '', 'g') AS x FROM raw)
SELECT k, CASE WHEN starts_with(x, '010') AND length(x) = 11 THEN substr(x, 1, 3) || '-' || substr(x, 4, 4) || '-' || right(x, 4) WHEN starts_with(x, '02') AND length(x) IN (9, 10) THEN '02-' || substr(x, 3, length(x) - 6) || '-' || right(x, 4)
  WHEN regexp_matches(x, '^0[3-6]\\d') AND length(x) IN (10, 11) THEN substr(x, 1, 3) || '-' || substr(x, 4, length(x) - 7) || '-' || right(x, 4) ELSE '' END AS phone FROM d"""
)
def phone_normalize(spark, d):
    return _raw(spark, d).select("k", X.normalize_phone(F.col("phone")).alias("phone"))


@query(
    f"""WITH raw AS ({_RAW}), d AS (SELECT k, regexp_extract(day, '(20\\d{{2}})[.\\-/](\\d{{1,2}})[.\\-/](\\d{{1,2}})', ['y', 'm', 'd']) AS x FROM raw), i AS (SELECT k, x.y || '-' || lpad(x.m, 2, '0') || '-' || lpad(x.d, 2, '0') AS s, x.y FROM d)
SELECT k, CASE WHEN y <> '' AND try_cast(s AS DATE) IS NOT NULL THEN s ELSE '' END AS day FROM i"""
)
def date_normalize(spark, d):
    return _raw(spark, d).select("k", X.normalize_receipt_date(F.col("day"), repair=False).alias("day"))


@query(
    f"""WITH raw AS ({_RAW}), t AS (SELECT k, replace(clock, ' ', '') AS c FROM raw), e AS (SELECT k, regexp_extract(c, '(\\d{{1,2}}):(\\d{{2}})', ['h', 'm']) AS a, regexp_extract(c, '(\\d{{1,2}})시(?:(\\d{{1,2}})분?)?', ['h', 'm']) AS b FROM t)
SELECT k, CASE WHEN try_cast(a.h AS INT) <= 23 AND try_cast(a.m AS INT) <= 59 THEN lpad(a.h, 2, '0') || ':' || a.m WHEN try_cast(b.h AS INT) <= 23 AND try_cast(coalesce(nullif(b.m, ''), '0') AS INT) <= 59 THEN lpad(b.h, 2, '0') || ':' || lpad(coalesce(nullif(b.m, ''), '0'), 2, '0') ELSE '' END AS clock FROM e"""
)
def time_normalize(spark, d):
    return _raw(spark, d).select("k", X.normalize_time(F.col("clock"), receipt=True).alias("clock"))


@query(
    f"""WITH raw AS ({_RAW}), e AS (SELECT k, coalesce(nullif(regexp_extract(qty, '수량\\s*[|:]?\\s*(\\d{{1,2}})', 1), ''), nullif(regexp_extract(qty, '(\\d{{1,2}})\\s*(?:개|단|EA|ea)', 1), ''))::INT AS n FROM raw)
SELECT k, CASE WHEN n BETWEEN 1 AND 99 THEN n::VARCHAR ELSE '' END AS qty FROM e"""
)
def quantity_extract(spark, d):
    return _raw(spark, d).select("k", X.normalize_quantity(F.col("qty"), receipt=True).alias("qty"))


def _fields(spark, d):
    k = F.col("o_orderkey")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.floor(k / 7) % len(xs) + 1).cast("int"))
    key = F.element_at(F.array(*[F.lit(x) for x in ("deliveryAddress", "recipientTel", "venueName", "productName", "recipientName", "memo")]), (k % 6 + 1).cast("int"))
    value = pick("서울 종로구 세종로 12", "서울 어딘가", "tel 010-1234-5678", "010-1234-5678", "축하 화환", "basket", "", "한빛홀", "김민준 실장")
    return B.read(spark, d, "orders").select(k.alias("doc_id"), key.alias("key"), value.alias("value"), (k % 100).cast("int").alias("confidence"), (k % 2 == 0).alias("required"), F.array().cast("array<string>").alias("errors")).withColumn(
        "status", receipts.field_status(F.col("value"), F.col("errors"), F.col("confidence"), F.lit(False))
    )


_FIELDS_SQL = """f AS (SELECT o_orderkey AS doc_id, ['deliveryAddress', 'recipientTel', 'venueName', 'productName', 'recipientName', 'memo'][o_orderkey % 6 + 1] AS key,
  ['서울 종로구 세종로 12', '서울 어딘가', 'tel 010-1234-5678', '010-1234-5678', '축하 화환', 'basket', '', '한빛홀', '김민준 실장'][o_orderkey // 7 % 9 + 1] AS value, (o_orderkey % 100)::INT AS confidence, o_orderkey % 2 = 0 AS required FROM orders),
s AS (SELECT *, CASE WHEN value = '' THEN 'missing' WHEN confidence >= 85 THEN 'confirmed' WHEN confidence >= 60 THEN 'review' ELSE 'warning' END AS status FROM f)"""


@query("WITH " + _FIELDS_SQL + " SELECT status, count(*) AS n FROM s GROUP BY status")
def field_status(spark, d):
    return _fields(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query(
    "WITH " + _FIELDS_SQL + """, r AS (SELECT *, regexp_matches(value, '(^|\\D)010-\\d{3,4}-\\d{4}($|\\D)') AS phone FROM s),
g AS (SELECT *, value <> '' AND CASE key WHEN 'deliveryAddress' THEN phone OR contains(value, 'tel') OR NOT contains(value, '서울') WHEN 'recipientTel' THEN NOT phone
    WHEN 'venueName' THEN phone OR contains(value, 'tel') OR contains(value, '화환') WHEN 'recipientName' THEN phone OR contains(value, 'tel') OR contains(value, '서울') ELSE false END AS rej,
  value <> '' AND CASE key WHEN 'deliveryAddress' THEN NOT contains(value, '세종로 1') WHEN 'productName' THEN NOT contains(value, '화환') ELSE false END AS warn FROM r)
SELECT doc_id, key, CASE WHEN rej THEN '' ELSE value END AS value, CASE WHEN rej THEN 0 ELSE confidence END AS confidence, CASE WHEN rej THEN CASE WHEN required THEN 'missing' ELSE 'warning' END WHEN warn AND status <> 'missing' THEN 'warning' ELSE status END AS status, (rej OR warn)::INT AS errors FROM g"""
)
def field_guardrails(spark, d):
    return receipts.guardrails(_fields(spark, d)).select("doc_id", "key", "value", "confidence", "status", F.size("errors").alias("errors"))


@query("WITH " + _FIELDS_SQL + " SELECT doc_id // 10 AS doc_id, floor(avg(confidence) + 0.5)::INT AS document_confidence FROM s WHERE required GROUP BY 1")
def document_confidence(spark, d):
    return receipts.document_confidence(_fields(spark, d).withColumn("doc_id", F.floor(F.col("doc_id") / 10)))


@query(
    "WITH " + _FIELDS_SQL
    + """, g AS (SELECT doc_id // 10 AS doc_id, coalesce(list('필수 항목 누락: ' || key ORDER BY doc_id) FILTER (required AND trim(value) = ''), []) AS miss, floor(avg(confidence) FILTER (required) + 0.5)::INT AS c,
  coalesce(list('필수 항목 확인 필요: ' || key ORDER BY doc_id) FILTER (required AND status IN ('warning', 'review')), []) AS unsure FROM s GROUP BY 1), r AS (SELECT doc_id, c, miss || CASE WHEN c < 82 THEN ['문서 신뢰도 낮음: ' || c || '%'] ELSE [] END || unsure AS reasons FROM g)
SELECT doc_id, c AS document_confidence, reasons, len(reasons) > 0 AS fallback FROM r"""
)
def ocr_enrichment(spark, d):
    f = _fields(spark, d).withColumns({"ord": F.col("doc_id"), "label": F.col("key"), "source": F.lit("")}).withColumn("doc_id", F.floor(F.col("doc_id") / 10))
    return receipts.enrich(f).select("doc_id", "document_confidence", "reasons", "fallback")


@query(
    "WITH " + _FIELDS_SQL + """, t AS (SELECT doc_id // 4 AS doc_id, string_agg(value, ' ' ORDER BY doc_id) AS text FROM s GROUP BY 1)
SELECT doc_id, CASE WHEN trim(text) = '' THEN 0 ELSE regexp_matches(text, '화환')::INT + regexp_matches(text, '서울\\s*[가-힣0-9\\s]*(?:시|군|구|동|로|길)')::INT + regexp_matches(text, '(?:01[016789]|02|0[3-6]\\d)[-\\s]?\\d{3,4}[-\\s]?\\d{4}')::INT END AS score FROM t"""
)
def receipt_evidence_gate(spark, d):
    t = _fields(spark, d).groupBy(F.floor(F.col("doc_id") / 4).alias("g")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "value"))), lambda x: x["value"]), " ").alias("text"))
    return t.select(F.col("g").alias("doc_id"), X.evidence_score(F.col("text")).alias("score"))


def _korean(spark, d):
    """Receipts in the form the parser is made for, rendered from orders."""
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % n + 1).cast("int"))
    text = F.concat_ws(
        "\n", pick(3, "발주처: 한빛플라워", "발주화원 : 행복꽃집", "경기 21호(임플라워) 발주처"), pick(2, "품명: 축하3단화환", "상품명 근조화환 2개"), F.concat(F.lit("배달일시: 2026년 0"), s(k % 9 + 1), F.lit("월 "), s(k % 28 + 1), F.lit("일")),
        pick(4, "배달장소: 주소 서울 종로구 세종로 12", "배송지", "주소: [불명]", "배송주소 부산 해운대구 우동 5"), F.when(k % 4 == 1, "서울 강남구 테헤란로 7"), pick(2, "받는분: 김민준 실장", "인수자 전화 010-1234-5678"), pick(3, "예식 12시20분", "시간엄수: 10:30", ""), F.concat(F.lit("수량: "), s(k % 12)),
    )
    return B.read(spark, d, "orders").select(k.alias("doc_id"), text.alias("text"))


@query()
def parse_receipts(spark, d):
    """The whole parser; it has regular expressions with look-around, so its results are checked by unit tests."""
    return receipts.parse_texts_once(_korean(spark, d)).select("doc_id", "key", "value", "confidence", "status")


_TOUR = """WITH RECURSIVE s AS MATERIALIZED (SELECT c_nationkey AS route, c_custkey AS ord, 37.4 + (c_custkey * 7919 % 1000) / 4000.0::DOUBLE AS lat, 126.8 + (c_custkey * 104729 % 1000) / 4000.0::DOUBLE AS lon FROM customer),
t(route, seen, ord, lat, lon, visit) AS (
  SELECT DISTINCT route, []::BIGINT[], NULL::BIGINT, 37.5033::DOUBLE, 127.0442::DOUBLE, 0::BIGINT FROM s
  UNION ALL
  SELECT route, list_append(seen, x.ord), x.ord, x.lat, x.lon, visit + 1 FROM (
    SELECT t.route, t.seen, t.visit, arg_min({'ord': s.ord, 'lat': s.lat, 'lon': s.lon}, (pow(sin(radians(s.lat - t.lat) / 2), 2) + cos(radians(t.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - t.lon) / 2), 2), s.ord)) AS x
    FROM t JOIN s ON s.route = t.route AND NOT list_contains(t.seen, s.ord) GROUP BY t.route, t.seen, t.visit))"""


@query(_TOUR + " SELECT route, ord, visit FROM t WHERE visit > 0")
def nearest_neighbor_route(spark, d):
    return routing.nearest_neighbor(B.stops(spark, d))


@query("WITH s AS (SELECT c_nationkey AS route, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS ord, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT route, c_custkey, CASE WHEN n > 4 AND ord = 3 THEN 4 WHEN n > 4 AND ord = 4 THEN 3 ELSE ord END AS ord FROM s")
def manual_stop_swap(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("c_nationkey")
    s = B.read(spark, d, "customer").select(F.col("c_nationkey").alias("route"), "c_custkey", (F.row_number().over(w.orderBy("c_custkey")) - 1).alias("ord"), F.count("*").over(w).alias("n"))
    return routing.swap(s, 3, 1).select("route", "c_custkey", F.col("ord").cast("long").alias("ord"))


_ADDR = "WITH a AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Seoul  tel 02' WHEN 2 THEN 'Seoul ' || c_name || ' floor' ELSE c_name END AS address, CASE WHEN c_custkey % 3 = 0 THEN 'D' || (c_custkey % 7) END AS district FROM customer), n AS (SELECT *, trim(regexp_replace(address, '\\s+', ' ', 'g')) AS t FROM a)"


@query(
    _ADDR
    + """, w AS (SELECT *, contains(t, 'tel') AS noise, (CASE WHEN NOT (contains(t, 'Seoul') AND contains(t, 'floor')) THEN 1 ELSE 0 END) + (CASE WHEN district IS NULL THEN 1 ELSE 0 END) AS bad FROM n)
SELECT c_custkey, CASE WHEN t = '' THEN 'missing' WHEN noise THEN 'needsReview' ELSE 'candidate' END AS status, CASE WHEN t = '' OR noise THEN 1 ELSE bad END AS warnings, CASE WHEN t = '' OR noise THEN 0 WHEN bad > 0 THEN 2 ELSE 1 END AS n,
  CASE WHEN t = '' OR noise THEN NULL WHEN bad > 0 THEN 65 ELSE 82 END AS confidence, CASE WHEN NOT (t = '' OR noise) THEN round(37.45::DOUBLE + (list_sum(list_transform(string_split(t || ':0', ''), lambda x: ascii(x))) % 130) / 1000.0::DOUBLE, 6) END AS latitude FROM w"""
)
def address_candidates(spark, d):
    k = F.col("c_custkey")
    a = B.read(spark, d, "customer").select(k, F.when(k % 5 == 0, "").when(k % 5 == 1, "Seoul  tel 02").when(k % 5 == 2, F.concat(F.lit("Seoul "), "c_name", F.lit(" floor"))).otherwise(F.col("c_name")).alias("address"), F.when(k % 3 == 0, F.concat(F.lit("D"), (k % 7).cast("string"))).alias("district"))
    c = routing.address_candidates(a, "address", "district", noise="tel", regions="Seoul", detail="floor")
    first = F.get("candidates", 0)
    return c.select("c_custkey", "status", F.size("warnings").alias("warnings"), F.size("candidates").alias("n"), first["confidence"].alias("confidence"), first["latitude"].alias("latitude"))


def _boxes(spark, d):
    """Four dimensions of a vector as one box in page units."""
    e = B.read(spark, d, "embeddings").select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, F.lit(4)))).alias("line_no", "v"))
    unit = lambda i, size: F.floor(F.abs(F.get("v", F.lit(i)).cast("double")) * size + 0.5)
    return e.select(F.col("vec_id").alias("doc_id"), (F.col("line_no") + 1).alias("line_no"), unit(0, 3000).cast("double").alias("x"), unit(1, 4000).cast("double").alias("y"), (unit(2, 300) + 5).cast("double").alias("width"), (unit(3, 80) + 5).cast("double").alias("height"))


_BOXES = """WITH e AS (SELECT vec_id AS doc_id, unnest(range(0, 16)) AS i, embedding AS v FROM embeddings), b AS (SELECT doc_id, i + 1 AS line_no, floor(abs(v[i * 4 + 1]::DOUBLE) * 3000 + 0.5) AS x, floor(abs(v[i * 4 + 2]::DOUBLE) * 4000 + 0.5) AS y, floor(abs(v[i * 4 + 3]::DOUBLE) * 300 + 0.5) + 5 AS width, floor(abs(v[i * 4 + 4]::DOUBLE) * 80 + 0.5) + 5 AS height FROM e)"""


@query(
    _BOXES
    + """, c AS (SELECT *, x + width / 2 AS cx, y + height / 2 AS cy, x + width AS rt, y + height AS bt FROM b), pg AS (SELECT doc_id, max(rt) AS w, max(bt) AS h FROM c GROUP BY doc_id),
j AS (SELECT a.doc_id, a.line_no AS a_line, k.line_no AS c_line, greatest(0.0::DOUBLE, 82 - greatest(0.0::DOUBLE, k.x - a.rt) / pg.w * 55 - abs(k.cy - a.cy) / pg.h * 130) AS near FROM c a JOIN c k ON k.doc_id = a.doc_id AND k.line_no <> a.line_no JOIN pg ON pg.doc_id = a.doc_id
  WHERE k.cx BETWEEN a.rt - pg.w * 0.015 AND a.rt + pg.w * 0.55 AND k.cy BETWEEN a.cy - pg.h * 0.12 AND a.cy + pg.h * 0.07)
SELECT doc_id, a_line, count(*) AS n, round(max(near), 6) AS nearest FROM j GROUP BY doc_id, a_line"""
)
def spatial_neighbors(spark, d):
    p = spatial.positioned(_boxes(spark, d).withColumn("text", F.concat(F.lit("t"), "line_no")).withColumn("confidence", F.lit(70.0)))
    p = p.join(spatial.pages(p), "doc_id")
    a = p.select("doc_id", F.col("line_no").alias("a_line"), F.col("right").alias("a_right"), F.col("cy").alias("a_cy"))
    return spatial.beside(a, p).groupBy("doc_id", "a_line").agg(F.count("*").alias("n"), F.round(F.max("near"), 6).alias("nearest"))


@query()
def spatial_candidates(spark, d):
    names = [a for v in spatial.ANCHORS.values() for a in v[:1]]
    text = F.element_at(F.array(*[F.lit(x) for x in [*names, "2026-06-14", "010-1234-5678", "서울 종로구 세종로 12", "축하 화환", "3개"]]), (F.col("line_no") + F.col("doc_id")) .cast("int") % 16 + 1)
    return spatial.field_candidates(_boxes(spark, d).withColumn("text", text).withColumn("confidence", F.lit(70.0)), 2026).select("doc_id", "key", "value", "confidence", "place")


@query(
    _BOXES
    + """, ok AS (SELECT doc_id, x + width / 2 AS cx, y + height / 2 AS cy, height FROM b), size AS (SELECT doc_id, count(*) AS n, greatest(1.0::DOUBLE, quantile_cont(height, 0.5) * 0.6::DOUBLE) AS bucket FROM ok GROUP BY doc_id),
turned AS (SELECT ok.doc_id, deg, floor((cy * cos(radians(deg)) - cx * sin(radians(deg))) / bucket + 0.5) AS place FROM ok JOIN size ON size.doc_id = ok.doc_id, (SELECT -20 + i * 0.5::DOUBLE AS deg FROM range(0, 81) r(i)) WHERE n >= 6),
scores AS (SELECT doc_id, deg, sum(c * c)::BIGINT AS score FROM (SELECT doc_id, deg, place, count(*) AS c FROM turned GROUP BY ALL) GROUP BY doc_id, deg),
best AS (SELECT doc_id, arg_max(deg, (score, -deg)) AS deg, max(score) AS score, max(score) FILTER (deg = 0) AS zero FROM scores GROUP BY doc_id)
SELECT s.doc_id, round(b.deg, 2) AS degrees, abs(b.deg) >= 1.5 AND (b.score - b.zero) / b.zero::DOUBLE >= 0.02 AS confident, n AS sample_lines FROM size s JOIN best b ON b.doc_id = s.doc_id"""
)
def skew_estimate(spark, d):
    return spatial.skew(_boxes(spark, d))


@query(_BOXES + " SELECT doc_id, quantile_cont(height, 0.5) AS median_height FROM b GROUP BY doc_id")
def median_line_height(spark, d):
    return _boxes(spark, d).groupBy("doc_id").agg(F.percentile("height", 0.5).alias("median_height"))


@query(
    _BOXES
    + """, c AS (SELECT *, x + width / 2 AS cx, y + height / 2 AS cy, x + width AS rt, y + height AS bt FROM b), pg AS (SELECT doc_id, max(rt) AS w, max(bt) AS h FROM c GROUP BY doc_id)
SELECT a.doc_id, 'productName' AS key, a.line_no AS a_line, k.line_no AS c_line FROM c a JOIN c k ON k.doc_id = a.doc_id AND k.line_no <> a.line_no JOIN pg ON pg.doc_id = a.doc_id
  WHERE a.line_no % 4 = 0 AND k.cx BETWEEN a.rt - pg.w * 0.015 AND a.rt + pg.w * 0.55 AND k.cy BETWEEN a.cy - pg.h * 0.12 AND a.cy + pg.h * 0.07"""
)
def field_search_view(spark, d):
    b = _boxes(spark, d).withColumn("text", F.when(F.col("line_no") % 4 == 0, "상품명").otherwise(F.concat(F.lit("t"), "line_no"))).withColumn("confidence", F.lit(70.0))
    return spatial.inspect(b, ["productName", "memo"]).select("doc_id", "key", "a_line", "c_line")


@query()
def reading_order(spark, d):
    return spatial.reading_order(_boxes(spark, d).withColumn("text", F.concat(F.lit("t"), "line_no")))


def _venues(spark, d):
    """Distinct part names as venues, with a brand as alias."""
    p = B.read(spark, d, "part").groupBy("p_name").agg(F.min("p_brand").alias("brand"), F.min("p_partkey").alias("k"), F.min("p_size").alias("size"))
    forms = F.array(F.struct(F.col("p_name").alias("form"), (F.col("k") * 2).alias("ord")), F.struct(F.concat("brand", F.lit(" hall")).alias("form"), (F.col("k") * 2 + 1).alias("ord")))
    kind = F.when(F.col("size") % 3 == 0, "funeral").when(F.col("size") % 3 == 1, "wedding")
    return p.select(F.col("p_name").alias("name"), F.explode(forms).alias("f"), kind.alias("type")).select("name", "f.form", "f.ord", "type")


def _venue_texts(spark, d):
    return B.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("hall of "), F.col("p_name"), F.lit(" 3층")).alias("text"))


# all pairs of distinct texts and forms; every substring of a text is looked for in every form
_MATCHED = r"""WITH t AS (SELECT p_partkey AS id, regexp_replace(lower('hall of ' || p_name || ' 3층'), '[\s.,/\\|()\[\]{}<>~\-:''"]+', '', 'g') AS a FROM part),
p AS (SELECT p_name AS name, min(p_brand) AS brand, min(p_partkey) AS k FROM part GROUP BY p_name),
v AS (SELECT name, ord, regexp_replace(lower(form), '[\s.,/\\|()\[\]{}<>~\-:''"]+', '', 'g') AS b FROM (SELECT name, name AS form, k * 2 AS ord FROM p UNION ALL SELECT name, brand || ' hall', k * 2 + 1 FROM p)),
subs AS (SELECT a, substr(a, i, n) AS s, n FROM (SELECT DISTINCT a FROM t), range(1, 60) x(i), range(4, 60) y(n) WHERE i + n - 1 <= length(a)),
pairs AS (SELECT a, b, max(n) AS common FROM subs JOIN (SELECT DISTINCT b FROM v) ON contains(b, s) GROUP BY a, b),
scored AS (
  SELECT a, b, CASE WHEN a = b THEN 1.0::DOUBLE WHEN contains(a, b) THEN greatest(0.6::DOUBLE, least(1.0::DOUBLE, length(b) / 5.0::DOUBLE)) WHEN contains(b, a) THEN length(a) / length(b)::DOUBLE
    ELSE common / least(length(a), length(b))::DOUBLE END AS score FROM pairs WHERE length(a) >= 4 AND length(b) >= 4),
best AS (SELECT a, name, arg_max(ord, (score, -ord)) AS ord, max(score) AS score FROM scored JOIN v USING (b) WHERE score >= 0.6 GROUP BY a, name),
placed AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, ord) AS place FROM best)"""


@query(_MATCHED + " SELECT id, name, round(score, 6) AS score, place::INTEGER AS place FROM t JOIN placed USING (a) WHERE place <= 5")
def venue_match(spark, d):
    return venues.match_venues(_venue_texts(spark, d), _venues(spark, d)).select("id", "name", F.round("score", 6).alias("score"), "place")


@query(
    _MATCHED
    + """, near AS (SELECT *, max(score) OVER (PARTITION BY a) AS top FROM placed WHERE place <= 7)
SELECT id, name, round(score, 6) AS score, place::INTEGER AS place FROM t JOIN near USING (a) WHERE place <= 3 AND top - score <= 0.1"""
)
def venue_band(spark, d):
    return venues.suggest(_venue_texts(spark, d), _venues(spark, d)).select("id", "name", F.round("score", 6).alias("score"), "place")


@query(
    """WITH r AS (SELECT p_partkey AS ord, trim(p_brand) AS name, 'Seoul ' || (p_size % 10) AS address, CASE p_partkey % 5 WHEN 0 THEN '폐업' WHEN 1 THEN '' ELSE '영업/정상' END AS state FROM part WHERE p_partkey % 11 <> 0)
SELECT min(ord) AS ord, name, address FROM r WHERE state <> '폐업' GROUP BY name, address"""
)
def venue_dedupe(spark, d):
    k = F.col("p_partkey")
    raw = B.read(spark, d, "part").select(k.alias("ord"), F.when(k % 11 == 0, " ").otherwise(F.concat(F.lit(" "), "p_brand")).alias("상호명"), F.lit("").alias("도로명주소"), F.concat(F.lit("Seoul "), (F.col("p_size") % 10).cast("string")).alias("지번주소"), F.when(k % 5 == 0, "폐업").when(k % 5 == 1, "").otherwise("영업/정상").alias("영업상태명"))
    return venues.from_licences(raw, "wedding", "ord").select("ord", "name", "address")


@query(
    """WITH v AS (SELECT CASE p_size % 4 WHEN 0 THEN 'localdata' WHEN 1 THEN 'official' WHEN 2 THEN 'web' ELSE 'unverified' END AS source, CASE WHEN p_size % 3 = 0 THEN 'funeral' ELSE 'wedding' END AS type FROM part)
SELECT source, type, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM v), 1) AS percent, source IN ('localdata', 'official', 'verified') AS safe FROM v GROUP BY source, type"""
)
def provenance_report(spark, d):
    s = F.col("p_size")
    return venues.provenance(B.read(spark, d, "part").select(F.when(s % 4 == 0, "localdata").when(s % 4 == 1, "official").when(s % 4 == 2, "web").alias("source"), F.when(s % 3 == 0, "funeral").otherwise("wedding").alias("type")))


_EVAL = """WITH g AS (SELECT item_id, regexp_replace(b.text, '[^\\x00-\\x7F]', '?', 'g') AS golden, regexp_replace(d.text, '[^\\x00-\\x7F]', '?', 'g') AS prediction FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id),
u AS (SELECT item_id, regexp_replace(golden, '\\[[^\\]\\n]+\\]', '', 'g') AS golden, regexp_replace(coalesce(prediction, ''), '\\[[^\\]\\n]+\\]', '', 'g') AS prediction FROM g),
n AS (SELECT item_id, regexp_replace(lower(golden), '[\\s|\\x0B]', '', 'g') AS gc, regexp_replace(lower(prediction), '[\\s|\\x0B]', '', 'g') AS pc,
  list_filter(string_split(trim(regexp_replace(lower(golden), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda t: t <> '') AS toks, trim(regexp_replace(lower(prediction), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS pt FROM u),
s AS (SELECT item_id, pc = '' AS empty, length(gc) AS golden_chars, levenshtein(pc, gc) AS distance, round(levenshtein(pc, gc) / length(gc)::DOUBLE, 4) AS cer, round(len(list_filter(toks, lambda t: contains(pt, t))) / len(toks)::DOUBLE, 4) AS coverage FROM n)"""


def _samples(spark, d):
    """Whole benchmark texts against whole documents of the same number; other than ASCII is '?', as SQL counts bytes."""
    ascii_only = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "?")
    docs = B.read(spark, d, "documents").select(F.col("doc_id").alias("item_id"), ascii_only("text").alias("prediction"))
    g = B.read(spark, d, "benchmark").select("item_id", ascii_only("text").alias("golden")).join(docs, "item_id", "left")
    return evaluation.score_samples(g)


@query(_EVAL + " SELECT * FROM s")
def cer_samples(spark, d):
    return _samples(spark, d).drop("golden", "prediction")


@query(_EVAL + " SELECT count(*) AS samples, round(avg(empty::INT), 4) AS empty_rate, round(sum(distance) / sum(golden_chars)::DOUBLE, 4) AS cer_micro, round(avg(cer), 4) AS cer_macro, round(avg(coverage), 4) AS coverage, round(sum(distance) / sum(golden_chars)::DOUBLE, 4) <= 0.45 AS passed FROM s")
def cer_report(spark, d):
    return evaluation.summarize(_samples(spark, d), 0.45)


_GRID = """WITH grid AS (SELECT a * 3 + b AS config, a AS left_slack, b AS right_grow FROM range(0, 3) t(a), range(0, 3) u(b)), r AS (SELECT g.*, l.doc_id AS sample, (x * (config + 1)) % 4 AS required, (x + config) % 9 AS populated, (x * 7 + config * config) % 5 AS hits, 50 + (x * 3 + config * 11) % 40 AS confidence FROM (SELECT l.doc_id, len(regexp_extract_all(coalesce(d.text, ''), '[^\\x20\\x09-\\x0D]+')) AS x FROM labels l JOIN documents d ON d.doc_id = l.doc_id) l, grid g)"""


def _grid(spark, d):
    """Nine configurations on the labelled documents; what they score follows from the number of words."""
    g = spark.range(9).select(F.col("id").alias("config"), F.floor(F.col("id") / 3).alias("left_slack"), (F.col("id") % 3).alias("right_grow"))
    x, c = F.col("x"), F.col("config")
    words = B.read(spark, d, "documents").select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("x"))
    labelled = B.read(spark, d, "labels").select("doc_id").join(words, "doc_id").withColumnRenamed("doc_id", "sample")
    return labelled.join(F.broadcast(g)).withColumns({"required": x * (c + 1) % 4, "populated": (x + c) % 9, "hits": (x * 7 + c * c) % 5, "confidence": F.lit(50) + (x * 3 + c * 11) % 40}).drop("x")


@query(_GRID + " SELECT config, sum(required)::BIGINT AS required, sum(populated)::BIGINT AS populated, sum(hits)::BIGINT AS hits, round(avg(confidence), 6) AS confidence, round(sum(required) * 120 + sum(populated) * 18 + sum(hits) * 28 + round(avg(confidence), 6), 6) AS score FROM r GROUP BY config")
def grid_sweep(spark, d):
    return evaluation.sweep(_grid(spark, d), ["config"])


_LOO = _GRID + ", s AS (SELECT config, sample, left_slack, right_grow, required * 120 + populated * 18 + hits * 28 AS score FROM r), t AS (SELECT *, sum(score) OVER (PARTITION BY config) - score AS train FROM s), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY train DESC, config) AS k FROM t) WHERE k = 1)"


def _folds(spark, d):
    g = _grid(spark, d).withColumn("score", F.col("required") * 120 + F.col("populated") * 18 + F.col("hits") * 28)
    return evaluation.leave_one_out(g.withColumn("ord", F.col("config")))


@query(_LOO + " SELECT sample, config AS chosen, train::BIGINT AS train_score, score AS test_score FROM b")
def leave_one_out(spark, d):
    return _folds(spark, d)


@query(_LOO + " SELECT count(DISTINCT config // 3) AS left_slack, count(DISTINCT config % 3) AS right_grow FROM b")
def fold_stability(spark, d):
    f = _folds(spark, d).select(F.floor(F.col("chosen") / 3).alias("left_slack"), (F.col("chosen") % 3).alias("right_grow"))
    return evaluation.fold_stability(f, ["left_slack", "right_grow"])


_ORI = """WITH l AS (SELECT user_id AS image, (event_id % 4 * 90)::INT AS orientation, event_type || '-' || event_id AS text, (floor(value) % 100) / 100.0::DOUBLE AS confidence, (event_id % 10) / 10.0::DOUBLE AS region FROM events),
s AS (SELECT image, orientation, count(*) AS lines, sum(length(regexp_replace(text, '[^a-z0-9]+', '', 'g')))::BIGINT AS chars, avg(confidence) AS conf, avg(region) AS region FROM l GROUP BY image, orientation),
c AS (SELECT *, lines * 5 + chars * 0.8::DOUBLE + conf * 12 + region * 4 AS score, lines >= 6 AND chars >= 28 AND conf >= 0.45 AS good FROM s),
u AS (SELECT *, bool_or(orientation = 0 AND good) OVER (PARTITION BY image) AS up FROM c)
SELECT image, orientation, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, lines DESC, chars DESC, orientation) AS k FROM u WHERE NOT up OR orientation = 0) WHERE k = 1"""


@query(_ORI)
def orientation_choice(spark, d):
    e = B.read(spark, d, "events").select(F.col("user_id").alias("image"), (F.col("event_id") % 4 * 90).cast("int").alias("orientation"), F.concat("event_type", F.lit("-"), F.col("event_id").cast("string")).alias("text"), (F.floor("value") % 100 / 100.0).alias("confidence"), (F.col("event_id") % 10 / 10.0).alias("region_score"))
    return evaluation.choose_orientation(evaluation.orientation_scores(e)).select("image", "orientation", F.round("score", 6).alias("score"))


@query(
    """WITH s AS (SELECT user_id AS sequence, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_id % 4 AS label FROM events), p AS (SELECT *, lag(label) OVER (PARTITION BY sequence ORDER BY step) AS prev FROM s)
SELECT sequence, list(label ORDER BY step) AS labels FROM p WHERE label <> 0 AND (prev IS NULL OR prev <> label) GROUP BY sequence"""
)
def ctc_collapse(spark, d):
    from pyspark.sql import Window

    s = B.read(spark, d, "events").select(F.col("user_id").alias("sequence"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("step"), (F.col("event_id") % 4).alias("label"))
    return imaging.ctc_collapse(s)


@query(
    """WITH e AS (SELECT vec_id AS image, unnest(range(0, 64)) AS i, embedding AS v FROM embeddings), p AS (SELECT image, i % 8 AS x, i // 8 AS y, floor(abs(v[i + 1]::DOUBLE) * 900)::INT % 256 AS g FROM e), l AS (SELECT *, g / 255.0::DOUBLE AS lum FROM p),
n AS (SELECT *, lag(lum) OVER (PARTITION BY image, y ORDER BY x) + lead(lum) OVER (PARTITION BY image, y ORDER BY x) + lag(lum) OVER (PARTITION BY image, x ORDER BY y) + lead(lum) OVER (PARTITION BY image, x ORDER BY y) - lum * 4 AS lap FROM l)
SELECT image, round(avg(lum), 6) AS mean, round(avg((lum < 0.18)::INT), 6) AS dark, round(avg((lum > 0.94)::INT), 6) AS blown, round(var_pop(lap) * 255 * 255, 2) AS laplacian FROM n GROUP BY image"""
)
def image_statistics(spark, d):
    return imaging.pixel_statistics(_pixels(spark, d)).select("image", F.round("mean", 6).alias("mean"), F.round("dark", 6).alias("dark"), F.round("blown", 6).alias("blown"), F.round("laplacian", 2).alias("laplacian"))


#: Pixels of the packed images: 64 by 48, so that every tile holds more than 20.
_PACKED_WIDTH, _PACKED = 64, 64 * 48


@query(
    rf"""WITH g AS (SELECT vec_id AS image, i % {_PACKED_WIDTH} AS x, i // {_PACKED_WIDTH} AS y, floor(abs(embedding[(i * 7 + i // 64 * 3) % 64 + 1]::DOUBLE) * 1900)::INT % 256 AS c FROM embeddings, range({_PACKED}) t(i)),
l AS (SELECT image, x, y, c, least(255, c + 40) AS r, c // 2 + 90 AS b FROM g),
p AS (SELECT image, x, y, (r * 0.299::DOUBLE + c * 0.587::DOUBLE + b * 0.114::DOUBLE) / 255 AS lum, greatest(r, c, b) AS hi, least(r, c, b) AS lo FROM l),
q AS (SELECT *, lum > 0.48 AND (hi - lo) / hi::DOUBLE < 0.42 AS paper, lag(lum) OVER r + lead(lum) OVER r + lag(lum) OVER k + lead(lum) OVER k - lum * 4 AS lap FROM p WINDOW r AS (PARTITION BY image, y ORDER BY x), k AS (PARTITION BY image, x ORDER BY y)),
s AS (SELECT image, count(*) AS pixels, avg(lum) AS mean, var_pop(lum) AS variance, avg((lum < 0.18)::INT) AS dark, avg((lum > 0.94)::INT) AS blown, avg(paper::INT) AS paper_ratio, coalesce(var_pop(lap), 0) * 255 * 255 AS laplacian,
  (max(x) FILTER (paper) - min(x) FILTER (paper) + 1) * (max(y) FILTER (paper) - min(y) FILTER (paper) + 1) / count(*)::DOUBLE AS box, degrees(atan2(covar_pop(x, y) FILTER (paper) * 2, var_pop(x) FILTER (paper) - var_pop(y) FILTER (paper))) / 2 AS angle FROM q GROUP BY image),
t AS (SELECT image, stddev_pop(m) AS tile_std FROM (SELECT image, avg(lum) AS m, count(*) AS n FROM p WHERE lum > 0.42 GROUP BY image, (x * {imaging.TILE_COLUMNS} + {imaging.TILE_COLUMNS - 1}) // 64, (y * {imaging.TILE_ROWS} + {imaging.TILE_ROWS - 1}) // 48) WHERE n > 20 GROUP BY image)
SELECT image, pixels, round(mean, 9) AS mean, round(variance, 9) AS variance, round(dark, 9) AS dark, round(blown, 9) AS blown, round(paper_ratio, 9) AS paper_ratio, round(CASE WHEN paper_ratio > 0.035 THEN box ELSE 0 END, 9) AS box,
  round(CASE WHEN paper_ratio > 0.035 THEN angle END, 4) AS angle, round(laplacian, 2) AS laplacian, round(coalesce(tile_std, sqrt(variance)), 9) AS tile_std FROM s LEFT JOIN t USING (image)"""
)
def packed_image_statistics(spark, d):
    """All statistics of images that are rows, of coloured pixels made of vectors."""
    i = F.sequence(F.lit(0), F.lit(_PACKED - 1))
    grey = F.transform(i, lambda k: F.floor(F.abs(F.get("embedding", ((k * 7 + F.floor(k / 64) * 3) % 64).cast("int")).cast("double")) * 1900).cast("int") % 256)
    rgb = F.transform("g", lambda c: F.least(F.lit(255), c + 40) * 65_536 + c * 256 + F.floor(c / 2).cast("int") + 90)
    images = B.spread(B.read(spark, d, "embeddings")).select(F.col("vec_id").alias("image"), grey.alias("g")).select("image", F.lit(_PACKED_WIDTH).alias("width"), rgb.alias("rgb"))
    places = {"laplacian": 2, "angle": 4}
    return imaging.packed_statistics(images).select("image", "pixels", *[F.round(c, places.get(c, 9)).alias(c) for c in ("mean", "variance", "dark", "blown", "paper_ratio", "box", "angle", "laplacian", "tile_std")])


def _pixels(spark, d):
    e = B.read(spark, d, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("i", "v"))
    g = F.floor(F.abs(F.col("v").cast("double")) * 900).cast("int") % 256
    return e.select("image", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), g.alias("red"), g.alias("green"), g.alias("blue"))


@query(
    """WITH e AS (SELECT vec_id AS image, unnest(range(0, 64)) AS i, embedding AS v FROM embeddings), p AS (SELECT image, i % 8 AS x, i // 8 AS y, floor(abs(v[i + 1]::DOUBLE) * 900)::INT % 256 AS g FROM e), l AS (SELECT *, (g * 0.299::DOUBLE + g * 0.587::DOUBLE + g * 0.114::DOUBLE) / 255 AS lum FROM p),
n AS (SELECT *, lag(lum) OVER (PARTITION BY image, y ORDER BY x) + lead(lum) OVER (PARTITION BY image, y ORDER BY x) + lag(lum) OVER (PARTITION BY image, x ORDER BY y) + lead(lum) OVER (PARTITION BY image, x ORDER BY y) - lum * 4 AS lap FROM l),
s AS (SELECT image, avg(lum) AS mean, sqrt(var_pop(lum)) AS tile, avg((lum < 0.18)::INT) AS dark, avg((lum > 0.94)::INT) AS blown, avg((lum > 0.48)::INT) AS paper, var_pop(lap) * 255 * 255 AS sharp,
  (max(x) FILTER (lum > 0.48) - min(x) FILTER (lum > 0.48) + 1) * (max(y) FILTER (lum > 0.48) - min(y) FILTER (lum > 0.48) + 1) / 64.0::DOUBLE AS box,
  degrees(atan2(covar_pop(x, y) FILTER (lum > 0.48) * 2, var_pop(x) FILTER (lum > 0.48) - var_pop(y) FILTER (lum > 0.48))) / 2 AS angle FROM n GROUP BY image),
t AS (SELECT *, CASE WHEN paper > 0.035 AND box IS NOT NULL THEN box ELSE 0 END AS bx, CASE WHEN paper > 0.035 AND box IS NOT NULL THEN abs(angle) % 90 END AS off FROM s),
q AS (SELECT image, floor(greatest(0, least(100, log10(sharp + 1) * 34)) + 0.5) AS blur, floor(greatest(0, least(100, 100 - CASE WHEN mean < 0.66 THEN (0.66 - mean) * 150 ELSE (mean - 0.66) * 55 END - dark * 65 - blown * 20)) + 0.5) AS brightness,
  CASE WHEN paper < 0.04 THEN 20 WHEN bx < 0.22 THEN floor(bx * 180 + 0.5) WHEN bx > 0.98 THEN 88 ELSE floor(least(100, bx * 55 + 52) + 0.5) END AS coverage, CASE WHEN off IS NULL THEN 35 ELSE floor(greatest(0, least(100, 100 - least(off, 90 - off) * 5.5)) + 0.5) END AS skew, floor(greatest(0, least(100, 100 - tile * 185)) + 0.5) AS shadow FROM t),
z AS (SELECT *, floor(blur * 0.27::DOUBLE + brightness * 0.22::DOUBLE + coverage * 0.23::DOUBLE + skew * 0.12::DOUBLE + shadow * 0.16::DOUBLE + 0.5) AS score FROM q)
SELECT image, score, blur, brightness, coverage::DOUBLE AS coverage, skew::DOUBLE AS skew, shadow, score >= 68 AND blur >= 50 AND brightness >= 50 AND coverage >= 50 AS passed FROM z"""
)
def image_quality_scores(spark, d):
    """Images too small for tiles, so the spread over tiles is that of the pixels; tiles have a unit test."""
    return imaging.quality(imaging.pixel_statistics(_pixels(spark, d))).select("image", "score", "blur", "brightness", "coverage", "skew", "shadow", "passed")


@query("SELECT p_partkey, CASE WHEN w <= 2400 THEN w ELSE floor(w * (2400.0::DOUBLE / w) + 0.5)::INT END AS prep_w, greatest(32, ceil(w * least(1.0::DOUBLE, 960.0::DOUBLE / w) / 32) * 32)::INT AS det_w FROM (SELECT p_partkey, p_size * 97 + 10 AS w FROM part)")
def prepared_sizes(spark, d):
    w = F.col("p_size") * 97 + 10
    s = B.read(spark, d, "part").select("p_partkey", w.cast("double").alias("w"))
    return s.select("p_partkey", imaging.prepared_size(F.col("w"), F.col("w") / 2)[0].alias("prep_w"), imaging.detector_size(F.col("w"), F.col("w") / 2)[0].alias("det_w"))


def _frames(spark, d):
    return _frames_of(B.read(spark, d, "events"))


def _frames_of(events):
    e = F.col("event_id")
    v = F.concat(F.lit("v"), (F.floor("value") % 3).cast("string"))
    found = F.array(
        F.struct(F.lit("venueName").alias("key"), v.alias("value"), (F.lit(60) + F.floor("value") % 40).cast("double").alias("confidence"), F.lit("review").alias("status"), F.array().cast("array<string>").alias("errors")),
        F.struct(F.lit("recipientTel").alias("key"), F.when(e % 5 == 0, "bad").otherwise("010-1234-5678").alias("value"), F.lit(90.0).alias("confidence"), F.lit("confirmed").alias("status"), F.array().cast("array<string>").alias("errors")),
        F.struct(F.lit("deliveryAddress").alias("key"), v.alias("value"), F.lit(82.0).alias("confidence"), F.when(e % 7 == 0, "warning").otherwise("review").alias("status"), F.array().cast("array<string>").alias("errors")),
    )
    return events.select(F.col("user_id").cast("string").alias("session"), e.cast("string").alias("frame_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("captured_ms"), (e % 11 != 0).alias("passed"), (e % 900).alias("processing_ms"), found.alias("found"))


_LIVE = """WITH RECURSIVE f AS MATERIALIZED (
  SELECT user_id::VARCHAR AS session, event_id::VARCHAR AS frame_id, epoch_ms(ts) AS now_ms, event_id % 11 <> 0 AS passed, event_id % 900 AS busy, 'v' || (floor(value)::BIGINT % 3) AS v, (60 + floor(value)::BIGINT % 40)::DOUBLE AS mc, event_id % 5 <> 0 AS tel, event_id % 7 <> 0 AS addr,
    row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id::VARCHAR) AS n FROM events),
t AS (
  SELECT DISTINCT session, 0::BIGINT AS n, NULL::BIGINT AS last_ms, NULL::BIGINT AS till_ms, '' AS mv, 0.0::DOUBLE AS mc, 0 AS ms, '' AS av, 0 AS ac, 0 AS a_s, 0 AS ps, NULL::VARCHAR AS frame_id, NULL::BIGINT AS at_ms, NULL::VARCHAR AS decision FROM f
  UNION ALL
  SELECT session, n, CASE WHEN skipped THEN last_ms ELSE now_ms END, CASE WHEN runs THEN now_ms + busy ELSE till_ms END, CASE WHEN m THEN v ELSE mv END, CASE WHEN m THEN greatest(mc, fmc) ELSE mc END, CASE WHEN m THEN CASE WHEN v = mv THEN ms + 1 ELSE 1 END ELSE ms END,
    CASE WHEN a THEN v ELSE av END, CASE WHEN a THEN 82 ELSE ac END, CASE WHEN a THEN CASE WHEN v = av THEN a_s + 1 ELSE 1 END ELSE a_s END, CASE WHEN p THEN ps + 1 ELSE ps END, frame_id, now_ms,
    CASE WHEN too_early THEN 'skipped-interval' WHEN skipped THEN 'skipped-busy' WHEN NOT runs THEN 'rejected-quality' WHEN CASE WHEN m THEN CASE WHEN v = mv THEN ms + 1 ELSE 1 END ELSE ms END >= 2 AND CASE WHEN a THEN CASE WHEN v = av THEN a_s + 1 ELSE 1 END ELSE a_s END >= 2 AND CASE WHEN p THEN ps + 1 ELSE ps END >= 2 THEN 'ready' ELSE 'accepted' END
  FROM (SELECT *, runs AND ms < 2 AND fmc >= 85 AND (mv = '' OR v = mv OR fmc > mc) AS m, runs AND a_s < 2 AND addr AND (av = '' OR v = av OR 82 > ac) AS a, runs AND ps < 2 AND tel AS p FROM (
    SELECT x.*, NOT skipped AND passed AS runs FROM (
      SELECT t.session, f.n, t.last_ms, t.till_ms, t.mv, t.mc, t.ms, t.av, t.ac, t.a_s, t.ps, f.frame_id, f.now_ms, f.passed, f.busy, f.v, f.mc AS fmc, f.tel, f.addr, coalesce(f.now_ms - t.last_ms < 500, false) AS too_early, coalesce(f.now_ms - t.last_ms < 500, false) OR coalesce(f.now_ms < t.till_ms, false) AS skipped
      FROM t JOIN f ON f.session = t.session AND f.n = t.n + 1) x))),
d AS (SELECT session, n, at_ms, frame_id, decision, (ms >= 2)::INT + (a_s >= 2)::INT + (ps >= 2)::INT AS locked FROM t WHERE n > 0)"""


@query(_LIVE + " SELECT session, frame_id, decision, locked::BIGINT AS locked, locked = 3 AS ready FROM d")
def live_session(spark, d):
    return live.batch(_frames(spark, d)).select("session", "frame_id", "decision", "locked", "ready")


@query(_LIVE + " SELECT session, frame_id, decision, locked::BIGINT AS locked, locked = 3 AS ready FROM d")
def live_session_stream(spark, d):
    """The same frames as a stream with durable state, run until the watermark has passed them all."""
    schema = B.read(spark, d, "events").schema
    found = _frames_of(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d))
    decided = sessions.decide(found, late="0 seconds", idle="3650 days")
    place = f"{files.shared_dir(spark)}/waybill-{uuid.uuid4().hex}"
    run = decided.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(decided.schema).parquet(f"{place}/out").select("session", "frame_id", "decision", "locked", "ready")


@query(
    _LIVE
    + """ SELECT session, arg_max(locked, (at_ms, frame_id))::BIGINT AS locked, arg_max(locked, (at_ms, frame_id)) = 3 AS ready, count(*) AS frames, count(*) FILTER (decision = 'skipped-interval') AS skipped_interval, count(*) FILTER (decision = 'skipped-busy') AS skipped_busy,
  count(*) FILTER (decision = 'rejected-quality') AS rejected_quality, count(*) FILTER (decision = 'accepted') AS accepted FROM d GROUP BY session"""
)
def live_session_totals(spark, d):
    return live.summary(live.batch(_frames(spark, d)))


@query(
    _LIVE
    + """, g AS (SELECT session, arg_max(locked, (at_ms, frame_id))::BIGINT AS locked, count(*) FILTER (decision = 'accepted') AS a, count(*) FILTER (decision = 'rejected-quality') AS r FROM d GROUP BY session)
SELECT session, locked, 3 AS total, 3 - locked AS remaining, CASE WHEN a > 0 THEN a || '개 프레임 누적' WHEN r > 0 THEN r || '개 프레임 재촬영 필요' ELSE '프레임 대기 중' END AS frames, CASE WHEN a > 0 THEN '다음 프레임 촬영' ELSE '첫 프레임 촬영' END AS capture, locked || '/3' AS step FROM g"""
)
def live_presentation(spark, d):
    return live.presentation(live.batch(_frames(spark, d)))


@query(
    """WITH c AS (SELECT user_id AS session, event_id AS key, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'old' END AS value, event_id % 50 AS confidence FROM events WHERE event_type <> 'error' AND user_id % 4 <> 0),
i AS (SELECT user_id AS session, event_id AS key, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE 'new' END AS value, event_id % 70 AS confidence FROM events WHERE event_type <> 'view')
SELECT c.session, c.key, CASE WHEN (trim(c.value) = '' AND trim(i.value) <> '') OR i.confidence > c.confidence THEN i.value ELSE c.value END AS value, CASE WHEN (trim(c.value) = '' AND trim(i.value) <> '') OR i.confidence > c.confidence THEN i.confidence ELSE c.confidence END AS confidence
FROM c LEFT JOIN i ON i.key = c.key AND i.session = c.session UNION ALL SELECT * FROM i WHERE session NOT IN (SELECT session FROM c)"""
)
def merge_fields(spark, d):
    e = F.col("event_id")
    ev = B.read(spark, d, "events").withColumn("session", F.col("user_id"))
    c = ev.where("event_type <> 'error' and user_id % 4 <> 0").select("session", e.alias("key"), F.when(e % 3 == 0, "").otherwise("old").alias("value"), (e % 50).alias("confidence"))
    i = ev.where("event_type <> 'view'").select("session", e.alias("key"), F.when(e % 5 == 0, " ").otherwise("new").alias("value"), (e % 70).alias("confidence"))
    return live.merge_fields(c, i, by=["session"])


@query("SELECT user_id AS session, max(event_id % 90) AS confidence, sum(event_id % 300)::BIGINT AS processing_ms, sum(1)::BIGINT AS variants, bool_or(event_id % 17 = 0) AS fallback, list(event_type ORDER BY event_id) AS unmapped, arg_max(event_type, (event_id % 40, event_id)) AS event_type FROM events GROUP BY user_id")
def merge_results(spark, d):
    e = F.col("event_id")
    r = B.read(spark, d, "events").select(F.col("user_id").alias("session"), e.alias("ord"), (e % 90).alias("confidence"), (e % 300).alias("processing_ms"), F.lit(1).alias("variants"), (e % 17 == 0).alias("fallback"), F.array("event_type").alias("unmapped"), "event_type", (e % 40).alias("event_confidence"))
    return live.merge_results(r)
