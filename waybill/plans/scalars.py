"""Queries over scalar rules: texts, money, times and scores, each with its SQL for checking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.functions import semantics as S
from waybill.functions import text as X
from waybill.operators import imaging, receipts
from waybill.sources import bindings as B

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


def _cases(spark, d, *texts):
    k = F.col("p_partkey")
    return B.read(spark, d, "part").select(k, _pick(k, *texts).alias("t"))


def _case_sql(*texts):
    quoted = ", ".join("'" + t.replace("'", "''") + "'" for t in texts)
    return f"c AS (SELECT p_partkey, [{quoted}][p_partkey % {len(texts)} + 1] AS t FROM part)"


@query(
    "SELECT o_orderkey, format('{:,}', floor(o_totalprice + 0.5)::BIGINT) || '원' AS whole, CASE WHEN o_totalprice >= 10000 THEN regexp_replace((floor(o_totalprice / 1000.0 + 0.5) / 10.0::DOUBLE)::VARCHAR, '\\.0$', '') || '만' ELSE format('{:,}', floor(o_totalprice + 0.5)::BIGINT) END AS short FROM orders"
)
def money_labels(spark, d):
    x = F.col("o_totalprice").cast("double")
    return B.read(spark, d, "orders").select("o_orderkey", S.won(x).alias("whole"), S.won(x, short=True).alias("short"))


@query(
    """WITH t AS (SELECT p_partkey, (p_partkey % 24) AS h, p_partkey * 7 % 60 AS m FROM part), u AS (SELECT *, (h * 60 + m - 75 + 1440) % 1440 AS x FROM t)
SELECT p_partkey, lpad((x // 60)::VARCHAR, 2, '0') || ':' || lpad((x % 60)::VARCHAR, 2, '0') AS moved, CASE WHEN p_partkey % 2 = 0 THEN lpad(h::VARCHAR, 2, '0') || ':' || lpad(m::VARCHAR, 2, '0') ELSE 'soon' END AS clock FROM u"""
)
def clock_arithmetic(spark, d):
    k = F.col("p_partkey")
    at = F.format_string("%02d:%02d", (k % 24).cast("int"), (k * 7 % 60).cast("int"))
    return B.read(spark, d, "part").select(k, S.add_minutes(at, -75).alias("moved"), S.time_of(F.when(k % 2 == 0, F.concat(F.lit("2026-01-01 "), at)).otherwise("soon")).alias("clock"))


@query("WITH " + _case_sql("plain", "a,b", 'say "x"', "two\nlines", "") + """ SELECT p_partkey, CASE WHEN regexp_matches(t, '[",\\r\\n]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END AS cell FROM c""")
def csv_cells(spark, d):
    return _cases(spark, d, "plain", "a,b", 'say "x"', "two\nlines", "").select("p_partkey", S.csv_cell(F.col("t")).alias("cell"))


@query("WITH " + _case_sql("서울특별시 강남구 역삼동", "경기 수원시 팔달로", "부산광역시 해운대구", "강원 홍천군 남면", "서울특별시", "") + " SELECT p_partkey, ['강남구', '수원시', '해운대구', '홍천군', NULL, NULL][p_partkey % 6 + 1] AS district FROM c")
def address_districts(spark, d):
    return _cases(spark, d, "서울특별시 강남구 역삼동", "경기 수원시 팔달로", "부산광역시 해운대구", "강원 홍천군 남면", "서울특별시", "").select("p_partkey", X.district_of(F.col("t")).alias("district"))


_VENUE_TEXTS = ("병원 장례식장 105 호실", "예식장 2층 로비 3 층", "지하 1층 특실", "신랑 신부", "plain", "故 인 조화")


@query("WITH " + _case_sql(*_VENUE_TEXTS) + " SELECT p_partkey, ['105호실', '3층', '지하1층', '', '', ''][p_partkey % 6 + 1] AS unit, ['funeral', 'wedding', NULL, 'wedding', NULL, 'funeral'][p_partkey % 6 + 1] AS kind, ['H 105호실', 'H 3층', 'H 지하1층', 'H', 'H', 'H'][p_partkey % 6 + 1] AS composed FROM c")
def venue_words(spark, d):
    c = _cases(spark, d, *_VENUE_TEXTS)
    return c.select("p_partkey", X.unit_suffix(F.col("t")).alias("unit"), X.venue_kind(F.col("t")).alias("kind"), X.compose_venue(F.lit("H"), F.col("t")).alias("composed"))


@query("WITH " + _case_sql("근조 화환", "개업 축하", "축하 3단", "화분", "웨딩 오픈") + " SELECT p_partkey, ['condolence', 'opening', 'congratulation', 'other', 'opening'][p_partkey % 5 + 1] AS type, [86, 80, 78, 40, 80][p_partkey % 5 + 1] AS confidence FROM c")
def event_types(spark, d):
    return _cases(spark, d, "근조 화환", "개업 축하", "축하 3단", "화분", "웨딩 오픈").select("p_partkey", X.event_type(F.col("t")).alias("e")).select("p_partkey", "e.type", "e.confidence")


@query("WITH " + _case_sql("O10-l234-5678", "OK 2O26", "SB", "1O", "tel 0I0") + " SELECT p_partkey, ['010-1234-5678', 'OK 2026', 'SB', '1O', 'tel 010'][p_partkey % 5 + 1] AS repaired FROM c")
def digit_repair(spark, d):
    return _cases(spark, d, "O10-l234-5678", "OK 2O26", "SB", "1O", "tel 0I0").select("p_partkey", X.repair_digits(F.col("t")).alias("repaired"))


_PHONES = ("call 010-1234-5678 or 02 123 4567", "no 5010-1234-56789", "031-222-3333.", "x")


@query("WITH " + _case_sql(*_PHONES) + " SELECT p_partkey, [['010-1234-5678', '02-123-4567'], [], ['031-222-3333'], []][p_partkey % 4 + 1] AS phones FROM c")
def phones_found(spark, d):
    return _cases(spark, d, *_PHONES).select("p_partkey", X.phones_in(F.col("t")).alias("phones"))


_VALUES = ("주소: 서울 1", "[불명]", "받는분 김 [불명] 수", "성명: 이름: 박", "plain  value")


@query("WITH " + _case_sql(*_VALUES) + " SELECT p_partkey, ['서울 1', '', '김 수', '박', 'plain value'][p_partkey % 5 + 1] AS cleaned FROM c")
def cleaned_values(spark, d):
    return _cases(spark, d, *_VALUES).select("p_partkey", S.squeeze(X.clean_value(F.col("t"))).alias("cleaned"))


_VENDORS = ("[본점] 장미 (행복꽃집) (010-1)", "한빛 플라워 02-123-4567", "(대표 김) 화원", "꽃")


@query("WITH " + _case_sql(*_VENDORS) + " SELECT p_partkey, ['행복꽃집', '한빛 플라워 02-123-4567', '화원', '꽃'][p_partkey % 4 + 1] AS vendor FROM c")
def refined_vendors(spark, d):
    return _cases(spark, d, *_VENDORS).select("p_partkey", X.refine_vendor(F.col("t")).alias("vendor"))


@query("WITH " + _case_sql("김민준 실장", "반드시 서명", "이 영희", "") + " SELECT p_partkey, ['김민준 실장', '', '이 영희', ''][p_partkey % 4 + 1] AS name FROM c")
def recipient_names(spark, d):
    return _cases(spark, d, "김민준 실장", "반드시 서명", "이 영희", "").select("p_partkey", X.recipient_name(F.col("t")).alias("name"))


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: x::DOUBLE * CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 4 END + CASE WHEN vec_id % 3 = 0 THEN 0.25::DOUBLE ELSE 0 END) AS l FROM embeddings), m AS (SELECT *, list_max(l) AS top FROM v)
SELECT vec_id, list_position(l, top) - 1 AS label, round(CASE WHEN list_min(l) >= 0 AND top <= 1.0001::DOUBLE AND abs(list_sum(l) - 1) < 0.05::DOUBLE THEN top ELSE 1 / list_sum(list_transform(l, lambda x: exp(x - top))) END, 9) AS probability FROM m"""
)
def step_probabilities(spark, d):
    k = F.col("vec_id")
    scores = F.transform(F.slice("embedding", 1, 4), lambda x: F.when(k % 3 == 0, F.lit(0.25)).otherwise(x.cast("double") * 4))
    return B.read(spark, d, "embeddings").select(k, imaging.step_probability(scores).alias("p")).select("vec_id", "p.label", F.round("p.probability", 9).alias("probability"))


@query("SELECT p_partkey, p_size > 0 AS any, floor(least(100, least(p_size, 30) / greatest(p_size, 30)::DOUBLE * 100) + 0.5) AS coverage, false AS passed, least(1.45::DOUBLE, greatest(1.0::DOUBLE, 0.26::DOUBLE / greatest(0.08::DOUBLE, p_size / 100.0::DOUBLE))) AS contrast FROM part")
def unmeasured_quality(spark, d):
    s = F.col("p_size").cast("double")
    q = B.read(spark, d, "part").select("p_partkey", (s > 0).alias("any"), imaging.unmeasured_quality(s, F.lit(30.0)).alias("q"), imaging.illumination(F.lit(0.5), s / 100.0).alias("contrast"))
    return q.select("p_partkey", "any", "q.coverage", "q.passed", "contrast")


_LINES = (("상품명: 축하화환", "주소: 서울", "수량: 2"), ("memo", "배송지", "배송지: 부산 1"), ("주소 서울 주소: 부산",), ("받는분:", "없음"))


def _line_docs(spark, d):
    k = F.col("p_partkey")
    lists = F.array(*[F.array(*[F.lit(x) for x in xs]) for xs in _LINES])
    return B.read(spark, d, "part").select(k, F.element_at(lists, (k % len(_LINES) + 1).cast("int")).alias("lines"))


@query("SELECT p_partkey, ['서울', '부산 1', '서울 주소: 부산', NULL][p_partkey % 4 + 1] AS value, [2, 3, 1, NULL][p_partkey % 4 + 1] AS line_no FROM part")
def first_labelled_values(spark, d):
    return _line_docs(spark, d).select("p_partkey", receipts.labeled_value(F.col("lines"), ("주소", "배송지")).alias("v")).select("p_partkey", "v.value", "v.line_no")


@query("SELECT p_partkey, ['상품명: 축하화환', NULL, NULL, NULL][p_partkey % 4 + 1] AS source FROM part")
def first_shaped_lines(spark, d):
    return _line_docs(spark, d).select("p_partkey", receipts.first_line(F.col("lines"), receipts.SHAPES["productName"]).alias("v")).select("p_partkey", "v.source")


_EMBEDDED = ("상품명: 화환 수량: 2 주소: 서울", "주소 서울", "인수자: 김 (전화: 010)", "메모: 급 전화: 02")


@query("WITH " + _case_sql(*_EMBEDDED) + " SELECT p_partkey, [['상품명: 화환', '수량: 2', '주소: 서울'], ['주소 서울'], ['인수자: 김 (전화: 010)'], ['메모: 급', '전화: 02']][p_partkey % 4 + 1] AS parts FROM c")
def embedded_labels(spark, d):
    return _cases(spark, d, *_EMBEDDED).select("p_partkey", receipts.split_embedded(F.col("t")).alias("parts"))
