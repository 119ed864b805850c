"""Queries over deliveries, money and schedules, each with its SQL for checking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.functions import semantics as S
from waybill.operators import changes, finance, joins, schedule
from waybill.sources import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TODAY = "2000-06-30"
NOW_MS = 900_000_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_COMPACT = "replace(replace(o.address, ' ', ''), chr(9), '')"
_PRICED = f"""priced AS (
  SELECT o.*, (SELECT arg_min(f.district, f.ord) FROM b_fees f WHERE contains({_COMPACT}, replace(f.district, ' ', ''))) AS district,
    (SELECT arg_min(f.fee_cents, f.ord) FROM b_fees f WHERE contains({_COMPACT}, replace(f.district, ' ', ''))) AS configured FROM b_orders o),
income AS (SELECT service_date AS date, CASE WHEN fee_cents > 0 THEN fee_cents ELSE coalesce(configured, 1500000) END AS r FROM priced WHERE service_date IS NOT NULL),
daily AS (
  SELECT date, sum(r)::BIGINT AS revenue_cents, sum(f)::BIGINT AS fuel_cents, sum(n)::BIGINT AS deliveries, (sum(r) - sum(f))::BIGINT AS net_cents
  FROM (SELECT date, r, 0 AS f, 1 AS n FROM income UNION ALL SELECT date, 0, amount_cents, 0 FROM b_fuel) GROUP BY date)"""
_DAILY = B.with_ctes("b_orders", "b_fees", "b_fuel") + ", " + _PRICED


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return finance.daily_profit(B.orders(spark, d), B.fuel(spark, d), B.fees(spark, d))


@query(_DAILY + " SELECT * FROM daily")
def daily_profit(spark, d):
    return _daily(spark, d)


@query(_DAILY + " SELECT *, revenue_cents > 0 AS has_revenue, fuel_cents > 0 AS has_fuel FROM daily")
def calendar_profit_days(spark, d):
    return finance.calendar_days(_daily(spark, d))


@query(_DAILY + " SELECT sum(revenue_cents)::BIGINT AS revenue_cents, sum(fuel_cents)::BIGINT AS fuel_cents, sum(net_cents)::BIGINT AS net_cents, sum(deliveries)::BIGINT AS deliveries FROM daily")
def period_profit(spark, d):
    return finance.period_total(_daily(spark, d))


@query(_DAILY + f" SELECT date, replace(substr(date, 6), '-', '/') AS label, net_cents FROM daily WHERE date <= '{TODAY}' AND (deliveries > 0 OR fuel_cents > 0) ORDER BY date DESC LIMIT 8")
def profit_trend_last_n(spark, d):
    return finance.trend(_daily(spark, d), TODAY)


@query(
    _DAILY
    + """ SELECT date AS ord, 0 AS "all", concat_ws(',', date, revenue_cents, fuel_cents, net_cents, deliveries) AS line FROM daily
UNION ALL SELECT NULL, 1, concat_ws(',', 'total', sum(revenue_cents)::BIGINT, sum(fuel_cents)::BIGINT, sum(net_cents)::BIGINT, sum(deliveries)::BIGINT) FROM daily"""
)
def profit_csv_rollup(spark, d):
    return finance.csv_rows(_daily(spark, d)).withColumn("all", F.col("all").cast("int"))


@query(
    B.with_ctes("b_orders", "b_fees") + ", " + _PRICED.split("income AS")[0].rstrip().rstrip(",")
    + " SELECT id, district, CASE WHEN fee_cents > 0 THEN fee_cents ELSE coalesce(configured, 1500000) END AS revenue_cents FROM priced"
)
def district_fee_lookup(spark, d):
    return finance.order_fees(B.orders(spark, d), B.fees(spark, d)).select("id", "district", "revenue_cents")


_EFF = """SELECT {k} m.d AS distance_cm, f.l AS liters, f.c AS fuel_cents, CASE WHEN f.l > 0 THEN floor(m.d / 100.0::DOUBLE / f.l * 10 + 0.5) / 10.0::DOUBLE END AS km_per_liter,
  CASE WHEN m.d > 0 THEN floor(f.c / (m.d / 100.0::DOUBLE) + 0.5) END AS cents_per_km"""


@query(B.with_ctes("b_fuel", "b_mileage") + _EFF.format(k="") + " FROM (SELECT sum(distance_cm)::BIGINT AS d FROM b_mileage) m, (SELECT sum(liters) AS l, sum(amount_cents)::BIGINT AS c FROM b_fuel) f")
def fleet_efficiency(spark, d):
    return finance.efficiency(B.fuel(spark, d), B.mileage(spark, d))


@query(
    B.with_ctes("b_fuel", "b_mileage")
    + """, f AS (SELECT coalesce(nullif(trim(vehicle), ''), 'unassigned') AS vehicle, sum(liters) AS l, sum(amount_cents)::BIGINT AS c FROM b_fuel GROUP BY 1),
m AS (SELECT coalesce(nullif(trim(vehicle), ''), 'unassigned') AS vehicle, sum(distance_cm)::BIGINT AS d FROM b_mileage GROUP BY 1),
j AS (SELECT coalesce(f.vehicle, m.vehicle) AS vehicle, coalesce(m.d, 0) AS d, coalesce(f.l, 0) AS l, coalesce(f.c, 0) AS c FROM f FULL JOIN m ON f.vehicle = m.vehicle)
SELECT vehicle, d AS distance_cm, l AS liters, c AS fuel_cents, CASE WHEN l > 0 THEN floor(d / 100.0::DOUBLE / l * 10 + 0.5) / 10.0::DOUBLE END AS km_per_liter,
  CASE WHEN d > 0 THEN floor(c / (d / 100.0::DOUBLE) + 0.5) END AS cents_per_km FROM j"""
)
def efficiency_by_vehicle(spark, d):
    return finance.efficiency_by_vehicle(B.fuel(spark, d), B.mileage(spark, d))


@query(
    B.with_ctes("b_fuel", "b_mileage")
    + """ SELECT date, sum(f)::BIGINT AS fuel_cents, sum(nf)::BIGINT AS fuel_logs, sum(m)::BIGINT AS distance_cm, sum(nm)::BIGINT AS mileage_logs
FROM (SELECT date, amount_cents AS f, 1 AS nf, 0 AS m, 0 AS nm FROM b_fuel UNION ALL SELECT date, 0, 0, distance_cm, 1 FROM b_mileage) GROUP BY date"""
)
def day_log_totals(spark, d):
    return finance.day_totals(B.fuel(spark, d), B.mileage(spark, d))


def _fuel_input(spark, d):
    """Raw fuel inputs with every kind of fault."""
    k = F.col("l_orderkey")
    return B.read(spark, d, "lineitem").select(
        F.concat_ws("-", k, "l_partkey", "l_suppkey", "l_linenumber").alias("id"),
        F.when(k % 19 == 0, "2026/01/02").otherwise(B.iso(F.col("l_shipdate"))).alias("date"),
        F.when(k % 23 == 0, F.lit(0.0)).otherwise(F.col("l_quantity")).alias("liters"),
        F.when(k % 3 == 0, F.lit(None)).otherwise(F.floor(F.col("l_discount") * 10000 + 1500)).cast("double").alias("price_per_liter"),
        F.when(k % 2 == 0, F.lit(None)).otherwise(F.floor(F.col("l_extendedprice") * 100 + 0.5) / 4).cast("double").alias("amount"),
        F.when(k % 29 == 0, F.lit(-1.0)).when(k % 5 == 0, F.lit(None)).otherwise((k % 1000).cast("double")).alias("odometer_km"),
        F.when(k % 7 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" V"), (F.col("l_suppkey") % 25).cast("string"))).alias("vehicle"),
    )


_FUEL_IN = """WITH raw AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS id, CASE WHEN l_orderkey % 19 = 0 THEN '2026/01/02' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date,
    CASE WHEN l_orderkey % 23 = 0 THEN 0.0::DOUBLE ELSE l_quantity END AS liters, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE floor(l_discount * 10000 + 1500) END AS price_per_liter,
    CASE WHEN l_orderkey % 2 = 0 THEN NULL ELSE floor(l_extendedprice * 100 + 0.5) / 4 END AS amount,
    CASE WHEN l_orderkey % 29 = 0 THEN -1.0::DOUBLE WHEN l_orderkey % 5 = 0 THEN NULL ELSE (l_orderkey % 1000)::DOUBLE END AS odometer_km,
    CASE WHEN l_orderkey % 7 = 0 THEN ' ' ELSE ' V' || (l_suppkey % 25) END AS vehicle FROM lineitem),
checked AS (
  SELECT *, list_filter([CASE WHEN NOT regexp_full_match(date, '\\d{4}-\\d{2}-\\d{2}') THEN 'Fuel date must be YYYY-MM-DD.' END, CASE WHEN NOT liters > 0 THEN 'Fuel liters must be greater than 0.' END,
    CASE WHEN NOT coalesce(price_per_liter > 0, false) AND NOT coalesce(amount > 0, false) THEN 'Either price per liter or total amount is required.' END,
    CASE WHEN odometer_km < 0 THEN 'Odometer must be 0 or greater.' END], lambda x: x IS NOT NULL) AS errors FROM raw)"""


@query(_FUEL_IN + " SELECT id, array_to_string(errors, ' ') AS errors FROM checked WHERE len(errors) > 0")
def fuel_log_validation(spark, d):
    return finance.validate_fuel(_fuel_input(spark, d)).where(F.size("errors") > 0).select("id", F.concat_ws(" ", "errors").alias("errors"))


@query(
    _FUEL_IN
    + """ SELECT id, date, liters, CASE WHEN amount > 0 AND price_per_liter > 0 THEN floor(price_per_liter + 0.5) WHEN amount > 0 THEN floor(floor(amount + 0.5) / liters * 10 + 0.5) / 10.0::DOUBLE ELSE coalesce(price_per_liter, 0) END AS price_per_liter,
  CASE WHEN amount > 0 THEN floor(amount + 0.5) ELSE floor(coalesce(price_per_liter, 0) * liters + 0.5) END AS amount, coalesce(odometer_km, 0) AS odometer_km, nullif(trim(vehicle), '') AS vehicle FROM checked WHERE len(errors) = 0"""
)
def fuel_log_build(spark, d):
    return finance.build_fuel(_fuel_input(spark, d))


@query(
    """WITH raw AS (SELECT event_id AS id, CASE WHEN event_id % 17 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d') END AS date, CASE WHEN event_id % 11 = 0 THEN -5.0::DOUBLE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS odometer_km,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 19 = 0 THEN -1.0::DOUBLE ELSE value / 10 END AS daily_distance_km, CASE WHEN event_id % 3 = 0 THEN '  ' ELSE 'V' || (user_id % 25) END AS vehicle FROM events)
SELECT id, date, odometer_km, coalesce(daily_distance_km, 0) AS daily_distance_km, nullif(trim(vehicle), '') AS vehicle FROM raw
WHERE regexp_full_match(date, '\\d{4}-\\d{2}-\\d{2}') AND odometer_km >= 0 AND (daily_distance_km IS NULL OR daily_distance_km >= 0)"""
)
def mileage_log_build(spark, d):
    e = F.col("event_id")
    raw = B.read(spark, d, "events").select(
        e.alias("id"),
        F.when(e % 17 == 0, "soon").otherwise(B.iso(F.col("ts"))).alias("date"),
        F.when(e % 11 == 0, F.lit(-5.0)).when(e % 13 == 0, F.lit(None)).otherwise(F.col("value")).alias("odometer_km"),
        F.when(e % 5 == 0, F.lit(None)).when(e % 19 == 0, F.lit(-1.0)).otherwise(F.col("value") / 10).alias("daily_distance_km"),
        F.when(e % 3 == 0, "  ").otherwise(F.concat(F.lit("V"), (F.col("user_id") % 25).cast("string"))).alias("vehicle"),
    )
    return finance.build_mileage(raw)


def _legacy(spark, d):
    k = F.col("o_orderkey")
    at = F.concat(B.iso(F.col("o_orderdate")), F.when(k % 3 == 0, F.concat(F.lit(" "), F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":15"))).when(k % 3 == 1, F.lit("")).otherwise(F.lit("T9:5")))
    return B.read(spark, d, "orders").select(
        F.concat(F.when(k % 4 == 0, "delivery-").otherwise("old-"), k.cast("string")).alias("id"),
        F.concat(F.lit("shop "), (k % 9).cast("string")).alias("orderVendor"), F.when(k % 5 == 0, "").otherwise("02-111-2222").alias("orderVendorTel"),
        F.lit("").alias("deliveryVendor"), F.lit("").alias("deliveryVendorTel"),
        F.element_at(F.array(*[F.lit(x) for x in ("축하 화환", "근조 화환", "관엽 화분", "basket", "")]), (k % 5 + 1).cast("int")).alias("productName"),
        (k % 4 - 1).cast("int").alias("productQuantity"), F.when(k % 2 == 0, "13:00").otherwise("1pm").alias("eventTime"), at.alias("deliveryDt"),
        F.when(k % 6 == 0, "").otherwise("Main st 1").alias("deliveryAddress"), F.lit("").alias("customerRequests"), F.lit("010-1234-5678").alias("recipientTel"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending").alias("status"),
        ((k % 200) / 10.0).alias("distanceKm"), (k % 7 * 1000.0).alias("fee"), F.lit(37.5).alias("latitude"), F.lit(None).cast("double").alias("longitude"),
    )


_LEGACY = """WITH l AS (
  SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'delivery-' ELSE 'old-' END || o_orderkey AS id, ['축하 화환', '근조 화환', '관엽 화분', 'basket', ''][o_orderkey % 5 + 1] AS product, (o_orderkey % 4 - 1)::INT AS qty,
    CASE WHEN o_orderkey % 2 = 0 THEN '13:00' ELSE '1pm' END AS ev, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey % 3 AS form, lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':15' AS clock,
    CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'Main st 1' END AS address, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'pending' END AS status, (o_orderkey % 200) / 10.0::DOUBLE AS km, o_orderkey % 7 * 1000.0::DOUBLE AS fee,
    'shop ' || (o_orderkey % 9) AS vendor, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '02-111-2222' END AS tel FROM orders),
o AS (SELECT *, CASE WHEN form < 2 THEN day END AS service_date, CASE WHEN form = 0 THEN day || 'T' || clock || ':00+09:00' END AS deadline, CASE WHEN form < 2 AND ev = '13:00' THEN day || 'T13:00:00+09:00' END AS event_at FROM l)"""


@query(
    _LEGACY
    + """ SELECT id, CASE product WHEN '축하 화환' THEN 'congratulation' WHEN '근조 화환' THEN 'condolence' WHEN '관엽 화분' THEN 'plant' WHEN 'basket' THEN 'other' END AS category, CASE WHEN qty > 0 THEN qty END AS quantity, service_date, deadline AS strict_deadline_at, event_at,
  CASE WHEN deadline IS NOT NULL THEN 'exact' WHEN service_date IS NOT NULL THEN 'date-only' ELSE 'unknown' END AS precision, CASE WHEN event_at IS NOT NULL THEN 'critical' ELSE 'normal' END AS priority, address, status, CASE WHEN status = 'completed' THEN 'completed' END AS proof,
  CASE WHEN starts_with(id, 'delivery-') THEN 'sample' ELSE 'migration' END AS source FROM o"""
)
def legacy_to_order(spark, d):
    o = schedule.legacy_to_order(_legacy(spark, d), "2026-01-01T00:00:00Z")
    return o.select(
        "id", "product.category", "product.quantity", F.col("schedule.serviceDate").alias("service_date"), F.col("schedule.strictDeadlineAt").alias("strict_deadline_at"), F.col("schedule.eventAt").alias("event_at"),
        F.col("schedule.timePrecision").alias("precision"), "schedule.priority", "destination.address", "status", F.col("proofOfDelivery.status").alias("proof"), F.col("source.type").alias("source"),
    )


@query(
    _LEGACY
    + """ SELECT id, vendor AS "orderVendor", tel AS "orderVendorTel", product AS "productName", CASE WHEN qty > 0 THEN qty ELSE 0 END AS "productQuantity", CASE WHEN event_at IS NOT NULL THEN '13:00' ELSE '' END AS "eventTime",
  concat_ws(' ', service_date, CASE WHEN deadline IS NOT NULL THEN clock END) AS "deliveryDt", coalesce(address, '') AS "deliveryAddress", CASE WHEN status IN ('completed', 'failed') THEN status ELSE 'pending' END AS status, km AS "distanceKm", fee, 0.0::DOUBLE AS longitude FROM o"""
)
def order_to_legacy(spark, d):
    return schedule.order_to_legacy(schedule.legacy_to_order(_legacy(spark, d), "2026-01-01T00:00:00Z")).select(
        "id", "orderVendor", "orderVendorTel", "productName", "productQuantity", "eventTime", "deliveryDt", "deliveryAddress", "status", "distanceKm", "fee", "longitude"
    )


_ITEMS = B.with_ctes("b_orders") + """, items AS (
  SELECT 'calendar-' || id AS id, id AS order_id, service_date AS date, strict_deadline_at AS deadline_at, start_at, event_at, planned_at, coalesce(nullif(venue_name, ''), nullif(product_name, ''), nullif(address, ''), '배달 일정') AS title, address, status,
    CASE WHEN event_at IS NOT NULL THEN 'critical' ELSE 'normal' END AS priority FROM b_orders WHERE service_date IS NOT NULL)"""


@query(_ITEMS + " SELECT *, coalesce(deadline_at, start_at, event_at, planned_at, date || 'T23:59:59') AS sort_key FROM items")
def calendar_items(spark, d):
    return schedule.calendar_items(B.orders(spark, d)).withColumn("sort_key", schedule.calendar_order())


@query(B.with_ctes("b_orders") + " SELECT id, service_date FROM b_orders WHERE service_date BETWEEN '1996-02-01' AND '1996-02-29'")
def orders_in_range(spark, d):
    return schedule.in_range(B.orders(spark, d), "1996-02-01", "1996-02-29").select("id", "service_date")


def _stops(spark, d):
    e = F.col("event_id")
    orders = B.read(spark, d, "orders")
    return orders.where("o_orderstatus <> 'F'").select(
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("order_id"),
        F.explode(F.array(F.struct((F.col("o_orderkey") % 9 + 2).cast("int").alias("sequence"), F.lit("10:00").alias("planned_at")), F.struct((F.col("o_orderkey") % 5 * 2 + 1).cast("int").alias("sequence"), F.lit("11:00").alias("planned_at")))).alias("s"),
    ).select("order_id", "s.sequence", F.concat("s.planned_at", F.lit("/"), F.col("s.sequence").cast("string")).alias("planned_at"))


@query(
    _ITEMS
    + """, stops AS (SELECT 'order-' || o_orderkey AS order_id, unnest([{'s': (o_orderkey % 9 + 2)::INT, 'p': '10:00'}, {'s': (o_orderkey % 5 * 2 + 1)::INT, 'p': '11:00'}]) AS x FROM orders WHERE o_orderstatus <> 'F'),
firsts AS (SELECT order_id, min(x.s) AS sequence FROM stops GROUP BY order_id)
SELECT i.id, f.sequence FROM items i LEFT JOIN firsts f ON f.order_id = i.order_id"""
)
def calendar_route_left_join(spark, d):
    return schedule.with_stops(schedule.calendar_items(B.orders(spark, d)), _stops(spark, d)).select("id", "sequence")


_LATE = "coalesce(planned_ts > coalesce(deadline_ts, event_ts, start_ts), false)"
_OVERLAP = """EXISTS (SELECT 1 FROM b_calendar r WHERE r.id <> c.id AND c.start_ts < r.end_ts AND r.start_ts < c.end_ts)"""


@query(B.with_ctes("b_calendar") + f" SELECT id, {_OVERLAP} AS conflict, {_LATE} AS late FROM b_calendar c")
def schedule_risks(spark, d):
    return schedule.risks(B.calendar(spark, d))


@query(
    B.with_ctes("b_calendar")
    + f""", risks AS (SELECT c.*, {_OVERLAP} AS conflict, {_LATE} AS late FROM b_calendar c), days AS (SELECT strftime(x, '%Y-%m-%d') AS date FROM (SELECT unnest(generate_series(DATE '2023-12-31', DATE '2023-12-31' + INTERVAL 41 DAY, INTERVAL 1 DAY)) AS x))
SELECT d.date, count(r.id) AS items, coalesce(bool_or(r.priority <> 'normal' OR r.conflict OR r.late), false) AS urgent FROM days d LEFT JOIN risks r ON r.date = d.date GROUP BY d.date"""
)
def month_grid_urgency(spark, d):
    return schedule.month_grid(B.calendar(spark, d), "2024-01-01")


_NOTES = B.with_ctes("b_orders") + f""", leads AS (SELECT * FROM (VALUES ('strictDeadline', 'strict', 60, 0), ('strictDeadline', 'strict', 30, 1), ('eventTime', 'event', 120, 2), ('eventTime', 'event', 60, 3)) AS t(kind, tag, lead, ord)),
timed AS (SELECT o.*, l.*, epoch_ms(CASE WHEN l.tag = 'strict' THEN strict_deadline_at ELSE event_at END::TIMESTAMPTZ) AS at_ms FROM b_orders o, leads l WHERE status IN ('pending', 'reviewRequired')),
notes AS (
  SELECT 'waybill-' || id || '-' || tag || '-' || lead AS id, id AS order_id, kind, at_ms - lead * 60000 AS fire_at_ms, CASE WHEN tag = 'strict' THEN '배송 엄수 ' ELSE '예식/행사 ' END || lead || '분 전' AS title,
    coalesce(product_name, venue_name, 'delivery') || ' · ' || address AS body, ord FROM timed WHERE at_ms <> 0 AND at_ms - lead * 60000 > {NOW_MS})"""


@query(_NOTES + " SELECT * FROM notes")
def planned_notifications(spark, d):
    return schedule.planned_notifications(B.orders(spark, d), NOW_MS)


@query(_NOTES + " SELECT kind, count(*) AS n FROM notes GROUP BY kind")
def notification_counts(spark, d):
    return schedule.planned_notifications(B.orders(spark, d), NOW_MS).groupBy("kind").agg(F.count("*").alias("n"))


@query(_NOTES + " SELECT id, fire_at_ms FROM notes ORDER BY fire_at_ms, order_id, ord LIMIT 12")
def next_notifications(spark, d):
    return schedule.planned_notifications(B.orders(spark, d), NOW_MS).orderBy("fire_at_ms", "order_id", "ord").limit(12).select("id", "fire_at_ms")


@query(
    B.with_ctes("b_archive")
    + """, k AS (SELECT id, captured_at, coalesce(week_key, 'unknown') AS week_key FROM b_archive)
SELECT week_key, strftime(date_trunc('week', max(captured_at) + INTERVAL 9 HOUR), '%Y.%m.%d') || ' ~ ' || strftime(date_trunc('week', max(captured_at) + INTERVAL 9 HOUR) + INTERVAL 6 DAY, '%m.%d') AS label,
  list(id ORDER BY captured_at DESC, id DESC) AS receipts, count(*) AS n FROM k GROUP BY week_key"""
)
def archive_weeks(spark, d):
    return schedule.archive_weeks(B.archive(spark, d))


@query(B.with_ctes("b_archive") + " SELECT count(*) AS receipts, count(DISTINCT coalesce(week_key, 'unknown')) AS weeks FROM b_archive")
def archive_total(spark, d):
    return schedule.archive_weeks(B.archive(spark, d)).agg(F.sum("n").alias("receipts"), F.count("*").alias("weeks"))


@query(B.with_ctes("b_orders") + " SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status <> 'pending') AS completed, round(sum(distance_km) FILTER (status = 'pending'), 6) AS remaining_km FROM b_orders")
def home_figures(spark, d):
    return schedule.home_figures(B.orders(spark, d))


@query(
    B.with_ctes("b_orders")
    + """ SELECT id, CASE WHEN status IN ('failed', 'revisitNeeded') THEN 'risk' WHEN event_at IS NOT NULL OR contains(coalesce(product_name, ''), '축하') THEN 'urgent' WHEN distance_km >= 10 THEN 'risk' WHEN status = 'completed' THEN 'completed' ELSE 'normal' END AS class FROM b_orders"""
)
def priority_classes(spark, d):
    return B.orders(spark, d).select("id", schedule.priority_class(F.col("event_at"), F.col("product_name"), F.col("status"), F.col("distance_km")).alias("class"))


@query(B.with_ctes("b_orders") + " SELECT id FROM b_orders WHERE status = 'pending' AND contains(lower(concat_ws(' ', nullif(product_name, ''), nullif(address, ''), nullif(vendor_name, ''))), 'asia nation_1')")
def delivery_search(spark, d):
    return schedule.search(B.orders(spark, d), " ASIA NATION_1 ", "pending", ["product_name", "address", "vendor_name"]).select("id")


@query(_ITEMS + " SELECT date, list(id ORDER BY coalesce(deadline_at, start_at, event_at, date || 'T23:59'), id) AS ids FROM items GROUP BY date")
def items_by_date(spark, d):
    return schedule.items_by_date(schedule.calendar_items(B.orders(spark, d)))


_STATE = B.with_ctes("b_changes") + """, state AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day DESC, part_key DESC, supp_key DESC, price_cents DESC, discount_pct DESC) AS rn FROM b_changes) WHERE rn = 1)"""


def _state(spark, d):
    return changes.compact_log(B.changes(spark, d), ["key"], [F.col(c) for c in ("day", "part_key", "supp_key", "price_cents", "discount_pct")])


@query(_STATE + " SELECT key, order_key, day, part_key, supp_key, price_cents, discount_pct FROM state")
def upsert_latest(spark, d):
    return _state(spark, d)


@query(_STATE + " SELECT key, day FROM state WHERE key NOT IN (SELECT key FROM b_changes WHERE discount_pct = 0)")
def delete_by_key(spark, d):
    gone = B.changes(spark, d).where("discount_pct = 0").select("key")
    return changes.delete(_state(spark, d), gone, ["key"]).select("key", "day")


@query(_STATE + ", fresh AS (SELECT key, 'new' AS day FROM state WHERE discount_pct >= 8 UNION ALL SELECT 'x-' || key, 'new' FROM state WHERE discount_pct = 1) SELECT key, day FROM fresh UNION ALL SELECT key, day FROM state WHERE key NOT IN (SELECT key FROM fresh)")
def upsert_merge(spark, d):
    now = _state(spark, d).select("key", "discount_pct", "day")
    fresh = now.where("discount_pct >= 8").select("key", F.lit("new").alias("day")).unionByName(now.where("discount_pct = 1").select(F.concat(F.lit("x-"), "key").alias("key"), F.lit("new").alias("day")))
    return changes.upsert(now.select("key", "day"), fresh, ["key"])


@query(_STATE + " SELECT key, day, price_cents FROM state WHERE key = (SELECT max(key) FROM state)")
def point_lookup(spark, d):
    """The record of one key, here the greatest."""
    state = _state(spark, d)
    key = state.agg(F.max("key")).first()[0]
    return state.where(F.col("key") == key).select("key", "day", "price_cents")


def _migration(spark, d):
    legacy = _legacy(spark, d).select("id", F.lit(1).alias("ord"), "status").unionByName(_legacy(spark, d).where("fee = 0").select("id", F.lit(2).alias("ord"), F.lit("again").alias("status")))
    return changes.migrate(legacy, _legacy(spark, d).where("fee = 1000").select("id"))


_MIGRATE = _LEGACY + ", legacy AS (SELECT id, 1 AS ord, status, fee FROM l UNION ALL SELECT id, 2, 'again', fee FROM l WHERE fee = 0), added AS (SELECT id, arg_min(status, ord) AS status FROM legacy WHERE id NOT IN ('delivery-1', 'delivery-2', 'delivery-3', 'delivery-4') AND fee <> 1000 GROUP BY id)"


@query(_MIGRATE + " SELECT id, status FROM added")
def legacy_migration(spark, d):
    return _migration(spark, d)[0].select("id", "status")


@query(_MIGRATE + " SELECT (SELECT count(*) FROM legacy) AS source_count, (SELECT count(*) FROM legacy WHERE id IN ('delivery-1', 'delivery-2', 'delivery-3', 'delivery-4')) AS skipped_samples, (SELECT count(*) FROM added) AS migrated_count")
def migration_report(spark, d):
    return _migration(spark, d)[1]


@query(
    B.with_ctes("b_orders")
    + """ SELECT id, CASE WHEN status IN ('failed', 'revisitNeeded') AND order_key % 2 = 0 THEN CASE status WHEN 'failed' THEN 'Failed delivery proof requires a failure reason.' ELSE 'Revisit proof requires a reason.' END END AS error,
  CASE status WHEN 'completed' THEN 'now' END AS completed_at, CASE WHEN order_key % 2 = 1 THEN 'closed' END AS reason, CASE WHEN order_key % 3 = 0 THEN 1 ELSE 2 END AS photos FROM b_orders WHERE status IN ('completed', 'failed', 'revisitNeeded')"""
)
def proof_transitions(spark, d):
    o = B.orders(spark, d).where("status in ('completed', 'failed', 'revisitNeeded')").withColumn("reason", F.when(F.col("order_key") % 2 == 1, " closed ").otherwise("  "))
    photos = F.array(F.lit("a"), F.when(F.col("order_key") % 3 == 0, "").otherwise("b"))
    made = [F.when(F.col("status") == s, changes.proof(s, F.lit("now"), photos=photos, reason=F.col("reason"))) for s in ("completed", "failed", "revisitNeeded")]
    p = o.withColumn("p", F.coalesce(*made))
    return p.select("id", changes.proof_error(F.col("status"), F.col("reason")).alias("error"), F.col("p.completedAt").alias("completed_at"), F.col("p.failureReason").alias("reason"), F.size("p.photoUris").alias("photos"))


@query(
    "SELECT c_custkey, floor((37.48 + list_sum(list_transform(string_split(c_name, ''), lambda x: ascii(x))) % 45 / 1000.0::DOUBLE) * 1000000 + 0.5)::BIGINT AS lat6, floor((127.01 + list_sum(list_transform(string_split(c_name, ''), lambda x: ascii(x))) % 70 / 1000.0::DOUBLE) * 1000000 + 0.5)::BIGINT AS lon6 FROM customer"
)
def pseudo_geocode(spark, d):
    lat, lon = S.pseudo_geocode(F.col("c_name"))
    return B.read(spark, d, "customer").select("c_custkey", F.floor(lat * 1000000 + 0.5).cast("long").alias("lat6"), F.floor(lon * 1000000 + 0.5).cast("long").alias("lon6"))


_STOPS = "WITH s AS (SELECT c_nationkey AS route, c_custkey AS ord, 37.4 + (c_custkey * 7919 % 1000) / 4000.0::DOUBLE AS latitude, 126.8 + (c_custkey * 104729 % 1000) / 4000.0::DOUBLE AS longitude FROM customer)"


@query(
    _STOPS
    + ", n AS (SELECT *, lead(latitude) OVER w AS lat2, lead(longitude) OVER w AS lon2 FROM s WINDOW w AS (PARTITION BY route ORDER BY ord)), h AS (SELECT *, pow(sin(radians(lat2 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(lat2)) * pow(sin(radians(lon2 - longitude) / 2), 2) AS a FROM n) SELECT route, ord, round(6371.0::DOUBLE * 2 * atan2(sqrt(a), sqrt(1 - a)), 6) AS km FROM h WHERE lat2 IS NOT NULL"
)
def haversine_legs(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("route").orderBy("ord")
    s = B.stops(spark, d).withColumn("lat2", F.lead("latitude").over(w)).withColumn("lon2", F.lead("longitude").over(w)).where("lat2 is not null")
    return s.select("route", "ord", F.round(S.haversine_km(F.col("latitude"), F.col("longitude"), F.col("lat2"), F.col("lon2")), 6).alias("km"))


@query(B.with_ctes("b_orders") + " SELECT id, regexp_replace(address, '^(\\S+ \\S+) .*$', '\\1 ···') AS masked FROM b_orders")
def address_masking(spark, d):
    return B.orders(spark, d).select("id", changes.address_mask(F.col("address")).alias("masked"))


@query(
    """SELECT DISTINCT o_custkey AS driver, CASE o_custkey % 8 WHEN 0 THEN 'Invalid JSON backup file.' WHEN 1 THEN 'Backup root must be an object.' WHEN 2 THEN 'This is not a backup file of this application.' WHEN 3 THEN 'Unsupported backup schema version.'
  WHEN 4 THEN 'Backup contains invalid collection data.' WHEN 5 THEN 'Backup contains invalid contact logs.' WHEN 6 THEN 'Backup is missing settings.' END AS error FROM orders"""
)
def backup_validation(spark, d):
    """Backups of each driver's orders, most of them spoilt in one of seven ways."""
    k, form = F.col("o_custkey"), F.col("o_custkey") % 8
    record = F.struct(F.concat(F.lit("order-"), "o_orderkey").alias("id"), F.when(form != 4, F.col("o_orderstatus")).alias("status"), F.struct(F.col("o_orderdate").cast("string").alias("date")).alias("schedule"))
    orders = B.read(spark, d, "orders").groupBy(k.alias("driver")).agg(F.to_json(F.collect_list(record)).alias("orders"))
    form = F.col("driver") % 8
    text = F.concat(
        F.when(form == 1, "[").otherwise(""), F.lit('{"app":"'), F.when(form == 2, "other").otherwise("waybill"), F.lit('","schemaVersion":'), F.when(form == 3, "2").otherwise("1"), F.lit(',"orders":'), "orders", F.lit(',"fuelLogs":[],"mileageLogs":[{"id":"m"}]'),
        F.when(form == 5, ',"contactLogs":[1]').otherwise(""), F.when(form != 6, ',"settings":{}').otherwise(""), F.when(form != 0, "}").otherwise(""), F.when(form == 1, "]").otherwise(""),
    )
    return orders.select("driver", changes.backup_error(text).alias("error"))


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 9000.0::DOUBLE WHEN n_nationkey % 3 = 1 THEN 15000.0::DOUBLE ELSE 77.0::DOUBLE END AS fee FROM nation")
def settings_merge(spark, d):
    n = B.read(spark, d, "nation").orderBy("n_nationkey")
    default = F.map_from_entries(F.collect_list(F.when(F.col("n_nationkey") % 3 != 2, F.struct("n_name", F.lit(15000.0)))))
    stored = F.map_from_entries(F.collect_list(F.when(F.col("n_nationkey") % 3 == 0, F.struct("n_name", F.lit(9000.0))).when(F.col("n_nationkey") % 3 == 2, F.struct("n_name", F.lit(77.0)))))
    return n.agg(default.alias("a"), stored.alias("b")).select(F.explode(changes.merge_maps(F.col("a"), F.col("b"))).alias("name", "fee"))
