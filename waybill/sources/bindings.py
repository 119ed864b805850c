"""Delivery relations bound to the driver's star schema.

Money is whole cents, every ordered choice has an ordinal, and dates are ISO strings. ``CTES`` says the same in SQL for
checking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(x: Column) -> Column:
    return F.floor(x * 100 + 0.5).cast("long")


def iso(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM-dd")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery orders, flat: one per order, with its customer's address.

    All joins are left to Catalyst, which knows the sizes: customers are facts at a large scale, nations and regions never.
    """
    places = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    k = F.col("o_orderkey")
    return (
        read(spark, sf_dir, "orders")
        .join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            k.alias("order_key"),
            F.concat(F.lit("order-"), k.cast("string")).alias("id"),
            F.when(k % 17 != 0, iso(F.col("o_orderdate"))).alias("service_date"),
            F.when(F.col("o_orderpriority") == "1-URGENT", cents(F.col("o_totalprice"))).otherwise(F.lit(0)).cast("long").alias("fee_cents"),
            F.concat_ws(" ", "r_name", "n_name", "c_mktsegment").alias("address"),
            F.when(F.col("o_orderstatus") == "F", "completed")
            .when(F.col("o_orderstatus") == "O", "pending")
            .otherwise(F.element_at(F.array(*[F.lit(s) for s in ("draft", "reviewRequired", "failed", "revisitNeeded", "cancelled")]), (k % 5 + 1).cast("int")))
            .alias("status"),
            F.when((k % 17 != 0) & (k % 3 == 0), F.concat(iso(F.col("o_orderdate")), F.lit("T"), F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":30:00+09:00"))).alias("strict_deadline_at"),
            F.when((k % 17 != 0) & (k % 4 == 0), F.concat(iso(F.col("o_orderdate")), F.lit("T"), F.lpad((k % 20 + 3).cast("string"), 2, "0"), F.lit(":00:00+09:00"))).alias("event_at"),
            F.when(k % 7 == 0, F.concat(iso(F.col("o_orderdate")), F.lit("T"), F.lpad((k % 12 + 8).cast("string"), 2, "0"), F.lit(":00:00+09:00"))).alias("start_at"),
            F.when(k % 5 == 1, F.concat(iso(F.col("o_orderdate")), F.lit("T"), F.lpad((k % 10 + 7).cast("string"), 2, "0"), F.lit(":45:00+09:00"))).alias("planned_at"),
            F.when(k % 11 != 0, F.concat(F.lit("wreath "), F.col("c_mktsegment"))).alias("product_name"),
            F.when(k % 5 == 0, F.concat(F.lit("hall "), F.col("n_name"))).alias("venue_name"),
            F.col("c_name").alias("vendor_name"),
            ((k % 200) / 10.0).alias("distance_km"),
        )
    )


def fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fee table (region, district, fee_cents, ord), at most 25 rows."""
    n = F.col("n_nationkey")
    return (
        read(spark, sf_dir, "nation")
        .join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("r_name").alias("region"), F.col("n_name").alias("district"), ((F.lit(10000) + n * 500) * 100).cast("long").alias("fee_cents"), n.cast("int").alias("ord"))
    )


def fuel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "lineitem")
        .where("l_linenumber = 1")
        .select(
            F.concat_ws("-", F.lit("fuel"), F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("id"),
            iso(F.col("l_shipdate")).alias("date"),
            F.col("l_quantity").alias("liters"),
            cents(F.col("l_extendedprice")).alias("amount_cents"),
            F.when(F.col("l_suppkey") % 10 == 0, F.lit("  ")).otherwise(F.concat(F.lit("V"), (F.col("l_suppkey") % 25).cast("string"))).alias("vehicle"),
        )
    )


def mileage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("mileage-"), F.col("event_id").cast("string")).alias("id"),
        iso(F.col("ts")).alias("date"),
        F.floor(F.col("value") * 100 + 0.5).cast("long").alias("distance_cm"),
        F.concat(F.lit("V"), (F.col("user_id") % 25).cast("string")).alias("vehicle"),
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar items from view events: an interval of as many minutes as the value, planned and deadline around it."""
    e = F.col("event_id")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    minutes = lambda n: F.make_dt_interval(mins=n)
    start = F.date_trunc("second", F.col("ts"))
    return (
        read(spark, sf_dir, "events")
        .where("event_type = 'view'")
        .select(
            F.concat(F.lit("calendar-"), e.cast("string")).alias("id"),
            iso(F.col("ts")).alias("date"),
            F.when(e % 13 != 0, stamp(start)).alias("start_at"),
            F.when(e % 13 != 0, stamp(start + minutes(F.floor(F.col("value")).cast("int")))).alias("end_at"),
            F.when(e % 3 == 0, stamp(start + minutes((e % 7 * 10).cast("int")))).alias("deadline_at"),
            F.when(e % 4 == 0, stamp(start + minutes((e % 5 * 10).cast("int")))).alias("event_at"),
            F.when(e % 2 == 0, stamp(start + minutes((e % 11 * 6).cast("int")))).alias("planned_at"),
            F.when(e % 9 == 0, F.lit("critical")).otherwise(F.lit("normal")).alias("priority"),
            F.col("user_id").alias("driver"),
        )
    )


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waybill.functions.semantics import iso_week_key

    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("receipt-"), F.col("event_id").cast("string")).alias("id"),
        F.date_trunc("second", F.col("ts")).alias("captured_at"),
        F.when(F.col("event_id") % 50 != 0, iso_week_key(F.date_trunc("second", F.col("ts")))).alias("week_key"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert log by (order, line): a later date replaces, ties by part, supplier, price, discount."""
    return read(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("key"),
        F.col("l_orderkey").alias("order_key"),
        iso(F.col("l_shipdate")).alias("day"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"),
        cents(F.col("l_extendedprice")).alias("price_cents"),
        F.floor(F.col("l_discount") * 100 + 0.5).cast("long").alias("discount_pct"),
    )


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route stops: customers of a nation at stand-in coordinates, in order of their key."""
    return read(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("route"),
        F.col("c_custkey").alias("ord"),
        (F.lit(37.4) + (F.col("c_custkey") * 7919 % 1000) / 4000.0).alias("latitude"),
        (F.lit(126.8) + (F.col("c_custkey") * 104729 % 1000) / 4000.0).alias("longitude"),
    )


#: Lines of a rendered receipt: (number, condition, text), the texts in the same SQL on both engines.
LINES = (
    (1, "true", "'Order shop: ' || vendor_name"),
    (2, "true", "CASE order_key % 4 WHEN 0 THEN 'Delivery date: ' || service_date WHEN 1 THEN 'delivery-date ' || service_date WHEN 2 THEN 'Delivry date: ' || service_date ELSE 'Date: ' || service_date END"),
    (3, "true", "CASE order_key % 3 WHEN 0 THEN 'Product' WHEN 1 THEN 'Product: ' || product_name ELSE 'Goods: ' || product_name END"),
    (4, "order_key % 3 = 0", "product_name"),
    (5, "true", "'Phone: 010-' || lpad(CAST(order_key % 9000 + 1000 AS VARCHAR(8)), 4, '0') || '-' || lpad(CAST(order_key * 7 % 10000 AS VARCHAR(8)), 4, '0')"),
    (6, "order_key % 6 = 1", "'thank you'"),
    (7, "order_key % 5 = 2", "'Shop tel. ' || CAST(order_key % 24 AS VARCHAR(8)) || ':' || lpad(CAST(order_key % 60 AS VARCHAR(8)), 2, '0')"),
    (8, "order_key % 7 = 3", "'Product: second ' || product_name"),
    (9, "true", "'Qty: ' || CAST(order_key % 120 AS VARCHAR(8))"),
    (10, "order_key % 8 = 5", "'Zone code: Z' || CAST(order_key % 10 AS VARCHAR(8))"),
    (11, "true", "'Address: ' || address"),
)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where a small file is read by fewer tasks: for work that costs much more than the rows weigh."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def receipt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and value lines rendered from orders, an array for each: (order_key, lines array<struct(line_no, text)>)."""
    rendered = F.array(*[F.when(F.expr(cond), F.struct(F.lit(no).alias("line_no"), F.expr(text).alias("text"))) for no, cond, text in LINES])
    return orders(spark, sf_dir).select("order_key", F.filter(rendered, lambda x: x["text"].isNotNull()).alias("lines"))


#: Alias table of the rendered receipts: key, label and aliases in order.
REGISTRY = (
    ("orderingVendorName", "Order shop", ("shop", "ordering vendor", "florist")),
    ("deliveryDate", "Delivery date", ("date", "ship date", "delivery day")),
    ("productName", "Product", ("goods", "product name", "item")),
    ("quantity", "Qty", ("quantity", "count")),
    ("recipientTel", "Phone", ("recipient phone", "tel", "mobile")),
    ("deliveryAddress", "Address", ("delivery address", "place")),
    ("memo", "Memo", ("note", "remarks")),
)


def registry_rows(registry=REGISTRY) -> list[tuple[str, str, int]]:
    """(key, alias, ord): label first, then aliases."""
    out = []
    for key, label, aliases in registry:
        out += [(key, a, len(out) + i) for i, a in enumerate((label, *aliases))]
    return out


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE ['draft', 'reviewRequired', 'failed', 'revisitNeeded', 'cancelled'][o_orderkey % 5 + 1] END"
_DAY = "strftime(o_orderdate, '%Y-%m-%d')"

CTES = {
    "b_orders": f"""
  SELECT o_orderkey AS order_key, 'order-' || o_orderkey AS id, CASE WHEN o_orderkey % 17 <> 0 THEN {_DAY} END AS service_date,
    CASE WHEN o_orderpriority = '1-URGENT' THEN floor(o_totalprice * 100 + 0.5)::BIGINT ELSE 0 END AS fee_cents,
    r_name || ' ' || n_name || ' ' || c_mktsegment AS address, {_STATUS} AS status,
    CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 3 = 0 THEN {_DAY} || 'T' || lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':30:00+09:00' END AS strict_deadline_at,
    CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 4 = 0 THEN {_DAY} || 'T' || lpad((o_orderkey % 20 + 3)::VARCHAR, 2, '0') || ':00:00+09:00' END AS event_at,
    CASE WHEN o_orderkey % 7 = 0 THEN {_DAY} || 'T' || lpad((o_orderkey % 12 + 8)::VARCHAR, 2, '0') || ':00:00+09:00' END AS start_at,
    CASE WHEN o_orderkey % 5 = 1 THEN {_DAY} || 'T' || lpad((o_orderkey % 10 + 7)::VARCHAR, 2, '0') || ':45:00+09:00' END AS planned_at,
    CASE WHEN o_orderkey % 11 <> 0 THEN 'wreath ' || c_mktsegment END AS product_name, CASE WHEN o_orderkey % 5 = 0 THEN 'hall ' || n_name END AS venue_name,
    c_name AS vendor_name, (o_orderkey % 200) / 10.0::DOUBLE AS distance_km
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "b_fees": "SELECT r_name AS region, n_name AS district, ((10000 + n_nationkey * 500) * 100)::BIGINT AS fee_cents, n_nationkey AS ord FROM nation JOIN region ON n_regionkey = r_regionkey",
    "b_fuel": """
  SELECT 'fuel-' || l_orderkey || '-' || l_partkey || '-' || l_suppkey AS id, strftime(l_shipdate, '%Y-%m-%d') AS date, l_quantity AS liters, floor(l_extendedprice * 100 + 0.5)::BIGINT AS amount_cents,
    CASE WHEN l_suppkey % 10 = 0 THEN '  ' ELSE 'V' || (l_suppkey % 25) END AS vehicle FROM lineitem WHERE l_linenumber = 1""",
    "b_mileage": "SELECT 'mileage-' || event_id AS id, strftime(ts, '%Y-%m-%d') AS date, floor(value * 100 + 0.5)::BIGINT AS distance_cm, 'V' || (user_id % 25) AS vehicle FROM events",
    "b_calendar": """
  SELECT 'calendar-' || event_id AS id, strftime(ts, '%Y-%m-%d') AS date, user_id AS driver,
    CASE WHEN event_id % 13 <> 0 THEN date_trunc('second', ts) END AS start_ts, CASE WHEN event_id % 13 <> 0 THEN date_trunc('second', ts) + to_minutes(floor(value)::INT) END AS end_ts,
    CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) + to_minutes((event_id % 7 * 10)::INT) END AS deadline_ts,
    CASE WHEN event_id % 4 = 0 THEN date_trunc('second', ts) + to_minutes((event_id % 5 * 10)::INT) END AS event_ts,
    CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) + to_minutes((event_id % 11 * 6)::INT) END AS planned_ts,
    CASE WHEN event_id % 9 = 0 THEN 'critical' ELSE 'normal' END AS priority
  FROM events WHERE event_type = 'view'""",
    "b_archive": """
  SELECT 'receipt-' || event_id AS id, date_trunc('second', ts) AS captured_at,
    CASE WHEN event_id % 50 <> 0 THEN strftime(date_trunc('second', ts) + INTERVAL 9 HOUR, '%G-W%V') END AS week_key FROM events""",
    "b_changes": """
  SELECT l_orderkey || '-' || l_linenumber AS key, l_orderkey AS order_key, strftime(l_shipdate, '%Y-%m-%d') AS day, l_partkey AS part_key, l_suppkey AS supp_key,
    floor(l_extendedprice * 100 + 0.5)::BIGINT AS price_cents, floor(l_discount * 100 + 0.5)::BIGINT AS discount_pct FROM lineitem""",
    "b_lines": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT order_key, {no} AS line_no, {text} AS text FROM b_orders WHERE {cond}" for no, cond, text in LINES) + ") WHERE text IS NOT NULL",
    "b_registry": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{a}', {o})" for k, a, o in registry_rows()) + ") AS t(key, alias, ord)",
}
_NEEDS = {"b_lines": ["b_orders"]}


def with_ctes(*names: str) -> str:
    """WITH clause that defines the named bindings and what they need."""
    wanted = [n for name in names for n in [*_NEEDS.get(name, []), name]]
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in dict.fromkeys(wanted))
