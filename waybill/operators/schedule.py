"""Calendar, legacy records, risks, notifications, archives and home figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.functions.semantics import first_truthy, instant, is_service_date, week_range_label
from waybill.operators.joins import first_rows, interval_overlaps

DEFAULT_TITLE = "배달 일정"
STATUSES = ("draft", "reviewRequired", "pending", "completed", "failed", "revisitNeeded", "cancelled")


def product_category(name: Column) -> Column:
    """First keyword rule that fits, other for any further name, null without one."""
    return (
        F.when(name.rlike("축하|웨딩"), "congratulation").when(name.rlike("근조|장례"), "condolence").when(name.rlike("화분|관엽|난"), "plant").when(name != "", "other")
    )


def legacy_to_order(legacy: DataFrame, now: Column | str) -> DataFrame:
    """Flat legacy deliveries as nested orders; an empty string is no value."""
    now = F.lit(now) if isinstance(now, str) else now
    pattern = r"^(\d{4}-\d{2}-\d{2})(?:[ T](\d{2}:\d{2}))?$"
    fits = F.col("deliveryDt").rlike(pattern)
    day = F.when(fits, F.regexp_extract("deliveryDt", pattern, 1))
    clock = F.nullif(F.regexp_extract("deliveryDt", pattern, 2), F.lit(""))
    deadline = F.when(fits & clock.isNotNull(), F.concat(day, F.lit("T"), clock, F.lit(":00+09:00")))
    event = F.when(day.isNotNull() & F.col("eventTime").rlike(r"^\d{2}:\d{2}$"), F.concat(day, F.lit("T"), F.col("eventTime"), F.lit(":00+09:00")))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    finite = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c), F.col(c))
    done = F.col("status") == "completed"
    whole = (F.col("productQuantity") > 0) & (F.col("productQuantity") == F.floor("productQuantity"))
    return legacy.select(
        F.lit(1).alias("schemaVersion"),
        "id",
        F.struct(some("orderVendor").alias("name"), some("orderVendorTel").alias("telephone")).alias("orderingVendor"),
        F.struct(some("deliveryVendor").alias("name"), some("deliveryVendorTel").alias("telephone")).alias("fulfillingVendor"),
        F.struct(some("productName").alias("name"), product_category(F.col("productName")).alias("category"), F.when(whole, F.col("productQuantity")).alias("quantity")).alias("product"),
        F.struct(
            day.alias("serviceDate"),
            F.lit("Asia/Seoul").alias("timezone"),
            deadline.alias("strictDeadlineAt"),
            event.alias("eventAt"),
            F.when(deadline.isNotNull(), "exact").when(day.isNotNull(), "date-only").otherwise("unknown").alias("timePrecision"),
            F.when(event.isNotNull(), "critical").otherwise("normal").alias("priority"),
            F.when(done, now).alias("completedAt"),
        ).alias("schedule"),
        F.struct(F.lit(None).cast("string").alias("venueName"), some("deliveryAddress").alias("address"), finite("latitude").alias("latitude"), finite("longitude").alias("longitude")).alias("destination"),
        F.struct(some("recipientTel").alias("telephone")).alias("recipient"),
        some("customerRequests").alias("customerRequests"),
        "status",
        F.when(done, F.struct(F.lit("completed").alias("status"), now.alias("recordedAt"), now.alias("completedAt"), F.array().cast("array<string>").alias("photoUris"), F.lit("Migrated completed delivery.").alias("note"))).alias("proofOfDelivery"),
        F.struct(finite("distanceKm").alias("distanceKm"), finite("fee").alias("fee"), F.lit(None).cast("string").alias("district")).alias("settlement"),
        F.struct(F.when(F.col("id").startswith("delivery-"), "sample").otherwise("migration").alias("type"), F.col("id").alias("legacyId")).alias("source"),
        now.alias("createdAt"),
        now.alias("updatedAt"),
    )


def order_to_legacy(orders: DataFrame) -> DataFrame:
    """Nested orders as flat deliveries with '' and 0 for what is missing."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    clock = lambda c: F.nullif(F.regexp_extract(F.coalesce(F.col(c), F.lit("")), r"T(\d{2}:\d{2})", 1), F.lit(""))
    return orders.select(
        "id",
        text("orderingVendor.name").alias("orderVendor"),
        text("orderingVendor.telephone").alias("orderVendorTel"),
        text("fulfillingVendor.name").alias("deliveryVendor"),
        text("fulfillingVendor.telephone").alias("deliveryVendorTel"),
        text("product.name").alias("productName"),
        F.coalesce("product.quantity", F.lit(0)).alias("productQuantity"),
        F.coalesce(clock("schedule.eventAt"), F.lit("")).alias("eventTime"),
        F.concat_ws(" ", F.nullif(F.col("schedule.serviceDate"), F.lit("")), clock("schedule.strictDeadlineAt")).alias("deliveryDt"),
        text("destination.address").alias("deliveryAddress"),
        text("customerRequests").alias("customerRequests"),
        text("recipient.telephone").alias("recipientTel"),
        F.when(F.col("status").isin("completed", "failed", "revisitNeeded"), F.col("status")).otherwise("pending").alias("status"),
        number("settlement.distanceKm").alias("distanceKm"),
        number("settlement.fee").alias("fee"),
        number("destination.latitude").alias("latitude"),
        number("destination.longitude").alias("longitude"),
    )


def calendar_items(orders: DataFrame) -> DataFrame:
    """Flat orders with a real service date as calendar items."""
    return orders.where(is_service_date(F.col("service_date"))).select(
        F.concat(F.lit("calendar-"), F.col("id")).alias("id"),
        F.col("id").alias("order_id"),
        F.col("service_date").alias("date"),
        F.col("strict_deadline_at").alias("deadline_at"),
        "start_at",
        "event_at",
        "planned_at",
        F.coalesce(first_truthy(F.col("venue_name"), F.col("product_name"), F.col("address")), F.lit(DEFAULT_TITLE)).alias("title"),
        F.coalesce("address", F.lit("")).alias("address"),
        "status",
        F.when(F.col("event_at").isNotNull(), "critical").otherwise("normal").alias("priority"),
    )


def calendar_order(screen: bool = False) -> Column:
    """Sort key of the calendar, a string: deadline, start, event, planned arrival, end of day.

    The screen's variant leaves the planned arrival out and ends the day at T23:59.
    """
    parts = [F.col("deadline_at"), F.col("start_at"), F.col("event_at"), *([] if screen else [F.col("planned_at")])]
    return F.coalesce(first_truthy(*parts), F.concat(F.col("date"), F.lit("T23:59" if screen else "T23:59:59")))


def in_range(orders: DataFrame, first: str, last: str) -> DataFrame:
    """Orders of the days first to last, both included and compared as strings; none if either is no real date."""
    both = is_service_date(F.lit(first)) & is_service_date(F.lit(last))
    return orders.where(both & (F.col("service_date") >= first) & (F.col("service_date") <= last))


def with_stops(items: DataFrame, stops: DataFrame) -> DataFrame:
    """Left join with the first stop, by sequence, of each order: adds stop_planned_at, sequence."""
    first = first_rows(stops, ["order_id"], [F.col("sequence")]).select("order_id", F.col("planned_at").alias("stop_planned_at"), "sequence")
    return items.join(first, "order_id", "left")


def conflicts(items: DataFrame) -> DataFrame:
    """Ids of items (id, start_at, end_at) whose times overlap any other's, dates and status aside."""
    return interval_overlaps(items.select("id", instant(F.col("start_at")).alias("start"), instant(F.col("end_at")).alias("end")), "start", "end", "id")


def is_late() -> Column:
    """Planned after the first of deadline, event, start that is there; what can't be read is not late."""
    return F.coalesce(instant(F.col("planned_at")) > instant(first_truthy(F.col("deadline_at"), F.col("event_at"), F.col("start_at"))), F.lit(False))


def risks(items: DataFrame) -> DataFrame:
    """id, conflict, late of every item."""
    hit = conflicts(items).withColumn("conflict", F.lit(True))
    return items.select("id", is_late().alias("late")).join(hit, "id", "left").withColumn("conflict", F.coalesce("conflict", F.lit(False))).select("id", "conflict", "late")


def month_grid(items: DataFrame, first_of_month: str) -> DataFrame:
    """42 days from the Sunday on or before the first: number of items and whether any is urgent (priority, conflict, late)."""
    spark = items.sparkSession
    days = spark.range(42).select(F.date_format(F.date_add(F.date_sub(F.lit(first_of_month).cast("date"), F.dayofweek(F.lit(first_of_month).cast("date")) - 1), F.col("id").cast("int")), "yyyy-MM-dd").alias("date"))
    marked = items.join(risks(items), "id")
    counted = marked.groupBy("date").agg(F.count("*").alias("items"), F.bool_or((F.col("priority") != "normal") | F.col("conflict") | F.col("late")).alias("urgent"))
    return days.join(counted, "date", "left").select("date", F.coalesce("items", F.lit(0)).cast("long").alias("items"), F.coalesce("urgent", F.lit(False)).alias("urgent"))


def planned_notifications(orders: DataFrame, now_ms: int, strict_leads: Sequence[int] = (60, 30), event_leads: Sequence[int] = (120, 60), strict_on: bool = True, event_on: bool = True) -> DataFrame:
    """Notifications still to come of open orders: id, order_id, kind, fire_at_ms, title, body, and ord, the place of the
    lead in the order they are generated in: ties of fire_at_ms go by order_id, then ord."""
    ms = lambda c: F.unix_millis(instant(F.col(c)))
    kinds = [("strictDeadline", "strict", "strict_deadline_at", strict_leads, strict_on), ("eventTime", "event", "event_at", event_leads, event_on)]
    leads = [F.struct(F.lit(kind).alias("kind"), F.lit(tag).alias("tag"), F.lit(n).alias("lead"), F.lit(i).alias("ord"), ms(c).alias("at")) for i, (kind, tag, c, n) in enumerate((k, t, c, n) for k, t, c, ns, on in kinds if on for n in ns)]
    if not leads:
        leads = [F.struct(F.lit("").alias("kind"), F.lit("").alias("tag"), F.lit(0).alias("lead"), F.lit(0).alias("ord"), F.lit(0).cast("long").alias("at"))]
    fired = orders.where(F.col("status").isin("pending", "reviewRequired")).select("*", F.explode(F.array(*leads)).alias("n"))
    at = F.col("n.at") - F.col("n.lead") * 60_000
    return fired.where((F.col("n.at") != 0) & (at > now_ms)).select(
        F.concat(F.lit("waybill-"), F.col("id"), F.lit("-"), F.col("n.tag"), F.lit("-"), F.col("n.lead").cast("string")).alias("id"),
        F.col("id").alias("order_id"),
        F.col("n.kind").alias("kind"),
        at.alias("fire_at_ms"),
        F.concat(F.when(F.col("n.kind") == "strictDeadline", F.lit("배송 엄수 ")).otherwise(F.lit("예식/행사 ")), F.col("n.lead").cast("string"), F.lit("분 전")).alias("title"),
        F.concat(F.coalesce(first_truthy(F.col("product_name"), F.col("venue_name")), F.lit("delivery")), F.lit(" · "), F.coalesce(F.nullif(F.col("address"), F.lit("")), F.lit("address not confirmed"))).alias("body"),
        F.col("n.ord").alias("ord"),
    )


def archive_weeks(archive: DataFrame) -> DataFrame:
    """Receipts by stored week, newest first: week_key, label (of the newest), receipts (ids in order), n."""
    keyed = archive.withColumn("week_key", F.coalesce(F.nullif(F.col("week_key"), F.lit("")), F.lit("unknown")))
    newest = F.sort_array(F.collect_list(F.struct("captured_at", "id")), asc=False)
    return keyed.groupBy("week_key").agg(newest.alias("r"), F.max("captured_at").alias("newest"), F.count("*").alias("n")).select("week_key", week_range_label(F.col("newest")).alias("label"), F.transform("r", lambda x: x["id"]).alias("receipts"), "n")


def home_figures(orders: DataFrame) -> DataFrame:
    """All, pending, completed (all that isn't pending) and the distance still to go."""
    pending = F.col("status") == "pending"
    return orders.agg(F.count("*").alias("total"), F.count_if(pending).alias("pending"), F.round(F.coalesce(F.sum(F.when(pending, F.col("distance_km"))), F.lit(0.0)), 6).alias("remaining_km")).withColumn("completed", F.col("total") - F.col("pending"))


def priority_class(event_time: Column, product: Column, status: Column, distance: Column) -> Column:
    """First rule that fits: risk after a failure, urgent for events, risk from ten kilometres, else by status."""
    event = (F.coalesce(event_time, F.lit("")) != "") | F.coalesce(product, F.lit("")).contains("축하")
    return F.when(status.isin("failed", "revisitNeeded"), "risk").when(event, "urgent").when(distance >= 10, "risk").when(status == "completed", "completed").otherwise("normal")


def search(deliveries: DataFrame, query: str, status: str | None, columns: Sequence[str]) -> DataFrame:
    """Deliveries of a status whose joined non-empty fields contain the query, case aside."""
    q = query.strip().lower()
    out = deliveries if status in (None, "all") else deliveries.where(F.col("status") == status)
    return out.where(F.lower(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in columns])).contains(q)) if q else out


def items_by_date(items: DataFrame) -> DataFrame:
    """Items of each date in screen order: date, ids."""
    key = calendar_order(screen=True)
    return items.withColumn("_k", key).groupBy("date").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "id"))), lambda x: x["id"]).alias("ids"))
