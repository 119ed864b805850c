"""From recognised text to a registered order: parsing by layout, the second pass after deskewing, the gate, the order.

Recognition itself happens elsewhere: what it found comes as tables, a row per document and variant (``first``, and
``rotated`` where the image was turned upright and read again).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.functions import text as X
from waybill.functions.semantics import composed, round_half_up, squeeze, trim_all
from waybill.operators import receipts, schedule, spatial
from waybill.operators.finance import order_fees
from waybill.operators.joins import by_all_cores
from waybill.sources.files import written

ON = ["doc_id", "variant"]


def filled(value: Column) -> Column:
    return trim_all(F.coalesce(value, F.lit(""))) != ""


def parse_recognised(docs: DataFrame, lines: DataFrame, year: int) -> tuple[DataFrame, DataFrame]:
    """Parsed documents and their fields.

    ``docs``: doc_id, full_text. ``lines``: doc_id, line_no, text, x, y, width, height, confidence. The text in reading order
    is parsed unless the text as recognised shows more evidence of a receipt; then the values beside their labels on the
    page are merged in. Returns (doc_id, text, document_confidence) and the field rows. The confidence is that of the
    parsed text alone.
    """
    layout = spatial.reading_order(lines).withColumnRenamed("text", "layout")
    both = by_all_cores(docs, "doc_id").select("doc_id", F.coalesce("full_text", F.lit("")).alias("full_text")).join(layout, "doc_id", "left").withColumn("layout", F.coalesce(F.nullif(F.col("layout"), F.lit("")), F.col("full_text")))
    scored = both.withColumns({"_l": X.evidence_score(composed(F.col("layout"))), "_f": X.evidence_score(composed(F.col("full_text")))})
    texts = scored.select("doc_id", F.when(F.col("_l") >= F.col("_f"), F.col("layout")).otherwise(F.col("full_text")).alias("text"))
    texts = written(texts)  # laid out once
    fields = receipts.parse_texts_once(texts)
    sure = receipts.document_confidence(fields)
    return texts.join(sure, "doc_id", "left"), spatial.merge_candidates(fields, spatial.field_candidates(lines, year))


def variant_score(confidence: Column, required: Column, populated: Column) -> Column:
    """What decides between two readings of a document: confidence first, then required fields, then any."""
    return confidence + required * 8 + populated * 2


def choose_variant(scored: DataFrame) -> DataFrame:
    """The variant of each document to go on with: (doc_id, variant, variants_compared).

    ``scored``: doc_id, variant, document_confidence, required, populated. The rotated one replaces the first if it scores
    higher and its confidence is not more than two points lower.
    """
    of = lambda v: F.max(F.when(F.col("variant") == v, F.struct("document_confidence", variant_score(F.col("document_confidence"), F.col("required"), F.col("populated")).alias("score"))))
    both = scored.groupBy("doc_id").agg(of("first").alias("a"), of("rotated").alias("b"))
    better = F.coalesce((F.col("b.score") > F.col("a.score")) & (F.col("b.document_confidence") >= F.col("a.document_confidence") - 2), F.lit(False))
    return both.select("doc_id", F.when(better, "rotated").otherwise("first").alias("variant"), F.when(F.col("b").isNotNull(), 2).otherwise(1).alias("variants_compared"))


def read_receipts(assets: DataFrame, recognised: DataFrame, lines: DataFrame, year: int) -> tuple[DataFrame, DataFrame]:
    """Results and fields of captured receipts.

    ``assets``: doc_id, uri, raw_text. ``recognised``: doc_id, variant, full_text. ``lines``: doc_id, variant and boxes. A text
    that came with the asset is parsed as it is. Else the first variant is read, and the rotated one where the skew of the
    first is certain and it has text. Returns one row per document (doc_id, status, variant, variants_compared, text,
    document_confidence, reasons, fallback, event_type, core_fields) and field rows of the documents that were read;
    status is read, no-image, no-text or no-evidence.
    """
    # all variants are parsed as documents of their own, in one pass
    kind = dict(assets.dtypes)["doc_id"]
    key = F.concat_ws(":", "variant", F.col("doc_id").cast("string")).alias("doc_id")
    apart = lambda df: df.withColumn("variant", F.split_part("doc_id", F.lit(":"), F.lit(1))).withColumn("doc_id", F.regexp_replace("doc_id", "^[^:]*:", "").cast(kind))
    given = assets.where(filled(F.col("raw_text"))).select("doc_id", F.lit("given").alias("variant"), F.col("raw_text").alias("full_text"))
    seen = assets.where(~filled(F.col("raw_text")) & filled(F.col("uri"))).select("doc_id").join(recognised.where(filled(F.col("full_text"))), "doc_id").select("doc_id", "variant", "full_text")
    first = seen.where("variant = 'first'")
    tilted = spatial.skew(lines.where("variant = 'first'").drop("variant")).where("confident").select("doc_id")
    turned = seen.where("variant = 'rotated'").join(tilted, "doc_id", "left_semi").join(first.select("doc_id"), "doc_id", "left_semi")
    docs = written(given.unionByName(first).unionByName(turned))
    boxes = written(lines.join(docs.select(*ON), ON, "left_semi"))
    texts, fields = parse_recognised(docs.select(key, "full_text"), boxes.select(key, *[c for c in boxes.columns if c not in ON]), year)
    texts, fields = apart(texts), written(apart(fields))
    counts = fields.groupBy(*ON).agg(F.count_if(filled(F.col("value"))).alias("populated"), F.count_if(F.col("required") & filled(F.col("value"))).alias("required"))
    chosen = choose_variant(texts.where("variant <> 'given'").join(counts, ON)).unionByName(given.select("doc_id", "variant", F.lit(1).alias("variants_compared")))
    chosen_fields = fields.join(chosen.select(*ON), ON, "left_semi")
    chosen_texts = texts.join(chosen, ON)
    enriched = receipts.enrich(chosen_fields).drop("document_confidence", "conflict")
    out = assets.select("doc_id", "uri", "raw_text").join(chosen_texts, "doc_id", "left").join(enriched, "doc_id", "left").withColumn("_t", composed(F.coalesce("text", F.lit(""))))
    status = (
        F.when(filled(F.col("raw_text")), "read").when(~filled(F.col("uri")), "no-image").when(F.col("text").isNull(), "no-text").when(receipts.usable(F.col("_t"), F.coalesce("core_fields", F.lit(0))), "read").otherwise("no-evidence")
    )
    results = out.withColumn("status", status).drop("uri", "raw_text", "_t")
    return results, chosen_fields.join(results.where("status = 'read'").select("doc_id"), "doc_id", "left_semi")


# Messages of the gate (fixed values).
NOTHING_READ, ADDRESS_NOT_CHOSEN, MISSING_END = "실제 인수증에서 인식되고 검수된 정보가 없습니다. 거짓 정보 생성을 막기 위해 등록을 중단했습니다.", "배송주소 후보를 선택해야 지도, 수수료, 수익 계산에 사용할 수 있습니다.", " 항목을 입력해주세요."


def registration_errors(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Why a document can't be registered, null if it can: (doc_id, error).

    ``docs``: doc_id, text, selected (the chosen address candidate or null). The first rule that is broken counts: something
    was read, required fields are there, an address candidate is chosen.
    """
    gaps = F.transform(F.array_sort(F.collect_list(F.when(F.col("required") & ~filled(F.col("value")), F.struct("ord", "label")))), lambda x: x["label"])
    g = docs.join(fields.groupBy("doc_id").agg(F.count("*").alias("n"), gaps.alias("gaps")), "doc_id", "left")
    error = (
        F.when(~filled(F.col("text")) | (F.coalesce("n", F.lit(0)) == 0), NOTHING_READ)
        .when(F.size("gaps") > 0, F.concat(F.array_join("gaps", ", "), F.lit(MISSING_END)))
        .when(F.col("selected").isNull(), ADDRESS_NOT_CHOSEN)
    )
    return g.select("doc_id", error.alias("error"))


def register(docs: DataFrame, fields: DataFrame, fees: DataFrame, now: str) -> DataFrame:
    """Orders of the documents that pass the gate: flat fields become a nested order with the fee of its district.

    ``docs``: doc_id, text, selected struct<display, latitude, longitude>, and delivery_id, the id of the order.
    """
    good = registration_errors(docs, fields).where("error is null").select("doc_id")
    of = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    keys = ("orderingVendorName", "orderingVendorTel", "fulfillingVendorName", "fulfillingVendorTel", "productName", "productQuantity", "eventTime", "deliveryDate", "strictTime", "memo", "recipientTel")
    flat = fields.where(F.col("key").isin(*keys)).groupBy("doc_id").agg(*[F.coalesce(trim_all(of(k)), F.lit("")).alias(k) for k in keys])
    whole = F.when(F.col("productQuantity").rlike(r"^\d{1,9}$"), F.col("productQuantity").cast("int")).otherwise(0)
    d = docs.join(good, "doc_id", "left_semi").join(flat, "doc_id", "left")
    legacy = d.select(
        F.col("delivery_id").alias("id"), F.col("orderingVendorName").alias("orderVendor"), F.col("orderingVendorTel").alias("orderVendorTel"), F.col("fulfillingVendorName").alias("deliveryVendor"),
        F.col("fulfillingVendorTel").alias("deliveryVendorTel"), "productName", whole.alias("productQuantity"), "eventTime",
        F.concat_ws(" ", F.nullif(F.col("deliveryDate"), F.lit("")), F.nullif(F.col("strictTime"), F.lit(""))).alias("deliveryDt"), F.col("selected.display").alias("deliveryAddress"),
        F.col("memo").alias("customerRequests"), "recipientTel", F.lit("pending").alias("status"), F.lit(0.0).alias("distanceKm"), F.lit(0.0).alias("fee"), F.col("selected.latitude").alias("latitude"), F.col("selected.longitude").alias("longitude"),
    )
    priced = order_fees(legacy.withColumns({"address": F.col("deliveryAddress"), "fee_cents": F.lit(0)}), fees)
    found = priced.withColumn("fee", F.col("revenue_cents") / 100.0)
    order = schedule.legacy_to_order(found.drop("address", "fee_cents", "configured_cents", "revenue_cents"), now)
    district = found.select("id", F.col("district").alias("_district"))
    return (
        order.join(district, "id")
        .withColumn("settlement", F.col("settlement").withField("district", F.col("_district")))
        .withColumn("source", F.struct(F.lit("ocr").alias("type"), F.lit(None).cast("string").alias("legacyId")))
        .drop("_district")
    )


def archive_summary(fields: DataFrame) -> DataFrame:
    """What an archive keeps of a document: trimmed address, recipient and product, blank as null, and the confidence."""
    of = lambda k: F.nullif(trim_all(F.max(F.when(F.col("key") == k, F.col("value")))), F.lit(""))
    sure = round_half_up(F.avg(F.when(F.col("required"), F.col("confidence")))).cast("int")
    return fields.groupBy("doc_id").agg(of("deliveryAddress").alias("delivery_address"), of("recipientName").alias("recipient_name"), of("productName").alias("product_name"), sure.alias("document_confidence"))


def review_query(fields: DataFrame) -> DataFrame:
    """What a vendor is looked up by: (doc_id, vendor_name, vendor_phone), a venue standing in for the vendor."""
    of = lambda k: F.nullif(trim_all(F.max(F.when(F.col("key") == k, F.col("value")))), F.lit(""))
    name = F.coalesce(of("orderingVendorName"), of("venueName"), F.lit(""))
    phone = F.coalesce(of("orderingVendorTel"), of("fulfillingVendorTel"), of("recipientTel"))
    return fields.groupBy("doc_id").agg(name.alias("vendor_name"), phone.alias("vendor_phone"))


def preview(text: Column, limit: int = 160) -> Column:
    """A text on one line, cut with an ellipsis."""
    t = squeeze(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("…"))).otherwise(t)


def messages(*lists: Column) -> Column:
    """Messages of several checks, each once, in order."""
    return F.array_distinct(F.concat(*lists))


def district_search(fees: DataFrame, query: str) -> DataFrame:
    """Districts whose name contains the query, white space aside; all for a blank one."""
    q = "".join(query.split())
    return fees.where(F.contains(F.regexp_replace("district", r"\s+", ""), F.lit(q))) if q else fees


def route_length(stops: DataFrame) -> DataFrame:
    """Total distance of each route."""
    return stops.groupBy("route").agg(F.round(F.sum(F.coalesce("distance_km", F.lit(0.0))), 6).alias("distance_km"))


#: Orders of the delivery list, by name.
LIST_ORDERS = {"fee": ("fee_cents", False), "newest": ("order_key", False), "time": ("sort_key", True)}


def delivery_list(deliveries: DataFrame, by: str) -> DataFrame:
    """Place of each delivery in the list (from 1), in one of LIST_ORDERS, ids breaking ties. Sorting is left to the sink."""
    column, up = LIST_ORDERS[by]
    order = F.col(column).asc_nulls_last() if up else F.col(column).desc_nulls_last()
    # the list of one driver is one screen; a larger table is listed driver by driver
    return deliveries.withColumn("place", F.row_number().over(Window.partitionBy("driver").orderBy(order, "id")))


def global_places(df: DataFrame, column: str, *order: Column, name: str = "place") -> DataFrame:
    """Place (from 1) of each row's ``column`` in the order of all its distinct values; equal values share a place, nulls
    come first, an empty table has none.

    Distinct values are range-partitioned by the order, numbered within their range, and lifted by the number of values in
    the ranges before it, of which there is one row each: no task takes them all. A value that many rows hold is one value
    until its place is joined back, where adaptive execution can split it.
    """
    by = order or (F.col(column),)
    # written, as the ranges come from a sample: a second reading must see the same ones
    ranged = written(df.select(column).distinct().repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    places = ranged.withColumn("_in", within).join(starts, "_part").select(F.col(column).alias("_value"), (F.col("_start") + F.col("_in")).cast("long").alias(name))
    return df.join(places, F.col(column).eqNullSafe(F.col("_value")), "left").drop("_value")


def by_locale(labels: DataFrame, column: str) -> DataFrame:
    """Place (from 1) of each label as readers expect it, by the Unicode collation; equal labels share one."""
    return global_places(labels, column, F.collate(F.col(column), "UNICODE"), F.col(column))


# An inquiry to the makers (fixed values).
EMAIL, LEAST_CONTENT, MOST_BODY = r"^[^\s@]+@[^\s@]+\.[^\s@]+$", 10, 1400


def inquiry_complete(email: Column, kind: Column, subject: Column, content: Column) -> Column:
    return F.coalesce(trim_all(email).rlike(EMAIL) & (kind != "") & filled(subject) & (F.length(trim_all(content)) >= LEAST_CONTENT), F.lit(False))


def inquiry_link(to: str, app: str, email: Column, kind: Column, subject: Column, content: Column, images: Column) -> Column:
    """A mailto link; the content is cut so that the body keeps within MOST_BODY characters."""
    head = F.concat(F.lit("문의 유형: "), kind, F.lit("\n회신 이메일: "), trim_all(email), F.lit("\n\n"))
    tail = F.when(images > 0, F.concat(F.lit("\n\n(첨부 이미지 "), images.cast("string"), F.lit("장은 메일 작성 화면에서 직접 추가해 주세요.)"))).otherwise("")
    room, said = F.lit(MOST_BODY) - F.length(head) - F.length(tail), trim_all(content)
    body = F.concat(head, F.when(F.length(said) > room, F.concat(F.substring(said, F.lit(1), F.greatest(F.lit(0), room - 1)), F.lit("…"))).otherwise(said), tail)
    encoded = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    title = F.concat(F.lit(f"[{app} 문의] "), kind, F.lit(" · "), trim_all(subject))
    return F.concat(F.lit(f"mailto:{to}?subject="), encoded(title), F.lit("&body="), encoded(body))
