"""Reports on recognition: parser summaries, provenance and risks, golden hits, hypotheses, comparison of engines, telemetry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions import text as X
from waybill.functions.semantics import composed, trim_all
from waybill.operators.evaluation import choose
from waybill.operators.registration import filled, preview

# Fields a report looks at (fixed values).
REQUIRED = ("deliveryDate", "productName", "deliveryAddress")
OBSERVED = ("orderingVendorName", "fulfillingVendorName", "productName", "productQuantity", "deliveryDate", "deliveryAddress", "recipientName", "recipientTel", "memo")


def _compact(text: Column) -> Column:
    return trim_all(F.regexp_replace(F.lower(text), r"[\s|·•]+", ""))


def field_provenance(fields: DataFrame, texts: DataFrame) -> DataFrame:
    """Fields with provenance: missing, sourceText (its line stands in the text), rawFallback (it does itself), unsupported.

    ``texts``: doc_id, text. Texts are composed once per document and fields once per row.
    """
    raw = texts.select("doc_id", _compact(composed(F.coalesce("text", F.lit("")))).alias("_raw"))
    f = fields.withColumns({"_v": composed(F.coalesce("value", F.lit(""))), "_s": composed(F.coalesce("source", F.lit("")))}).withColumns({"_v": _compact(F.col("_v")), "_s": _compact(F.col("_s"))})
    said = (
        F.when(F.coalesce("value", F.lit("")) == "", "missing")
        .when((F.coalesce("source", F.lit("")) != "") & F.contains("_raw", "_s"), "sourceText")
        .when((F.col("_v") != "") & F.contains("_raw", "_v"), "rawFallback")
        .otherwise("unsupported")
    )
    return f.join(raw, "doc_id", "left").withColumn("_raw", F.coalesce("_raw", F.lit(""))).withColumn("provenance", said).drop("_v", "_s", "_raw")


def parser_summary(marked: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """One row per document of fields with provenance: numbers of populated, unsupported and fallback fields, missing required keys."""
    missing = F.array(*[F.when(F.coalesce(F.max(F.when(F.col("key") == k, filled(F.col("value")))), F.lit(False)), None).otherwise(F.lit(k)) for k in required])
    of = lambda p: F.count_if(F.col("provenance") == p)
    return marked.groupBy("doc_id").agg(
        F.count_if(F.coalesce("value", F.lit("")) != "").alias("populated"), of("unsupported").alias("unsupported"), of("rawFallback").alias("raw_fallback"), F.array_compact(missing).alias("missing_required")
    )


def risks(first_line: Column) -> Column:
    """Semantic risks of a field row: array<struct(severity, reason)>. Rules and words are fixed values."""
    key, v, s = F.col("key"), F.coalesce("value", F.lit("")), F.coalesce("source", F.lit(""))
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    one = lambda severity, reason: F.struct(F.lit(severity).alias("severity"), F.lit(reason).alias("reason"))
    phone = v.rlike(r"^(?:01[016789]-\d{3,4}-\d{4}|02-\d{3,4}-\d{4}|0\d{2}-\d{3,4}-\d{4})$")
    tel = (
        F.when(~phone, one("false-data", "recipientTel is populated with a non-phone value"))
        .when((s == "") & F.contains(digits(F.coalesce(first_line, F.lit(""))), digits(v)), one("false-data", "digits from the order identifier were normalized as recipientTel"))
        .when(s == "", one("review", "unlabelled phone fallback cannot prove that the number belongs to the recipient"))
    )
    found = F.array(
        F.when((key == "recipientTel") & (v != ""), tel),
        F.when((key == "recipientName") & v.rlike("플라워|반드시|이름|분시"), one("false-data", "layout-shift assigned a vendor or form instruction as recipientName")),
        F.when((key == "memo") & v.rlike(r"010-\d{3,4}-?$"), one("false-data", "vendor/contact line was assigned as memo")),
    )
    return F.array_compact(found)


def anti_fabrication(marked: DataFrame, texts: DataFrame, markers: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Per document and over all: values without support in the text, risky values, markers of demonstration data.

    ``marked``: fields with provenance. A document passes if nothing is unsupported and no marker shows.
    """
    t = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    joined = marked.join(t, "doc_id", "left").withColumn("_r", risks(F.get(F.split("text", r"\r?\n"), 0)))
    severity = lambda s: F.sum(F.size(F.filter("_r", lambda r: r["severity"] == s)))
    shows = lambda m: F.bool_or(F.contains(F.coalesce("text", F.lit("")), F.lit(m)) | F.contains(F.coalesce("value", F.lit("")), F.lit(m)) | F.contains(F.coalesce("source", F.lit("")), F.lit(m)))
    leaked = F.array_compact(F.array(*[F.when(shows(m), F.lit(m)) for m in markers])) if markers else F.array().cast("array<string>")
    each = joined.groupBy("doc_id").agg(
        F.count_if(F.coalesce("value", F.lit("")) != "").alias("populated"), F.count_if(F.col("provenance") == "unsupported").alias("unsupported"),
        F.coalesce(severity("false-data"), F.lit(0)).alias("false_data"), F.coalesce(severity("review"), F.lit(0)).alias("review"), leaked.alias("leaked"),
    )
    each = each.withColumn("passed", (F.size("leaked") == 0) & (F.col("unsupported") == 0))
    total = each.agg(
        F.count("*").alias("documents"), F.count_if("passed").alias("passed"), F.coalesce(F.sum(F.size("leaked")), F.lit(0)).alias("leaks"), F.coalesce(F.sum("unsupported"), F.lit(0)).alias("unsupported"),
        F.coalesce(F.sum("false_data"), F.lit(0)).alias("false_data"), F.coalesce(F.sum("review"), F.lit(0)).alias("review"),
    )
    return each, total


# How a golden text states a field: label and value on a line (fixed values).
GOLDEN_LABELS = {
    "orderingVendorName": "발주처|발주화원|발주회원", "fulfillingVendorName": "배송화원|수주회원", "productName": "품명|상품명|배송상품", "productQuantity": "수량", "deliveryDate": "배달일시|배송일시",
    "deliveryAddress": "배달장소|배송장소", "recipientName": "받는분|받으실분|인수자", "recipientTel": "핸드폰|전화|HP|TEL", "memo": "요구사항|요청사항",
}


def golden_fields(golden: DataFrame, labels: dict[str, str] = GOLDEN_LABELS) -> DataFrame:
    """Fields that golden texts (doc_id, text) state: (doc_id, key, expected), the first line of each key."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\r?\n"), trim_all), lambda x: x != "")
    first = lambda p: F.get(F.filter(F.transform(F.col("_l"), lambda x: F.regexp_extract(x, rf"^(?:{p})\s*:\s*(.+)$", 1)), lambda v: v != ""), 0)
    found = F.array(*[F.struct(F.lit(k).alias("key"), trim_all(first(p)).alias("expected")) for k, p in labels.items()])
    return golden.withColumn("_l", lines).select("doc_id", F.explode(F.filter(found, lambda x: x["expected"].isNotNull())).alias("f")).select("doc_id", "f.*")


def by_suffix(samples: DataFrame, manifest: DataFrame) -> DataFrame:
    """Samples (file) with the manifest row (image, ...) whose image path ends with the file's name, the first by image.

    A name is the last part of a path, so the join is on that part and not on all pairs.
    """
    base = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    m = manifest.withColumn("_b", base(F.col("image")))
    s = samples.withColumn("_b", base(F.col("file")))
    from waybill.operators.joins import first_rows

    hits = s.select("file", "_b").distinct().join(m, "_b").where(F.col("image").endswith(F.col("file")))
    return samples.join(first_rows(hits, ["file"], [F.col("image")]).drop("_b"), "file", "left")


def require_all(left: DataFrame, right: DataFrame, on: str, what: str) -> DataFrame:
    """Inner join that fails where the right side has no row for one of the left."""
    marked = left.join(right.withColumn("_there", F.lit(True)), on, "left")
    miss = F.concat(F.lit(f"Missing {what} for "), F.coalesce(F.col(on).cast("string"), F.lit("null")))
    return marked.withColumn("_there", F.when(F.col("_there").isNull(), F.raise_error(miss)).otherwise(F.lit("x"))).where("_there is not null").drop("_there")


def loose_hit(key: Column, value: Column, expected: Column, year: str = "2026") -> Column:
    """Whether a value agrees with what was expected; both composed. Dates by day, phones by digits, other values if at
    least 38 % of the expected words of two letters or more are in them."""
    norm = lambda c: trim_all(F.regexp_replace(F.lower(F.replace(c, F.lit("[불명]"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))

    def day(c: Column) -> Column:
        korean, iso = r"(?:(20\d{2})\s*년)?\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일", r"(20\d{2})-(\d{2})-(\d{2})"
        written = lambda p, i: F.regexp_extract(c, p, i)
        pad = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
        spoken = F.concat_ws("-", F.when(written(korean, 1) == "", F.lit(year)).otherwise(written(korean, 1)), pad(written(korean, 2)), pad(written(korean, 3)))
        return F.when(written(iso, 1) != "", F.concat_ws("-", written(iso, 1), written(iso, 2), written(iso, 3))).when(written(korean, 2) != "", spoken).otherwise("")

    digits = lambda c: F.regexp_replace(c, r"\D", "")
    words = F.filter(F.split(norm(expected), r"\s+"), lambda t: F.length(t) >= 2)
    there = norm(value)
    covered = F.when(F.size(words) > 0, F.size(F.filter(words, lambda t: F.contains(there, t))) / F.size(words) >= 0.38).otherwise(False)
    hit = F.when(key == "deliveryDate", day(value) == day(expected)).when(key.endswith("Tel"), (F.length(digits(value)) >= 8) & F.contains(digits(expected), digits(value))).otherwise(covered)
    return F.coalesce((value != "") & (expected != "") & hit, F.lit(False))


def golden_summary(fields: DataFrame, expected: DataFrame, required: Sequence[str] = REQUIRED, observed: Sequence[str] = OBSERVED) -> DataFrame:
    """One row per document: required and observed fields that are populated, and golden hits."""
    f = fields.where(F.col("key").isin(*observed, *required)).join(expected, ["doc_id", "key"], "left")
    f = f.withColumns({"_v": composed(F.coalesce("value", F.lit(""))), "_e": composed(F.coalesce("expected", F.lit("")))})
    there = F.coalesce("value", F.lit("")) != ""
    return f.withColumn("hit", loose_hit(F.col("key"), F.col("_v"), F.col("_e"))).groupBy("doc_id").agg(
        F.count_if(there & F.col("key").isin(*required)).alias("required"), F.count_if(there & F.col("key").isin(*observed)).alias("populated"), F.count_if(F.col("hit") & F.col("key").isin(*observed)).alias("hits")
    )


def hypotheses(quality_passed: Column, empty: Column, missing_required: Column, populated: Column, previous: Column) -> Column:
    """Labels of what may have gone wrong with a sample, in order. ``previous``: populated fields of an earlier parse or null."""
    gaps = missing_required >= 2
    return F.array_compact(
        F.array(
            F.when(quality_passed & (empty | gaps), F.lit("QUALITY_GATE_FALSE_POSITIVE")),
            F.when(~empty & gaps, F.lit("PARSER_MAPPING_FAILURE")),
            F.when(~empty & (populated < previous), F.lit("CURRENT_PARSER_REGRESSION")),
        )
    )


def hypothesis_summary(samples: DataFrame) -> DataFrame:
    """Means and counts over samples (passed, empty, cer, coverage, populated, missing_required, labels)."""
    return samples.agg(
        F.count("*").alias("samples"), F.count_if("passed").alias("quality_passes"), F.count_if(~F.col("empty")).alias("non_empty"), F.round(F.avg("cer"), 4).alias("cer_macro"), F.round(F.avg("coverage"), 4).alias("coverage"),
        F.round(F.avg("populated"), 2).alias("populated"), F.count_if(F.col("missing_required") >= 2).alias("with_gaps"), F.count_if(F.array_contains("labels", "QUALITY_GATE_FALSE_POSITIVE")).alias("false_positives"),
    )


def best_configurations(sweep: DataFrame, config: Sequence[str], n: int = 10) -> DataFrame:
    """The n configurations with the highest score, earlier ones first among equals."""
    return sweep.orderBy(F.desc("score"), *config).limit(n)


def compare_engines(images: DataFrame, engines: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcome of each engine on each image, and the decision for each image.

    ``images``: image, uri. ``engines``: engine, ord, available, reason. ``runs``: image, engine, outcome (success, no-text,
    unavailable, error), text, line_count, processing_ms, populated, required, missing_required, document_confidence,
    message. An engine that isn't available is skipped, an image without a uri unavailable. The best success has most
    fields, then most confidence, then most text, then comes first in the list.
    """
    r = images.join(F.broadcast(engines)).join(runs, ["image", "engine"], "left")  # a handful of engines
    status = F.when(~F.col("available"), "skipped").when(~filled(F.col("uri")), "unavailable").otherwise(F.coalesce("outcome", F.lit("error")))
    ran = status.isin("success", "no-text", "unavailable", "error") & F.col("available") & filled(F.col("uri"))
    ok = status == "success"
    number = lambda c, when: F.when(when, F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c)
    each = r.select(
        "image", "engine", "ord", status.alias("status"), number("processing_ms", ran), F.when(ran, F.length(F.coalesce("text", F.lit("")))).otherwise(0).cast("long").alias("text_length"),
        F.when(ran, preview(F.coalesce("text", F.lit("")))).otherwise("").alias("preview"), number("line_count", ran), number("populated", ok), number("required", ok), number("missing_required", ok),
        F.when(ok, F.col("document_confidence")).alias("document_confidence"), F.when(status == "skipped", F.col("reason")).when(~ok, F.coalesce("message", F.lit("No prepared receipt image URI is available."))).alias("message"),
    )
    best = choose(each.where("status = 'success'"), ["image"], [F.desc("populated"), F.desc(F.coalesce("document_confidence", F.lit(0))), F.desc("text_length"), F.col("ord")])
    decision = images.select("image").join(best.select("image", F.col("engine").alias("best")), "image", "left")
    return each, decision.withColumn("decision", F.when(F.col("best").isNotNull(), "use-best-candidate").otherwise("manual-review-required"))


def stream_telemetry(events: DataFrame) -> DataFrame:
    """Frames of a stream (stream, ord, frame_id, drop_reason or null): received, dropped, the last frame and last reason."""
    lost = F.col("drop_reason").isNotNull()
    return events.groupBy("stream").agg(
        F.count_if(~lost).alias("received"), F.count_if(lost).alias("dropped"), F.max_by("frame_id", F.when(~lost, F.col("ord"))).alias("last_frame"), F.max_by("drop_reason", F.when(lost, F.col("ord"))).alias("last_reason")
    )


def dataset_errors(manifest: DataFrame, images: DataFrame, golden: DataFrame) -> DataFrame:
    """Faults of a dataset, a row each: (image, error).

    ``manifest``: ord, image, golden, sha256. ``images``: path, content. ``golden``: path, text. A sample whose fields are
    missing is looked at no further, nor is one with a missing file.
    """
    from pyspark.sql import Window

    said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    whole = manifest.withColumn("_ok", said("image") & said("golden") & said("sha256"))
    nth = lambda c: F.row_number().over(Window.partitionBy("_ok", c).orderBy("ord"))
    m = whole.withColumns({"_i": nth("image"), "_g": nth("golden")})
    m = m.join(images.select(F.col("path").alias("image"), F.sha2("content", 256).alias("_sha")), "image", "left").join(golden.select(F.col("path").alias("golden"), F.col("text").alias("_text")), "golden", "left")
    text = trim_all(F.replace(F.col("_text"), F.lit("\r\n"), F.lit("\n")))
    both = F.col("_sha").isNotNull() & F.col("_text").isNotNull()
    rule = lambda broken, *parts: F.when(broken, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]))
    # messages as callers know them (fixed values)
    checks = F.array(
        rule(~F.col("_ok"), "image, rawGoldenText, and sha256 are required."),
        rule(F.col("_ok") & (F.col("_i") > 1), "duplicate image."),
        rule(F.col("_ok") & (F.col("_g") > 1), "duplicate rawGoldenText."),
        rule(F.col("_ok") & F.col("_sha").isNull(), "image file is missing."),
        rule(F.col("_ok") & F.col("_sha").isNotNull() & F.col("_text").isNull(), "raw golden text file is missing."),
        rule(F.col("_ok") & both & (F.col("_sha") != F.col("sha256")), "sha256 mismatch. expected ", F.col("sha256"), ", got ", F.col("_sha")),
        rule(F.col("_ok") & both & (text == ""), "raw golden text is empty."),
        rule(F.col("_ok") & both & ~text.contains("\n"), "raw golden text should preserve line-level structure."),
        rule(F.col("_ok") & both & text.rlike("(?i)TODO|FIXME"), "raw golden text contains TODO/FIXME."),
    )
    return m.select(F.coalesce(F.nullif(F.col("image"), F.lit("")), F.lit("<missing image>")).alias("image"), F.explode(F.array_compact(checks)).alias("error"))


def file_evidence(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """What there is of each wanted file (doc_id, original, prepared: uris or null) among ``files`` (uri, size, content).

    Adds size and digest of both, which of them is the active input, and whether the prepared one is another file.
    """
    f = files.select("uri", F.col("size").cast("long").alias("size"), F.md5("content").alias("md5"))
    out = wanted
    for c in ("original", "prepared"):
        out = out.join(f.select(F.col("uri").alias(c), F.col("size").alias(f"{c}_size"), F.col("md5").alias(f"{c}_md5")), c, "left")
    there = lambda c: F.col(f"{c}_md5").isNotNull()
    active = F.when(there("prepared"), "prepared").when(there("original"), "original").otherwise("missing")
    return out.select("doc_id", "original_size", "original_md5", "prepared_size", "prepared_md5", active.alias("active"), F.coalesce(F.col("prepared") != F.col("original"), F.lit(False)).alias("normalized"))
