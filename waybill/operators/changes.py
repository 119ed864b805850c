"""Collections as change logs: upsert, delete, link, migrate, settings, backups and proof of delivery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.semantics import blank_to_null, trim_all
from waybill.operators.joins import latest

SAMPLE_IDS = ("delivery-1", "delivery-2", "delivery-3", "delivery-4")
BACKUP_VERSION = 1
BACKUP_APPS = ("waybill", "waybill-mobile")


def upsert(current: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """``current`` with the rows of ``incoming`` in place of those with their key, new keys added; keys are unique in both."""
    return current.join(incoming.select(*key), list(key), "left_anti").unionByName(incoming)


def compact_log(log: DataFrame, key: Sequence[str], order: Sequence[Column], deleted: str | None = None) -> DataFrame:
    """State after a change log, last change wins; keys whose last change is a delete are gone."""
    state = latest(log, key, order)
    return state.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else state


def delete(current: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    return current.join(keys.select(*key).distinct(), list(key), "left_anti")


def link(receipts: DataFrame, links: DataFrame) -> DataFrame:
    """Sets linked_delivery_id from links (id, delivery_id, unique by id); a link to a missing receipt is an error."""
    marked = receipts.withColumn("_there", F.lit(True)).join(links, "id", "full_outer")
    checked = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("Receipt "), F.col("id"), F.lit(" not found")))).otherwise(F.coalesce("delivery_id", "linked_delivery_id"))
    return marked.withColumn("linked_delivery_id", checked.cast("string")).drop("_there", "delivery_id")


def migrate(legacy: DataFrame, current: DataFrame, samples: Sequence[str] = SAMPLE_IDS) -> tuple[DataFrame, DataFrame]:
    """Legacy rows to add (no samples, none already there, the first of a repeated id), and a report of numbers."""
    real = legacy.where(~F.col("id").isin(*samples))
    new = real.join(current.select("id"), "id", "left_anti")
    added = latest(new, ["id"], [-F.col("ord")])
    report = legacy.agg(F.count("*").alias("source_count"), F.count_if(F.col("id").isin(*samples)).alias("skipped_samples")).crossJoin(F.broadcast(added.agg(F.count("*").alias("migrated_count"))))  # one row each
    return added, report


def learn_alias(registry: DataFrame, key: str, alias: str) -> DataFrame:
    """Appends an alias to the field's if it is new and not its label."""
    new = (F.col("key") == key) & (F.col("label") != alias)
    return registry.withColumn("aliases", F.when(new, F.array_union("aliases", F.array(F.lit(alias)))).otherwise(F.col("aliases")))


def backup_error(json: Column, apps: Sequence[str] = BACKUP_APPS) -> Column:
    """First rule that a backup breaks, null for a good one."""
    v = F.try_parse_json(json)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    root = F.schema_of_variant(v)
    of = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    obj = lambda s: F.coalesce(s.startswith("OBJECT"), F.lit(False))
    records = lambda path: get(path, "array<variant>")
    has_id = lambda r: F.coalesce(F.schema_of_variant(F.try_variant_get(r, "$.id", "variant")) == "STRING", F.lit(False))
    order = lambda r: has_id(r) & F.coalesce(F.schema_of_variant(F.try_variant_get(r, "$.status", "variant")) == "STRING", F.lit(False)) & obj(F.schema_of_variant(F.try_variant_get(r, "$.schedule", "variant")))
    good = lambda path, rule: F.coalesce(F.forall(records(path), rule), F.lit(False))
    version = get("$.schemaVersion", "double")
    numeric = F.coalesce(of("$.schemaVersion").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))
    return (
        F.when(v.isNull(), "Invalid JSON backup file.")
        .when(~obj(root), "Backup root must be an object.")
        .when(~F.coalesce(get("$.app", "string").isin(*apps), F.lit(False)), "This is not a backup file of this application.")
        .when(~numeric | (version > BACKUP_VERSION), "Unsupported backup schema version.")
        .when(~(good("$.orders", order) & good("$.fuelLogs", has_id) & good("$.mileageLogs", has_id)), "Backup contains invalid collection data.")
        .when(of("$.contactLogs").isNotNull() & ~good("$.contactLogs", has_id), "Backup contains invalid contact logs.")
        .when(~obj(of("$.settings")), "Backup is missing settings.")
    )


def merge_maps(defaults: Column, stored: Column) -> Column:
    """Defaults with stored values over them, default keys first."""
    return F.map_from_entries(
        F.concat(
            F.transform(F.map_entries(defaults), lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.try_element_at(stored, e["key"]), e["value"]).alias("value"))),
            F.filter(F.map_entries(F.coalesce(stored, F.create_map().cast("map<string,double>"))), lambda e: ~F.map_contains_key(defaults, e["key"])),
        )
    )


def nav_app(x: Column, known: Sequence[str] = ("google", "tmap", "naver")) -> Column:
    return F.when(x.isin(*known), x).otherwise(F.lit(known[0]))


def proof(status: str, now: Column, recorded: Column | None = None, photos: Column | None = None, note: Column | None = None, reason: Column | None = None, signature: Column | None = None) -> Column:
    """Proof struct of a result."""
    none = F.lit(None).cast("string")
    kept = F.filter(F.coalesce(photos, F.array().cast("array<string>")), lambda x: F.coalesce(x != "", F.lit(False))) if photos is not None else F.array().cast("array<string>")
    return F.struct(
        F.lit(status).alias("status"),
        (F.coalesce(F.nullif(recorded, F.lit("")), now) if recorded is not None else now).alias("recordedAt"),
        (now if status == "completed" else none).alias("completedAt"),
        kept.alias("photoUris"),
        (blank_to_null(note) if note is not None else none).alias("note"),
        (blank_to_null(reason) if reason is not None else none).alias("failureReason"),
        (blank_to_null(signature) if signature is not None else none).alias("signatureUri"),
    )


def proof_error(result: Column, reason: Column) -> Column:
    """A failure and a revisit need a reason of their own."""
    missing = blank_to_null(reason).isNull()
    return F.when((result == "failed") & missing, "Failed delivery proof requires a failure reason.").when((result == "revisitNeeded") & missing, "Revisit proof requires a reason.")


def clear_proof(orders: DataFrame, now: Column) -> DataFrame:
    """Orders whose result is taken back: pending again, without proof and time of completion."""
    return orders.withColumns({"status": F.lit("pending"), "proofOfDelivery": F.lit(None).cast(orders.schema["proofOfDelivery"].dataType), "schedule": F.col("schedule").withField("completedAt", F.lit(None).cast("string")), "updatedAt": now})


def append_photo(proof_column: Column, uri: Column, now: Column) -> Column:
    """A photo is evidence, not a result: the status of an existing proof stays, a new one is pending."""
    fresh = F.struct(F.lit("pending").alias("status"), now.alias("recordedAt"), F.array(uri).alias("photoUris"))
    grown = F.struct(proof_column["status"].alias("status"), proof_column["recordedAt"].alias("recordedAt"), F.concat(F.coalesce(proof_column["photoUris"], F.array().cast("array<string>")), F.array(uri)).alias("photoUris"))
    return F.when(proof_column.isNull(), fresh).otherwise(grown)


PHOTO_FOLDERS = ("completion-photos", "receipt-photos")


def photo_path(folder: Column, order_id: Column, token: Column) -> Column:
    """Relative path with anything but letters, digits, - and _ replaced; an empty part is x."""
    safe = lambda c: F.coalesce(F.nullif(F.regexp_replace(c, r"[^a-zA-Z0-9_-]", "_"), F.lit("")), F.lit("x"))
    return F.concat(safe(folder), F.lit("/"), safe(order_id), F.lit("-"), safe(token), F.lit(".jpg"))


def is_safe_photo_path(path: Column) -> Column:
    """Only paths that were made here are read: no path leads out of the folders."""
    return F.coalesce(path.rlike(rf"^(?:{'|'.join(PHOTO_FOLDERS)})/[A-Za-z0-9_-]+\.jpg$"), F.lit(False))


def address_mask(address: Column) -> Column:
    """The first two words, the rest hidden; addresses of up to two words stay."""
    words = F.filter(F.split(trim_all(address), r"\s+"), lambda x: x != "")
    return F.when(F.size(words) > 2, F.concat(F.concat_ws(" ", F.slice(words, 1, 2)), F.lit(" ···"))).otherwise(address)
