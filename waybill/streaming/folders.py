"""A folder of JSON files as a stream, and a sink of notifications in which a batch counts once.

Every file is read whole, as a row: a file that is no JSON, or no record, is a row too, with its text kept, so that nothing
is lost silently. The sink writes a batch's notifications and the batch's number in one commit of a store; a batch that
comes again, after a crash between its commit and the stream's checkpoint, finds its number there and changes nothing.

Defined results: a file whose id is missing counts as corrupt; files that are not named *.json are passed over; of several
rows with one id in a batch the last by ``fire_at_ms`` counts; a notification whose time has come is taken off the
schedule; an empty batch is a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.sources.ledger import Store

#: Collections that the sink needs in its store.
TABLES = {
    "scheduled": ("id string, fire_at_ms long, title string", ["id"]),
    "batches": ("query string, batch long", ["query"]),
}


def watch(spark: SparkSession, folder: str, schema: str, id: str = "id") -> DataFrame:
    """Stream of the folder's files: path, the fields of ``schema``, and corrupt (the text of a file that holds no record)."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").load(folder)
    return records(files.select(F.col("_metadata.file_path").alias("path"), "value"), schema, id)


def records(texts: DataFrame, schema: str, id: str = "id") -> DataFrame:
    """``watch`` for a table of (path, value)."""
    parsed = texts.select("path", "value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    good = F.col("r").isNotNull() & F.col("r")[id].isNotNull()
    return parsed.select("path", "r.*", F.when(~good, F.coalesce("value", F.lit(""))).alias("corrupt"))


def scheduler(store: Store, query: str, now_ms: Callable[[], int]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: puts a batch's rows (id, fire_at_ms, title) on the schedule if they are to come, takes those that
    are not off it, and notes the batch, all in one commit."""

    def take(rows: DataFrame, batch: int) -> None:
        last = store.get("batches", query).first()
        if last is not None and last.batch >= batch:
            return
        spark = rows.sparkSession
        tx = store.begin()
        # a batch is read twice: it is worked out once
        held = rows.select("id", "fire_at_ms", "title").where("id is not null").persist()
        try:
            latest = held.groupBy("id").agg(F.max_by(F.struct("fire_at_ms", "title"), F.struct("fire_at_ms", "title")).alias("r")).select("id", "r.*")
            now = now_ms()
            tx.upsert("scheduled", latest.where(F.col("fire_at_ms") > now))
            tx.delete("scheduled", latest.where(F.coalesce(F.col("fire_at_ms") <= now, F.lit(True))))
            tx.upsert("batches", spark.createDataFrame([(query, batch)], "query string, batch long"))
            tx.commit()
        finally:
            held.unpersist()

    return take
