"""The activity log: compact view, new rows, undo."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tillwise.functions.categories import effective_status
from tillwise.functions.dates import instant
from tillwise.functions.text import strip
from tillwise.operators.stats import top_rows

RECENT_ROWS = 25
# Payload keys too large to show, and the kinds an undo exists for.
BULKY_KEYS = ("boosts", "detected", "items", "line_items", "line_items_raw", "raw_result", "raw_text")
RECEIPT_KINDS = ("receipt_added", "receipt_imported_file")
EXTRACTION_KINDS = ("ocr_completed", "ocr_failed", "llm_completed", "llm_failed", "extract_failed")
SHOPPING_KIND, IMAGE_KIND = "shopping_list_auto_run", "inventory_image_analyzed"
PAYLOAD = (
    "receipt_id string, "
    "added array<struct<shopping_list_item_id:string,product_id:string>>, "
    "renamed array<struct<shopping_list_item_id:string,old_name:string,new_name:string>>, "
    "shopping_state_updates array<struct<product_id:string,previous:struct<last_auto_added_at:timestamp,"
    "last_store_tag:string,last_store_tag_confidence:double>>>, "
    "boosts array<struct<product_id:string,previous:struct<last_seen_at:timestamp,last_seen_confidence:double>>>"
)
CLEARED = (
    "ocr_text", "ocr_confidence", "extract_started_at", "extract_queued_at", "extract_finished_at", "extract_duration_ms",
    "extract_queue_delay_ms", "extract_method", "extract_provider", "extract_model",
)


def shorten(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def compact_payload(payload: Column) -> Column:
    """Payload JSON with bulky keys dropped, long texts cut, lists as counts and objects without nesting."""
    values = F.from_json(payload, "map<string,string>")
    kept = F.map_filter(values, lambda k, v: ~k.isin(*BULKY_KEYS))

    def compact(k: Column, v: Column) -> Column:
        shallow = F.map_filter(F.from_json(v, "map<string,string>"), lambda _, x: ~F.coalesce(x, F.lit("")).rlike(r"^[\[{]"))
        short = F.transform_values(shallow, lambda _, x: shorten(strip(x), 120))
        as_object = F.when(F.size(short) > 0, F.to_json(short)).otherwise(
            F.concat(F.lit('{"keys":'), F.size(F.from_json(v, "map<string,string>")).cast("string"), F.lit("}"))
        )
        count = F.concat(F.lit('{"count":'), F.json_array_length(v).cast("string"), F.lit("}"))
        return (
            F.when(v.startswith("[") & F.json_array_length(v).isNotNull(), count)
            .when(v.startswith("{") & F.from_json(v, "map<string,string>").isNotNull(), as_object)
            .otherwise(shorten(strip(v), 120))
        )

    compacted = F.transform_values(kept, compact)
    return F.when(F.size(compacted) > 0, compacted)


def recent_activities(activities: DataFrame, keys: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    newest = top_rows(activities, [F.col("timestamp").desc(), F.col("activity_id")], limit, keys)
    return newest.select(
        *keys, "activity_id", "timestamp", "kind", shorten(F.col("description"), 180).alias("description"),
        compact_payload(F.col("payload")).alias("payload"),
    )


def emit_activity(
    rows: DataFrame, kind: str, description: Column, payload_columns: Sequence[str], as_of, keys: Sequence[str] = (), row_key: Sequence[str] = (),
) -> DataFrame:
    """One audit row per input row; the id is a hash of kind, time, payload, tenant and ``row_key``.

    Events whose payloads may be equal need the columns of a row key, which tell them apart; the same input then gives the
    same ids again.
    """
    payload = F.to_json(F.struct(*payload_columns))
    stamp = instant(as_of)
    more = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*keys, *row_key)]
    ident = F.sha2(F.concat_ws("|", F.lit(kind), stamp.cast("string"), payload, *more), 256)
    return rows.select(
        *keys, F.substring(ident, 1, 32).alias("activity_id"), stamp.alias("timestamp"), F.lit(kind).alias("kind"),
        description.alias("description"), payload.alias("payload"),
    )


def _parsed(activities: DataFrame, *kinds: str) -> DataFrame:
    return activities.where(F.col("kind").isin(*kinds)).withColumn("p", F.from_json("payload", PAYLOAD))


def undone_receipt_ids(activities: DataFrame, *kinds: str) -> DataFrame:
    rows = _parsed(activities, *kinds).where("p.receipt_id is not null")
    return rows.select(F.col("p.receipt_id").alias("receipt_id")).distinct()


def undo_receipts(activities: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``receipts``, ``line_items`` and ``observations`` without the receipts whose arrival is undone."""
    gone = undone_receipt_ids(activities, *RECEIPT_KINDS)
    cast = lambda df: df.join(gone.select(F.col("receipt_id").alias("_gone")), F.col("receipt_id").cast("string") == F.col("_gone"), "left_anti")
    return {name: cast(table) for name, table in tables.items()}


def undo_extraction(activities: DataFrame, receipts: DataFrame) -> DataFrame:
    """Receipts with the extraction fields of the undone runs cleared."""
    cleared = undone_receipt_ids(activities, *EXTRACTION_KINDS).select(
        F.col("receipt_id").alias("_id"), F.lit(True).alias("_clear")
    )
    joined = receipts.join(cleared, F.col("receipt_id").cast("string") == F.col("_id"), "left").drop("_id")
    hit = F.coalesce("_clear", F.lit(False))
    for c in CLEARED:
        if c in receipts.columns:
            joined = joined.withColumn(c, F.when(~hit, F.col(c)))
    if "extract_attempts" in receipts.columns:
        joined = joined.withColumn("extract_attempts", F.when(hit, 0).otherwise(F.col("extract_attempts")))
    status = effective_status(F.lit(None).cast("string"), F.col("file_path"))
    return joined.withColumn("extract_status", F.when(hit, status).otherwise(F.col("extract_status"))).drop("_clear")


def undo_shopping_run(activities: DataFrame, shopping_list: DataFrame) -> DataFrame:
    """The list without the items a run added, and with its renames reverted where nobody renamed since."""
    runs = _parsed(activities, SHOPPING_KIND)
    added = runs.select(F.explode("p.added.shopping_list_item_id").alias("id")).where("id is not null")
    renames = runs.select(F.inline("p.renamed")).where("old_name <> '' and new_name <> ''")
    back = renames.groupBy(F.col("shopping_list_item_id").alias("id")).agg(F.min(F.struct("old_name", "new_name")).alias("_r"))
    kept = shopping_list.join(added, "id", "left_anti").join(back, "id", "left")
    reverts = F.trim("name") == F.trim("_r.new_name")
    return kept.withColumn("name", F.when(reverts, F.col("_r.old_name")).otherwise(F.col("name"))).select(*shopping_list.columns)


def undone_shopping_state(activities: DataFrame) -> DataFrame:
    """State rows to write back for undone runs: see ``merge_state``."""
    rows = _parsed(activities, SHOPPING_KIND).select(F.inline("p.shopping_state_updates")).where("product_id is not null")
    latest = rows.groupBy("product_id").agg(F.min("previous").alias("p"))
    return latest.select("product_id", "p.*")


def undone_evidence(activities: DataFrame) -> DataFrame:
    """Sighting rows to write back for undone image analyses."""
    rows = _parsed(activities, IMAGE_KIND).select(F.inline("p.boosts")).where("product_id is not null")
    return rows.groupBy("product_id").agg(F.min("previous").alias("p")).select("product_id", "p.*")
