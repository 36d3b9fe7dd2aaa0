"""Scoped exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tillwise.functions.dates import in_date_range, instant

SCHEMA_VERSION = 1
# Columns an export leaves out, by scope.
ALWAYS_DROPPED = ("file_path", "ocr_text", "raw_text")
ANALYTICS_DROPPED = ALWAYS_DROPPED + (
    "source_meta", "extract_started_at", "extract_queued_at", "extract_finished_at", "extract_duration_ms",
    "extract_queue_delay_ms", "extract_method", "extract_provider", "extract_model", "merchant_hints",
)
SCOPES = ("analytics", "debug", "full")


def clean_scope(scope: str | None) -> str:
    name = (scope or "analytics").strip().lower()
    return name if name in SCOPES else "analytics"


def export_scope_projection(receipts: DataFrame, scope: str) -> DataFrame:
    return receipts.drop(*(ANALYTICS_DROPPED if clean_scope(scope) == "analytics" else ALWAYS_DROPPED))


def export_data(
    tables: dict[str, DataFrame], scope: str = "analytics", since: str | None = None, until: str | None = None,
    include_undated: bool = False,
) -> dict[str, DataFrame]:
    """Receipts of the range and the rows of the other tables that belong to them.

    ``tables`` may have ``receipts, line_items, products, observations, stores, inventory_images, activities``.
    """
    scope = clean_scope(scope)
    receipts = tables["receipts"].where(in_date_range(F.col("purchased_at"), since, until, include_undated))
    ids = receipts.select("receipt_id")
    out = {"receipts": export_scope_projection(receipts, scope)}
    for name in ("observations", "line_items"):
        if name in tables:
            out[name] = tables[name].join(ids, "receipt_id", "left_semi")
    if "stores" in tables:
        used = receipts.select("store_entity_id").where("store_entity_id is not null")
        out["stores"] = tables["stores"].join(used, "store_entity_id", "left_semi")
    if "products" in tables and "observations" in out:
        out["products"] = tables["products"].join(out["observations"].select("product_id"), "product_id", "left_semi")
    if "inventory_images" in tables:
        out["inventory_images"] = tables["inventory_images"].drop("file_path")
    if "activities" in tables and scope == "full":
        out["activities"] = tables["activities"]
    return out


def export_counts(exported: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) of an export."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in sorted(exported.items())
    ]
    return reduce(DataFrame.unionByName, parts)


def write_export(exported: dict[str, DataFrame], path: str, as_of, scope: str = "analytics") -> None:
    """One JSON folder per table and a manifest with version, scope, time and row counts."""
    for name, df in exported.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    manifest = export_counts(exported).withColumn("schema_version", F.lit(SCHEMA_VERSION)).withColumn(
        "exported_at", instant(as_of)
    ).withColumn("scope", F.lit(clean_scope(scope)))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
