"""JSON inputs: model answers and saved document stores; table output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillwise.functions.categories import DINING, effective_status
from tillwise.operators.extract import MODEL_SCHEMA

SAVED_RECEIPT = (
    "id string, total double, purchased_at string, store_name string, store_entity_id string, receipt_category string, "
    "receipt_category_source string, receipt_type string, receipt_type_source string, "
    "receipt_subcategories array<struct<subcategory:string,total:double>>, "
    "grocery_subcategories array<struct<subcategory:string,total:double>>, receipt_subcategory string, "
    "line_items_raw array<struct<raw_name:string,line_total:double,qty_raw:string,unit_price_raw:double>>, "
    "currency string, raw_text string, ocr_text string, ocr_confidence int, content_hash string, extract_status string, "
    "extract_attempts int, extract_duration_ms bigint, extract_method string, extract_provider string, "
    "source_type string, source_meta map<string,string>, file_path string, filename string, created_at string"
)
SAVED_TABLES = {
    "receipts": SAVED_RECEIPT,
    "line_items": "line_item_id string, receipt_id string, raw_name string, line_total double, qty_raw string, "
    "unit_price_raw double, matched_product_id string, match_confidence int",
    "products": "product_id string, canonical_name string, aliases array<string>, unit_type string, created_at string, updated_at string",
    "observations": "observation_id string, product_id string, store_name string, observed_at string, pack_price double, "
    "unit_price double, unit_type string, confidence int, receipt_id string, line_item_id string",
    "stores": "store_entity_id string, chain_name string, branch_name string, address string, postal_code string, city string, "
    "org_number string, phone string, store_id string, aliases array<string>, created_at string, updated_at string",
    "processed_files": "fingerprint string, content_hash string, path string, filename string, size bigint, mtime bigint",
    "inventory_images": "image_id string, file_path string, filename string, fingerprint string, taken_at string, status string, "
    "attempts int, created_at string, updated_at string, raw_result string",
}


def first_json_object(c: Column) -> Column:
    """The text from the first ``{`` to the last ``}``; empty when there is none."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)(\{.*\})", 1)


def parse_model_json(df: DataFrame, column: str, schema: str = MODEL_SCHEMA, name: str = "model") -> DataFrame:
    """Adds the parsed object of a model answer; unreadable answers give null fields."""
    return df.withColumn(name, F.from_json(first_json_object(F.col(column)), schema))


def migrate_receipts(saved: DataFrame) -> DataFrame:
    """Saved receipts of any age in today's columns: old names, old category value, single subcategories, statuses."""
    category = F.coalesce("receipt_category", "receipt_type")
    rows = F.filter("grocery_subcategories", lambda r: (F.trim(r["subcategory"]) != "") & (r["total"] > 0))
    rows = F.transform(rows, lambda r: F.struct(F.trim(r["subcategory"]).alias("subcategory"), F.bround(r["total"], 2).alias("total")))
    single = F.array(F.struct(F.trim("receipt_subcategory").alias("subcategory"), F.bround("total", 2).alias("total")))
    empty = F.array().cast("array<struct<subcategory:string,total:double>>")
    migrated = (
        F.when(F.col("receipt_subcategories").isNotNull(), F.col("receipt_subcategories"))
        .when(F.coalesce(F.size(rows), F.lit(0)) > 0, rows)
        .when((F.trim("receipt_subcategory") != "") & (F.col("total") > 0), single)
        .otherwise(empty)
    )
    status = effective_status(F.nullif("extract_status", F.lit("queued")), F.col("file_path"))
    return (
        saved.withColumn("receipt_subcategories", migrated)
        .withColumn("receipt_category", F.when(F.lower(F.trim(category)) == "eating_out", DINING).otherwise(category))
        .withColumn("receipt_category_source", F.coalesce("receipt_category_source", "receipt_type_source"))
        .withColumn("extract_status", status)
        .withColumn("extract_attempts", F.coalesce("extract_attempts", F.lit(0)))
        .withColumn("source_meta", F.coalesce("source_meta", F.create_map().cast("map<string,string>")))
        .withColumn("purchased_at", F.trim("purchased_at").try_cast("timestamp"))
        .withColumn("created_at", F.trim("created_at").try_cast("timestamp"))
        .drop("receipt_type", "receipt_type_source", "receipt_subcategory", "grocery_subcategories")
        .withColumnRenamed("id", "receipt_id")
    )


def load_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a saved document store: one JSON document whose collections are keyed by id."""
    schema = "data struct<" + ",".join(
        f"{name}:map<string,struct<{_as_struct(ddl)}>>" for name, ddl in SAVED_TABLES.items()
    ) + ",store_aliases:map<string,string>>"
    saved = spark.read.schema(schema).json(path, multiLine=True)
    tables = {
        name: saved.select(F.explode(F.map_values(f"data.{name}")).alias("r")).select("r.*") for name in SAVED_TABLES
    }
    tables["receipts"] = migrate_receipts(tables["receipts"])
    tables["store_aliases"] = saved.select(F.explode("data.store_aliases").alias("key", "canonical"))
    return tables


def _as_struct(ddl: str) -> str:
    return ",".join(f"{n}:{t}" for n, t in (part.strip().split(" ", 1) for part in _top_level_parts(ddl)))


def _top_level_parts(ddl: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(ddl[start:i])
            start = i + 1
    return parts + [ddl[start:]]


def write_tables(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Every table as parquet; tables with a time column are partitioned by its month."""
    months = {"receipts": "purchased_at", "observations": "observed_at", "activities": "timestamp"}
    for name, df in tables.items():
        if name in months and months[name] in df.columns:
            dated = df.withColumn("purchase_month", F.date_format(months[name], "yyyy-MM"))
            dated.write.mode(mode).partitionBy("purchase_month").parquet(f"{path}/{name}")
        else:
            df.write.mode(mode).parquet(f"{path}/{name}")
