"""The star-schema test tables seen as receipts, items, observations, stores and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF = "2001-07-25 12:00:00"
EVENTS_AS_OF = "2024-01-30 00:00:00"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; timestamps are read as instants in UTC so that time filters reach the scan."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def receipts(spark: SparkSession, sf_dir: str, subcategories: bool = False) -> DataFrame:
    """``orders`` as receipts; with ``subcategories`` the nested spend rows come from the line items."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    orders = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("receipt_id"),
        F.col("o_orderdate").alias("purchased_at"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("total"),
        F.concat(F.lit("Store "), (F.col("o_custkey") % 40).cast("string")).alias("store_name"),
        F.when(urgent, "dining").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "").otherwise("grocery")
        .alias("receipt_category"),
        F.lit("auto").alias("receipt_category_source"),
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string"), F.when(F.col("o_custkey") % 2 == 0, ".pdf").otherwise(".jpg"))
        .alias("filename"),
        F.col("o_custkey").alias("customer_id"),
        F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "running").alias("extract_status"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("")).otherwise(F.concat(F.lit("/in/"), F.col("o_orderkey").cast("string")))
        .alias("file_path"),
        (F.col("o_totalprice") % 9000).cast("long").alias("extract_duration_ms"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "LLM").when(F.col("o_orderpriority") == "3-MEDIUM", "heuristic")
        .alias("extract_method"),
        F.when(F.col("o_custkey") % 3 == 0, "OpenAI").when(F.col("o_custkey") % 3 == 1, "ollama").alias("extract_provider"),
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderdate")).alias("extract_finished_at"),
    )
    if not subcategories:
        return orders
    # Summed per order and type first; the list per order then holds one entry per part type (six in all).
    nested = (
        subcategory_rows(spark, sf_dir).groupBy("receipt_id")
        .agg(F.sort_array(F.collect_list(F.struct("subcategory", "total"))).alias("receipt_subcategories"))
    )
    return orders.join(nested, "receipt_id", "left")


def subcategory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(receipt_id, subcategory, total) from line items and part types."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount")
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return lines.join(parts, "l_partkey").groupBy(
        F.col("l_orderkey").alias("receipt_id"), F.lower("p_type").alias("subcategory")
    ).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("total"))


def line_item_id():
    return F.concat_ws("-", "l_orderkey", F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), "l_partkey", "l_suppkey")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as receipt lines: (receipt_id, pos, raw_name, line_total, qty_raw, unit_price_raw)."""
    lines = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"
    )
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return lines.join(parts, "l_partkey").select(
        F.col("l_orderkey").alias("receipt_id"),
        (F.col("l_linenumber") * 100_000_000 + F.col("l_partkey")).cast("long").alias("pos"),
        F.initcap("p_name").alias("raw_name"),
        F.col("l_extendedprice").alias("line_total"),
        F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" pcs")).alias("qty_raw"),
        F.lit(None).cast("double").alias("unit_price_raw"),
        line_item_id().alias("line_item_id"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as price observations: product by part name, store by supplier region."""
    lines = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"
    )
    orders = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("observed_at")
    )
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("product_id"))
    regions = (
        load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
        .join(load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey")
        .join(load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
        .select("l_suppkey", F.col("r_name").alias("store_name"))
    )
    return lines.join(orders, "l_orderkey").join(parts, "l_partkey").join(regions, "l_suppkey").select(
        "product_id", "store_name", "observed_at",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.lit("pcs").alias("unit_type"),
        F.least(F.lit(100), 65 + 5 * F.col("l_linenumber")).cast("int").alias("confidence"),
        F.col("l_orderkey").alias("receipt_id"),
        line_item_id().alias("line_item_id"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(F.col("p_name").alias("product_id")).distinct().withColumn(
        "canonical_name", F.initcap("product_id")
    )


def evidence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product state from ``view`` events, one product per user."""
    views = load(spark, sf_dir, "events").where("event_type = 'view'")
    return views.groupBy(F.col("user_id").alias("product_id")).agg(
        F.max("ts").alias("last_seen_at"), (F.max("value") / 500.0).alias("last_seen_confidence")
    )


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stores of a chain per nation; some lack their identifying fields."""
    nations = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    rich = F.col("s_suppkey") % 3 != 0
    return load(spark, sf_dir, "supplier").join(nations, "s_nationkey").select(
        F.format_string("s%09d", "s_suppkey").alias("store_entity_id"),
        F.initcap(F.regexp_replace("n_name", "_", " ")).alias("chain_name"),
        F.when(rich, F.col("s_name")).alias("branch_name"),
        F.when(rich, F.concat(F.lit("High Street "), (F.col("s_suppkey") % 7).cast("string"))).alias("address"),
        F.when(rich, F.format_string("%05d", F.col("s_suppkey") % 4)).alias("postal_code"),
        F.when(rich, F.concat(F.lit("City "), F.col("n_regionkey").cast("string"))).alias("city"),
        F.when(F.col("s_suppkey") % 5 == 1, F.format_string("55%04d", F.col("s_suppkey") % 25)).alias("org_number"),
        F.when(F.col("s_suppkey") % 5 == 2, F.format_string("070-%05d", "s_suppkey")).alias("phone"),
        F.lit(None).cast("string").alias("store_id"),
        F.array(F.initcap(F.regexp_replace("n_name", "_", " "))).alias("aliases"),
        F.timestamp_seconds(F.lit(946684800) + F.col("s_suppkey") * 86400).alias("created_at"),
        F.timestamp_seconds(F.lit(946684800) + F.col("s_suppkey") * 86400).alias("updated_at"),
    )
