"""Registered queries of the write paths, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillwise.functions.dates import instant
from tillwise.operators import extract, maintain, writes
from tillwise.plans import driver_tables as tables
from tillwise.plans.driver_tables import AS_OF, load
from tillwise.plans.oracle_data import DAY, STORES


def _day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _aliases(spark, d) -> DataFrame:
    """Two spellings that stand for known chains."""
    rows = load(spark, d, "region").where("r_regionkey in (0, 1)")
    first = F.col("r_regionkey") == 0
    return rows.select(F.when(first, "old mart").otherwise("ica maxi").alias("key"), F.when(first, "Nation 4").otherwise("Nation 3").alias("canonical"))


def _stored(spark, d) -> DataFrame:
    """Orders as stored receipts without a store of their own."""
    none = F.lit(None).cast("string")
    item = F.struct(F.col("store_name").alias("raw_name"), F.col("total").alias("line_total"), F.lit("1").alias("qty_raw"), F.lit(None).cast("double").alias("unit_price_raw"))
    return tables.receipts(spark, d).select(
        "receipt_id", "total", "purchased_at", "created_at", "store_name", none.alias("store_entity_id"), "receipt_category", "receipt_category_source",
        F.lit(None).cast(maintain.SUBCATEGORY_ROWS).alias("receipt_subcategories"), F.array(item).alias("line_items_raw"), F.lit("kr").alias("currency"),
        none.alias("raw_text"), none.alias("ocr_text"), "filename", "file_path", "extract_status", F.lit(None).cast("timestamp").alias("extract_queued_at"))


def _fields(rows: DataFrame, feed: DataFrame) -> DataFrame:
    """The compared fields of each receipt with what the feed says about it."""
    told = feed.select("receipt_id", F.array_join("fields", ",").alias("fields"), "kind", "reprocess")
    first = F.get("receipt_subcategories", F.lit(0))
    return rows.join(told, "receipt_id", "left").select(
        "receipt_id", F.round("total", 2).alias("total"), _day("purchased_at"), "store_name", "store_entity_id", "receipt_category", "receipt_category_source",
        first["subcategory"].alias("subcategory"), F.round(first["total"], 2).alias("sub_total"), F.size("line_items_raw").cast("long").alias("n_items"),
        "fields", "kind", "reprocess")


def update_receipts(spark, d):
    """Corrected names (an alias, a chain in another spelling, an unknown store), categories and dates of filled orders."""
    name = F.when(F.col("o_custkey") % 3 == 0, "Old Mart").when(F.col("o_custkey") % 3 == 1, "nation 5").otherwise("Fresh Foods")
    updates = load(spark, d, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("receipt_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("store_name"), F.lit("total")))
        .when(F.col("o_orderpriority") == "2-HIGH", F.array(F.lit("receipt_category"), F.lit("currency")))
        .otherwise(F.array(F.lit("purchased_at"))).alias("fields"),
        name.alias("store_name"), F.when(F.col("o_orderpriority") == "5-LOW", "soon").otherwise("2001-01-02").alias("purchased_at"),
        F.lit(7.0).alias("total"), F.lit(" ").alias("currency"), F.lit("restaurant").alias("receipt_category"),
        F.lit(None).cast(maintain.SUBCATEGORY_ROWS).alias("receipt_subcategories"), F.lit(None).cast(f"array<{extract.ITEM}>").alias("line_items_raw"),
        F.lit(False).alias("clear_line_items"))
    out = writes.update_receipts(_stored(spark, d), updates, tables.stores(spark, d), _aliases(spark, d), AS_OF)
    return _fields(out["receipts"], out["changes"])


def add_receipts(spark, d):
    """Typed receipts: one of three chains, or a segment's own shop."""
    rows = load(spark, d, "orders").join(load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").select(
        F.col("o_orderkey").alias("receipt_id"), F.when(F.col("o_orderkey") % 10 != 3, F.col("o_totalprice")).alias("total"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.when(F.col("o_orderstatus") == "F", "Old Mart").when(F.col("o_orderstatus") == "O", "NATION 5").otherwise(F.initcap("c_mktsegment")).alias("store"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Take-Away").alias("receipt_category"), F.lit(None).cast("string").alias("raw_text"),
        F.lit(None).cast(maintain.SUBCATEGORY_ROWS).alias("receipt_subcategories"), F.lit(None).cast(f"array<{extract.ITEM}>").alias("line_items_raw"))
    stored = _stored(spark, d).where("false")
    out = writes.add_receipts(stored, rows, tables.stores(spark, d), _aliases(spark, d), AS_OF)
    return _fields(out["receipts"], out["changes"])


def reread_receipts(spark, d):
    """Stored texts read again: model answers for urgent orders, text for the rest."""
    from tillwise.plans.queries_data import _receipt_inputs

    texts = _receipt_inputs(spark, d).select("receipt_id", F.col("text").alias("raw_text"), "locale", "model")
    stored = _stored(spark, d).drop("raw_text").withColumn("store_name", F.when(F.col("receipt_category") != "dining", "Corner Market")).withColumn("line_items_raw", F.array().cast(f"array<{extract.ITEM}>"))
    stored = stored.withColumn("total", F.when(F.col("receipt_category") == "dining", F.col("total"))).join(texts, "receipt_id")
    out = writes.reread_receipts(stored, tables.stores(spark, d), _aliases(spark, d), AS_OF, "2000-01-01", "2001-12-31")
    return _fields(out["receipts"], out["changes"])


def queue_extraction(spark, d):
    rows = _stored(spark, d).withColumn("extract_status", F.when(F.col("receipt_id") % 7 == 0, "failed").otherwise(F.coalesce("extract_status", F.lit("pending"))))
    queued = maintain.queue_extraction(rows, AS_OF)
    return queued.select("receipt_id", "extract_status", (F.col("extract_queued_at") == instant(AS_OF)).alias("queued_now"))


QUERIES = {f"write_{f.__name__}": f for f in (update_receipts, add_receipts, reread_receipts)} | {"queue_extraction": queue_extraction}

_RICH = """rich AS (SELECT chain_name, store_entity_id FROM st QUALIFY row_number() OVER (PARTITION BY chain_name ORDER BY filled DESC, s_suppkey DESC) = 1)"""


def _entity(name: str) -> str:
    """The richest store of a chain, or a new one named by the hash of what is known about it."""
    return f"coalesce((SELECT store_entity_id FROM rich WHERE chain_name = {name}), substr(sha256('at:' || lower({name}) || '|||'), 1, 32))"


_UPDATES = f"""WITH {STORES}, {_RICH}, o AS (
  SELECT o_orderkey AS receipt_id, o_orderstatus = 'F' AS f, o_orderpriority AS p, o_totalprice AS price, o_orderdate AS ts, 'Store ' || (o_custkey % 40) AS old_name,
    CASE o_custkey % 3 WHEN 0 THEN 'Nation 4' WHEN 1 THEN 'Nation 5' ELSE 'Fresh Foods' END AS name FROM orders),
k AS (SELECT name, {_entity('name')} AS entity, CASE WHEN name = 'Nation 5' AND name NOT IN (SELECT chain_name FROM rich) THEN 'nation 5' ELSE name END AS shown FROM (SELECT DISTINCT name FROM o)),
n AS (SELECT o.*, entity, shown, f AND p = '1-URGENT' AS moved, f AND p = '2-HIGH' AS sorted, f AND p IN ('3-MEDIUM', '4-NOT SPECIFIED') AS dated, f AND p <> '5-LOW' AS active FROM o JOIN k USING (name)),
v AS (SELECT *, CASE WHEN moved THEN 7 ELSE price END AS total, CASE WHEN dated THEN TIMESTAMP '2001-01-02' ELSE ts END AS day,
  CASE p WHEN '1-URGENT' THEN 'dining' WHEN '4-NOT SPECIFIED' THEN '' ELSE 'grocery' END AS old_category, CASE WHEN sorted THEN 'dining' WHEN active THEN 'grocery'
    ELSE CASE p WHEN '1-URGENT' THEN 'dining' WHEN '4-NOT SPECIFIED' THEN '' ELSE 'grocery' END END AS category FROM n)
SELECT receipt_id, round(total, 2) AS total, strftime(day, {DAY}) AS purchased_at, CASE WHEN moved THEN shown ELSE old_name END AS store_name, CASE WHEN moved THEN entity END AS store_entity_id,
  category AS receipt_category, CASE WHEN sorted THEN 'manual' ELSE 'auto' END AS receipt_category_source, CASE WHEN active THEN 'unclassified' END AS subcategory,
  CASE WHEN active THEN round(total, 2) END AS sub_total, CAST(1 AS BIGINT) AS n_items,
  CASE WHEN active THEN concat_ws(',', CASE WHEN total <> price THEN 'total' END, CASE WHEN day <> ts THEN 'purchased_at' END, CASE WHEN moved THEN 'store_name,store_entity_id' END,
    CASE WHEN category <> old_category THEN 'receipt_category' END, CASE WHEN sorted THEN 'receipt_category_source' END, 'receipt_subcategories') END AS fields,
  CASE WHEN active THEN 'update' END AS kind, CASE WHEN active THEN moved OR day <> ts END AS reprocess FROM v"""

_ADDED = f"""WITH {STORES}, {_RICH}, o AS (
  SELECT o_orderkey AS receipt_id, o_totalprice AS total, o_orderdate AS ts, o_orderpriority = '1-URGENT' AS typed,
    CASE o_orderstatus WHEN 'F' THEN 'Nation 4' WHEN 'O' THEN 'Nation 5' ELSE upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) END AS name
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 10 <> 3),
k AS (SELECT name, {_entity('name')} AS entity, CASE WHEN name IN (SELECT chain_name FROM rich) OR name IN ('Nation 4') THEN name WHEN name = 'Nation 5' THEN 'NATION 5' ELSE name END AS shown FROM (SELECT DISTINCT name FROM o))
SELECT receipt_id, round(total, 2) AS total, strftime(CAST(CAST(ts AS DATE) AS TIMESTAMP), {DAY}) AS purchased_at, shown AS store_name, entity AS store_entity_id,
  CASE WHEN typed THEN 'dining' ELSE 'grocery' END AS receipt_category, CASE WHEN typed THEN 'manual' ELSE 'auto' END AS receipt_category_source, 'unclassified' AS subcategory,
  round(total, 2) AS sub_total, CAST(0 AS BIGINT) AS n_items, 'total,purchased_at,store_name,store_entity_id,receipt_category,receipt_category_source,receipt_subcategories,line_items_raw' AS fields,
  'insert' AS kind, false AS reprocess FROM o JOIN k USING (name)"""

_QUEUED = f"""WITH r AS (SELECT o_orderkey AS receipt_id, CASE WHEN o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' THEN 'running' ELSE 'pending' END AS s,
  o_orderpriority <> '5-LOW' AS has_file FROM orders)
SELECT receipt_id, CASE WHEN has_file AND s IN ('pending', 'failed') THEN 'queued' ELSE s END AS extract_status, CASE WHEN has_file AND s IN ('pending', 'failed') THEN true END AS queued_now FROM r"""

_REREAD = f"""WITH {STORES}, {_RICH}, o AS (
  SELECT o_orderkey AS receipt_id, o_totalprice AS total, o_orderdate AS ts, o_orderpriority = '1-URGENT' AS model, o_orderpriority = '4-NOT SPECIFIED' AS untyped FROM orders
  WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderdate < TIMESTAMP '2002-01-01'),
v AS (SELECT *, model AND total + 1 <= 50000 AS split FROM o)
SELECT receipt_id, round(total, 2) AS total, strftime(ts, {DAY}) AS purchased_at, CASE WHEN model THEN 'Nation 3' ELSE 'Corner Market' END AS store_name,
  CASE WHEN model THEN (SELECT {_entity("'Nation 3'")}) END AS store_entity_id, CASE WHEN model THEN 'dining' ELSE 'grocery' END AS receipt_category, 'auto' AS receipt_category_source,
  CASE WHEN split THEN 'bar_pub' ELSE 'unclassified' END AS subcategory, round(CASE WHEN split THEN total + 1 ELSE total END, 2) AS sub_total,
  CAST(CASE WHEN model THEN 1 ELSE 0 END AS BIGINT) AS n_items,
  CASE WHEN model THEN 'store_name,store_entity_id,receipt_subcategories,line_items_raw' WHEN untyped THEN 'total,receipt_category,receipt_subcategories' ELSE 'total,receipt_subcategories' END AS fields,
  'update' AS kind, model AS reprocess FROM v"""

ORACLE = {"write_reread_receipts": _REREAD, "write_update_receipts": _UPDATES, "write_add_receipts": _ADDED, "queue_extraction": _QUEUED}
