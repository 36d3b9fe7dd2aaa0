"""Registered queries: spend, quality, prices, restock, shopping, inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillwise.config import Config
from tillwise.functions.categories import category_key, effective_status, is_unknown_subcategory
from tillwise.functions.dates import days_before, instant, iso_week, month_key, shift_month
from tillwise.operators import activities, inventory, prices, quality, restock, shopping, spend
from tillwise.operators.stats import top_rows
from tillwise.plans import driver_tables as tables
from tillwise.plans.driver_tables import AS_OF, EVENTS_AS_OF, load
from tillwise.plans.snapshot import snapshot, snapshot_sizes
from tillwise.session import settle

TENANT = ["tenant"]


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _tenants(df: DataFrame) -> DataFrame:
    return df.withColumn("tenant", (F.col("customer_id") % 20).cast("long"))


def spend_totals(spark, d):
    row = spend.spend_totals(tables.receipts(spark, d), AS_OF)
    return row.select(*[F.round(c, 4).alias(c) for c in row.columns])


def spend_week(spark, d):
    return spend_totals(spark, d).select("week_total")


def spend_month(spark, d):
    return spend_totals(spark, d).select("month_total")


def spend_year(spark, d):
    return spend_totals(spark, d).select("year_total")


def spend_totals_by_tenant(spark, d):
    row = spend.spend_totals(_tenants(tables.receipts(spark, d)), AS_OF, TENANT)
    return row.select("tenant", *[F.round(c, 4).alias(c) for c in row.columns if c != "tenant"])


def receipt_subcategory_totals(spark, d):
    rows = spend.receipt_subcategory_totals(tables.receipts(spark, d, True))
    return rows.withColumn("total", F.round("total", 4))


def spend_by_category_periods(spark, d):
    return spend.spend_by_category_periods(tables.receipts(spark, d), AS_OF, places=4)


def spend_by_subcategory_periods(spark, d):
    return spend.spend_by_subcategory_periods(tables.receipts(spark, d, True), AS_OF, places=4)


def spend_by_category_periods_by_tenant(spark, d):
    return spend.spend_by_category_periods(_tenants(tables.receipts(spark, d)), AS_OF, TENANT, places=4)


def truncation_meta(spark, d):
    rows = spend.subcategory_period_totals(tables.receipts(spark, d, True), AS_OF)
    return spend.truncation_meta(rows, spend.SUBCATEGORY_ROWS)


def category_pivot(spark, d):
    return spend.category_pivot(spend_by_category_periods(spark, d)).select(
        "category", *[F.round(c, 4).alias(c) for c in ("week", "month", "year")]
    )


def receipt_status_counts(spark, d):
    return quality.receipt_status_counts(tables.receipts(spark, d))


def receipt_status_summary(spark, d):
    return quality.receipt_status_summary(tables.receipts(spark, d))


def processing_timing(spark, d):
    return quality.processing_timing(tables.receipts(spark, d), AS_OF, places=6)


def recent_receipts(spark, d):
    rows = quality.recent_receipts(tables.receipts(spark, d), limit=quality.RECENT_ROWS)
    return rows.withColumn("purchased_at", day("purchased_at"))


def recent_receipts_by_tenant(spark, d):
    rows = quality.recent_receipts(_tenants(tables.receipts(spark, d)), TENANT, 5)
    return rows.select("tenant", "receipt_id", day("purchased_at"), "total")


def dedupe_recent_receipts(spark, d):
    rows = quality.dedupe_recent_receipts(tables.receipts(spark, d), limit=quality.DEDUPED_ROWS)
    return rows.withColumn("purchased_at", day("purchased_at"))


def unknown_category(spark, d):
    rows = quality.unknown_category_receipts(tables.receipts(spark, d))
    return rows.withColumn("purchased_at", day("purchased_at"))


def is_unknown_subcategory_rows(spark, d):
    label = F.when(F.col("p_type") == "PROMO", F.lit(" Misc ")).when(F.col("p_type") == "SMALL", "").when(
        F.col("p_type") == "LARGE", "Other").otherwise(F.col("p_type"))
    parts = load(spark, d, "part").withColumn("subcategory", label)
    return parts.groupBy("subcategory").agg(
        F.count(F.lit(1)).alias("n"), F.max(is_unknown_subcategory(F.col("subcategory"))).alias("is_unknown")
    )


def unknown_subcategory_items(spark, d):
    rows = quality.unknown_subcategory_items(tables.receipts(spark, d, True), tables.items(spark, d))
    return rows.withColumn("sample_purchased_at", day("sample_purchased_at"))


def unknown_item_report(spark, d):
    subs = tables.receipts(spark, d, True).withColumn(
        "receipt_subcategories",
        F.transform("receipt_subcategories", lambda s: F.struct(
            F.when(s["subcategory"] == "promo", "Misc").otherwise(s["subcategory"]).alias("subcategory"), s["total"].alias("total"))),
    )
    return quality.unknown_item_report(subs, tables.items(spark, d))


def price_baselines(spark, d):
    rows = prices.price_baselines(tables.observations(spark, d))
    return rows.withColumn("baseline", F.round("baseline", 8))


def last_prices(spark, d):
    rows = top_rows(
        tables.observations(spark, d), [F.col("observed_at").desc(), F.col("line_item_id").desc()], 5, ["product_id"]
    )
    return rows.select("product_id", "line_item_id", day("observed_at"), "unit_price")


def overpaid_items(spark, d):
    rows = prices.overpaid_items(tables.observations(spark, d), tables.products(spark, d), AS_OF, places=8)
    return rows.withColumn("observed_at", day("observed_at"))


def overpaid_items_by_tenant(spark, d):
    obs = tables.observations(spark, d).withColumn("tenant", F.col("store_name"))
    # Every tenant knows all products: the names need no further pass over the observations.
    products = load(spark, d, "region").select(F.col("r_name").alias("tenant")).crossJoin(tables.products(spark, d))
    rows = prices.overpaid_items(obs, products, AS_OF, keys=TENANT, limit=5, places=8)
    return rows.select("tenant", "product", "unit_price", "baseline", "overpaid_pct", "line_item_id")


def top_price_increases(spark, d):
    return prices.top_price_increases(tables.observations(spark, d), tables.products(spark, d), AS_OF, places=8)


def best_store_by_item(spark, d):
    return prices.best_store_by_item(tables.observations(spark, d), tables.products(spark, d), AS_OF, places=8)


def _customer_purchases(spark, d):
    return load(spark, d, "orders").select(F.col("o_custkey").alias("product_id"), F.col("o_orderdate").alias("observed_at"))


def purchase_gaps(spark, d):
    return restock.purchase_gaps(_customer_purchases(spark, d), ["product_id"], "observed_at").select(
        "product_id", F.round("gap", 6).alias("gap"), "weight"
    )


def restock_levels(spark, d):
    rows = restock.restock_levels(_customer_purchases(spark, d), AS_OF)
    return rows.select(
        "product_id", "purchases", F.round("cadence", 6).alias("cadence"), F.round("days_since_last", 6).alias("days_since_last"),
        "level", F.round("confidence", 6).alias("confidence"),
    )


def _customer_state(spark, d):
    """Segment and balance of a customer stand in for what earlier runs and images left behind."""
    now = instant(AS_OF)
    segment = F.col("c_mktsegment")
    return load(spark, d, "customer").select(
        F.col("c_custkey").alias("product_id"),
        F.when(segment == "BUILDING", days_before(now, 3)).when(segment == "MACHINERY", days_before(now, 9)).alias("last_auto_added_at"),
        F.lit(None).cast("string").alias("last_store_tag"),
        F.when(segment == "MACHINERY", F.lit(0.8)).alias("last_store_tag_confidence"),
        F.when(segment == "HOUSEHOLD", days_before(now, 2)).alias("last_seen_at"),
        F.when(segment == "HOUSEHOLD", F.lit(0.9)).alias("last_seen_confidence"),
    )


LOW_BAR = Config(restock_confidence=0.5)


def restock_candidates(spark, d):
    rows = restock.restock_candidates(_customer_purchases(spark, d), _customer_state(spark, d), AS_OF, LOW_BAR)
    return rows.select("product_id", "status", "level", F.round("confidence", 6).alias("confidence"))


def _aliases(spark, d):
    """MIDDLE EAST is an alias of ASIA; the rest of the alias table maps names to themselves."""
    return load(spark, d, "region").select(
        F.lower("r_name").alias("key"), F.when(F.col("r_name") == "MIDDLE EAST", "ASIA").otherwise(F.col("r_name")).alias("canonical")
    )


def resolve_store_alias(spark, d):
    rows = restock.resolve_store_alias(tables.observations(spark, d), _aliases(spark, d), "store_name")
    return rows.groupBy("store_name").agg(F.count(F.lit(1)).alias("n"))


def _prices(spark, d):
    return restock.store_prices(tables.observations(spark, d), _aliases(spark, d), AS_OF)


def _stored_prices(spark, d):
    """Store prices written once for the queries that read them several times."""
    return settle(_prices(spark, d))


def store_prices(spark, d):
    return _prices(spark, d).select(
        "product_id", "store", "n", F.round("median", 8).alias("median"), F.round("q25", 8).alias("q25"),
        F.round("q75", 8).alias("q75"), day("last_seen"), "unit_type",
    )


def store_recommendation(spark, d):
    return restock.store_recommendation(_prices(spark, d), AS_OF, places=8)


def plan_stores(spark, d):
    recs = restock.store_recommendation(_stored_prices(spark, d), AS_OF)
    return restock.plan_stores(recs).withColumn("place", F.col("place").cast("long"))


def store_plan(spark, d):
    prices_ = _stored_prices(spark, d)
    recs = restock.store_recommendation(prices_, AS_OF)
    return restock.store_plan(recs, prices_).select("product_id", "planned_store", "best")


def _customer_list(spark, d):
    """Open and done list entries named after customers."""
    segment = F.col("c_mktsegment")
    name = F.when(segment == "MACHINERY", F.concat(F.lower("c_name"), F.lit(" @ AFRICA"))).when(
        segment == "FURNITURE", F.concat(F.lit("[Auto] "), F.col("c_name")))
    return load(spark, d, "customer").select(
        F.format_string("i%09d", "c_custkey").alias("id"), name.alias("name"), (F.col("c_acctbal") < 0).alias("complete")
    ).where("name is not null")


def _customer_candidates(spark, d):
    return load(spark, d, "customer").join(
        load(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey"
    ).select(
        F.col("c_custkey").alias("product_id"), F.col("c_name").alias("name"),
        (0.75 + (F.col("c_custkey") % 20) / 100.0).alias("confidence"), F.lit("due").alias("reason"),
        F.when(F.col("n_regionkey") == 0, "AFRICA").when(F.col("n_regionkey") == 1, "ASIA").alias("planned_store"),
        (0.70 + (F.col("c_custkey") % 30) / 100.0).alias("store_confidence"),
    )


MARKED = Config(item_marker="[Auto]")


def reconcile_shopping_list(spark, d):
    rows = shopping.reconcile_shopping_list(
        _customer_candidates(spark, d), _customer_list(spark, d), _customer_state(spark, d), MARKED
    )
    return rows.select("product_id", "action", "new_name", "old_name", "shopping_list_item_id", "store")


def _run(spark, d):
    """A restock run over orders as purchases: ten customers share a product, two stores (one known under an alias) sell it."""
    key, even = F.col("o_orderkey"), F.col("o_orderkey") % 2 == 0
    obs = load(spark, d, "orders").select(
        F.floor(F.col("o_custkey") / 10).alias("product_id"), F.when(key % 4 == 0, "MIDDLE EAST").when(even, "ASIA").otherwise("AFRICA").alias("store_name"),
        F.col("o_orderdate").alias("observed_at"), (key % 7 + F.when(even, 130).otherwise(100)).cast("double").alias("unit_price"), F.lit("pcs").alias("unit_type"),
        F.lit(90).alias("confidence"), F.format_string("%012d", key).alias("line_item_id"),
    )
    products = load(spark, d, "customer").select(F.col("c_custkey").alias("product_id"), F.col("c_name").alias("canonical_name"))
    return shopping.auto_shopping_run(
        obs, products, _customer_state(spark, d), _customer_list(spark, d), AS_OF, MARKED_LOW_BAR, _aliases(spark, d)
    )


MARKED_LOW_BAR = Config(item_marker="[Auto]", restock_confidence=0.5)


def auto_shopping_run(spark, d):
    return _run(spark, d)["decisions"].select(
        "product_id", "action", "new_name", "old_name", "shopping_list_item_id", "store", "confidence"
    )


def auto_shopping_skipped(spark, d):
    return _run(spark, d)["skipped"]


def inventory_recently_seen(spark, d):
    products = load(spark, d, "customer").select(F.col("c_custkey").alias("product_id"), F.col("c_name").alias("canonical_name"))
    rows = inventory.inventory_recently_seen(products, tables.evidence_state(spark, d), EVENTS_AS_OF)
    return rows.select(
        "product_id", "product", day("last_seen_at"), day("expires_at"), "confidence"
    )


def inventory_by_day(spark, d):
    products = load(spark, d, "customer").select(F.col("c_custkey").alias("product_id"), F.col("c_name").alias("canonical_name"))
    seen = inventory.inventory_recently_seen(products, tables.evidence_state(spark, d), EVENTS_AS_OF)
    return inventory.inventory_day_rows(seen).select(F.col("day").cast("string").alias("day"), "n", "product_id", F.col("label").alias("item"))


def apply_inventory_evidence(spark, d):
    views = load(spark, d, "events").select(F.col("user_id").alias("product_id"), (F.col("value") / 500).alias("confidence"))
    rows = inventory.apply_inventory_evidence(views, tables.evidence_state(spark, d), EVENTS_AS_OF)
    return rows.select("product_id", F.round("last_seen_confidence", 6).alias("last_seen_confidence"), day("last_seen_at"), day("previous_seen_at"))


def detected_items(spark, d):
    events = load(spark, d, "events")
    number = F.get_json_object("props", "$.k")
    raw = (
        F.when(F.col("event_type") == "view", F.concat(F.lit('["Milk '), number, F.lit('", " "]')))
        .when(F.col("event_type") == "click", F.concat(F.lit('[{"label": "Egg '), number, F.lit('", "confidence": '), (F.col("value") / 100).cast("string"), F.lit("}]")))
        .when(F.col("event_type") == "error", F.lit("no json"))
        .otherwise(F.concat(F.lit('{"Rice '), number, F.lit('": true, "Tea": false}')))
    )
    images = events.select(F.col("event_id").alias("image_id"), raw.alias("raw_result"))
    return inventory.explode_detections(images).select("image_id", "label", F.round("confidence", 6).alias("confidence"))


def _activities(spark, d):
    return load(spark, d, "events").select(
        F.col("event_id").alias("activity_id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("kind"),
        F.repeat(F.concat(F.col("event_type"), F.lit(" happened ")), 14).alias("description"),
        F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "items": [1,2], "seen": [1,2,3], "note": "'),
                 F.repeat(F.lit("ab "), 50), F.lit('", "sub": {"a": 1, "b": [1]}}')).alias("payload"),
    )


def recent_activities(spark, d):
    rows = activities.recent_activities(_activities(spark, d), limit=activities.RECENT_ROWS)
    return rows.select(
        "activity_id", "kind", "description", *[F.element_at("payload", k).alias(k) for k in ("k", "seen", "note", "sub")],
        F.size("payload").cast("long").alias("n_keys"),
    )


def compact_payload(spark, d):
    rows = _activities(spark, d)
    compact = activities.compact_payload(F.col("payload"))
    return rows.select("activity_id", F.element_at(compact, "note").alias("note"), F.element_at(compact, "seen").alias("seen"))


def date_keys(spark, d):
    ts = F.col("o_orderdate")
    return load(spark, d, "orders").groupBy(
        F.date_format(iso_week(ts), "yyyy-MM-dd").alias("week"), month_key(ts).alias("month"),
        F.date_format(shift_month(ts, -11), "yyyy-MM-dd").alias("first_of_12"),
    ).agg(F.count(F.lit(1)).alias("n"))


def effective_status_rows(spark, d):
    rows = tables.receipts(spark, d)
    return rows.select("receipt_id", effective_status(F.col("extract_status"), F.col("file_path")).alias("status"),
                       category_key(F.col("receipt_category")).alias("category"))


def snapshot_result_sizes(spark, d):
    products = tables.products(spark, d)
    all_tables = {
        "receipts": tables.receipts(spark, d, True), "items": tables.items(spark, d),
        "observations": tables.observations(spark, d), "products": products,
        "product_state": load(spark, d, "part").select(F.col("p_name").alias("product_id")).distinct().select(
            "product_id", days_before(instant(AS_OF), 2).alias("last_seen_at"), F.lit(0.5).alias("last_seen_confidence")),
        "activities": _activities(spark, d),
    }
    return snapshot_sizes(snapshot(all_tables, AS_OF, settled=True))


QUERIES = {
    "spend_totals": spend_totals, "spend_week": spend_week, "spend_month": spend_month, "spend_year": spend_year,
    "spend_totals_by_tenant": spend_totals_by_tenant,
    "receipt_subcategory_totals": receipt_subcategory_totals,
    "spend_by_category_periods": spend_by_category_periods,
    "spend_by_subcategory_periods": spend_by_subcategory_periods,
    "spend_by_category_periods_by_tenant": spend_by_category_periods_by_tenant,
    "truncation_meta": truncation_meta, "category_pivot": category_pivot,
    "receipt_status_counts": receipt_status_counts, "receipt_status_summary": receipt_status_summary,
    "processing_timing": processing_timing, "recent_receipts": recent_receipts,
    "recent_receipts_by_tenant": recent_receipts_by_tenant, "dedupe_recent_receipts": dedupe_recent_receipts,
    "unknown_category": unknown_category, "is_unknown_subcategory": is_unknown_subcategory_rows,
    "unknown_subcategory_items": unknown_subcategory_items, "unknown_item_report": unknown_item_report,
    "price_baselines": price_baselines, "last_prices": last_prices, "overpaid_items": overpaid_items,
    "overpaid_items_by_tenant": overpaid_items_by_tenant, "top_price_increases": top_price_increases,
    "best_store_by_item": best_store_by_item, "purchase_gaps": purchase_gaps, "restock_levels": restock_levels,
    "restock_candidates": restock_candidates, "resolve_store_alias": resolve_store_alias, "store_prices": store_prices,
    "store_recommendation": store_recommendation, "plan_stores": plan_stores, "store_plan": store_plan,
    "reconcile_shopping_list": reconcile_shopping_list, "auto_shopping_run": auto_shopping_run,
    "auto_shopping_skipped": auto_shopping_skipped, "inventory_recently_seen": inventory_recently_seen,
    "inventory_by_day": inventory_by_day, "apply_inventory_evidence": apply_inventory_evidence,
    "detected_items": detected_items, "recent_activities": recent_activities, "compact_payload": compact_payload,
    "date_keys": date_keys, "effective_status": effective_status_rows, "snapshot": snapshot_result_sizes,
}
