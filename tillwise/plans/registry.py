"""All registered queries and SQL twins."""

from tillwise.operators.spend import CATEGORY_ROWS
from tillwise.plans import oracle_analytics, oracle_data, queries_analytics, queries_data, queries_writes
from tillwise.plans.snapshot import MEASURES

QUERIES = {**queries_analytics.QUERIES, **queries_data.QUERIES, **queries_writes.QUERIES}
ORACLE = {**oracle_analytics.ORACLE, **oracle_data.ORACLE, **queries_writes.ORACLE}

#: The results of a refresh whose own query is registered under another name, has a limit, or none.
_OF_SNAPSHOT = {
    "recent_receipts": "SELECT * FROM orders", "recent_activities": "SELECT * FROM events", "inventory_recently_seen": "SELECT DISTINCT p_name FROM part",
    "unknown_category_receipts": ORACLE["unknown_category"], "subcategory_meta": ORACLE["truncation_meta"],
    "category_meta": f"SELECT least(count(*), {CATEGORY_ROWS}) AS returned_rows FROM ({ORACLE['spend_by_category_periods']})",
}
_RESULTS = (
    "best_store_by_item", "category_meta", "inventory_recently_seen", "overpaid_items", "processing_timing", "receipt_status_counts", "recent_activities",
    "recent_receipts", "spend_by_category_periods", "spend_by_subcategory_periods", "spend_totals", "subcategory_meta", "top_price_increases",
    "unknown_category_receipts", "unknown_subcategory_items",
)
#: The whole refresh: the twins of its results, each counted and measured.
ORACLE["snapshot"] = "\nUNION ALL ".join(
    f"SELECT '{name}' AS result, count(*) AS row_count, {f'CAST(sum({MEASURES[name]}) AS BIGINT)' if name in MEASURES else 'CAST(NULL AS BIGINT)'} AS measured "
    f"FROM ({_OF_SNAPSHOT.get(name) or ORACLE[name]}) AS t" for name in _RESULTS
)
