"""Receipt lists, classification gaps and processing statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tillwise.functions.amounts import half_even
from tillwise.functions.categories import (
    UNKNOWN_SUBCATEGORIES, category_key, effective_status, failure_class, is_unknown_category, is_unknown_subcategory, shortened,
)
from tillwise.functions.dates import instant
from tillwise.functions.text import blank_to_null
from tillwise.operators.spend import with_subcategory_totals
from tillwise.operators.stats import exact_medians, nearest_rank, top_rows
from tillwise.session import settle

RECENT_ROWS = 20
DEDUPED_ROWS = 15
TIMING_WINDOW = 200
LIST_COLUMNS = (
    "receipt_id", "purchased_at", "store_name", "total", "filename", "receipt_category", "receipt_category_source",
)
FLAGGED_COLUMNS = ("receipt_id", "purchased_at", "store_name", "total", "receipt_category", "receipt_subcategories")


def recent_receipts(receipts: DataFrame, keys: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    dated = receipts.where(F.col("purchased_at").isNotNull()).select(*keys, *LIST_COLUMNS)
    return top_rows(dated, [F.col("purchased_at").desc(), F.col("receipt_id")], limit, keys)


def dedupe_recent_receipts(receipts: DataFrame, keys: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Recent receipts once per local day, store and total."""
    recent = recent_receipts(receipts, keys)
    same = [
        *keys, F.to_date("purchased_at"), F.coalesce("store_name", F.lit("")),
        F.format_number(F.coalesce("total", F.lit(0.0)), 2),
    ]
    order = [F.col("purchased_at").desc(), F.col("receipt_id")]
    first = recent.withColumn("_n", F.row_number().over(Window.partitionBy(*same).orderBy(*order))).where("_n = 1")
    return top_rows(first.drop("_n"), order, limit, keys)


def unknown_category_receipts(
    receipts: DataFrame, keys: Sequence[str] = (), limit: int | None = None
) -> DataFrame:
    """Receipts without a usable category, newest first, undated last."""
    rows = receipts.where(is_unknown_category(F.col("receipt_category"))).select(*keys, *LIST_COLUMNS)
    newest = [F.col("purchased_at").desc_nulls_last(), F.col("receipt_id")]
    return top_rows(rows, newest, limit, keys).withColumn("total", half_even("total", 2))


def _unknown_sum(totals):
    return F.aggregate(
        totals, F.lit(0.0),
        lambda acc, s: acc + F.when(is_unknown_subcategory(s["subcategory"]), s["total"]).otherwise(0.0),
    )


def unknown_subcategory_items(
    receipts: DataFrame, items: DataFrame, keys: Sequence[str] = (), limit: int | None = None
) -> DataFrame:
    """Item names of receipts with unknown spend; receipts without items give one row per store.

    ``items`` has ``receipt_id, pos, raw_name, line_total``.
    """
    # The names of the totals are keys already; which are unknown is asked once for each.
    unknown = F.filter("_totals", lambda s: s["subcategory"].isin(*UNKNOWN_SUBCATEGORIES))
    flagged = (
        with_subcategory_totals(receipts.select(*keys, *FLAGGED_COLUMNS), "_totals")
        .withColumn("_rows", F.explode(F.array(unknown))).where(F.size("_rows") > 0)
        .select(
            *keys, "receipt_id", "purchased_at", category_key(F.col("receipt_category")).alias("_category"),
            F.coalesce(F.nullif("store_name", F.lit("")), F.lit("Unknown")).alias("_store"),
            F.aggregate("_rows", F.lit(0.0), lambda acc, s: acc + s["total"]).alias("_unknown"),
        )
    )
    # Read twice below, and costly to derive where the subcategories come from a join.
    flagged = settle(flagged)
    # An inner join, so that the items of one huge receipt can be split over tasks; receipts without items are
    # found separately by their ids alone.
    lines = items.select(*keys, "receipt_id", "pos", "raw_name", F.coalesce("line_total", F.lit(0.0)).alias("_a"))
    with_items = lines.join(flagged, [*keys, "receipt_id"]).withColumn("_name", blank_to_null(F.col("raw_name")))
    bare = flagged.join(items.select(*keys, "receipt_id").distinct(), [*keys, "receipt_id"], "left_anti").withColumn(
        "_name", F.concat(F.lit("[No line items] "), F.col("_store"))
    ).withColumn("pos", F.lit(0)).withColumn("_a", F.col("_unknown"))
    columns = [*keys, "receipt_id", "pos", "purchased_at", "_category", "_store", "_name", "_a"]
    named = with_items.select(*columns).unionByName(bare.select(*columns)).where("_name is not null").withColumn(
        "_amount", F.greatest("_a", F.lit(0.0))
    )
    seen = ["receipt_id", "pos"]
    rows = named.groupBy(*keys, F.lower("_name").alias("_key")).agg(
        F.sum("_amount").alias("total"), F.count(F.lit(1)).alias("count"),
        F.min(F.struct(*seen, F.col("_name").alias("name"), F.col("_category").alias("category"), F.col("_store").alias("store"))).alias("_f"),
        F.min(F.when(F.col("purchased_at").isNotNull(), F.struct(*seen, "purchased_at"))).alias("_d"),
    )
    rows = rows.withColumn("total", half_even("total", 2)).withColumn("item", F.col("_f.name"))
    order = [F.col("total").desc(), F.col("count").desc(), F.col("item"), F.col("_key")]
    return top_rows(rows, order, limit, keys).select(
        *keys, "item", "total", "count", F.col("_f.category").alias("category"),
        F.col("_f.store").alias("sample_store_name"), F.col("_f.receipt_id").alias("sample_receipt_id"),
        F.col("_d.purchased_at").alias("sample_purchased_at"),
    )


def unknown_item_report(
    receipts: DataFrame, items: DataFrame, currency: str = "kr", keys: Sequence[str] = ()
) -> DataFrame:
    """Formatted item lines of receipts with unknown spend: (receipt_id, line_no, line)."""
    flagged = receipts.where(_unknown_sum(F.coalesce("receipt_subcategories", F.array().cast(
        "array<struct<subcategory:string,total:double>>"))) > 0).select(*keys, "receipt_id")
    joined = items.select(*keys, "receipt_id", "pos", "raw_name", "line_total", "qty_raw").join(flagged, [*keys, "receipt_id"])
    bare = flagged.join(items.select(*keys, "receipt_id").distinct(), [*keys, "receipt_id"], "left_anti")
    amount = F.when(
        F.col("line_total").isNotNull(), F.concat(F.format_string("%.2f", "line_total"), F.lit(f" {currency}".rstrip()))
    )
    qty = F.when(blank_to_null(F.col("qty_raw")).isNotNull(), F.concat(F.lit("qty "), blank_to_null(F.col("qty_raw"))))
    text = F.concat(
        F.lit("- "),
        F.concat_ws(" | ", F.coalesce(blank_to_null(F.col("raw_name")), F.lit("Unknown item")), qty, amount),
    )
    listed = joined.select(*keys, "receipt_id", F.col("pos").cast("long").alias("line_no"), text.alias("line"))
    none = F.lit("- No line items extracted for this receipt.")
    return listed.unionByName(bare.select(*keys, "receipt_id", F.lit(0).cast("long").alias("line_no"), none.alias("line")))


def receipt_status_counts(receipts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    status = effective_status(F.col("extract_status"), F.col("file_path"))
    return receipts.groupBy(*keys, status.alias("status")).agg(F.count(F.lit(1)).alias("count"))


def receipt_status_summary(receipts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals of all, unfinished and failed receipts."""
    status = effective_status(F.col("extract_status"), F.col("file_path"))

    def count_of(*names: str):
        return F.count(F.when(status.isin(*names), 1))

    return receipts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_receipts"),
        count_of("pending", "queued", "running").alias("in_progress"),
        count_of("failed").alias("failed"),
    )


def failure_reasons(errors: DataFrame, raw: str = "error", keys: Sequence[str] = ()) -> DataFrame:
    """Errors by class: the whole text is the group, only its label ``reason`` is shortened."""
    grouped = errors.groupBy(*keys, failure_class(F.col(raw)).alias("_class")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(*keys, shortened(F.col("_class")).alias("reason"), "n")


def processing_timing(
    receipts: DataFrame, as_of, keys: Sequence[str] = (), window_n: int | None = None, model_method: str = "llm",
    places: int = 2,
) -> DataFrame:
    """Seconds per extraction over all runs, or the newest ``window_n``: overall, by method, and by provider of model runs.

    Each row also has ``window_n`` and ``considered``, the number of runs that it and the others look at.
    """
    ts = F.coalesce("extract_finished_at", "created_at", instant(as_of))
    done = receipts.where((F.col("extract_status") == "done") & (F.col("extract_duration_ms") > 0)).select(
        *keys, "receipt_id", ts.alias("_ts"), (F.col("extract_duration_ms") / 1000.0).alias("seconds"),
        F.lower(F.coalesce(F.nullif("extract_method", F.lit("")), F.lit("unknown"))).alias("method"),
        F.lower(F.coalesce(F.nullif("extract_provider", F.lit("")), F.lit("unknown"))).alias("provider"),
    )
    window = top_rows(done, [F.col("_ts").desc(), F.col("receipt_id")], window_n, keys)
    groups = F.array(
        F.struct(F.lit("overall").alias("group_kind"), F.lit("all").alias("group_value")),
        F.struct(F.lit("method").alias("group_kind"), F.col("method").alias("group_value")),
        F.when(
            F.col("method") == model_method,
            F.struct(F.lit("provider").alias("group_kind"), F.col("provider").alias("group_value")),
        ),
    )
    # One struct holds the group, so that a null in a key is a group like any other.
    exploded = window.select(*keys, "seconds", F.explode(F.filter(groups, lambda g: g.isNotNull())).alias("g")).select(
        F.struct(*keys, "g.group_kind", "g.group_value").alias("_group"), "seconds"
    )
    means = exploded.groupBy("_group").agg(F.avg("seconds").alias("mean"))
    ranked = exact_medians(exploded, ["_group"], "seconds", extra={"p95": nearest_rank(0.95)})
    rows = ranked.join(means, "_group").select(
        "_group.*", F.col("n").alias("count"), half_even("mean", places).alias("avg_s"),
        half_even("median", places).alias("median_s"), half_even("p95", places).alias("p95_s"),
    )
    # A handful of rows per tenant: the overall one knows how many runs there were.
    considered = F.max(F.when(F.col("group_kind") == "overall", F.col("count"))).over(Window.partitionBy(*keys))
    return rows.withColumn("window_n", F.lit(window_n).cast("long")).withColumn("considered", considered)
