"""Spend totals by week, month, year and trailing twelve months.

Receipts have ``receipt_id, purchased_at, total, receipt_category`` and the nested
``receipt_subcategories ARRAY<STRUCT<subcategory, total>>``; ``keys`` are optional tenant columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tillwise.functions.amounts import half_even
from tillwise.functions.categories import RESIDUAL_TOLERANCE, VICE_SUBCATEGORIES, category_key, key_of
from tillwise.functions.dates import instant, iso_week, month_key, shift_month
from tillwise.functions.text import bound
from tillwise.operators.stats import top_rows

CATEGORY_ROWS = 120
SUBCATEGORY_ROWS = 180
PERIODS = ("week", "month", "year", "month_12m")
DROP_POLICY = "period_priority(week,month,year,month_12m) then category then newest month_12m then total_desc"


def spend_totals(receipts: DataFrame, as_of, keys: Sequence[str] = ()) -> DataFrame:
    """One row (per tenant) with the spend of the week, month and calendar year of ``as_of``."""
    now = instant(as_of)
    ts, total = F.col("purchased_at"), F.col("total")
    # One range covers all three periods, so the scan skips everything older.
    low = F.least(F.date_trunc("year", now), iso_week(now))
    high = F.greatest(F.date_trunc("year", now) + F.expr("INTERVAL 12 MONTHS"), iso_week(now) + F.expr("INTERVAL 7 DAYS"))
    inside = receipts.where((ts >= low) & (ts < high))

    def part(unit: str) -> Column:
        same = F.date_trunc(unit, ts) == F.date_trunc(unit, now)
        return F.coalesce(F.sum(F.when(same, total)), F.lit(0.0)).alias(f"{unit}_total")

    return inside.groupBy(*keys).agg(part("week"), part("month"), part("year"))


def with_subcategory_totals(receipts: DataFrame, name: str = "subcategory_totals") -> DataFrame:
    """Adds the totals by subcategory as an array of (subcategory, total), worked out inside each row.

    Amounts of zero or less are dropped. What the rows leave of the receipt total goes to
    ``unclassified``; rows that exceed the total are kept as they are.
    """
    given = F.coalesce("receipt_subcategories", F.array().cast("array<struct<subcategory:string,total:double>>"))
    keyed = F.transform(given, lambda s: F.struct(key_of(s["subcategory"]).alias("subcategory"), s["total"].alias("total")))
    totals = bound(F.filter(keyed, lambda s: s["total"] > 0), lambda rows: bound(_with_rest(rows, F.col("total")), _summed))
    # A generated column: what is asked of it above is not answered by working it out again below.
    return receipts.withColumn(name, F.explode(F.array(totals)))


def _with_rest(rows: Column, total: Column) -> Column:
    """``rows`` and what they leave of ``total``, each under its name or ``unclassified``."""

    def rest(known: Column) -> Column:
        left = F.when((known <= 0) & (total > 0), total).when(total > known + RESIDUAL_TOLERANCE, total - known)
        return F.when(left.isNotNull(), F.array(F.struct(F.lit("unclassified").alias("subcategory"), left.alias("total")))).otherwise(
            F.array().cast("array<struct<subcategory:string,total:double>>"))

    known = F.aggregate(rows, F.lit(0.0), lambda acc, s: acc + s["total"])
    return F.transform(F.concat(rows, bound(known, rest)), lambda s: F.struct(
        F.when(s["subcategory"] == "", "unclassified").otherwise(s["subcategory"]).alias("subcategory"), s["total"].alias("total")))


def _summed(rows: Column) -> Column:
    """One row per name, in the order of their first rows."""

    def total_of(k: Column) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda acc, s: acc + F.when(s["subcategory"] == k, s["total"]).otherwise(0.0))

    def by_name(names: Column) -> Column:
        # Mostly no name comes twice; then there is nothing to add up.
        summed = F.transform(names, lambda k: F.struct(k.alias("subcategory"), total_of(k).alias("total")))
        return F.when(F.size(names) == F.size(rows), rows).otherwise(summed)

    return bound(F.array_distinct(rows["subcategory"]), by_name)


def receipt_subcategory_totals(receipts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Long form of :func:`with_subcategory_totals`: (receipt_id, subcategory, total)."""
    return with_subcategory_totals(receipts).select(*keys, "receipt_id", F.inline("subcategory_totals"))


def _in_reporting_range(as_of) -> Column:
    """Dated receipts with a total inside the week, year or trailing twelve months of ``as_of``."""
    now = instant(as_of)
    week, year = iso_week(now), F.date_trunc("year", now)
    low = F.least(week, year, shift_month(now, -11).cast("timestamp"))
    high = F.greatest(week + F.expr("INTERVAL 7 DAYS"), year + F.expr("INTERVAL 12 MONTHS"))
    ts = F.col("purchased_at")
    return F.col("total").isNotNull() & (ts >= low) & (ts < high)


def _with_periods(receipts: DataFrame, as_of, *columns: str) -> DataFrame:
    """One row per receipt and period it belongs to; columns ``period`` and ``month``."""
    now = instant(as_of)
    ts = F.col("purchased_at")
    first_month = shift_month(now, -11).cast("timestamp")
    next_month = shift_month(now, 1).cast("timestamp")
    week, year = iso_week(now), F.date_trunc("year", now)
    rows = receipts.where(_in_reporting_range(as_of))
    none = F.lit(None).cast("string")

    def period(name: str, inside: Column, month: Column = none) -> Column:
        return F.when(inside, F.struct(F.lit(name).alias("period"), month.alias("month")))

    periods = F.array(
        period("week", iso_week(ts) == week),
        period("month", F.date_trunc("month", ts) == F.date_trunc("month", now)),
        period("year", F.date_trunc("year", ts) == year),
        period("month_12m", (ts >= first_month) & (ts < next_month), month_key(ts)),
    )
    exploded = rows.select(*columns, F.explode(F.filter(periods, lambda p: p.isNotNull())).alias("_p"))
    return exploded.select("*", "_p.period", "_p.month").drop("_p")


def _period_order(*tail: Column) -> list[Column]:
    rank = F.array_position(F.array(*[F.lit(p) for p in PERIODS]), F.col("period"))
    return [rank, F.col("category"), F.col("month").desc(), F.col("total").desc(), *tail]


def _month_start() -> Column:
    return F.concat(F.col("month"), F.lit("-01")).alias("month_start")


def category_period_totals(receipts: DataFrame, as_of, keys: Sequence[str] = ()) -> DataFrame:
    """Uncapped spend rows by period and category."""
    rows = receipts.withColumn("category", category_key(F.col("receipt_category")))
    dated = _with_periods(rows, as_of, *keys, "category", "total")
    return dated.groupBy(*keys, "period", "category", "month").agg(
        F.sum("total").alias("total"), F.count(F.lit(1)).alias("receipt_count")
    )


def spend_by_category_periods(
    receipts: DataFrame, as_of, keys: Sequence[str] = (), limit: int | None = None, places: int = 2
) -> DataFrame:
    rows = category_period_totals(receipts, as_of, keys)
    return top_rows(rows, _period_order(), limit, keys).select(
        *keys, "period", "category", "month", _month_start(), half_even("total", places).alias("total"), "receipt_count"
    )


def subcategory_period_totals(receipts: DataFrame, as_of, keys: Sequence[str] = ()) -> DataFrame:
    """Uncapped spend rows by period, category and subcategory."""
    rows = receipts.withColumn("category", category_key(F.col("receipt_category")))
    # The totals of a receipt are worked out once, before it is repeated for its periods.
    rows = with_subcategory_totals(rows.where(_in_reporting_range(as_of)))
    dated = _with_periods(rows, as_of, *keys, "category", "subcategory_totals")
    split = dated.select(*keys, "period", "month", "category", F.inline("subcategory_totals"))
    return split.where("total > 0").groupBy(*keys, "period", "category", "subcategory", "month").agg(
        F.sum("total").alias("total"), F.count(F.lit(1)).alias("receipt_count")
    )


def spend_by_subcategory_periods(
    receipts: DataFrame, as_of, keys: Sequence[str] = (), limit: int | None = None, places: int = 2
) -> DataFrame:
    rows = subcategory_period_totals(receipts, as_of, keys)
    return top_rows(rows, _period_order(F.col("subcategory")), limit, keys).select(
        *keys, "period", "category", "subcategory", "month", _month_start(), half_even("total", places).alias("total"),
        "receipt_count", F.col("subcategory").isin(*VICE_SUBCATEGORIES).alias("is_vice"),
    )


def truncation_meta(rows: DataFrame, max_rows: int, keys: Sequence[str] = ()) -> DataFrame:
    """What a cap of ``max_rows`` does to ``rows``."""
    n = F.count(F.lit(1))
    kept = F.least(n, F.lit(int(max_rows)))
    return rows.groupBy(*keys).agg(
        (n > max_rows).alias("truncated"), F.lit(int(max_rows)).cast("long").alias("max_rows"),
        kept.cast("long").alias("returned_rows"), (n - kept).cast("long").alias("dropped_rows"),
        F.lit(DROP_POLICY).alias("drop_policy"),
    )


def category_pivot(period_rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Category rows with week, month and year columns from the rows of :func:`spend_by_category_periods`."""
    wide = period_rows.where(F.col("period").isin("week", "month", "year")).groupBy(*keys, "category")
    return wide.pivot("period", ["week", "month", "year"]).agg(F.sum("total")).fillna(0.0, ["week", "month", "year"])
