from pyspark.sql import functions as F

from tillwise.operators import inventory, quality, spend

DDL = "receipt_id long, purchased_at string, total double, receipt_category string, subs string"


def receipts(spark, rows):
    df = spark.createDataFrame(rows, DDL).withColumn("purchased_at", F.col("purchased_at").cast("timestamp"))
    return df.withColumn("receipt_subcategories", F.from_json("subs", "array<struct<subcategory:string,total:double>>")).withColumn(
        "store_name", F.lit("S")).withColumn("filename", F.lit("f")).withColumn("receipt_category_source", F.lit("auto"))


def subs(*pairs):
    return "[" + ",".join(f'{{"subcategory":"{n}","total":{t}}}' for n, t in pairs) + "]"


def test_subcategory_totals(spark):
    rows = [
        (1, None, 100.0, "", subs(("dairy", 30), ("Dairy", 20), ("pantry", -5))), (2, None, 10.0, "", None),
        (3, None, 10.0, "", subs(("eggs", 9.995))), (4, None, 10.0, "", subs(("eggs", 12))), (5, None, -3.0, "", None),
        (6, None, None, "", subs(("eggs", 1))), (7, None, 10.0, "", subs(("", 4))),
    ]
    got = {(r[0], r[1]): round(r[2], 6) for r in spend.receipt_subcategory_totals(receipts(spark, rows)).collect()}
    assert got == {(1, "dairy"): 50, (1, "unclassified"): 50, (2, "unclassified"): 10, (3, "eggs"): 9.995, (4, "eggs"): 12, (6, "eggs"): 1, (7, "unclassified"): 10}


def test_iso_week_over_new_year(spark):
    rows = [(1, "2024-12-29", 5.0, "", None), (2, "2025-01-01", 7.0, "", None), (3, "2024-12-31", None, "", None)]
    got = spend.spend_totals(receipts(spark, rows), "2024-12-30 10:00:00").first()
    assert (got.week_total, got.month_total, got.year_total) == (7.0, 5.0, 5.0)


def test_trailing_twelve_months(spark):
    rows = [(1, "2023-04-01", 1.0, "a", None), (2, "2023-03-31", 2.0, "a", None)]
    got = spend.spend_by_category_periods(receipts(spark, rows), "2024-03-15").collect()
    assert [(r.period, r.month, r.total) for r in got] == [("month_12m", "2023-04", 1.0)]


def test_category_sums_equal_totals(spark, sf_dir):
    from tillwise.plans import driver_tables as t

    rows = t.receipts(spark, sf_dir)
    totals = spend.spend_totals(rows, t.AS_OF).first()
    sums = {r[0]: r[1] for r in spend.category_period_totals(rows, t.AS_OF).groupBy("period").sum("total").collect()}
    for name in ("week", "month", "year"):
        assert abs(sums[name] - totals[f"{name}_total"]) < 1e-4


def test_subcategories_cover_the_total(spark, sf_dir):
    from tillwise.plans import driver_tables as t

    rows = t.receipts(spark, sf_dir, True)
    known = spend.receipt_subcategory_totals(rows).groupBy("receipt_id").agg(F.sum("total").alias("s"))
    assert rows.join(known, "receipt_id", "left").where("total > 0 and (s is null or s < total - 0.0091)").count() == 0


def test_tenants_do_not_mix(spark):
    rows = receipts(spark, [(i, "2024-03-01", 1.0, f"c{i}", None) for i in range(6)]).withColumn("tenant", F.col("receipt_id") % 2)
    got = spend.spend_by_category_periods(rows, "2024-03-15", ["tenant"], limit=2).groupBy("tenant").count().collect()
    assert sorted((r[0], r[1]) for r in got) == [(0, 2), (1, 2)]


def test_unknown_items_and_synthetic_rows(spark):
    rows = receipts(spark, [(1, "2024-03-01", 10.0, "grocery", None), (2, None, 4.0, "", None), (3, "2024-03-02", 5.0, "", subs(("dairy", 5)))])
    items = spark.createDataFrame([(1, 0, "Milk", 3.0), (1, 1, "MILK", -1.0), (3, 0, "Bread", 5.0), (1, 2, " ", 1.0)], "receipt_id long, pos int, raw_name string, line_total double")
    got = quality.unknown_subcategory_items(rows, items).collect()
    assert [(r.item, r.total, r["count"]) for r in got] == [("[No line items] S", 4.0, 1), ("Milk", 3.0, 2)]


def test_meta_and_pivot(spark):
    rows = receipts(spark, [(1, "2024-03-14", 10.0, "a", None), (2, "2024-02-01", 4.0, "b", None)])
    periods = spend.spend_by_category_periods(rows, "2024-03-15")
    meta = spend.truncation_meta(periods, 3).first()
    assert (meta.truncated, meta.returned_rows, meta.dropped_rows) == (True, 3, 3)
    wide = {r.category: (r.week, r.month, r.year) for r in spend.category_pivot(periods).collect()}
    assert wide == {"a": (10.0, 10.0, 10.0), "b": (0.0, 0.0, 4.0)}


def test_timing_and_days_are_not_capped(spark):
    runs = spark.range(1000).select(
        F.col("id").alias("receipt_id"), F.when(F.col("id") < 600, "t").alias("tenant"), F.lit("done").alias("extract_status"),
        F.timestamp_seconds("id").alias("created_at"), F.lit(None).cast("timestamp").alias("extract_finished_at"),
        ((F.col("id") + 1) * 1000).alias("extract_duration_ms"), F.lit("ocr").alias("extract_method"), F.lit(None).cast("string").alias("extract_provider"),
    )
    got = [tuple(r) for r in quality.processing_timing(runs, "2024-01-01").collect()]
    assert sorted(got) == [("method", "ocr", 1000, 500.5, 500.5, 950.0, None, 1000), ("overall", "all", 1000, 500.5, 500.5, 950.0, None, 1000)]
    got = [tuple(r) for r in quality.processing_timing(runs, "2024-01-01", ["tenant"]).where("group_kind = 'overall'").collect()]
    assert sorted(got, key=repr) == [("t", "overall", "all", 600, 300.5, 300.5, 570.0, None, 600), (None, "overall", "all", 400, 800.5, 800.5, 980.0, None, 400)]
    assert quality.processing_timing(runs, "2024-01-01", window_n=200).where("group_kind = 'overall'").first()["count"] == 200
    seen = spark.range(120).select(
        F.col("id").alias("product_id"), F.lit("p").alias("product"), F.timestamp_seconds("id").alias("last_seen_at"), F.lit(0.5).alias("confidence"))
    assert [(r.n, len(r["items"])) for r in inventory.inventory_by_day(seen).collect()] == [(120, 120)]
    assert [r.n for r in inventory.inventory_by_day(seen, limit=50).collect()] == [50]


def test_long_errors_with_one_beginning_are_two_reasons(spark):
    same = "x" * 230
    errors = spark.createDataFrame([(same + "a",), (same + "a",), (same + "b",), ("Timeout",), (None,)], "error string")
    got = sorted(tuple(r) for r in quality.failure_reasons(errors).collect())
    assert got == [("parse_failed", 1), ("timed_out", 1), ("x" * 220 + "...", 1), ("x" * 220 + "...", 2)]


def test_subcategory_totals_are_worked_out_once(spark, sf_dir):
    """One row per subcategory, and a filter on the totals, must not repeat the sums below."""
    from tillwise.plans.queries_analytics import receipt_subcategory_totals

    plan = receipt_subcategory_totals(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(coalesce(") == 1
    some = spend.with_subcategory_totals(receipts(spark, [(1, None, 9.0, "", None)])).where(F.exists("subcategory_totals", lambda s: s["total"] > 3))
    assert some._jdf.queryExecution().optimizedPlan().toString().count("lower(coalesce(") == 1
    assert some.count() == 1


def test_unknown_items_ask_once_for_each_name(spark):
    """Names of totals are keys already: they are not made keys again to tell the unknown ones."""
    rows = receipts(spark, [(1, "2024-03-01", 10.0, "grocery", subs((" Other ", 4), ("DAIRY", 2), ("other", 1), ("-", 3)))])
    asked = []
    settle, quality.settle = quality.settle, lambda df: asked.append(df) or settle(df)
    try:
        items = spark.createDataFrame([], "receipt_id long, pos int, raw_name string, line_total double")
        got = quality.unknown_subcategory_items(rows, items).collect()
    finally:
        quality.settle = settle
    assert [(r.item, r.total, r["count"]) for r in got] == [("[No line items] S", 5.0, 1)]
    plan = asked[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 3  # one for the subcategories, two for the category; more when the names are made keys again


def test_totals_of_repeated_and_single_names(spark):
    rows = receipts(spark, [(1, None, 9.0, "", subs(("a", 1), ("A ", 2), ("b", 3))), (2, None, 6.0, "", subs(("b", 4), ("a", 2)))])
    got = {r[0]: [tuple(s) for s in r[1]] for r in spend.with_subcategory_totals(rows, "t").select("receipt_id", "t").collect()}
    assert got == {1: [("a", 3.0), ("b", 3.0), ("unclassified", 3.0)], 2: [("b", 4.0), ("a", 2.0)]}
