"""Write paths: alias, store, category and items of added, updated and re-read receipts; the change feed; tenants."""

from datetime import datetime

from pyspark.sql import functions as F
from test_maintain_activities import receipts

from tillwise import schema
from tillwise.operators import maintain, products, stores, writes

AT = "2024-02-01 00:00:00"
UPDATE = "receipt_id string, fields array<string>, store_name string, purchased_at string, total double, currency string, receipt_category string, " \
         "receipt_subcategories array<struct<subcategory:string,total:double>>, line_items_raw array<struct<raw_name:string,line_total:double,qty_raw:string,unit_price_raw:double>>, clear_line_items boolean"
ADD = "receipt_id string, total double, date string, store string, receipt_category string, raw_text string, receipt_subcategories array<struct<subcategory:string,total:double>>, " \
      "line_items_raw array<struct<raw_name:string,line_total:double,qty_raw:string,unit_price_raw:double>>"


def known_stores(spark):
    rows = [("s1", "Corner Market", None, "Street 1", "11111", "City", "556677", None, None, ["Corner Market"], datetime(2020, 1, 1), datetime(2020, 1, 1))]
    return spark.createDataFrame(rows, schema.STORES)


def aliases(spark, *rows):
    return spark.createDataFrame(list(rows), schema.STORE_ALIASES)


def test_update_goes_through_alias_and_store(spark):
    base = dict(total=10.0, store_name="Old", receipt_category="grocery", receipt_category_source="auto", purchased_at=datetime(2024, 1, 1), line_items_raw=[("Milk", 2.0, None, None)])
    table = receipts(spark, dict(base, receipt_id="a"), dict(base, receipt_id="b", merchant_hints=("55-6677", None, None, None, None, None, None)), dict(base, receipt_id="c"), dict(base, receipt_id="d"))
    row = lambda i, name, date=None, fields=("store_name",): (i, list(fields), name, date, None, None, None, None, None, None)
    updates = spark.createDataFrame([
        row("a", "the corner"), row("b", "Misread name"), row("c", "Pizza Palace"), row("d", "Never Made", "soon", ("store_name", "purchased_at")), row("zz", "Not Stored")], UPDATE)
    out = writes.update_receipts(table, updates, known_stores(spark), aliases(spark, ("the corner", "Corner Market")), AT)
    got = {r.receipt_id: r for r in out["receipts"].collect()}
    assert (got["a"].store_name, got["a"].store_entity_id) == ("Corner Market", "s1") == (got["b"].store_name, got["b"].store_entity_id)
    assert got["c"].store_name == "Pizza Palace" and got["c"].receipt_category == "dining" and got["c"].store_entity_id not in (None, "s1")
    assert got["d"].store_name == "Old" and got["d"].store_entity_id is None
    made = {r.chain_name: r for r in out["stores"].collect()}
    assert set(made) == {"Corner Market", "Pizza Palace"} and made["Pizza Palace"].store_entity_id == got["c"].store_entity_id
    feed = {r.receipt_id: r for r in out["changes"].collect()}
    assert set(feed) == {"a", "b", "c"} and all(r.kind == "update" and r.reprocess for r in feed.values())
    assert feed["a"].fields == ["store_name", "store_entity_id", "receipt_subcategories"]
    assert feed["c"].fields == ["store_name", "store_entity_id", "receipt_category", "receipt_subcategories"] and feed["c"].before.store_name == "Old"
    assert {(r.key, r.canonical) for r in out["store_aliases"].collect()} == {("the corner", "Corner Market"), ("old", "Pizza Palace")}


def test_add_and_apply(spark):
    rows = [("n1", 9.0, "2024-01-02", "the corner", None, None, None, [("Milk", 2.0, None, None)]), ("n2", 5.0, None, None, None, None, None, None), ("n3", None, None, "X", None, None, None, None)]
    stored = receipts(spark, dict(receipt_id="a", total=1.0))
    out = writes.add_receipts(stored, spark.createDataFrame(rows, ADD), known_stores(spark), aliases(spark, ("the corner", "Corner Market")), AT)
    got = {r.receipt_id: r for r in out["receipts"].collect()}
    assert set(got) == {"a", "n1", "n2"} and (got["n1"].store_name, got["n1"].store_entity_id) == ("Corner Market", "s1") and got["n2"].store_entity_id is None
    feed = {r.receipt_id: (r.kind, r.reprocess) for r in out["changes"].collect()}
    assert feed == {"n1": ("insert", True), "n2": ("insert", False)}
    assert [r.receipt_id for r in out["rejects"].collect()] == ["n3"]
    after = writes.apply_changes(stored, out["receipts"], out["changes"])
    assert {r.receipt_id for r in after.collect()} == {"a", "n1", "n2"}
    feed = writes.change_feed(stored, stored.where("false"))
    assert [(r.receipt_id, r.kind) for r in feed.collect()] == [("a", "delete")] and writes.apply_changes(stored, stored, feed).count() == 0
    assert writes.change_feed(stored, stored).count() == 0


def test_queue(spark):
    table = receipts(spark, dict(receipt_id="a", extract_status="pending", file_path="/in/a"), dict(receipt_id="b", extract_status="failed"), dict(receipt_id="c", extract_status="done", file_path="/in/c"), dict(receipt_id="d"))
    state = lambda rows: {r.receipt_id: (r.extract_status, str(r.extract_queued_at)) for r in rows.collect()}
    assert state(maintain.queue_extraction(table, AT)) == {"a": ("queued", AT), "b": ("failed", "None"), "c": ("done", "None"), "d": (None, "None")}
    ids = spark.createDataFrame([("b",), ("b",), ("c",)], "receipt_id string")
    assert state(maintain.queue_extraction(table, AT, ids)) == {"a": ("pending", "None"), "b": ("queued", AT), "c": ("done", "None"), "d": (None, "None")}


def test_tenants_stay_apart(spark):
    """The same names of two tenants give products and stores of their own."""
    items = spark.createDataFrame([("x", "Whole milk", 1), ("x", "Whole milks", 2), ("y", "Whole milks", 3), ("y", "Whole milk", 4), ("y", "!!!", 5)], "tenant string, raw_name string, arrival long")
    matched, names = products.match_products(items, keys=["tenant"])
    got = {(r.tenant, r.raw_name): r.product_id for r in matched.collect()}
    assert got["x", "Whole milk"] == got["x", "Whole milks"] != got["y", "Whole milks"] == got["y", "Whole milk"] and len(set(got.values())) == 3
    assert {(r.tenant, r.canonical_name) for r in products.new_products(names, AT, ["tenant"]).collect()} >= {("x", "Whole milk"), ("y", "Whole milks")}
    hints = spark.createDataFrame([("x", "r1", "New Shop"), ("y", "r2", "New Shop")], "tenant string, receipt_id string, chain_name string")
    hints = hints.withColumns({c: F.lit(None).cast("string") for c in ("branch_name", *stores.HINT_FIELDS)})
    none = known_stores(spark).where("false").withColumn("tenant", F.lit("x"))
    ids = [r.store_entity_id for r in stores.new_stores(stores.match_stores(hints, none, ["tenant"]), AT, ["tenant"]).collect()]
    assert len(ids) == len(set(ids)) == 2


def test_pairs_with_too_few_common_characters_are_left_out(spark):
    """The bound never leaves out a pair that reaches the ratio."""
    from difflib import SequenceMatcher

    import numpy as np

    rng = np.random.default_rng(1)
    pairs = [("".join(rng.choice(list("abc 1"), rng.integers(1, 12))), "".join(rng.choice(list("abc 1"), rng.integers(1, 12)))) for _ in range(600)]
    df = spark.createDataFrame(pairs, "a string, b string")
    kept = df.select("a", "b", products.may_be_similar(products._elements(F.col("a")), products._elements(F.col("b"))).alias("ok")).collect()
    assert all(r.ok for r in kept if SequenceMatcher(None, r.a, r.b).ratio() >= 0.75) and not all(r.ok for r in kept)


def test_equal_events_keep_their_own_ids(spark):
    from tillwise.operators.activities import emit_activity

    rows = spark.createDataFrame([("x", 1, 5), ("x", 2, 5), ("y", 1, 5)], "tenant string, nr int, n int")
    emit = lambda: [r.activity_id for r in emit_activity(rows, "receipt_added", F.lit("Added"), ["n"], AT, ["tenant"], ["nr"]).collect()]
    assert len(set(emit())) == 3 and emit() == emit()
