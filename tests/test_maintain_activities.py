from datetime import datetime

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tillwise import schema
from tillwise.config import Config
from tillwise.operators import activities, inventory, maintain, shopping

D = datetime


def receipts(spark, *rows):
    names = [f.name for f in spark.createDataFrame([], schema.RECEIPTS).schema]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema.RECEIPTS)


def test_semantic_duplicates_merge(spark):
    base = dict(total=10.0, purchased_at=D(2024, 1, 1, 9), store_name="ICA  Maxi", source_type="telegram")
    item = ("Milk", 1.0, None, None)
    table = receipts(
        spark, dict(base, receipt_id="a", filename="a.pdf", created_at=D(2024, 1, 2), line_items_raw=[item]),
        dict(base, receipt_id="b", filename="b.jpg", created_at=D(2024, 1, 3), currency="kr", line_items_raw=[item, item]),
        dict(base, receipt_id="c", filename="c.pdf", created_at=D(2024, 1, 4)),
        dict(base, receipt_id="d", filename="d.jpg", created_at=D(2024, 1, 4), source_type="mail"),
    )
    twins = maintain.semantic_duplicates(table)
    assert [(r.receipt_id, r.kept_receipt_id) for r in twins.collect()] == [("b", "a")]
    merged = {r.receipt_id: r for r in maintain.merge_semantic_duplicates(table, twins).collect()}
    assert set(merged) == {"a", "c", "d"}
    assert merged["a"].currency == "kr" and len(merged["a"].line_items_raw) == 2


def test_semantic_duplicates_stay_inside_their_key(spark):
    base = dict(total=10.0, purchased_at=D(2024, 1, 1, 9), store_name="ICA", source_type="telegram")
    rows = [dict(base, receipt_id=i, currency=k, filename=f, created_at=D(2024, 1, n)) for n, (k, i, f) in enumerate(
        [("a", "1", "1.pdf"), ("b", "1", "1.pdf"), ("a", "2", "2.jpg"), ("b", "3", "3.jpg")], 1)]
    table = receipts(spark, *rows).withColumn("tenant", F.col("currency")).withColumn("ocr_text", F.when(F.col("filename").endswith("jpg"), F.col("receipt_id")))
    twins = maintain.semantic_duplicates(table, keys=["tenant"])
    assert sorted((r.tenant, r.receipt_id, r.kept_receipt_id) for r in twins.collect()) == [("a", "2", "1"), ("b", "3", "1")]
    merged = maintain.merge_semantic_duplicates(table, twins, ["tenant"])
    assert sorted((r.tenant, r.receipt_id, r.ocr_text) for r in merged.collect()) == [("a", "1", "2"), ("b", "1", "3")]


def test_orders_that_look_alike_merge_their_own_photos(spark, sf_dir, tmp_path):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderpriority = '1-URGENT'").limit(20)
    copies = orders.unionByName(orders.withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000))
    copies.write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("lineitem", "part"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    rows = entry.queries()["merge_semantic_duplicates"](spark, str(tmp_path)).collect()
    assert len(rows) == 40 and {(r.ocr_text, r.n_items) for r in rows} == {("read from photo", 2)}


def test_updates(spark):
    table = receipts(spark, dict(receipt_id="a", total=10.0, store_name="Old", receipt_category="grocery", receipt_category_source="auto", purchased_at=D(2024, 1, 1)),
                     dict(receipt_id="b", total=10.0))
    ddl = "receipt_id string, fields array<string>, store_name string, purchased_at string, total double, currency string, receipt_category string, " \
          "receipt_subcategories array<struct<subcategory:string,total:double>>, line_items_raw array<struct<raw_name:string,line_total:double,qty_raw:string,unit_price_raw:double>>, clear_line_items boolean"
    rows = [("a", ["store_name", "receipt_category", "purchased_at", "receipt_subcategories"], "WILLY:S", "", None, None, "dining", [("bar pub", 4.0)], None, None),
            ("b", ["total", "receipt_category"], None, None, 3.0, None, "nonsense", None, None, None)]
    after, fixes = maintain.apply_receipt_updates(table, spark.createDataFrame(rows, ddl))
    got = {r.receipt_id: r for r in after.collect()}
    assert (got["a"].store_name, got["a"].purchased_at, got["a"].receipt_category, got["a"].receipt_category_source) == ("Willys", None, "dining", "manual")
    assert [(s.subcategory, s.total) for s in got["a"].receipt_subcategories] == [("bar_pub", 4.0)]
    assert got["b"].total == 10.0
    assert [(r.old_name, r.new_name) for r in fixes.collect()] == [("Old", "Willys")]


def test_update_of_subcategories_only(spark):
    table = receipts(spark, dict(receipt_id="a", total=10.0, receipt_category="grocery", receipt_category_source="manual"))
    rows = [("a", ["receipt_subcategories"], None, None, None, None, None, [("dairy", 4.0)], None, None)]
    ddl = "receipt_id string, fields array<string>, store_name string, purchased_at string, total double, currency string, receipt_category string, " \
          "receipt_subcategories array<struct<subcategory:string,total:double>>, line_items_raw array<struct<raw_name:string,line_total:double,qty_raw:string,unit_price_raw:double>>, clear_line_items boolean"
    after, _ = maintain.apply_receipt_updates(table, spark.createDataFrame(rows, ddl))
    assert [(s.subcategory, s.total) for s in after.first().receipt_subcategories] == [("dairy", 4.0)]


def test_stuck_and_failed(spark):
    table = receipts(spark, dict(receipt_id="a", extract_status="running", extract_started_at=D(2024, 1, 1)), dict(receipt_id="b", extract_status="queued", created_at=D(2024, 1, 1)),
                     dict(receipt_id="c", extract_status="done"))
    assert {r.receipt_id for r in maintain.stuck_receipts(table, "2024-01-01 01:00:00", 60).collect()} == {"a"}
    assert {r.receipt_id for r in maintain.stuck_receipts(table, "2024-01-01 01:00:00", 60, True).collect()} == {"a", "b"}
    reset = {r.receipt_id: (r.extract_status, r.extract_started_at) for r in maintain.reset_stuck_receipts(table, "2024-01-01 01:00:00", 60).collect()}
    assert reset == {"a": ("queued", None), "b": ("queued", None), "c": ("done", None)}
    failed = {r.receipt_id: (r.extract_status, r.extract_attempts, r.extract_duration_ms) for r in
              maintain.mark_extract_failed(table, spark.createDataFrame([("a",), ("b",)], "receipt_id string"), "2024-01-01 00:00:02").collect()}
    assert failed == {"a": ("failed", 1, 2000), "b": ("failed", 1, None), "c": ("done", 0, None)}


LIST = "id string, name string, complete boolean"
STATE = schema.PRODUCT_STATE
CANDIDATES = "product_id string, name string, confidence double, reason string, planned_store string, store_confidence double"


def decide(spark, open_list, candidates, state=(), config=Config(), **kw):
    rows = shopping.reconcile_shopping_list(spark.createDataFrame(candidates, CANDIDATES), spark.createDataFrame(open_list, LIST), spark.createDataFrame(list(state), STATE), config, **kw)
    return {r.product_id: (r.action, r.new_name) for r in rows.collect()}


def test_reconcile(spark):
    eggs = ("e", "Eggs", 0.8, "r", "X", 0.8)
    marked = Config(item_marker="[Auto]")
    assert decide(spark, [("1", "[Auto] Eggs @ X", False)], [eggs], config=marked) == {"e": ("already_present", "[Auto] Eggs @ X")}
    assert decide(spark, [("1", "Eggs", False)], [eggs]) == {"e": ("rename", "Eggs @ X")}
    assert decide(spark, [("1", "Eggs", False)], [eggs], dry_run=True) == {"e": ("already_present", "Eggs @ X")}
    assert decide(spark, [("1", "Eggs", True)], [eggs]) == {"e": ("add", "Eggs @ X")}
    held = [("e", None, None, 0.75, None, None)]
    assert decide(spark, [("1", "Eggs @ Y", False)], [eggs], held)["e"][0] == "already_present"
    assert decide(spark, [("1", "Eggs @ Y", False)], [("e", "Eggs", 0.8, "r", "X", 0.9)], held)["e"][0] == "rename"
    twins = [("a", "Eggs", 0.8, "r", None, None), ("b", "eggs", 0.9, "r", None, None)]
    assert {k: v[0] for k, v in decide(spark, [("1", "Milk", False)], twins).items()} == {"a": "already_present", "b": "add"}


def test_run_and_undo_restore_everything(spark):
    days = [D(2024, 1, 1), D(2024, 1, 11), D(2024, 1, 21)]
    obs = spark.createDataFrame([(p, "S", t, 2.0, "kg", 90, f"{p}{t}") for p in ("milk", "eggs") for t in days],
                                "product_id string, store_name string, observed_at timestamp, unit_price double, unit_type string, confidence int, line_item_id string")
    products = spark.createDataFrame([("milk", "Milk"), ("eggs", "Eggs")], "product_id string, canonical_name string")
    state = spark.createDataFrame([("milk", D(2023, 1, 1), "Old", 0.5, None, None)], STATE)
    shopping_list = spark.createDataFrame([("1", "Bread", False)], LIST)
    run = shopping.auto_shopping_run(obs, products, state, shopping_list, "2024-02-02")
    added = run["decisions"].where("action = 'add'")
    assert {r.new_name for r in added.collect()} == {"Milk", "Eggs"}
    after_state = inventory.merge_state(state, run["state_updates"])
    assert {r.product_id: r.last_store_tag for r in after_state.collect()} == {"milk": None, "eggs": None}
    full = shopping_list.unionByName(added.select(F.col("product_id").alias("id"), F.col("new_name").alias("name"), F.lit(False).alias("complete")))
    payload = run["state_updates"].agg(F.to_json(F.struct(
        F.collect_list(F.struct(F.col("product_id").alias("shopping_list_item_id"), "product_id")).alias("added"),
        F.collect_list(F.struct("product_id", F.struct(
            F.col("previous_last_auto_added_at").alias("last_auto_added_at"), F.col("previous_last_store_tag").alias("last_store_tag"),
            F.col("previous_last_store_tag_confidence").alias("last_store_tag_confidence")).alias("previous"))).alias("shopping_state_updates"),
    )).alias("payload")).withColumn("kind", F.lit("shopping_list_auto_run"))
    assert [r.name for r in activities.undo_shopping_run(payload, full).collect()] == ["Bread"]
    back = inventory.merge_state(after_state, activities.undone_shopping_state(payload))
    got = {r.product_id: (r.last_auto_added_at, r.last_store_tag, r.last_store_tag_confidence) for r in back.collect()}
    assert got == {"milk": (D(2023, 1, 1), "Old", 0.5), "eggs": (None, None, None)}


def test_undo_receipts_and_extraction(spark):
    table = receipts(spark, dict(receipt_id="a", extract_status="done", ocr_text="t", file_path="/x", extract_attempts=3), dict(receipt_id="b", extract_status="done", ocr_text="t"))
    log = spark.createDataFrame([("receipt_added", '{"receipt_id":"b"}'), ("ocr_completed", '{"receipt_id":"a"}'), ("other", '{"receipt_id":"a"}')], "kind string, payload string")
    kept = activities.undo_receipts(log, {"receipts": table})["receipts"]
    assert [r.receipt_id for r in kept.collect()] == ["a"]
    cleared = activities.undo_extraction(log, kept).first()
    assert (cleared.extract_status, cleared.ocr_text, cleared.extract_attempts) == ("pending", None, 0)


def test_undo_renames_only_when_unchanged(spark):
    log = spark.createDataFrame([("shopping_list_auto_run", '{"renamed":[{"shopping_list_item_id":"1","old_name":"A","new_name":"A @ X"},{"shopping_list_item_id":"2","old_name":"B","new_name":"B @ X"}]}')], "kind string, payload string")
    items = spark.createDataFrame([("1", "A @ X", False), ("2", "B mine", False)], LIST)
    assert {r.id: r.name for r in activities.undo_shopping_run(log, items).collect()} == {"1": "A", "2": "B mine"}


def test_evidence_never_falls(spark):
    state = spark.createDataFrame([("p", None, None, None, D(2024, 1, 1), 0.9)], STATE)
    seen = spark.createDataFrame([("p", 0.5), ("q", 1.7), ("q", 0.2)], "product_id string, confidence double")
    got = {r.product_id: r.last_seen_confidence for r in inventory.apply_inventory_evidence(seen, state, "2024-02-01").collect()}
    assert got == {"p": 0.9, "q": 1.0}


def test_detections(spark):
    raw = ['["Milk", {"label": "Eggs", "confidence": 2}, {"name": "Tea"}, " "]', '{"Rice": true, "Salt": false}', "oops", None]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, r string").select("i", inventory.detected_items(F.col("r")).alias("d"))
    got = {r.i: [(x.label, x.confidence) for x in r.d] for r in df.collect()}
    assert got == {0: [("Milk", 0.7), ("Eggs", 1.0), ("Tea", 0.7)], 1: [("Rice", 0.7)], 2: [], 3: []}


def test_audit_rows(spark):
    rows = spark.createDataFrame([("r1", 3)], "receipt_id string, item_count int")
    got = activities.emit_activity(rows, "receipt_added", F.lit("Receipt added"), ["receipt_id", "item_count"], "2024-01-01").first()
    assert (got.kind, got.payload, len(got.activity_id)) == ("receipt_added", '{"receipt_id":"r1","item_count":3}', 32)


def test_subcategory_rows_are_worked_out_once(spark, sf_dir):
    from tillwise.plans.queries_data import sanitize_subcategories

    plan = sanitize_subcategories(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("trim(lambda") == 1
