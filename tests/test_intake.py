"""The whole way from receipt texts to an answer."""

from datetime import datetime

from pyspark.sql import functions as F

from tillwise.operators import extract, prices, spend
from tillwise.plans.intake import intake

DOCS = f"""receipt_id string, arrival long, text string, filename string, locale string, model struct<store_name:string>,
    total double, purchased_at timestamp, store_name string, line_items_raw array<{extract.ITEM}>, org_number string"""
STORES = """store_entity_id string, chain_name string, branch_name string, address string, postal_code string, city string, org_number string,
    phone string, store_id string, aliases array<string>, created_at timestamp, updated_at timestamp"""
AS_OF = "2024-03-15"


def document(i, header, price, org=None):
    text = f"{header}\nDatum 2024-03-{i + 1:02d}\nMjölk 2 st {2 * price},00\nBröd 1 st 20,00\nAtt betala {2 * price + 20},00"
    return (f"r{i}", i, text, "scan.pdf", "sv-SE", None, None, None, None, None, org)


def test_text_to_best_store(spark):
    from tillwise.sources.documents import parse_model_json

    docs = [document(i, "WILLYS", 10) for i in range(3)] + [document(i, "COOP", 14, "5551") for i in range(3, 6)]
    frame = spark.createDataFrame(docs, DOCS).drop("model").withColumn("answer", F.lit(None).cast("string"))
    frame = parse_model_json(frame, "answer").drop("answer")
    stamp = datetime(2024, 1, 1)
    known = spark.createDataFrame([("s1", "Coop", None, None, None, None, "5551", None, None, ["Coop"], stamp, stamp)], STORES)
    aliases = spark.createDataFrame([("willys", "Willys City")], "key string, canonical string")
    out = intake(frame, known, aliases, AS_OF)
    receipts = out["receipts"].orderBy("receipt_id").collect()
    assert [(r.store_name, r.total, r.receipt_category) for r in receipts[:1]] == [("Willys City", 40.0, "grocery")]
    assert [r.store_entity_id for r in receipts[3:]] == ["s1"] * 3 and len({r.store_entity_id for r in receipts[:3]}) == 1
    assert {r.store_entity_id for r in out["stores"].collect()} == {r.store_entity_id for r in receipts}
    assert [(r.subcategory, r.total) for r in receipts[0].receipt_subcategories] == [("unclassified", 40.0)]
    assert out["line_items"].count() == 12 and out["observations"].count() == 12 and out["products"].count() == 2
    best = prices.best_store_by_item(out["observations"], out["products"], AS_OF).collect()
    assert [(r.best_store, r.best_median, r.overall_median) for r in best] == [("Willys City", 10.0, 12.0)]
    totals = spend.spend_totals(out["receipts"], AS_OF).first()
    assert totals["month_total"] == 3 * 40 + 3 * 48


def test_nothing_to_read(spark):
    from tillwise.sources.documents import parse_model_json

    frame = spark.createDataFrame([], DOCS).drop("model").withColumn("answer", F.lit(None).cast("string"))
    out = intake(parse_model_json(frame, "answer").drop("answer"), spark.createDataFrame([], STORES), spark.createDataFrame([], "key string, canonical string"), AS_OF)
    assert all(table.count() == 0 for table in out.values())
