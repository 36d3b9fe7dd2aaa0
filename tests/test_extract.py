from datetime import datetime

from pyspark.sql import functions as F

from tillwise.operators import extract
from tillwise.session import spread
from tillwise.sources import documents

AS_OF = "2024-03-03"


def read(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, text string, filename string, locale string")
    found = extract.with_items(extract.with_store(extract.with_date(extract.with_total(extract.with_lines(df)), AS_OF)))
    return found.orderBy("id").collect()


def test_totals(spark):
    rows = read(spark, [
        ("Subtotal 90,00\nTotal 100,00\nTotal 110,00", "", "base"), ("Milk 12,90\nBread 25,00", "", "base"), ("nothing", "", "base"),
        ("Delsumma 9,00\nSumma 10,00\nAtt betala 8,00", "", "sv-SE"), ("Importe 5,00\nTotal a pagar 4,00", "", "es-ES"),
    ])
    assert [r.found_total for r in rows] == [110.0, 25.0, None, 8.0, 4.0]


def test_dates(spark):
    rows = read(spark, [
        ("Best before 2024-09-01\nDate 2024-03-02", "", "base"), ("Datum 11 feb 2024", "", "sv-SE"), ("Fecha 3 enero 24", "", "es-CO"),
        ("12.02.24", "", "base"), ("no", "scan 2024-02-22.pdf", "base"), ("2024-03-01 10:15", "", "base"), ("31.02.2024", "", "base"),
        ("Best before 2024-02-01\n2024-01-05", "", "base"),
    ])
    want = [datetime(2024, 3, 2), datetime(2024, 2, 11), datetime(2024, 1, 3), datetime(2024, 2, 12), datetime(2024, 2, 22), datetime(2024, 3, 1),
            None, datetime(2024, 1, 5)]
    # A date pattern outranks the same line read as a whole with its time.
    assert [r.found_date for r in rows] == want


def test_stores(spark):
    rows = read(spark, [
        ("WILLYS\nHELSINGBORG VÄLA\nTel 042-123\nMjölk 12,90", "", "sv-SE"), ("Kvitto\nWILLYS:\nSumma 5,00", "", "sv-SE"),
        ("", "Corner Shop (2) 2024-02-22.pdf", "base"), ("1\n2\n3", "Corner Shop 20240222.pdf", "base"), ("Willyss\nx\nLund", "", "sv-SE"),
    ])
    assert [r.found_store for r in rows] == ["WILLYS HELSINGBORG VÄLA", "WILLYS", "Corner Shop", "Corner Shop", "Willyss"]


def test_items(spark):
    got = read(spark, [("Milk 2 st 25,90\nMoms 12% 2,77\n--- 5,00\nX 1,00\nCheese  old  -3,50", "", "sv-SE")])[0].found_items
    assert [(i.raw_name, i.line_total, i.qty_raw) for i in got] == [("Milk 2 st", 25.9, "2 st"), ("Cheese old", -3.5, None)]


def test_whole_texts_are_read(spark):
    things = [f"Thing {chr(65 + i % 26)} 1,{i % 100:02d}" for i in range(250)]
    filler = [f"x {i}" for i in range(200)]
    rows = read(spark, [("\n".join(things), "", "base"), ("\n".join([*filler, "Date 2024-03-02"]), "", "base"), ("\n".join(["1"] * 60 + ["WILLYS"]), "", "sv-SE")])
    assert len(rows[0].found_items) == 250
    assert rows[1].found_date == datetime(2024, 3, 2)
    assert rows[2].found_store == "WILLYS"


def test_receipts_take_no_date_from_the_file_name(spark):
    lines = extract.with_lines(spark.createDataFrame([("no date here", "x 2001-02-03.pdf", "base")], "text string, filename string, locale string"))
    assert extract.with_date(lines, AS_OF, use_filename=False).first().found_date is None
    assert extract.with_date(lines, AS_OF).first().found_date == datetime(2001, 2, 3)


def test_items_are_worked_out_once(spark, sf_dir):
    """One row per item adds a filter of empty arrays, which must not repeat the reading of the text."""
    from tillwise.plans.queries_data import extract_line_items

    plan = extract_line_items(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") + plan.count("att betala") == 1


def test_rows_are_dealt_by_their_number(spark, tmp_path):
    spark.range(5000).coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    assert spread(rows, 100).rdd.getNumPartitions() == 50
    assert spread(rows, 100_000).rdd.getNumPartitions() == spread(rows).rdd.getNumPartitions()


def test_months_of_every_pack_are_dated(spark):
    rows = read(spark, [("x 4okt2003 y", "", "sv-SE"), ("a 3 ENERO  24", "", "es-CO"), ("7.8.01", "", "zz"), ("due 1 maj 03\n2 juni 2003", "", "base")])
    assert [r.found_date for r in rows] == [datetime(2003, 10, 4), datetime(2024, 1, 3), datetime(2001, 8, 7), None]


def test_cleaning(spark):
    items = [("Summa 50,00", 50.0), ("Rabatt total", -5.0), ("12.00", 12.0), ("Cheese", 60.0), ("Cheese", 40.0), ("a 1,00 b 2,00", 3.0), ("##", 50.0)]
    df = spark.createDataFrame([(50.0, [(n, t, None, None) for n, t in items])], f"t double, i array<{extract.ITEM}>")
    kept = df.select(extract.clean_items(F.col("i"), F.col("t")).alias("k")).first().k
    assert [(i.raw_name, i.line_total) for i in kept] == [("Rabatt total", -5.0), ("Cheese", 40.0)]


def test_model_fields(spark):
    answer = (
        'Here: {"store_name":"ICA MAXI","total":"1,234.50","purchased_at":"2024-02-01","receipt_category":"Take away",'
        '"receipt_subcategory":"bar pub","line_items":[{"raw_name":"Latte","line_total":"3,50"},{"raw_name":"x","line_total":"free"}]} ok'
    )
    bad = '{"store_name":"a","total":99999,"purchased_at":"2031-01-01"}'
    df = documents.parse_model_json(spark.createDataFrame([(1, answer), (2, bad), (3, "none"), (4, None)], "id int, a string"), "a")
    got = extract.sanitize_model_fields(df, AS_OF).orderBy("id").collect()
    one = got[0]
    assert (one.m_store, one.m_total, one.m_date, one.m_category) == ("Ica Maxi", 1234.5, datetime(2024, 2, 1), "dining")
    assert [(i.raw_name, i.line_total) for i in one.m_items] == [("Latte", 3.5)]
    assert [(r.subcategory, r.total) for r in one.m_subcategories] == [("bar_pub", 1234.5)]
    assert all((r.m_store, r.m_total, r.m_date) == (None, None, None) for r in got[1:])


def test_all_fields_and_overwrite(spark):
    text = "WILLYS\n1234\nMjölk 12,90\nDatum 2024-02-11\nAtt betala 12,90"
    ddl = "receipt_id string, text string, filename string, locale string, a string, total double, purchased_at timestamp, store_name string, line_items_raw array<" + extract.ITEM + ">"
    rows = [("r", text, "f", "sv-SE", None, 5.0, None, None, None), ("m", text, "f", "sv-SE", '{"total": 7}', None, None, "Old", None)]
    df = documents.parse_model_json(spark.createDataFrame(rows, ddl), "a")
    kept = {r.receipt_id: r for r in extract.extract_receipts(df, AS_OF).collect()}
    assert (kept["r"].total, kept["r"].store_name, kept["r"].purchased_at) == (5.0, "Willys", datetime(2024, 2, 11))
    assert kept["r"].line_items_raw == []  # the only item costs more than the stored total
    assert (kept["m"].total, kept["m"].store_name) == (7.0, "Old")
    forced = {r.receipt_id: r for r in extract.extract_receipts(df, AS_OF, overwrite=True).collect()}
    assert (forced["r"].total, forced["m"].store_name) == (12.9, "Willys")
    assert [i.raw_name for i in forced["r"].line_items_raw] == ["Mjölk"]


def test_only_missing_fields_are_read(spark):
    """Fields that are there stay and their readers get no lines; missing ones are read from the same text."""
    text = "WILLYS\nHelsingborg\nDatum 2024-01-02\nMjölk 12,50\nAtt betala 12,50"
    fields = [12.0, "2023-05-06 00:00:00", "Shop", [("Bread", 3.0, None, None)]]
    rows = [(i, text, "scan.pdf", "sv_se", *[f if i >> k & 1 else None for k, f in enumerate(fields)]) for i in range(16)]
    df = spark.createDataFrame(rows, f"receipt_id int, text string, filename string, locale string, total double, purchased_at string, store_name string, line_items_raw array<{extract.ITEM}>")
    df = df.withColumn("purchased_at", F.col("purchased_at").cast("timestamp")).withColumn("model", F.from_json(F.lit("{}"), extract.MODEL_SCHEMA))
    read = extract.extract_receipts(df, "2024-06-01")
    got = {r.receipt_id: (r.total, str(r.purchased_at), r.store_name, [i.raw_name for i in r.line_items_raw]) for r in read.collect()}
    none, full = got[0], got[15]
    assert none == (12.5, "2024-01-02 00:00:00", none[2], ["Mjölk"]) and none[2].lower().startswith("willys")
    assert full == (12.0, "2023-05-06 00:00:00", "Shop", ["Bread"])
    for i in range(16):
        assert got[i][:3] == tuple((full if i >> k & 1 else none)[k] for k in range(3))
    asked = [line for line in read._jdf.queryExecution().optimizedPlan().toString().splitlines() if "_all_lines" in line]
    assert any("isnull(total" in line for line in asked) and any("isnull(store_name" in line for line in asked)
