import pytest
from pyspark.sql import functions as F

from tillwise.config import Config
from tillwise.functions import amounts, categories, dates, locale, text


def column(spark, values, fn, ddl="v string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], ddl).select(fn(F.col("v"))).collect()]


def test_names(spark):
    assert column(spark, ["WILLY:S  Öl 0,5l", "Straße", None, "--"], text.norm_name) == ["willy s öl 0 5l", "strasse", "", ""]
    assert column(spark, ["Milk 1 l x", "500g", "  Arla  Milk 3% ", "Cold Beer 33cl"], text.canonical_name) == ["Milk", "500g", "Arla Milk", "Beer"]


def test_alcohol(spark):
    values = ["Red Wine Vinegar", "Alkoholfri öl", "IPA 0,0", "Cava", "Lager cider", "Bread"]
    assert column(spark, values, text.alcohol_class) == [None, None, None, "Wine", "Beer", None]


def test_store_names(spark):
    values = ["WILLY:S", "I.C.A", "G i mi", "WILLY S", "kvitto", "Coop   Extra", "x", "Ica Maxi – "]
    want = ["Willys", "Ica", "Gi mi", "Willys", None, "Coop Extra", None, "Ica Maxi"]
    assert column(spark, values, text.normalize_store_name) == want
    assert column(spark, [None, "Storgatan 1", "Ica 12345", "Io", "Willys"], text.store_name_needs_help) == [True, True, True, True, False]


def test_unit_price(spark):
    rows = [(6.0, "500 g", None), (6.0, "2 pcs", None), (6.0, "3", None), (6.0, None, 2.5), (6.0, "0,5 l", None), (6.0, "0 kg", None), (6.0, None, None)]
    df = spark.createDataFrame(rows, "t double, q string, u double")
    got = [tuple(r) for r in df.select(*amounts.unit_price(F.col("t"), F.col("q"), F.col("u"))).collect()]
    assert got == [(12.0, "kg"), (3.0, "pcs"), (2.0, "pcs"), (2.5, "unknown"), (1.2, "l"), (None, "unknown"), (None, "unknown")]


def test_amounts(spark):
    assert column(spark, ["1.234,50", "12,50", "1,234", "1.234", "1d", "", "1,2,34"], amounts.parse_amount) == [1.2345, 12.5, 1234.0, 1.234, None, None, None]
    assert column(spark, ["a 1,234.50 b 12,50 c 7"], amounts.extract_amounts) == [[1234.5, 12.5]]
    assert column(spark, ["0.5", "1", "70", "170", "-3", "x"], amounts.norm_confidence) == [50, 100, 70, 100, 0, None]


def test_store_tags(spark):
    df = spark.createDataFrame([("Milk @ A @ B",), ("Eggs",), (" @ x",)], "v string")
    assert [tuple(r) for r in df.select(*text.split_store_tag(F.col("v"))).collect()] == [("Milk @ A", "B"), ("Eggs", None), ("@ x", None)]
    assert column(spark, ["[Auto] Eggs", "Eggs"], lambda c: text.strip_marker(c, "[Auto]", "prefix")) == ["Eggs", "Eggs"]
    assert column(spark, ["Eggs auto", "Eggs"], lambda c: text.strip_marker(c, "auto", "suffix")) == ["Eggs", "Eggs"]


def test_file_names(spark):
    assert column(spark, ["a/B.PDF", ".hidden", "x", "a.tar.gz", None], text.file_ext) == [".pdf", "", "", ".gz", ""]
    assert column(spark, ["C:\\x\\y.pdf", "..", None, "a/b/ c.png "], lambda c: text.safe_filename(c, "f")) == ["y.pdf", "f", "f", "c.png"]


def test_dates(spark):
    got = column(spark, ["2024-03-02T10:00:00+01:00", "2024-03-02", "junk", None], dates.purchased_ts)
    assert [str(v) for v in got] == ["2024-03-02 09:00:00", "2024-03-02 00:00:00", "None", "None"]
    df = spark.createDataFrame([("2026-12-31 23:59:59",), ("2027-01-01 00:00:00",), (None,)], "v string").withColumn("v", F.col("v").cast("timestamp"))
    assert [r[0] for r in df.select(dates.in_date_range(F.col("v"), "2026-12-01", "2026-12-31")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(dates.in_date_range(F.col("v"), None, "2026-12-31", True)).collect()] == [True, False, True]


def test_categories(spark):
    assert column(spark, ["Eating-Out", "groceries", "x", None], categories.category_alias) == ["dining", "grocery", None, None]
    assert column(spark, ["Dairy Eggs", "bar pub", "nope"], categories.subcategory_alias) == ["dairy", "bar_pub", None]
    assert column(spark, ["", None, "Big-Shop x"], categories.category_key) == ["uncategorized", "uncategorized", "big_shop_x"]
    assert column(spark, ["HTTP 404 model gone", "boom"], categories.failure_reason) == ["model_not_found", "boom"]


def test_locale_choice(spark):
    rows = [("sv-FI", "FI"), ("es", "CO"), ("es", "MX"), ("en", "SE"), ("en", "US"), (None, None)]
    df = spark.createDataFrame(rows, "l string, c string")
    got = [r[0] for r in df.select(locale.locale_id(F.col("l"), F.col("c"))).collect()]
    assert got == ["sv-SE", "es-CO", "es-ES", "sv-SE", "base", "base"]
    assert locale.locale_keywords(spark).where("locale = 'sv-SE' and kind = 'brands'").count() == 10


def test_text_quality(spark):
    good = "Total 12,50 kr " + "bread and butter " * 8
    assert column(spark, [good, "short", "$$$$ %%%% " * 20, None], text.low_text_quality) == [False, True, True, True]


def test_config_ranges():
    assert Config().baseline_window == 5
    with pytest.raises(ValueError):
        Config(baseline_window=2)
    with pytest.raises(ValueError):
        Config.from_options({"nope": 1})


def test_rounding_follows_the_binary_value(spark):
    import random

    from tillwise.functions.amounts import half_even

    rng = random.Random(4)
    values = [2.675, 2.665, 1.005, 0.125, 0.375, 2.5, 3.5, -2.675, -0.125, 0.0, 1e15 + 0.5, 1e300, 0.285, 1.115]
    values += [rng.randint(-10**6, 10**6) / 10 ** rng.randint(1, 7) for _ in range(3000)] + [(2 * rng.randint(0, 10**5) + 1) / 2000 for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (0, 1, 2, 3, 4, 6, 7):
        got = df.select("v", half_even("v", places).alias("r")).collect()
        assert [(r.v, r.r) for r in got if r.r != round(r.v, places)] == [], places
    empty = df.select(half_even(F.lit(None).cast("double"), 2).alias("n"), half_even(F.lit(float("nan")), 2).alias("x")).first()
    assert empty.n is None and empty.x != empty.x


def test_unit_price_reads_quantities_like_its_patterns(spark):
    import random
    import re

    from tillwise.functions import amounts
    from tillwise.operators.derive import priced_items

    rng = random.Random(5)
    texts = ["1.5\tKG", "2 pcs", "3pc", "0 st", "12.", "x 2 l 3 kg", "5..5ml", "", None, " ", "7 kg", "pcs", "1.2.3 g"]
    texts += ["".join(rng.choice("0125. \t\nkglmpcsx") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    rows = priced_items(spark.createDataFrame([(t, 6.0, None) for t in texts] + [("1 kg", 6.0, 2.5)], "qty_raw string, line_total double, unit_price_raw double"))
    assert rows.where("unit_price is not null")._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 2

    def want(text):
        low = (text or "").strip(" \t\n ").lower()
        if not low:
            return None, "unknown"
        found, count = re.search(amounts.QUANTITY, low, re.ASCII), re.search(amounts.COUNT, low)
        if found:
            qty = float(found[1]) / (1000.0 if found[2] in ("g", "ml") else 1.0)
            return (6.0 / qty, {"g": "kg", "ml": "l", "pc": "pcs"}.get(found[2], found[2])) if qty > 0 else (None, "unknown")
        return (6.0 / float(count[1]), "pcs") if count and float(count[1]) > 0 else (None, "unknown")

    got = [(r.qty_raw, r.unit_price, r.unit_type) for r in rows.collect()]
    assert got[-1] == ("1 kg", 2.5, "unknown")
    assert [g for g in got[:-1] if g[1:] != want(g[0])] == []
