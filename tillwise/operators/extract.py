"""Receipt fields from text.

Everything is worked out inside the row with array functions: a text is never split over rows, so reading
texts needs no shuffle at all. Inputs have ``text``, ``filename`` and ``locale`` columns
(see :func:`tillwise.functions.locale.locale_id`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillwise.functions import locale as packs
from tillwise.functions.amounts import AMOUNT, SIGNED_AMOUNT, extract_amounts, parse_amount
from tillwise.functions.categories import (
    RESIDUAL_TOLERANCE, category_alias, subcategory_alias,
)
from tillwise.functions.dates import days_after, instant, make_day
from tillwise.functions.text import (
    any_of, blank_to_null, bound, fold, normalize_store_name, squeeze, strip, text_lines,
)
from tillwise.session import pin

MAX_TOTAL = 50_000.0
# Words of rows that are no items, in cleaning and in reading.
CLEAN_WORDS = (
    "att betala", "summa", "subtotal", "totalt", "total", "moms", "vat", "växel", "change", "kontant", "kort",
    "orgnr", "org nr", "sparat", "kvitto", "receipt",
)
READ_WORDS = (
    "orgnr", "org nr", "tele", "kvitto", "receipt", "moms", "vat", "summa", "att betala", "totalt", "subtotal",
    "växel", "kort", "kontant",
)
NOT_A_STORE = ("summa", "total", "datum", "date", "tid", "time")
ITEM = "struct<raw_name:string,line_total:double,qty_raw:string,unit_price_raw:double>"


# What a line has to hold, whatever its locale, to be scored or dated; only such lines are looked at closely.
TOTAL_HINT = packs.any_pack("total_strong", "total_weak", "total_minor")
DATE_HINT = rf"\d[-./]\d{{1,2}}[-./]\d|\d{{8}}|\d\s*(?i:{any_of(packs.MONTH_NAMES)})\s*\d"


def _holds(c: Column, words: Column) -> Column:
    """One of the words occurs in the text."""
    return F.exists(words, lambda w: c.contains(w))


def _rank(c: Column, words: Column, points: int) -> Column:
    return F.when(_holds(c, words), F.lit(points)).otherwise(F.lit(0))


def with_lines(df: DataFrame) -> DataFrame:
    """Adds ``_lines``, the trimmed non-blank lines, once for all extractors."""
    return df.withColumn("_lines", text_lines(F.col("text")))


# ---------------------------------------------------------------- total

def with_total(df: DataFrame) -> DataFrame:
    """Adds ``found_total``: the amount of the best keyword line, else the largest amount of the text."""
    loc = F.col("locale")
    staged = df.withColumn(
        "_kw",
        F.struct(*[packs.words(loc, k).alias(k) for k in ("total_negative", "total_strong", "total_weak", "total_minor")]),
    )

    def line_score(low: Column) -> Column:
        skipped = _holds(low, F.col("_kw.total_negative")) | low.contains("subtotal")
        score = (
            _rank(low, F.col("_kw.total_strong"), 5) + _rank(low, F.col("_kw.total_weak"), 3)
            + _rank(low, F.col("_kw.total_minor"), 2)
        )
        return F.when(skipped, F.lit(0)).otherwise(score)

    # Score first; amounts are only looked for on lines that count.
    lowered = F.transform("_lines", lambda line, i: F.struct(F.lower(line).alias("low"), i.alias("idx"), line.alias("line")))
    staged = staged.withColumn(
        "_scored",
        F.filter(
            F.transform(
                F.filter(lowered, lambda s: s["low"].rlike(TOTAL_HINT)),
                lambda s: F.struct(line_score(s["low"]).alias("score"), s["idx"].alias("idx"), s["line"].alias("line")),
            ),
            lambda s: s["score"] > 0,
        ),
    )
    offers = F.flatten(
        F.transform(
            "_scored",
            lambda s: F.transform(
                extract_amounts(s["line"]),
                lambda amount, pos: F.struct(s["score"].alias("score"), s["idx"].alias("idx"), (-pos).alias("first"), amount.alias("amount")),
            ),
        )
    )
    staged = staged.withColumn("_best", F.array_max(offers))
    largest = F.array_max(F.flatten(F.transform("_lines", extract_amounts)))
    return staged.withColumn(
        "found_total", F.when(F.col("_best").isNotNull(), F.col("_best.amount")).otherwise(largest)
    ).drop("_kw", "_scored", "_best")


# ---------------------------------------------------------------- date

def day_like(value: Column, months: Column) -> Column:
    """A timestamp from one date text in any of the known notations, else null."""
    three = r"^\d{1,4}-\d{1,2}-\d{1,4}$"
    named = r"\b(\d{1,2})\s*([A-Za-zÅÄÖåäö]+)\s*(\d{2,4})\b"

    def pieces(p: Column) -> Column:
        a, b, c = (F.get(p, F.lit(i)) for i in range(3))
        return F.when(F.length(a) == 4, make_day(a, b, c)).otherwise(make_day(c, b, a))

    def numeric(dashed: Column) -> Column:
        compact = make_day(F.substring(dashed, 1, 4), F.substring(dashed, 5, 2), F.substring(dashed, 7, 2))
        return F.when(dashed.rlike(r"^\d{8}$"), compact).when(dashed.rlike(three), bound(F.split(dashed, "-"), pieces))

    def read(v: Column) -> Column:
        iso = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?\s?(Z|[+-]\d{2}:?\d{2})?)?$"), v.try_cast("timestamp"))
        month = F.element_at(months, F.lower(F.regexp_extract(v, named, 2)))
        spelled = bound(month, lambda m: F.when(
            m.isNotNull(), make_day(F.regexp_extract(v, named, 3), m.cast("string"), F.regexp_extract(v, named, 1))
        ))
        numbers = bound(F.regexp_replace(v, "[./]", "-"), numeric)
        return F.coalesce(iso, numbers.cast("timestamp"), spelled.cast("timestamp"))

    return bound(strip(value), read)


def filename_day(filename: Column) -> Column:
    name = F.coalesce(filename, F.lit(""))
    split = r"(\d{4})[-_.](\d{2})[-_.](\d{2})"
    joined = r"\b(\d{4})(\d{2})(\d{2})\b"
    rx = lambda p: make_day(*[F.regexp_extract(name, p, i) for i in (1, 2, 3)])
    return F.when(name.rlike(split), rx(split)).when(name.rlike(joined), rx(joined)).cast("timestamp")


def with_date(df: DataFrame, as_of, use_filename: bool = True) -> DataFrame:
    """Adds ``found_date``: the best-scored date of all lines, else, with ``use_filename``, a date in the file name."""
    loc, cutoff = F.col("locale"), days_after(instant(as_of), 2)
    staged = df.withColumn("_good", packs.words(loc, "date_positive")).withColumn(
        "_bad", packs.words(loc, "date_negative")
    ).withColumn("_months", packs.months(loc))
    lines = F.filter("_lines", lambda line: line.rlike(DATE_HINT))
    rank = lambda low: _rank(low, F.col("_good"), 5) - _rank(low, F.col("_bad"), 5)
    staged = staged.withColumn(
        "_dated",
        F.transform(
            lines,
            lambda line: F.struct(bound(fold(line), rank).alias("score"), line.alias("line")),
        ),
    )

    def found(line: Column, regex: str, bonus: int) -> Column:
        hits = F.regexp_extract_all(line, F.lit(f"({regex})"), F.lit(1))
        return F.transform(hits, lambda h: F.struct(F.lit(bonus).alias("bonus"), h.alias("value")))

    staged = staged.withColumn(
        "_offers",
        F.flatten(
            F.transform(
                "_dated",
                lambda s: F.transform(
                    F.concat(
                        found(s["line"], r"\b\d{4}[-./]\d{1,2}[-./]\d{1,2}\b", 2),
                        found(s["line"], r"\b\d{1,2}[-./]\d{1,2}[-./]\d{2,4}\b", 1),
                        found(s["line"], r"\b\d{8}\b", 0),
                        F.array(F.struct(F.lit(0).alias("bonus"), s["line"].alias("value"))),
                    ),
                    lambda h: F.struct((s["score"] + h["bonus"]).alias("score"), h["value"].alias("value")),
                ),
            )
        ),
    )
    dated = F.transform(
        "_offers", lambda o: F.struct(o["score"].alias("score"), day_like(o["value"], F.col("_months")).alias("ts"))
    )
    best = F.array_max(F.filter(dated, lambda o: o["ts"].isNotNull() & (o["ts"] <= cutoff)))
    staged = staged.withColumn("_best", best)
    named = filename_day(F.col("filename")) if use_filename else F.lit(None).cast("timestamp")
    return staged.withColumn("found_date", F.coalesce("_best.ts", named)).drop(
        "_good", "_bad", "_months", "_dated", "_offers", "_best"
    )


# ---------------------------------------------------------------- store

def letters_only(c: Column) -> Column:
    return strip(squeeze(F.regexp_replace(c, r"[^\p{L} &'-]", "")))


def without_contact(c: Column) -> Column:
    """The part of a line before a phone word or the first digit."""
    cut = F.regexp_replace(c, r"(?si)(?:\b(?:tel|tele|telefon|phone)\b|\d).*$", "")
    return F.when(cut == c, c).otherwise(F.regexp_replace(cut, r"^[ \-–—|,;:]+|[ \-–—|,;:]+$", ""))


def filename_store(filename: Column) -> Column:
    base = strip(F.regexp_replace(F.element_at(F.split(F.coalesce(filename, F.lit("")), "/"), -1), r"(?<=.)\.[^.]*$", ""))
    base = strip(F.regexp_replace(base, r"[\s_-]*(\d{4}[-_.]\d{2}[-_.]\d{2}|\d{8})$", ""))
    cleaned = letters_only(strip(F.regexp_replace(base, r"\s*\(\d+\)\s*$", "")))
    return F.when(F.length(cleaned).between(3, 80), cleaned)


def has_brand(low: Column, brands: Column, compact: Column) -> Column:
    """A brand occurs in the folded text, or a word of it is one or two slips away from a brand.

    ``compact`` holds the brands without spaces. Lengths too far apart rule a word out before its letters are compared.
    """
    tokens = F.filter(F.split(F.regexp_replace(low, r"[\s\-–—|]+", "\n"), "\n"), lambda t: F.length(t) >= 4)

    def near(token: Column, brand: Column) -> Column:
        size, longest = F.length(token) + F.length(brand), F.greatest(F.length(token), F.length(brand))
        alike = lambda same: 2.0 * same / size >= 0.86
        return alike(F.least(F.length(token), F.length(brand))) & alike(longest - F.levenshtein(token, brand))

    return _holds(low, brands) | F.exists(tokens, lambda t: F.exists(compact, lambda b: near(t, b)))


def with_store(df: DataFrame, use_filename: bool = True) -> DataFrame:
    """Adds ``found_store``: the best-scored line of the whole text, with its location lines when it is a chain."""
    loc = F.col("locale")
    staged = df.withColumn("_stop", packs.words(loc, "stop_exact")).withColumn(
        "_stop_in", packs.words(loc, "stop_contains")
    ).withColumn("_address", packs.words(loc, "address")).withColumn("_brands", packs.words(loc, "brands"))
    staged = staged.withColumn("_compact", F.transform("_brands", lambda b: F.replace(b, F.lit(" "), F.lit(""))))
    named = F.filter(
        F.transform(
            "_lines",
            lambda line, i: F.struct(
                i.alias("idx"), line.alias("line"),
                letters_only(F.when(line.rlike(r"\d"), without_contact(line)).otherwise(line)).alias("name"),
            ),
        ),
        lambda s: F.length(s["name"]).between(3, 80),
    )
    folded = F.transform(named, lambda s: F.struct(s["idx"].alias("idx"), s["line"].alias("line"), s["name"].alias("name"), fold(s["name"]).alias("low")))
    allowed = F.filter(folded, lambda s: ~F.array_contains(F.col("_stop"), s["low"]) & ~_holds(s["low"], F.col("_stop_in")))
    staged = staged.withColumn(
        "_heads",
        F.transform(allowed, lambda s: F.struct(
            s["idx"].alias("idx"), s["line"].alias("line"), s["name"].alias("name"), s["low"].alias("low"),
            has_brand(s["low"], F.col("_brands"), F.col("_compact")).alias("brand"),
        )),
    )
    low_stop = any_of(NOT_A_STORE)

    def usable(s: Column) -> Column:
        return s["brand"] | (F.length(F.regexp_replace(s["line"], r"[^0-9]", "")) < 6)

    def score(s: Column) -> Column:
        place = F.when(s["idx"] <= 2, 6).when(s["idx"] <= 6, 3).when(s["idx"] <= 12, 1).otherwise(0)
        letters = F.length(F.regexp_replace(s["name"], r"[^\p{L}]", ""))
        return (
            place + F.when(s["brand"], 6).otherwise(0) + F.when(letters >= 5, 2).otherwise(0)
            - F.when(s["low"].rlike(low_stop), 4).otherwise(0)
        )

    scored = F.transform(
        F.filter("_heads", usable),
        lambda s: F.struct(score(s).alias("score"), (-s["idx"]).alias("early"), s["name"].alias("name"), s["brand"].alias("brand")),
    )
    if use_filename:
        hint = F.struct(F.lit(4).alias("score"), F.lit(1).alias("early"), filename_store(F.col("filename")).alias("name"), F.lit(False).alias("brand"))
        scored = F.concat(scored, F.filter(F.array(hint), lambda h: h["name"].isNotNull()))
    staged = staged.withColumn("_best", F.array_max(scored)).withColumn("_at", -F.col("_best.early"))

    def location(line: Column) -> Column:
        def fits(cleaned: Column, low: Column) -> Column:
            return (
                F.length(cleaned).between(3, 50) & ~F.array_contains(F.col("_stop"), low) & ~_holds(low, F.col("_stop_in"))
                & ~_holds(low, F.col("_address")) & ~low.rlike(low_stop)
            )

        cleaned = letters_only(without_contact(line))
        return bound(cleaned, lambda c: F.when(bound(fold(c), lambda low: fits(c, low)), c))

    # Only a chain is followed by its place.
    line_at = lambda i: F.when(F.col("_best.brand"), F.get("_lines", F.col("_at") + i))
    name = F.col("_best.name")
    staged = staged.withColumn("_next", location(line_at(1))).withColumn(
        "_after", location(line_at(2))
    )
    repeats = lambda c: fold(c) == fold(name)
    first = F.when(~repeats(F.col("_next")), F.col("_next"))
    second = F.when(F.col("_next").isNotNull() & ~repeats(F.col("_after")), F.col("_after"))
    extends = F.col("_best.brand") & (F.col("_at") >= 0) & (F.size(F.split(name, r"\s+")) <= 3)
    store = F.when(extends, F.concat_ws(" ", name, first, second)).otherwise(name)
    empty_text = F.coalesce(F.col("text"), F.lit("")) == ""
    chosen = F.when(F.col("_best.score") >= 2, store)
    if use_filename:
        chosen = F.when(empty_text, filename_store(F.col("filename"))).otherwise(chosen)
    return staged.withColumn("found_store", chosen).drop(
        "_stop", "_stop_in", "_address", "_brands", "_compact", "_heads", "_best", "_at", "_next", "_after"
    )


# ---------------------------------------------------------------- line items

def with_items(df: DataFrame) -> DataFrame:
    """Adds ``found_items``: lines that end in an amount."""
    last = rf"({SIGNED_AMOUNT})\s*$"

    no_item = rf"^(?:---|===|\*\*\*)|{any_of(READ_WORDS)}"

    def quantity(low: Column) -> Column:
        counted = F.regexp_extract(low, r"((?:\d+(?:\.\d+)?)\s*(?:st|pcs|pc)\b)", 1)
        starred = F.regexp_extract(low, r"(\b\d+\s*st\*)", 1)
        return F.coalesce(F.nullif(counted, F.lit("")), F.nullif(starred, F.lit("")))

    def item(line: Column) -> Column:
        return F.struct(
            squeeze(strip(F.regexp_replace(line, last, ""))).alias("raw_name"),
            parse_amount(F.regexp_extract(line, last, 1)).alias("line_total"),
            bound(F.lower(line), quantity).alias("qty_raw"),
            F.lit(None).cast("double").alias("unit_price_raw"),
        )

    candidates = F.filter("_lines", lambda line: line.rlike(rf"{AMOUNT}\s*$") & ~F.lower(line).rlike(no_item))
    items = F.filter(
        F.transform(candidates, item), lambda i: i["line_total"].isNotNull() & (F.length(i["raw_name"]) >= 2)
    )
    # Items are mostly put one to a row, whose filter of empty arrays would work them out again, even inside a join.
    return pin(df.withColumn("found_items", items.cast(f"array<{ITEM}>")))


def clean_items(items: Column, total: Column) -> Column:
    """Items without totals, taxes, number rows and rows above the receipt total; discounts stay."""

    def keep(i: Column) -> Column:
        name, amount = i["raw_name"], i["line_total"]
        low = F.lower(name)
        discount = low.contains("rabatt") | low.rlike("^(-|discount)")
        amounts = F.size(F.regexp_extract_all(name, F.lit(f"({SIGNED_AMOUNT})"), F.lit(1)))
        is_total = F.coalesce((F.abs(amount - total) <= 0.01) & ~name.rlike("[A-Za-zÅÄÖåäö]"), F.lit(False))
        too_much = F.coalesce(amount > total + 1.0, F.lit(False))
        footer = low.rlike(any_of(CLEAN_WORDS)) | (amounts >= 2) | is_total | too_much
        return (name != "") & ~name.rlike(r"^[0-9.,\s]+$") & (discount | ~footer)

    trimmed = F.transform(items, lambda i: F.struct(
        F.coalesce(blank_to_null(i["raw_name"]), F.lit("")).alias("raw_name"), i["line_total"].alias("line_total"),
        blank_to_null(i["qty_raw"]).alias("qty_raw"), i["unit_price_raw"].alias("unit_price_raw"),
    ))
    return F.filter(trimmed, keep)


def coerce_items(items: Column) -> Column:
    """Model items (all fields text) with a name and a readable total."""
    typed = F.transform(items, lambda i: F.struct(
        blank_to_null(i["raw_name"]).alias("raw_name"), parse_amount(i["line_total"]).alias("line_total"),
        blank_to_null(i["qty_raw"]).alias("qty_raw"), parse_amount(i["unit_price_raw"]).alias("unit_price_raw"),
    ))
    return F.filter(typed, lambda i: i["raw_name"].isNotNull() & i["line_total"].isNotNull())


# ---------------------------------------------------------------- model output

MODEL_SCHEMA = (
    "store_name string, total string, purchased_at string, receipt_category string, receipt_subcategory string, "
    "receipt_subcategories array<struct<subcategory:string,total:string>>, "
    "line_items array<struct<raw_name:string,line_total:string,qty_raw:string,unit_price_raw:string>>"
)


def sanitize_rows(rows: Column, residual_total: Column | None = None) -> Column:
    """Known subcategories summed by name, largest first, with the rest of ``residual_total`` as unclassified."""
    empty = F.array().cast("array<struct<subcategory:string,total:double>>")
    named = F.coalesce(F.filter(
        F.transform(rows, lambda r: F.struct(
            subcategory_alias(r["subcategory"]).alias("subcategory"), r["total"].try_cast("double").alias("total"))),
        lambda r: r["subcategory"].isNotNull() & (r["total"] > 0),
    ), empty)

    def with_rest(named: Column) -> Column:
        rest = lambda known: F.when(
            residual_total > known + RESIDUAL_TOLERANCE,
            F.array(F.struct(F.lit("unclassified").alias("subcategory"), (residual_total - known).alias("total"))),
        ).otherwise(empty)
        return F.concat(named, bound(F.aggregate(named, F.lit(0.0), lambda acc, r: acc + r["total"]), rest))

    def summed(named: Column) -> Column:
        by_name = lambda n, i: F.struct(
            (-F.aggregate(named, F.lit(0.0), lambda acc, r: acc + F.when(r["subcategory"] == n, r["total"]).otherwise(0.0))).alias("neg"),
            i.alias("seq"), n.alias("subcategory"),
        )
        return F.transform(F.array_sort(F.transform(F.array_distinct(named["subcategory"]), by_name)), lambda r: F.struct(
            r["subcategory"].alias("subcategory"), F.bround(-r["neg"], 2).alias("total")
        ))

    return bound(named if residual_total is None else bound(named, with_rest), summed)


def sanitize_model_fields(df: DataFrame, as_of, fields: str = "model") -> DataFrame:
    """Model fields checked: adds ``m_store, m_total, m_date, m_category, m_subcategories, m_items``.

    ``fields`` is a struct column of :data:`MODEL_SCHEMA`.
    """
    f = lambda name: F.col(f"{fields}.{name}")
    months = packs.months(F.lit("base"))
    cutoff = days_after(instant(as_of), 2)
    staged = df.withColumn("m_store", normalize_store_name(blank_to_null(f("store_name")))).withColumn(
        "_total", parse_amount(f("total"))
    ).withColumn("_date", model_date(f("purchased_at"), months, cutoff))
    short_code = (F.length("m_store") <= 4) & (F.col("m_store") == F.upper("m_store")) & F.col("m_store").rlike(r"\p{L}")
    staged = staged.withColumn("m_store", F.when(~F.coalesce(short_code, F.lit(False)), F.col("m_store"))).withColumn(
        "m_total", F.when(F.col("_total").between(0.0, MAX_TOTAL), F.col("_total"))
    ).withColumn("m_date", F.when(F.col("_date") <= cutoff, F.col("_date")))
    staged = staged.withColumn("m_category", category_alias(f("receipt_category"))).withColumn(
        "m_items", coerce_items(f("line_items"))
    ).withColumn("_rows", sanitize_rows(f("receipt_subcategories")))
    single = subcategory_alias(f("receipt_subcategory"))
    promoted = F.array(F.struct(single.alias("subcategory"), F.bround("m_total", 2).alias("total")))
    rows = F.when((F.size("_rows") == 0) & single.isNotNull() & (F.col("m_total") > 0), promoted).otherwise(F.col("_rows"))
    return staged.withColumn("m_subcategories", rows).drop("_total", "_date", "_rows")


def model_date(value: Column, months: Column, cutoff: Column) -> Column:
    """Date of a short model answer: the whole text, else the best date pattern inside it."""
    tokens = F.regexp_extract_all(
        value, F.lit(r"(\b\d{4}[-./]\d{1,2}[-./]\d{1,2}\b|\b\d{1,2}[-./]\d{1,2}[-./]\d{2,4}\b|\b\d{8}\b)"), F.lit(1)
    )
    ymd = lambda t: t.rlike(r"^\d{4}[-./]")
    offers = F.concat(
        F.transform(tokens, lambda t: F.struct(F.when(ymd(t), 2).when(t.rlike("[-./]"), 1).otherwise(0).alias("score"), day_like(t, months).alias("ts"))),
        F.array(F.struct(F.lit(0).alias("score"), day_like(value, months).alias("ts"))),
    )
    return F.array_max(F.filter(offers, lambda o: o["ts"].isNotNull() & (o["ts"] <= cutoff)))["ts"]


# ---------------------------------------------------------------- all fields

def extract_receipts(df: DataFrame, as_of, overwrite: bool = False) -> DataFrame:
    """All fields of a receipt: the checked model value, else what the text gives.

    ``df`` has ``text, filename, locale, model`` and the current ``total, purchased_at, store_name,
    line_items_raw``. A field is set when it is empty or ``overwrite`` is given.
    """
    has_items = F.coalesce(F.size("line_items_raw") > 0, F.lit(False))
    readers = (
        (F.col("total").isNull(), with_total),
        (F.col("purchased_at").isNull(), lambda rows: with_date(rows, as_of, use_filename=False)),
        (F.col("store_name").isNull(), lambda rows: with_store(rows, use_filename=False)),
        (~has_items, with_items),
    )
    found = with_lines(df).withColumnRenamed("_lines", "_all_lines")
    # A field that stays as it is needs no reading: its reader gets no lines.
    for missing, reader in readers:
        asked = F.when(missing | F.lit(overwrite), F.col("_all_lines")).otherwise(F.array().cast("array<string>"))
        found = reader(found.withColumn("_lines", asked))
    found = pin(sanitize_model_fields(found.drop("_lines", "_all_lines"), as_of))

    def settled(current: str, value: Column) -> Column:
        return F.coalesce(value, F.col(current)) if overwrite else F.coalesce(F.col(current), value)

    store = F.coalesce("m_store", "found_store")
    named = F.when(F.col("store_name").isNull() | F.lit(overwrite), normalize_store_name(store))
    new_items = F.when(F.coalesce(F.size("m_items") > 0, F.lit(False)), F.col("m_items")).otherwise(F.col("found_items"))
    result = (
        found.withColumn("total", settled("total", F.coalesce("m_total", "found_total")))
        .withColumn("purchased_at", settled("purchased_at", F.coalesce("m_date", "found_date")))
        .withColumn("store_name", F.coalesce(named, F.col("store_name")))
        .withColumn("_new_items", F.when(~has_items | F.lit(overwrite), new_items))
    )
    cleaned = F.when(F.size("_new_items") > 0, clean_items(F.col("_new_items"), F.col("total")))
    result = result.withColumn("line_items_raw", F.coalesce(cleaned, F.col("line_items_raw")))
    return result.drop(
        "_new_items", "found_total", "found_date", "found_store", "found_items", "m_store", "m_total",
        "m_date", "m_items", "model",
    ).withColumnRenamed("m_category", "receipt_category_model").withColumnRenamed(
        "m_subcategories", "receipt_subcategories_model"
    )
