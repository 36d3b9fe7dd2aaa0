"""Number columns: money in text, unit prices, scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tillwise.functions.text import blank_to_null, bound, strip

# Money patterns, with and without a sign.
AMOUNT = r"[0-9]{1,3}(?:[.,][0-9]{3})*(?:[.,][0-9]{2})"
SIGNED_AMOUNT = "-?" + AMOUNT
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
QUANTITY = r"([0-9]+(?:\.[0-9]+)?)\s*(kg|g|l|ml|pcs|pc)"
COUNT = r"([0-9]+(?:\.[0-9]+)?)"
#: The letters of the units, and what a pattern takes for white space.
UNIT_CHARS, BLANKS = "kgmlpcs", " \t\n\x0b\f\r"


def total_num(c: Column) -> Column:
    """A double, null when the text is no number."""
    return bound(strip(c.cast("string")), lambda s: F.when(s.rlike(NUMBER), s.try_cast("double")))


def parse_amount(c: Column) -> Column:
    """Money text to a number; handles both separators and the decimal comma."""

    def plain(s: Column) -> Column:
        last = F.substring_index(s, ",", -1)
        return (
            F.when(~s.contains(","), s)
            .when(~s.contains(".") & (F.length(last) == 2), F.replace(s, F.lit(","), F.lit(".")))
            .otherwise(F.replace(s, F.lit(","), F.lit("")))
        )

    number = lambda p: F.when(p.rlike(NUMBER), p.try_cast("double"))
    return bound(bound(strip(c), plain), number)


def extract_amounts(c: Column) -> Column:
    """Every amount of a text, in order, as an array of doubles."""
    found = F.transform(F.regexp_extract_all(c, F.lit(f"({AMOUNT})"), F.lit(1)), parse_amount)
    return F.filter(found, lambda x: x.isNotNull())


def unit_price(line_total: Column, qty_raw: Column, unit_price_raw: Column) -> tuple[Column, Column]:
    """(price per unit, unit), see :func:`price_and_unit`; each column works both out."""
    found = price_and_unit(line_total, qty_raw, unit_price_raw)
    return found["price"], found["unit"]


def price_and_unit(line_total: Column, qty_raw: Column, unit_price_raw: Column) -> Column:
    """Struct of the price per unit and the unit: the stated price, else the total over the quantity text.

    For rows of a table :func:`tillwise.operators.derive.priced_items` is the faster way.
    """
    read = lambda text: F.struct(quantity_found(text).alias("found"), text.alias("text"))
    parts = lambda m: F.struct(*quantity_parts(m["found"]))
    priced = lambda m: bound(parts(m), lambda q: price_of(line_total, unit_price_raw, q["qty"], q["unit"], quantity_count(q["qty"], m["text"])))
    return bound(bound(quantity_text(qty_raw), read), priced)


def quantity_text(qty_raw: Column) -> Column:
    return F.lower(blank_to_null(qty_raw))


def quantity_found(text: Column) -> Column:
    """The first number with a unit in a :func:`quantity_text`."""
    return F.regexp_extract(text, QUANTITY, 0)


def quantity_parts(found: Column) -> tuple[Column, Column]:
    """``qty`` and ``unit`` of a :func:`quantity_found`: either is what is left without the characters of the other."""
    qty = F.translate(found, UNIT_CHARS + BLANKS, "").try_cast("double")
    return qty.alias("qty"), F.translate(found, "0123456789." + BLANKS, "").alias("unit")


def quantity_count(qty: Column, text: Column) -> Column:
    """The first number of a text in which no quantity was found."""
    return F.when(qty.isNull(), F.regexp_extract(text, COUNT, 1).try_cast("double"))


def price_of(line_total: Column, unit_price_raw: Column, qty: Column, unit: Column, count: Column) -> Column:
    """Struct of ``price`` and ``unit`` from what was read of the quantity text."""
    scaled = F.when(unit.isin("g", "ml"), qty / 1000.0).otherwise(qty)
    name = F.when(unit == "g", "kg").when(unit == "ml", "l").when(unit == "pc", "pcs").otherwise(unit)
    pair = lambda price, kind: F.struct(price.alias("price"), kind.alias("unit"))
    return (
        F.when(unit_price_raw.isNotNull(), pair(unit_price_raw, F.lit("unknown")))
        .when(qty > 0, pair(F.try_divide(line_total, scaled), name))
        .when(qty.isNull() & (count > 0), pair(F.try_divide(line_total, count), F.lit("pcs")))
        .otherwise(pair(F.lit(None).cast("double"), F.lit("unknown")))
    )


def norm_confidence(c: Column) -> Column:
    """0..1 or 0..100 to a whole number in 0..100."""
    n = total_num(c)
    scaled = F.when((n >= 0) & (n <= 1), n * 100).otherwise(n)
    return F.when(n.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), F.bround(scaled).cast("int"))))


def clamp01(c: Column) -> Column:
    # greatest and least skip nulls, so a null has to be kept apart.
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def recency_score(days: Column) -> Column:
    """1 up to a week, .6 at 30 days, 0 from 60 days on, linear in between."""
    score = (
        F.when(days <= 7, F.lit(1.0))
        .when(days <= 30, 1.0 - (days - 7) / 23.0 * 0.4)
        .when(days <= 60, 0.6 - (days - 30) / 30.0 * 0.6)
        .otherwise(F.lit(0.0))
    )
    return clamp01(score)


def iqr_stability(q25: Column, q75: Column, median: Column) -> Column:
    """1 for no spread, 0 from an interquartile range of a quarter of the median on."""
    spread = F.greatest(F.lit(0.0), q75 - q25) / F.greatest(F.lit(1e-9), median)
    return clamp01(1.0 - spread / 0.25)


#: Dekker's constant: splits a double into two halves whose products with numbers below 2^26 are exact.
SPLIT = float((1 << 27) + 1)


def half_even(c: Column | str, places: int) -> Column:
    """Presentation rounding of a double by its binary value; only true ties go to the even digit.

    The built-in rounds the shortest decimal form, which for 2.675 is a tie although the number lies below it. Where that
    form is a tie, the exact distance to it decides. Up to 7 places; beyond, and for other types, the built-in holds.
    """
    x = F.col(c) if isinstance(c, str) else c
    if not 0 <= places <= 7:
        return F.bround(x, places)
    scale = float(2 * 10**places)
    v = x.cast("double")
    nearest = F.rint(v * scale)
    tie = (F.abs(nearest) < 2.0**53) & (F.abs(nearest % 2) == 1) & (v == nearest / scale)
    high = v * SPLIT - (v * SPLIT - v)
    above = (high * scale - nearest) + (v - high) * scale
    plain = F.bround(x, places)
    return F.when(tie & (above > 0), (nearest + 1) / scale).when(tie & (above < 0), (nearest - 1) / scale).otherwise(plain)
