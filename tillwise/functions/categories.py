"""Receipt categories, subcategories and statuses."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from tillwise.functions.text import blank_to_null, bound, contains_any, fold, strip

GROCERY, DINING = "grocery", "dining"
AUTO, MANUAL = "auto", "manual"

# Spellings of the two categories and of the category sources.
CATEGORY_ALIASES = {
    "grocery": GROCERY, "groceries": GROCERY,
    "eat_out": DINING, "eating_out": DINING, "dining": DINING, "restaurant": DINING, "takeout": DINING,
    "take_away": DINING, "takeaway": DINING, "food_delivery": DINING, "delivery": DINING,
}
SOURCE_ALIASES = {"auto": AUTO, "automatic": AUTO, "manual": MANUAL}
# Words that make a store or a text a dining receipt.
DINING_STORE_WORDS = (
    "restaurant", "restaurang", "pizzeria", "pizza", "burger", "kebab", "sushi", "bistro", "cafe", "coffee",
    "bar", "pub", "grill", "takeaway", "take away", "delivery", "doordash", "uber eats", "ubereats", "foodora",
    "wolt", "just eat", "bolt food", "mcdonald", "burger king", "pizza hut", "domino", "kfc", "subway",
)
DINING_TEXT_WORDS = ("doordash", "uber eats", "ubereats", "foodora", "wolt", "just eat", "bolt food")
# Subcategory names allowed for each category, their aliases, and the vice keys.
GROCERY_SUBCATEGORIES = (
    "fresh_produce", "dairy", "eggs", "meat_seafood", "bakery", "frozen", "pantry", "snacks_beverages",
    "household", "personal_care", "baby_child", "pet_care", "pharmacy_health", "ready_meals", "fees_deposits",
    "tobacco_nicotine", "alcohol_beer", "alcohol_wine", "alcohol_spirits", "alcohol_cider", "unclassified",
)
DINING_SUBCATEGORIES = ("delivery_meal", "fast_food", "cafe_coffee", "bar_pub", "takeout_pickup", "restaurant")
SUBCATEGORY_ALIASES = {"dairy_eggs": "dairy"}
VICE_SUBCATEGORIES = ("alcohol_beer", "alcohol_wine", "alcohol_spirits", "alcohol_cider", "tobacco_nicotine")
# Names that count as unknown.
UNKNOWN_CATEGORIES = ("", "unknown", "uncategorized", "unclassified", "other", "none", "null")
UNKNOWN_SUBCATEGORIES = UNKNOWN_CATEGORIES + ("misc", "miscellaneous")
RESIDUAL_TOLERANCE = 0.009

#: Raw error texts are shown up to this length.
REASON_CHARS = 220


def key_of(c: Column) -> Column:
    """Lower-case key with underscores for spaces and dashes."""
    return F.translate(strip(F.lower(F.coalesce(c, F.lit("")))), " -", "__")


def category_key(c: Column) -> Column:
    key = key_of(c)
    return F.when(key == "", F.lit("uncategorized")).otherwise(key)


def is_unknown_category(c: Column) -> Column:
    return strip(F.lower(F.coalesce(c, F.lit("")))).isin(*UNKNOWN_CATEGORIES)


def is_unknown_subcategory(c: Column) -> Column:
    return key_of(c).isin(*UNKNOWN_SUBCATEGORIES)


def _lookup(table: dict, key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.element_at(pairs, key)


def category_alias(c: Column) -> Column:
    """grocery or dining for any known spelling, else null."""
    return _lookup(CATEGORY_ALIASES, F.regexp_replace(fold(strip(c)), "[ -]", "_"))


def source_alias(c: Column) -> Column:
    return _lookup(SOURCE_ALIASES, fold(strip(c)))


def subcategory_alias(c: Column) -> Column:
    """Known subcategory name for any spelling, else null."""
    key = bound(F.translate(fold(strip(c)), " -", "__"), lambda k: F.coalesce(_lookup(SUBCATEGORY_ALIASES, k), k))
    return bound(key, lambda k: F.when(k.isin(*GROCERY_SUBCATEGORIES, *DINING_SUBCATEGORIES), k))


def subcategory_allowed(name: Column, category: Column) -> Column:
    in_grocery, in_dining = name.isin(*GROCERY_SUBCATEGORIES), name.isin(*DINING_SUBCATEGORIES)
    return F.when(category == GROCERY, in_grocery).when(category == DINING, in_dining).otherwise(in_grocery | in_dining)


def infer_category(
    store: Column, filename: Column, raw_text: Column, ocr_text: Column, verdict: Column | None = None,
    whole_words: bool = False,
) -> Column:
    """Category from a given verdict, else from store and file words, else from text words, else grocery.

    ``whole_words`` stops short hints such as ``bar`` from matching inside longer words.
    """

    def joined(a: Column, b: Column) -> Column:
        return fold(F.concat_ws(" ", F.coalesce(a, F.lit("none")), F.coalesce(b, F.lit("none"))))

    def hit(c: Column, words) -> Column:
        if whole_words:
            return c.rlike(r"(?U)\b(?:" + "|".join(words) + r")\b")
        return contains_any(c, words)

    inferred = (
        F.when(hit(joined(blank_to_null(store), blank_to_null(filename)), DINING_STORE_WORDS), DINING)
        .when(hit(joined(blank_to_null(raw_text), blank_to_null(ocr_text)), DINING_TEXT_WORDS), DINING)
        .otherwise(GROCERY)
    )
    return inferred if verdict is None else F.coalesce(category_alias(verdict), inferred)


def effective_status(status: Column, file_path: Column) -> Column:
    """The stored status; without one, pending for files and done for typed receipts."""
    has_file = F.coalesce(file_path, F.lit("")) != ""
    return F.coalesce(F.nullif(status, F.lit("")), F.when(has_file, "pending").otherwise("done"))


def failure_reason(c: Column) -> Column:
    """Readable class of a raw error text, at most REASON_CHARS of it; to group, take :func:`failure_class`."""
    return shortened(failure_class(c))


def shortened(reason: Column) -> Column:
    return F.when(F.length(reason) > REASON_CHARS, F.concat(F.substring(reason, 1, REASON_CHARS), F.lit("..."))).otherwise(reason)


def failure_class(c: Column) -> Column:
    """Class of a raw error text: a known kind, or the whole text."""
    raw = strip(F.coalesce(c, F.lit("")))
    low = F.lower(raw)
    compact = F.replace(raw, F.lit("\n"), F.lit(" "))
    return (
        F.when(contains_any(low, ("insufficient_quota", "openai http 429")), "quota_exceeded")
        .when(contains_any(low, ("rate_limit", "too many requests")), "rate_limited")
        .when(low.contains("timeout"), "timed_out")
        .when(low.contains("http 401"), "bad_credentials")
        .when(low.contains("http 403"), "access_denied")
        .when(low.contains("http 404") & low.contains("model"), "model_not_found")
        .when(low.contains("http 5"), "provider_error")
        .when(raw == "", "parse_failed")
        .otherwise(compact)
    )
