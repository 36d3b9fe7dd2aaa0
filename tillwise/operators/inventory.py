"""Pantry evidence: what was seen on images, and what it does to the product state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tillwise.functions.amounts import clamp01, half_even
from tillwise.functions.dates import days_after, instant
from tillwise.functions.text import strip
from tillwise.operators.stats import top_rows

DAY_ROWS = 50
DEFAULT_CONFIDENCE = 0.7


def inventory_recently_seen(
    products: DataFrame, product_state: DataFrame, as_of, ttl_days: int = 7, keys: Sequence[str] = (), limit: int | None = None
) -> DataFrame:
    """Products whose last sighting has not expired, newest first."""
    group = [*keys, "product_id"]
    now = instant(as_of)
    state = product_state.select(*group, "last_seen_at", "last_seen_confidence").withColumn(
        "expires_at", days_after(F.col("last_seen_at"), ttl_days)
    )
    fresh = state.where((F.col("expires_at") > now) & F.lit(ttl_days > 0))
    rows = products.select(*group, "canonical_name").join(fresh, group).select(
        *group, F.coalesce("canonical_name", F.col("product_id").cast("string")).alias("product"), "last_seen_at", "expires_at",
        half_even("last_seen_confidence", 3).alias("confidence"),
    )
    return top_rows(rows, [F.col("last_seen_at").desc(), F.col("product_id")], limit, keys)


def inventory_day_rows(seen: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All sightings with their local day, the number of sightings of that day, and what is shown of each: (*keys, day, n,
    at, product_id, label). A day may have any number of rows; nothing is collected."""
    percent = half_even(F.col("confidence") * 100, 0).cast("long").cast("string")
    label = F.concat(F.col("product"), F.lit(" ("), F.coalesce(percent, F.lit("None")), F.lit("%)"))
    rows = seen.select(*keys, F.to_date("last_seen_at").alias("day"), F.unix_micros(F.col("last_seen_at")).alias("at"), "product_id", label.alias("label"))
    counts = rows.groupBy(*keys, "day").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(counts, [*keys, "day"]).select(*keys, "day", "n", "at", "product_id", "label")


def inventory_by_day(seen: DataFrame, keys: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """The sightings, or the newest ``limit``, as a list per local day for a display; a day's list is one value, so days of
    unknown size are better read from :func:`inventory_day_rows`."""
    newest = top_rows(seen, [F.col("last_seen_at").desc(), F.col("product_id")], limit, keys)
    rows = inventory_day_rows(newest, keys)
    entries = F.sort_array(F.collect_list(F.struct("at", "product_id", "label")), False)
    return rows.groupBy(*keys, "day").agg(F.max("n").alias("n"), F.transform(entries, lambda e: e["label"]).alias("items"))



def detected_items(raw: Column) -> Column:
    """Labels and confidences of a detection JSON: a list of texts or objects, or an object of flags."""
    text = strip(F.coalesce(raw, F.lit("")))
    texts = F.from_json(text, "array<string>")
    flags = F.from_json(text, "map<string,string>")

    def entry(label: Column, confidence: Column) -> Column:
        return F.struct(strip(label).alias("label"), clamp01(F.coalesce(confidence, F.lit(DEFAULT_CONFIDENCE))).alias("confidence"))

    # A list element that is an object keeps its JSON text in the plain reading; others are labels.
    parsed = F.transform(
        texts, lambda t: F.struct(t.alias("t"), F.from_json(t, "label string, name string, confidence string").alias("o"))
    )
    listed = F.transform(
        parsed,
        lambda p: F.when(
            p["t"].startswith("{"),
            entry(F.coalesce(F.nullif(p["o"]["label"], F.lit("")), p["o"]["name"], F.lit("")), p["o"]["confidence"].try_cast("double")),
        ).otherwise(entry(F.coalesce(p["t"], F.lit("")), F.lit(None).cast("double"))),
    )
    truthy = F.map_filter(flags, lambda k, v: ~F.coalesce(F.lower(v), F.lit("")).isin("", "false", "0", "0.0", "[]", "{}", "null"))
    mapped = F.transform(F.map_keys(truthy), lambda k: entry(k, F.lit(None).cast("double")))
    chosen = F.when(text.startswith("["), listed).when(text.startswith("{"), mapped)
    return F.filter(F.coalesce(chosen, F.array().cast("array<struct<label:string,confidence:double>>")), lambda d: d["label"] != "")


def explode_detections(images: DataFrame) -> DataFrame:
    """(image_id, pos, label, confidence) from ``raw_result``."""
    rows = images.select("image_id", F.posexplode(detected_items(F.col("raw_result"))).alias("pos", "_d"))
    return rows.select("image_id", "pos", "_d.label", "_d.confidence")


def apply_inventory_evidence(
    detections: DataFrame, product_state: DataFrame, as_of, keys: Sequence[str] = ()
) -> DataFrame:
    """New sighting state of every detected product; the confidence never falls.

    ``detections`` has ``product_id, confidence`` (see ``match_products`` for the ids).
    """
    group = [*keys, "product_id"]
    seen = detections.groupBy(*group).agg(F.max(clamp01(F.col("confidence"))).alias("_new"))
    old = product_state.select(*group, "last_seen_at", "last_seen_confidence")
    return seen.join(old, group, "left").select(
        *group, instant(as_of).alias("last_seen_at"),
        F.greatest("_new", "last_seen_confidence").alias("last_seen_confidence"),
        F.col("last_seen_at").alias("previous_seen_at"), F.col("last_seen_confidence").alias("previous_seen_confidence"),
    )


def merge_state(product_state: DataFrame, updates: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Product state with the columns of ``updates`` written over it, rows added where missing."""
    group = [*keys, "product_id"]
    fields = [c for c in updates.columns if c in product_state.columns and c not in group]
    marked = updates.select(*group, F.lit(True).alias("_u"), *[F.col(c).alias(f"_u_{c}") for c in fields])
    joined = product_state.join(marked, group, "full_outer")
    columns = [
        F.when(F.col("_u"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
        for c in product_state.columns
    ]
    return joined.select(*columns)
