"""Repeated runs of consecutive units (sentences or lines) across a corpus, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

RANGES = "array<struct<a:int,b:int>>"


def windows(docs: DataFrame, units: Column, run: int, min_words: int) -> DataFrame:
    """(_id, _th, h1, h2, a, b): each run of ``run`` consecutive non-blank units with at least ``min_words`` words.

    Units are compared without surrounding white space. a and b are the places of its first and last unit.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # Each unit is trimmed, hashed and counted once; a window's hashes are those of its units' hashes.
    trimmed = F.transform(units, lambda u: F.trim(u, F.lit(" \t\n\x0b\f\r")))
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_th"), trimmed.alias("units")).where(F.size("units") >= run)

    def unit(s: Column, i: Column) -> Column:
        words = F.size(F.split(s, r"\s+")) if min_words > 1 else F.lit(1)
        return F.struct(F.xxhash64(s).alias("h1"), F.xxhash64(F.lit(1), s).alias("h2"), words.alias("n"), i.alias("i"), (s == "").alias("blank"))

    full = F.filter(F.transform("units", unit), lambda x: ~x.blank)
    rows = rows.select("_id", "_th", full.alias("full")).where(F.size("full") >= run)
    rows = rows.select("_id", "_th", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("full") - (run - 1)), lambda j: F.slice("full", j, run)
    )).alias("w"))
    if min_words > 1:
        n = F.col("w")[0].n
        for k in range(1, run):
            n = n + F.col("w")[k].n
        rows = rows.where(n >= min_words)
    return rows.select(
        "_id", "_th", F.xxhash64("w.h1").alias("h1"), F.xxhash64("w.h2").alias("h2"),
        F.col("w")[0].i.alias("a"), F.col("w")[run - 1].i.alias("b"),
    )


def covered(wins: DataFrame) -> DataFrame:
    """(_id, _th, ranges): per document the merged ranges of places that lie in a window seen earlier.

    The first occurrence of a window is the one with the smallest (doc_id, text hash, place). Counts are combined
    before the shuffle; windows that occur once are dropped; the join has one row per window on its right, so
    a window that a third of the documents share can be split over tasks.
    """
    place = F.struct("_id", "_th", "a")
    first = wins.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = first.where(F.col("first") != F.col("last")).select("h1", "h2", "first")
    return merged(wins.join(first, ["h1", "h2"]).where(place != F.col("first")).select("_id", "_th", F.struct("a", "b").alias("r")))


def merged(later: DataFrame) -> DataFrame:
    """(_id, _th, ranges): per document its ranges ``r`` merged where they overlap or touch."""
    later = later.groupBy("_id", "_th").agg(F.sort_array(F.collect_set("r")).alias("found"))

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last.a.alias("a"), F.greatest(last.b, x.b).alias("b"))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)).b >= x.a - 1), joined).otherwise(F.concat(done, F.array(x)))

    return later.select("_id", "_th", F.aggregate("found", F.array().cast(RANGES), step).cast(RANGES).alias("ranges"))


def without(docs: DataFrame, gone: DataFrame, units: Column, joiner: str, names: tuple[str, str]) -> DataFrame:
    """``docs`` with the units in ``gone`` cut from ``text``, and two columns more: units and units removed.

    A null text stays null and has no units; columns of ``docs`` with the two new names are replaced.
    """
    total, removed = names
    text = F.coalesce(F.col("text"), F.lit(""))
    # The whole row travels as one column, so none of its names can clash.
    left = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("row_id"), F.xxhash64(text).alias("row_th"), units.alias("units"))
    both = left.join(gone, left["row_id"].eqNullSafe(gone["_id"]) & (left["row_th"] == gone["_th"]), "left")
    ranges = F.coalesce("ranges", F.array().cast(RANGES))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("ranges")), lambda i: F.slice(
        "units",
        F.when(i == 0, 1).otherwise(F.get("ranges", i - 1).b + 2),
        F.when(i == F.size("ranges"), F.size("units")).otherwise(F.get("ranges", i).a)
        - F.when(i == 0, 0).otherwise(F.get("ranges", i - 1).b + 1),
    )))
    n_gone = F.aggregate(ranges, F.lit(0), lambda n, x: n + x.b - x.a + 1)
    new = {
        "text": F.when(F.size(ranges) > 0, F.array_join(kept, joiner)).otherwise(F.col("row.text")),
        total: F.size("units").cast("long"), removed: n_gone.cast("long"),
    }
    rest = {c: F.col("row").getField(c) for c in docs.columns}
    return both.select(*[c.alias(name) for name, c in (rest | new).items()])
