"""Changes to stored receipts: categories, updates, deletes, merges of duplicates, stuck and failed runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tillwise.functions.categories import (
    AUTO, DINING, DINING_SUBCATEGORIES, GROCERY, GROCERY_SUBCATEGORIES, MANUAL, category_alias, infer_category, source_alias,
    subcategory_alias, subcategory_allowed,
)
from tillwise.functions.dates import in_date_range, instant, ms_between
from tillwise.functions.text import blank_to_null, bound, is_image, is_pdf, normalize_store_name, semantic_store_key
from tillwise.operators.extract import ITEM, clean_items, extract_receipts, sanitize_rows
from tillwise.operators.stats import top_rows
from tillwise.session import pin

SUBCATEGORY_ROWS = "array<struct<subcategory:string,total:double>>"
MERGED_FIELDS = ("total", "purchased_at", "store_name", "currency", "raw_text", "ocr_text", "ocr_confidence", "merchant_hints", "store_entity_id")


# ---------------------------------------------------------------- categories

def auto_category(
    given: Column, value: Column, given_source: Column, category: Column, source: Column, inferred: Column
) -> tuple[Column, Column]:
    """(category, source) after an update.

    A given value wins; a given value without meaning clears both; a manual category is kept; else the inferred
    one is stored as ``auto``. ``given`` tells whether the update carries a category.
    """
    explicit = category_alias(value)
    known = source_alias(F.coalesce(given_source, source))
    new_category = F.when(given, explicit).when(known == MANUAL, category).otherwise(inferred)
    new_source = (
        F.when(given & explicit.isNotNull(), F.coalesce(given_source, known))
        .when(~given & F.coalesce(known == MANUAL, F.lit(False)), source)
        .when(~given, F.lit(AUTO))
    )
    return new_category, new_source


def auto_subcategories(
    explicit: Column, model_rows: Column, stored: Column, category: Column, category_given: Column, total: Column
) -> Column:
    """Subcategory rows after an update; ``explicit`` is null when the update carries none."""
    model = F.coalesce(model_rows, F.array().cast(SUBCATEGORY_ROWS))
    dining = F.filter(sanitize_rows(model, total), lambda r: r["subcategory"].isin(*DINING_SUBCATEGORIES))
    grocery = F.filter(sanitize_rows(model, total), lambda r: r["subcategory"].isin(*GROCERY_SUBCATEGORIES))
    whole = F.when(total > 0, F.array(F.struct(F.lit("unclassified").alias("subcategory"), F.bround(total, 2).alias("total")))).otherwise(
        F.array().cast(SUBCATEGORY_ROWS)
    )
    nothing_new = (F.size(sanitize_rows(model)) == 0) & (F.coalesce(F.size(stored), F.lit(0)) > 0) & ~category_given
    known = category_alias(category)
    allowed = F.filter(sanitize_rows(explicit), lambda r: subcategory_allowed(r["subcategory"], known))
    return (
        F.when(explicit.isNotNull(), allowed)
        .when(nothing_new, sanitize_rows(stored, total))
        .when(known == DINING, bound(dining, lambda rows: F.when(F.size(rows) > 0, F.slice(rows, 1, 1)).otherwise(whole)))
        .when(known == GROCERY, bound(grocery, lambda rows: F.when(F.size(rows) > 0, rows).otherwise(whole)))
        .otherwise(F.array().cast(SUBCATEGORY_ROWS))
    )


def subcategory_error(rows: Column, category: Column) -> Column:
    """Why typed subcategory rows are refused, or null when they are fine."""
    known = category_alias(category)

    def problem(r: Column) -> Column:
        name = subcategory_alias(r["subcategory"])
        return (
            F.when(name.isNull(), "invalid_subcategory")
            .when(~subcategory_allowed(name, known), "not_allowed_for_category")
            .when(r["total"].isNull(), "invalid_total")
            .when(r["total"] <= 0, "total_not_positive")
        )

    return F.get(F.filter(F.transform(rows, problem), lambda p: p.isNotNull()), F.lit(0))


# ---------------------------------------------------------------- loading and updating

def load_receipts(rows: DataFrame, as_of, currency: str = "kr") -> tuple[DataFrame, DataFrame]:
    """(receipts, rejects) from typed rows: ``receipt_id, total, date, store, receipt_category, raw_text,
    receipt_subcategories`` and, where there are any, ``line_items_raw``.

    The category is inferred when none is given; items are cleaned against the total. Rows without a total, with an
    unreadable date or with bad subcategories are rejected.
    A row without a date stays undated.
    """
    typed = F.coalesce(blank_to_null(F.col("receipt_category")), F.lit("")) != ""
    store = blank_to_null(F.col("store"))
    category = F.coalesce(
        category_alias(F.col("receipt_category")),
        infer_category(store, F.lit(None).cast("string"), F.col("raw_text"), F.lit(None).cast("string")),
    )
    staged = rows.withColumn("_category", category).withColumn("_ts", F.trim("date").try_cast("timestamp"))
    bad_date = blank_to_null(F.col("date")).isNotNull() & F.col("_ts").isNull()
    error = F.when(F.col("total").isNull(), "missing_total").when(bad_date, "invalid_date").otherwise(
        F.when(F.col("receipt_subcategories").isNotNull(), subcategory_error(F.col("receipt_subcategories"), F.col("_category")))
    )
    staged = staged.withColumn("error", error)
    empty = F.lit(None).cast(SUBCATEGORY_ROWS)
    good = staged.where("error is null").withColumn(
        "_rows",
        auto_subcategories(F.col("receipt_subcategories"), empty, empty, F.col("_category"), F.lit(False), F.col("total")),
    )
    items = clean_items(F.col("line_items_raw"), F.col("total")) if "line_items_raw" in rows.columns else F.array().cast(f"array<{ITEM}>")
    receipts = good.select(
        "receipt_id", "total", F.col("_ts").alias("purchased_at"), F.col("store").alias("store_name"),
        F.col("_category").alias("receipt_category"), F.when(typed, MANUAL).otherwise(AUTO).alias("receipt_category_source"),
        F.col("_rows").alias("receipt_subcategories"), items.alias("line_items_raw"), F.lit(currency).alias("currency"), "raw_text",
        F.lit("done").alias("extract_status"), instant(as_of).alias("created_at"),
    )
    return receipts, staged.where("error is not null").select(*rows.columns, "error")


def apply_receipt_updates(receipts: DataFrame, updates: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(receipts, alias corrections) after user updates.

    ``updates`` has one row per receipt: ``receipt_id, fields`` (array of the field names given) and the new
    ``store_name, purchased_at`` (text), ``total, currency, receipt_category, receipt_subcategories, line_items_raw,
    clear_line_items``. Empty texts clear date, category and currency. A row with an unreadable date, category or
    subcategory is skipped. Where ``updates`` has ``store_entity_id``, its store names are already those of stores (see
    :func:`tillwise.operators.writes.update_receipts`).
    """
    on_columns = [*keys, "receipt_id"]
    placed = "store_entity_id" in updates.columns
    u = updates.select(*on_columns, *[F.col(c).alias(f"u_{c}") for c in updates.columns if c not in on_columns])
    joined = receipts.join(u, on_columns, "left")
    given = lambda name: F.coalesce(F.array_contains("u_fields", name), F.lit(False))
    new_date = blank_to_null(F.col("u_purchased_at")).try_cast("timestamp")
    bad_date = given("purchased_at") & blank_to_null(F.col("u_purchased_at")).isNotNull() & new_date.isNull()
    raw_category = blank_to_null(F.col("u_receipt_category"))
    bad_category = given("receipt_category") & raw_category.isNotNull() & category_alias(raw_category).isNull()
    effective = F.when(given("receipt_category"), category_alias(raw_category)).otherwise(F.col("receipt_category"))
    bad_rows = given("receipt_subcategories") & subcategory_error(F.col("u_receipt_subcategories"), effective).isNotNull()
    active = joined.withColumn("_on", F.col("u_fields").isNotNull() & ~bad_date & ~bad_category & ~F.coalesce(bad_rows, F.lit(False)))
    on = F.col("_on")
    pick = lambda name, value: F.when(on & given(name), value).otherwise(F.col(name))
    staged = (
        active.withColumn("_old_store", F.col("store_name"))
        .withColumn("store_name", pick("store_name", F.col("u_store_name") if placed else normalize_store_name(F.col("u_store_name"))))
        .withColumn("purchased_at", pick("purchased_at", new_date))
        .withColumn("total", pick("total", F.col("u_total")))
        .withColumn("currency", pick("currency", blank_to_null(F.col("u_currency"))))
    )
    if placed:
        staged = staged.withColumn("store_entity_id", F.when(on & given("store_name"), F.coalesce("u_store_entity_id", "store_entity_id")).otherwise(F.col("store_entity_id")))
    inferred = infer_category(F.col("store_name"), F.col("filename"), F.col("raw_text"), F.col("ocr_text"))
    category, source = auto_category(
        given("receipt_category"), raw_category, F.when(given("receipt_category"), F.lit(MANUAL)),
        F.col("receipt_category"), F.col("receipt_category_source"), inferred,
    )
    # Worked out once: the rows below mention them many times.
    staged = pin(staged.withColumn("_category", category).withColumn("_source", source))
    changed = given("receipt_category") | ~F.col("_category").eqNullSafe(F.col("receipt_category")) | ~F.col("_source").eqNullSafe(F.col("receipt_category_source"))
    rows = auto_subcategories(
        F.when(given("receipt_subcategories"), F.col("u_receipt_subcategories")), F.lit(None).cast(SUBCATEGORY_ROWS),
        F.col("receipt_subcategories"), F.col("_category"), changed, F.col("total"),
    )
    items = (
        F.when(on & F.coalesce("u_clear_line_items", F.lit(False)), F.slice("line_items_raw", 1, 0))
        .when(on & given("line_items_raw"), clean_items(F.col("u_line_items_raw"), F.col("total")))
        .otherwise(F.col("line_items_raw"))
    )
    staged = (
        staged.withColumn("receipt_subcategories", F.when(on, rows).otherwise(F.col("receipt_subcategories")))
        .withColumn("receipt_category", F.when(on, F.col("_category")).otherwise(F.col("receipt_category")))
        .withColumn("receipt_category_source", F.when(on, F.col("_source")).otherwise(F.col("receipt_category_source")))
        .withColumn("line_items_raw", items)
    )
    corrections = staged.where(
        on & given("store_name") & F.col("store_name").isNotNull() & (F.trim("_old_store") != "") & (F.trim("_old_store") != F.trim("store_name"))
    ).select(*on_columns, F.col("_old_store").alias("old_name"), F.col("store_name").alias("new_name"))
    return staged.select(*receipts.columns), corrections


def delete_receipts(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given receipts."""
    return {name: table.join(ids.select("receipt_id"), "receipt_id", "left_anti") for name, table in tables.items()}


def reparse_receipts(
    receipts: DataFrame, as_of, since: str | None = None, until: str | None = None, limit: int | None = None, overwrite: bool = False
) -> DataFrame:
    """Receipts read again from their stored text: new values, ``changed`` and ``items_changed``.

    Undated receipts are left out when a range is given; ``limit`` takes the newest by ``created_at``.
    ``receipts`` needs ``locale`` and ``model`` columns beside the stored ones. Only changed rows are returned.
    """
    compared = ("total", "purchased_at", "store_name", "line_items_raw")
    before = receipts
    for c in compared:
        before = before.withColumn(f"_old_{c}", F.col(c))
    after = reread(before, as_of, since, until, limit, overwrite)
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    has_items = F.coalesce(F.size("line_items_raw") > 0, F.lit(False))
    needs_items = differs("line_items_raw") | ((differs("store_name") | differs("purchased_at")) & has_items)
    after = after.withColumn("items_changed", needs_items).withColumn(
        "changed", differs("total") | differs("purchased_at") | differs("store_name") | differs("line_items_raw")
    )
    return after.where("changed").drop(*[f"_old_{c}" for c in compared])


def reread(
    receipts: DataFrame, as_of, since: str | None = None, until: str | None = None, limit: int | None = None, overwrite: bool = False
) -> DataFrame:
    """The receipts of the range that have a text, with what is read from it."""
    if since and until and since > until:
        raise ValueError("since must be <= until")
    rows = receipts.where(in_date_range(F.col("purchased_at"), since, until))
    if limit is not None:
        rows = top_rows(rows, [F.col("created_at").desc(), F.col("receipt_id")], max(1, int(limit)))
    text = F.coalesce(F.nullif("ocr_text", F.lit("")), F.nullif("raw_text", F.lit("")))
    return pin(extract_receipts(rows.where(text.isNotNull()).withColumn("text", text), as_of, overwrite)).drop("text")


# ---------------------------------------------------------------- duplicates

def semantic_signature(receipts: DataFrame) -> DataFrame:
    """Adds ``_sig`` (local day, store key, total) and ``_class`` (pdf or image); null where not comparable."""
    store = semantic_store_key(F.col("store_name"))
    sig = F.when(
        F.col("purchased_at").isNotNull() & (store != "") & F.col("total").isNotNull(),
        F.concat_ws("|", F.to_date("purchased_at").cast("string"), store, F.format_string("%.2f", F.col("total"))),
    )
    return receipts.withColumn("_sig", sig).withColumn(
        "_class", F.when(is_pdf(F.col("filename")), "pdf").when(is_image(F.col("filename")), "image")
    )


def semantic_duplicates(receipts: DataFrame, source_type: str = "telegram", keys: Sequence[str] = ()) -> DataFrame:
    """(receipt_id, kept_receipt_id): the pdf or image twin of an older receipt of the same day, store and total.

    The oldest receipt of a signature is kept and every member of the other file class goes. With ``keys``, receipts of
    different keys are never twins.
    """
    keys = list(keys)
    rows = semantic_signature(receipts.where(F.col("source_type") == source_type)).where("_sig is not null and _class is not null")
    kept = rows.groupBy(*keys, "_sig").agg(F.min(F.struct("created_at", "receipt_id", "_class")).alias("_k"))
    return rows.join(kept, [*keys, "_sig"]).where("_class <> _k._class").select(
        *keys, "receipt_id", F.col("_k.receipt_id").alias("kept_receipt_id"), F.col("_sig").alias("signature")
    )


def merge_semantic_duplicates(receipts: DataFrame, duplicates: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Receipts without the duplicates; kept ones take missing fields and longer item lists from theirs."""
    on_columns = [*keys, "receipt_id"]
    pairs = duplicates.select(*on_columns, "kept_receipt_id")
    gone = receipts.join(pairs, on_columns)
    fields = [c for c in MERGED_FIELDS if c in receipts.columns]

    def first_value(c: str) -> Column:
        kind = receipts.schema[c].dataType.typeName()
        filled = F.col(c).isNotNull() & ((F.col(c) != "") if kind == "string" else F.lit(True))
        return F.min_by(F.col(c), F.when(filled, F.struct("created_at", "receipt_id"))).alias(f"_d_{c}")

    item_count = F.coalesce(F.size("line_items_raw"), F.lit(0))
    merged = gone.groupBy(*keys, F.col("kept_receipt_id").alias("receipt_id")).agg(
        *[first_value(c) for c in fields], F.max_by("line_items_raw", F.struct(item_count, "created_at", "receipt_id")).alias("_d_items"),
    )
    kept = receipts.join(pairs.select(*on_columns), on_columns, "left_anti").join(merged, on_columns, "left")
    for c in fields:
        own = F.nullif(F.col(c), F.lit("")) if receipts.schema[c].dataType.typeName() == "string" else F.col(c)
        kept = kept.withColumn(c, F.coalesce(own, f"_d_{c}"))
    longer = F.coalesce(F.size("_d_items"), F.lit(0)) > item_count
    kept = kept.withColumn("line_items_raw", F.when(longer, F.col("_d_items")).otherwise(F.col("line_items_raw")))
    return kept.select(*receipts.columns)


# ---------------------------------------------------------------- extraction state

def extraction_backlog(receipts: DataFrame) -> DataFrame:
    return receipts.where((F.coalesce("file_path", F.lit("")) != "") & F.col("extract_status").isin("pending", "failed"))


def image_backlog(images: DataFrame) -> DataFrame:
    return images.where(F.col("status").isin("pending", "failed"))


def stuck_receipts(receipts: DataFrame, as_of, older_than_minutes: int, include_missing: bool = False) -> DataFrame:
    """Queued or running receipts that have been so for at least the given minutes."""
    since = F.when(F.col("extract_status") == "running", F.col("extract_started_at")).otherwise(F.col("extract_queued_at"))
    if include_missing:
        since = F.coalesce(since, F.col("created_at"))
    cutoff = instant(as_of) - F.expr(f"INTERVAL {int(older_than_minutes)} MINUTES")
    return receipts.where(F.col("extract_status").isin("queued", "running") & (since <= cutoff) & F.lit(older_than_minutes > 0))


def reset_stuck_receipts(receipts: DataFrame, as_of, older_than_minutes: int, include_missing: bool = False) -> DataFrame:
    """Receipts with the stuck ones queued again and their timings cleared."""
    since = F.when(F.col("extract_status") == "running", F.col("extract_started_at")).otherwise(F.col("extract_queued_at"))
    if include_missing:
        since = F.coalesce(since, F.col("created_at"))
    cutoff = instant(as_of) - F.expr(f"INTERVAL {int(older_than_minutes)} MINUTES")
    stuck = F.col("extract_status").isin("queued", "running") & (since <= cutoff) & F.lit(older_than_minutes > 0)
    marked = receipts.withColumn("_stuck", F.coalesce(stuck, F.lit(False)))
    marked = marked.withColumn("extract_status", F.when(F.col("_stuck"), "queued").otherwise(F.col("extract_status")))
    marked = marked.withColumn("extract_queued_at", F.when(F.col("_stuck"), instant(as_of)).otherwise(F.col("extract_queued_at")))
    for c in ("extract_started_at", "extract_finished_at", "extract_duration_ms", "extract_queue_delay_ms"):
        if c in receipts.columns:
            marked = marked.withColumn(c, F.when(~F.col("_stuck"), F.col(c)))
    return marked.drop("_stuck")


def queue_extraction(receipts: DataFrame, as_of, ids: DataFrame | None = None) -> DataFrame:
    """``receipts`` with pending and failed ones put into the queue: those in ``ids``, or all that have a file."""
    waiting = F.col("extract_status").isin("pending", "failed")
    if ids is None:
        chosen, rows = F.coalesce("file_path", F.lit("")) != "", receipts
    else:
        chosen, rows = F.col("_asked").isNotNull(), receipts.join(ids.select("receipt_id", F.lit(True).alias("_asked")).distinct(), "receipt_id", "left")
    queue = F.coalesce(waiting & chosen, F.lit(False))
    rows = rows.withColumn("extract_queued_at", F.when(queue, instant(as_of)).otherwise(F.col("extract_queued_at")))
    return rows.withColumn("extract_status", F.when(queue, "queued").otherwise(F.col("extract_status"))).select(*receipts.columns)


def mark_extract_failed(receipts: DataFrame, failures: DataFrame, as_of) -> DataFrame:
    """Receipts with the failed ones marked, timed, their text cleared and their category inferred again.

    ``failures`` has one ``receipt_id`` per failed run.
    """
    failed = failures.groupBy("receipt_id").agg(F.count(F.lit(1)).alias("_fails"))
    rows = receipts.join(failed, "receipt_id", "left").withColumn("_hit", F.col("_fails").isNotNull())
    hit, now = F.col("_hit"), instant(as_of)
    no_text = F.lit(None).cast("string")
    inferred = infer_category(F.col("store_name"), F.col("filename"), F.col("raw_text"), F.coalesce("ocr_text", no_text))
    category, source = auto_category(
        F.lit(False), no_text, no_text, F.col("receipt_category"), F.col("receipt_category_source"), inferred
    )
    change = lambda c, value: F.when(hit, value).otherwise(F.col(c))
    rows = (
        rows.withColumn("_category", change("receipt_category", category))
        .withColumn("_source", change("receipt_category_source", source))
        .withColumn("extract_status", change("extract_status", F.lit("failed")))
        .withColumn("extract_attempts", F.coalesce("extract_attempts", F.lit(0)) + F.coalesce("_fails", F.lit(0)).cast("int"))
        .withColumn("extract_duration_ms", change("extract_duration_ms", ms_between(F.col("extract_started_at"), now)))
        .withColumn("extract_finished_at", change("extract_finished_at", now))
    )
    for c in ("extract_started_at", "extract_queued_at", "ocr_text", "ocr_confidence"):
        if c in receipts.columns:
            rows = rows.withColumn(c, F.when(~hit, F.col(c)))
    return rows.withColumn("receipt_category", F.col("_category")).withColumn(
        "receipt_category_source", F.col("_source")
    ).select(*receipts.columns)
