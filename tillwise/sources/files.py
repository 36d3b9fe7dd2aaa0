"""Inbox files and uploads: listing, content hashes, new against known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillwise.functions.categories import AUTO, infer_category
from tillwise.functions.text import (
    IMAGE_EXTENSIONS, RECEIPT_EXTENSIONS, contains_any, file_ext, fold, safe_filename,
)

MAX_UPLOAD_BYTES = 25 * 1024 * 1024
# Caption words that decide what an upload shows.
PANTRY_WORDS = ("inventory", "fridge", "pantry", "cupboard", "kyl", "skafferi")
RECEIPT_WORDS = ("receipt", "kvitto", "kvittot")


def read_inbox(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").load(path)


def fingerprint(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def known_fingerprints(processed: DataFrame, receipts: DataFrame) -> DataFrame:
    """Fingerprints of processed files and of stored receipts."""
    stored = receipts.where(F.coalesce("content_hash", F.lit("")) != "").select(
        F.concat(F.lit("sha256:"), F.col("content_hash")).alias("fingerprint")
    )
    by_hash = processed.where(F.coalesce("content_hash", F.lit("")) != "").select(
        F.concat(F.lit("sha256:"), F.col("content_hash")).alias("fingerprint")
    )
    return processed.select("fingerprint").unionByName(by_hash).unionByName(stored).where("fingerprint is not null").distinct()


def hashed_listing(files: DataFrame, extensions) -> DataFrame:
    """Wanted files with their fingerprint; the content itself is dropped before anything is shuffled."""
    name = F.element_at(F.split("path", "/"), -1)
    wanted = files.withColumn("filename", name).where(file_ext(F.col("filename")).isin(*extensions))
    return wanted.select(
        "path", "filename", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"),
        fingerprint(F.col("content")).alias("fingerprint"),
    )


def split_new_and_duplicate(listing: DataFrame, known: DataFrame, order: str = "path") -> DataFrame:
    """Listing with ``status``: the first file of an unknown content is ``imported``, all others ``duplicate``.

    The first file per content is found by an aggregate, so any number of copies meets in partial results only.
    """
    first = listing.groupBy("fingerprint").agg(F.min(order).alias("_first")).join(known, "fingerprint", "left_anti")
    marked = listing.join(first, "fingerprint", "left")
    new = F.col("_first").isNotNull() & (F.col(order) == F.col("_first"))
    return marked.withColumn("status", F.when(new, "imported").otherwise("duplicate")).drop("_first")


def dedupe_by_content(listing: DataFrame, order: str = "path") -> DataFrame:
    """The first row of every content."""
    others = [c for c in listing.columns if c not in ("fingerprint", order)]
    first = listing.groupBy("fingerprint").agg(F.min(F.struct(order, *others)).alias("_f"))
    return first.select("fingerprint", "_f.*")


def scan_receipt_files(files: DataFrame, known: DataFrame) -> DataFrame:
    return split_new_and_duplicate(hashed_listing(files, RECEIPT_EXTENSIONS), known)


def scan_inventory_images(files: DataFrame, known: DataFrame) -> DataFrame:
    return split_new_and_duplicate(hashed_listing(files, IMAGE_EXTENSIONS), known)


def imported_receipts(scanned: DataFrame, as_of) -> DataFrame:
    """Receipt rows for the new files of a scan."""
    new = scanned.where("status = 'imported'")
    none = F.lit(None).cast("string")
    return new.select(
        F.substring(F.sha2(F.concat_ws("|", "fingerprint", "path"), 256), 1, 32).alias("receipt_id"),
        F.col("path").alias("file_path"), "filename", F.regexp_replace("fingerprint", "^sha256:", "").alias("content_hash"),
        infer_category(none, F.col("filename"), none, none).alias("receipt_category"),
        F.lit(AUTO).alias("receipt_category_source"), F.lit("queued").alias("extract_status"),
        F.lit(as_of).cast("timestamp").alias("created_at"),
    )


def detected_ext(content: Column) -> Column:
    """Extension told by the first bytes of a file, else null."""
    head = F.hex(F.substring(content, 1, 16))
    return (
        F.when(head.startswith("25504446"), ".pdf").when(head.startswith("FFD8FF"), ".jpg")
        .when(head.startswith("89504E470D0A1A0A"), ".png")
        .when(head.startswith("52494646") & head.contains("57454250"), ".webp")
        .when(F.substring(head, 9, 16).isin("6674797068656963", "6674797068656966"), ".heic")
    )


def classify_upload(filename: Column, caption: Column, content: Column) -> Column:
    """(kind, confidence, reason) of an upload, from its caption, extension and first bytes."""
    low = fold(F.coalesce(caption, F.lit("")))
    ext = file_ext(filename)
    pdf_bytes = F.coalesce(detected_ext(content) == ".pdf", F.lit(False))

    def verdict(kind: str, confidence: float, reason: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))

    return (
        F.when(contains_any(low, PANTRY_WORDS), verdict("inventory", 0.95, "caption_keyword"))
        .when(contains_any(low, RECEIPT_WORDS), verdict("receipt", 0.95, "caption_keyword"))
        .when((ext == ".pdf") | pdf_bytes, verdict("receipt", 0.95, "pdf_default_receipt"))
        .when(~ext.isin(*IMAGE_EXTENSIONS), verdict("receipt", 0.4, "unknown_extension_default_receipt"))
        .otherwise(verdict("receipt", 0.4, "no_model_default_receipt"))
    )


def refused_uploads(uploads: DataFrame, allowed_chats: DataFrame | None) -> DataFrame:
    """(upload_id, chat_id, reason) of the uploads that :func:`ingest_uploads` leaves out: ``too_large`` or ``chat_not_allowed``."""
    rows = uploads.select("upload_id", "chat_id", (F.length("content") > MAX_UPLOAD_BYTES).alias("_large"))
    reason = F.when(F.col("_large"), "too_large")
    if allowed_chats is not None:
        rows = rows.join(allowed_chats.select("chat_id", F.lit(True).alias("_on_list")).distinct(), "chat_id", "left")
        reason = F.when(F.col("_on_list").isNull(), "chat_not_allowed").otherwise(reason)
    return rows.select("upload_id", "chat_id", reason.alias("reason")).where("reason is not null")


def ingest_uploads(uploads: DataFrame, allowed_chats: DataFrame | None, known: DataFrame) -> DataFrame:
    """Uploads of allowed chats within the size limit, classified, hashed and marked new or duplicate.

    The others are told by :func:`refused_uploads`.

    ``uploads`` has ``upload_id, chat_id, filename, caption, content``; without an allow-list every chat passes.
    """
    rows = uploads.where(F.length("content") <= MAX_UPLOAD_BYTES)
    if allowed_chats is not None:
        rows = rows.join(allowed_chats.select("chat_id"), "chat_id", "left_semi")
    none = F.lit(None).cast("string")
    listing = rows.select(
        "upload_id", "chat_id", safe_filename(F.col("filename"), "receipt_upload").alias("filename"), "caption",
        F.length("content").cast("long").alias("size"), fingerprint(F.col("content")).alias("fingerprint"),
        classify_upload(F.col("filename"), F.col("caption"), F.col("content")).alias("_v"),
    )
    marked = split_new_and_duplicate(listing, known, "upload_id")
    return marked.select(
        "upload_id", "chat_id", "filename", "size", "fingerprint", "status", "_v.kind", "_v.confidence", "_v.reason",
        infer_category(none, F.col("filename"), F.col("caption"), none).alias("receipt_category"),
        F.lit("telegram").alias("source_type"),
    )


def allowed_chat_ids(spark: SparkSession, text: str) -> DataFrame | None:
    """Allow-list from a setting such as ``"12, 34"``; an empty setting allows every chat."""
    numbers = [int(p) for p in text.replace(",", " ").split() if p.lstrip("-").isdigit()]
    return spark.createDataFrame([(n,) for n in numbers], "chat_id long") if numbers else None
