"""Continuous jobs: file arrival, spend by period, observations, activity counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tillwise.functions.categories import category_key
from tillwise.functions.text import blank_to_null
from tillwise.operators.derive import priced_items
from tillwise.operators.products import learnt_names, match_products
from tillwise.session import settle
from tillwise.sources.files import RECEIPT_EXTENSIONS, hashed_listing
from tillwise.streaming.tables import BatchTable, newest

INBOX_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_inbox(spark: SparkSession, path: str, max_age: str = "36500d") -> DataFrame:
    """New files of a folder as a stream.

    The source skips files whose time stamp lies ``max_age`` before the newest one it has seen, and remembers the names of
    the others; the default skips none. A folder that files are moved out of stays small.
    """
    return spark.readStream.format("binaryFile").schema(INBOX_SCHEMA).option("maxFileAge", max_age).load(path)


def stream_ingest_files(
    files: DataFrame, known: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str,
    extensions=RECEIPT_EXTENSIONS, **trigger
) -> StreamingQuery:
    """Feed one file of each new content to ``sink``, however old the file is.

    The fingerprints met are keyed state of the stream (on a cluster, in the RocksDB state store), so a batch looks up its own
    contents only and reads nothing that earlier batches wrote. Each file is read and hashed once; its content goes
    before the shuffle. Contents that ``known()`` lists are left out. Of equal files that arrive together one stands
    for all. The sink has to write by batch number to be exactly-once.
    """
    unique = hashed_listing(files, extensions).dropDuplicates(["fingerprint"])

    def batch(df: DataFrame, epoch: int) -> None:
        old = known().select("fingerprint").distinct()
        sink(settle(df.join(old, "fingerprint", "left_anti").select(*df.columns, F.lit("imported").alias("status"))), epoch)

    return (
        unique.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def upsert(rows: DataFrame, path: str, checkpoint: str, keys: Sequence[str], every: int = 16, **trigger) -> StreamingQuery:
    """Write the changed rows of a running aggregate to the :class:`BatchTable` at ``path``; :func:`latest` reads them."""
    table = BatchTable(path, rows.schema, list(keys), every=every)
    return (
        rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(table.write)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def latest(spark: SparkSession, path: str, schema, keys: Sequence[str]) -> DataFrame:
    """The last written row of each key of an :func:`upsert` table."""
    return BatchTable(path, schema, list(keys)).read(spark)


def stream_spend_by_week(receipts: DataFrame, zone: str = "UTC") -> DataFrame:
    """Spend per local Monday week and category, for :func:`upsert`. A late row changes its week, however late it is: the
    state is one row per week and category.

    Receipts are shifted to wall-clock time first: windows start at fixed UTC instants, and the shift of four
    days moves their start from the epoch's Thursday to Monday.
    """
    local = receipts.withColumn("local_time", F.from_utc_timestamp("purchased_at", zone)).withColumn(
        "category", category_key(F.col("receipt_category"))
    )
    week = F.window("local_time", "7 days", "7 days", "4 days")
    return local.groupBy(week.alias("week"), "category").agg(
        F.sum("total").alias("total"), F.count(F.lit(1)).alias("receipt_count")
    ).select(F.col("week.start").alias("week_start"), "category", "total", "receipt_count")


def stream_spend_by_day(receipts: DataFrame, zone: str = "UTC") -> DataFrame:
    """Spend per local day and category; :func:`months_of` rolls days up."""
    local = receipts.withColumn("local_time", F.from_utc_timestamp("purchased_at", zone)).withColumn(
        "category", category_key(F.col("receipt_category"))
    )
    return local.groupBy(F.window("local_time", "1 day").alias("day"), "category").agg(
        F.sum("total").alias("total"), F.count(F.lit(1)).alias("receipt_count")
    ).select(F.col("day.start").alias("day_start"), "category", "total", "receipt_count")


def months_of(days: DataFrame) -> DataFrame:
    return days.groupBy(F.date_format("day_start", "yyyy-MM").alias("month"), "category").agg(
        F.sum("total").alias("total"), F.sum("receipt_count").alias("receipt_count")
    )


#: Current observations, by line item; see :func:`stream_observations`.
OBSERVED = """
    line_item_id STRING, receipt_id STRING, raw_name STRING, store_name STRING, observed_at TIMESTAMP, pack_price DOUBLE,
    unit_price DOUBLE, unit_type STRING, product_id STRING, match_confidence INT, receipt_version TIMESTAMP, arrival BIGINT
"""
#: Names of products, as :func:`tillwise.operators.products.known_names` gives them.
PRODUCT_NAMES = "name STRING, product_id STRING, seq BIGINT, canonical STRING"


def observation_table(spark: SparkSession, path: str, every: int = 16) -> BatchTable:
    schema = spark.createDataFrame([], OBSERVED).schema
    return BatchTable(path, schema, ["line_item_id"], ["receipt_version", "arrival"], every)


def product_name_table(spark: SparkSession, path: str, every: int = 16) -> BatchTable:
    return BatchTable(path, spark.createDataFrame([], PRODUCT_NAMES).schema, ["name"], (), every)


#: What is kept of an item and of a receipt.
LINE = ("line_item_id", "raw_name", "line_total", "qty_raw", "unit_price_raw", "arrival")
HEAD = ("store_name", "observed_at", "receipt_version")


def stream_observations(
    items: DataFrame, receipts: DataFrame, observed: BatchTable, checkpoint: str, names: BatchTable | None = None, **trigger
) -> StreamingQuery:
    """Price observations from two streams, items and receipts, whichever of a pair comes first.

    ``items`` has ``line_item_id, receipt_id, raw_name, line_total, qty_raw, unit_price_raw`` and a whole number
    ``arrival``; ``receipts`` has ``receipt_id, store_name, purchased_at`` and ``updated_at``. What comes is kept, without a time
    limit, in a table in the checkpoint's folder: a batch joins its items to all receipts and its receipts to the items of earlier
    batches, so an item is never lost for a late receipt, and no row has to stay in memory. A receipt that comes again with a
    later ``updated_at``, or a line item with a later ``arrival``, gives its observations anew, and ``observed`` keeps
    the newest of each line item. An item without name or total, or of an undated receipt, has no price and withdraws
    what was observed before; :func:`current_observations` leaves such rows out.

    With ``names``, items are matched to the product names of earlier batches, and the names that a batch adds are
    written under its number. A batch that is run again reads what was known before it and so writes the same rows.
    """
    heads = receipts.select("receipt_id", "store_name", F.col("purchased_at").alias("observed_at"), F.col("updated_at").alias("receipt_version"))
    both = items.select("receipt_id", F.lit(False).alias("head"), *LINE).unionByName(heads.withColumn("head", F.lit(True)), allowMissingColumns=True)
    both = both.where("receipt_id is not null")
    arrived = BatchTable(f"{checkpoint}/arrived", both.schema, ["receipt_id", "head", "line_item_id"], ["receipt_version", "arrival"], observed.every)

    def met(spark: SparkSession, epoch: int) -> DataFrame:
        """The pairs of which one side came in this batch, each with the newest receipt at hand."""
        new, old = arrived.batch(spark, epoch), arrived.stored(spark, before=epoch)
        lines, heads = ([df.where(kind).select("receipt_id", *side, "epoch") for df in (new, old)] for kind, side in (("not head", LINE), ("head", HEAD)))
        last = lambda some: newest(some, ["receipt_id"], ["receipt_version", "epoch"]).drop("epoch")
        asked = heads[1].join(lines[0].select("receipt_id"), "receipt_id", "left_semi")
        now = lines[0].drop("epoch").join(last(heads[0].unionByName(asked)), "receipt_id")
        return now.unionByName(lines[1].drop("epoch").join(last(heads[0]), "receipt_id"))

    def batch(df: DataFrame, epoch: int) -> None:
        arrived.write(df, epoch)
        rows = met(df.sparkSession, epoch)
        if names is not None:
            rows = newest(rows, ["line_item_id"], ["receipt_version", "arrival"])
        rows = rows.withColumn("raw_name", blank_to_null(F.col("raw_name")))
        live = F.col("raw_name").isNotNull() & F.col("line_total").isNotNull() & F.col("observed_at").isNotNull()
        price, unit = F.when(live, F.col("unit_price")), F.when(live, F.col("unit_type"))
        rows = priced_items(rows).withColumn("pack_price", F.col("line_total")).withColumn("unit_price", price).withColumn("unit_type", unit)
        unmatched = lambda some: some.withColumn("product_id", F.lit(None).cast("string")).withColumn("match_confidence", F.lit(None).cast("int"))
        if names is None:
            # Read once, by the write itself, so nothing is stored in between; the table's readers take the newest of each line item.
            observed.write(unmatched(rows), epoch)
            return
        rows = settle(rows)
        known = names.read(df.sparkSession, before=epoch)
        matched, aliases = match_products(rows.where("unit_price is not null"), known=known)
        names.write(learnt_names(aliases, known), epoch)
        observed.write(matched.unionByName(unmatched(rows.where("unit_price is null"))), epoch)

    return (
        both.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def current_observations(spark: SparkSession, observed: BatchTable) -> DataFrame:
    return observed.read(spark).where("unit_price is not null")


def stream_activity_counts(activities: DataFrame, size: str = "1 day") -> DataFrame:
    """Rows per window and kind, for :func:`upsert`; open windows included."""
    return activities.groupBy(
        F.window("timestamp", size).alias("w"), "kind"
    ).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "kind", "n")
