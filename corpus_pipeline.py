"""A corpus pipeline: each stage reads the documents that the one before kept, written as Parquet in between.

Language ID drops documents without a recognisable language; line dedup cuts repeated lines; the Jaccard join keeps one
document of each group of near copies; decontamination drops documents that hold benchmark passages; packing lays out
what remains in training sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillwise.llm import decontaminate as dc, jaccard_join as jj, language_id as li, line_dedup as ld, packing as pk, token_count as tc
from tillwise.session import ensure_checkpoint_dir

#: A document whose best language contains less than this share of its n-grams has none.
MIN_SCORE = 0.2


def _whole(docs: DataFrame) -> DataFrame:
    """(row, r_id, r_th): each row as one column, so that none of its names can clash, with its key."""
    th = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("r_id"), th.alias("r_th"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; learns from the labelled ones that are not held out.

    Texts that are null, have no letters or fit no language are rejected, rows with a null lang are judged alike.
    """
    learned = li.learn(docs.where(~li.held_out(F.col("doc_id"))))
    judged = li.identify(docs.select(F.struct(*docs.columns).alias("row"), "text"), learned)
    return judged.where((F.col("lang_pred") != li.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated lines; n_chars follows the text. A document of which nothing is left goes, as nothing is lost."""
    out = ld.line_dedup(docs.select(*docs.columns)).where((F.col("n_removed") == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        cut = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, cut).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group that near-copy links join; rows alike in id and text stay one."""
    kept = jj.jaccard_join(docs).where("kept").select(F.col("doc_id").alias("k_id"), F.col("_th").alias("k_th")).distinct()
    left = _whole(docs.dropDuplicates(["doc_id", "text"]))
    both = left.join(kept, left["r_id"].eqNullSafe(kept["k_id"]) & (left["r_th"] == kept["k_th"]), "left_semi")
    return both.select("row.*")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which an item of the benchmark was found."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = dc.decontaminate(docs, items).where("contaminated").select(F.col("doc_id").alias("b_id"), F.col("_th").alias("b_th"))
    left = _whole(docs)
    both = left.join(bad, left["r_id"].eqNullSafe(bad["b_id"]) & (left["r_th"] == bad["b_th"]), "left_anti")
    return both.select("row.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents with their places in training sequences."""
    out = pk.pack(docs, tc.vocabulary_path("byte_bpe_50k.tiktoken"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language), ("line_dedup", lines), ("jaccard_join", near_copies),
    ("decontaminate", benchmark), ("packing", sequences),
]

#: SQL can express neither MinHash clusters nor byte-pair encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared checkpoint folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
