"""The registered queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillwise.llm import (
    byte_bpe as bb, decontaminate as dc, embedding_dedup as ed, jaccard_join as jj, language_id as li, line_dedup as ld, packing as pk,
    sanitise as sa, shard as sh, spelling as sp, substring_dedup as sd, token_count as tc, vector_codes as vc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sd.substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_sentences", "n_removed", "text")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dc.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tc.token_counts(_table(spark, sf_dir, "documents"), tc.vocabulary_path("word_bpe_49k.json"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sh.shard(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pk.pack(_table(spark, sf_dir, "documents"), tc.vocabulary_path("byte_bpe_50k.tiktoken"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sa.find_personal(_table(spark, sf_dir, "documents"))
    counts = [_of_kind(kind).alias(f"n_{kind}") for kind in sa.PATTERNS]
    return out.select("doc_id", *counts, F.sha2(sa.span_text(F.col("base")), 256).alias("base_sha256"), sa.span_text(F.col("spans")).alias("spans"))


def _of_kind(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x.kind == kind)).cast("long")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jj.jaccard_join(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "kept")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ld.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = li.learn(docs.where(~li.held_out(F.col("doc_id"))))
    out = li.identify(docs.select("doc_id", "text"), learned)
    return out.select("doc_id", li.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bb.round_trip(_table(spark, sf_dir, "documents"), tc.vocabulary_path("byte_bpe_50k.tiktoken"))
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return out.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"), "n_split")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = vc.vector_codes(_table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.spelling_variants(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_decontaminate, op3_token_counts, op4_embedding_dedup, op5_sharding, op6_packing,
    op7_sanitise, op8_jaccard_join, op9_line_dedup, op10_language_id, op11_byte_bpe, op12_vector_codes, op13_spelling_variants,
    pipeline,
)}
