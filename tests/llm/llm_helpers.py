"""Small fixtures and plain-Python versions that the operators are held against."""

import re

from pyspark.sql import functions as F, types as T

CLASHING = ["_id", "_th", "h1", "units", "ranges", "size", "shard", "slot", "salt", "rank", "score", "lang_pred", "kept", "digest", "n_words", "spans"]
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(c, T.IntegerType()) for c in CLASHING],
])


def documents(spark, rows, clashing=True):
    """(doc_id, text[, lang]) rows as a documents table, with columns whose names the operators use themselves."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None, *[7] * len(CLASHING)) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df if clashing else df.select("doc_id", "text", "lang", "source", "n_chars")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def sample(spark, sf_dir, name="documents"):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


