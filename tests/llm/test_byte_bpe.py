"""Byte-level BPE against the rank library, code point by code point and on odd texts; exact round trips."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import documents, rows_of, sample, texts
from pyspark.sql import functions as F
from test_tokens_packing import ODD

from tillwise.llm import byte_bpe as bb
from tillwise.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_each_code_point_agrees(library):
    bpe = bb.coder(RANKS)
    for start in range(0, 0x110000, 0x100):
        text = "".join(f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)} {chr(c)}!" for c in range(start, start + 0x100) if not 0xD800 <= c < 0xE000)
        assert bpe.encode(text) == library(text), hex(start)


def test_random_texts_agree(library):
    bpe = bb.coder(RANKS)
    rng = np.random.default_rng(3)
    alphabet = list("aeiothsrnlcdu'!.,-#  \n\t09éñüößÅçæ中文👩") + ["ing", "'s", "'ll", " the", "  ", "<|endoftext|>", " ", "\r\n", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, rng.integers(1, 80)))
        assert bpe.encode(text) == library(text), text


def test_parts_cut_no_match(library):
    bpe = bb.coder(RANKS)
    rng = np.random.default_rng(4)
    for _ in range(300):
        text = "".join(rng.choice(list("ab1! \n'é") + [" x", "'s "], rng.integers(0, 200)))
        cut = list(bb.parts(text, 7))
        assert "".join(cut) == text and [i for p in cut for i in bpe.encode(p)] == library(text), text


def edges():
    return [(i, t) for i, t in enumerate(ODD)] + [
        (None, "x y"), (None, None), (5, None), (5, "a b"), (5, "a b"), (77, "word " * 200_000), (78, "中" * 30_000), (79, "a" * 100_000),
    ]


def test_table(spark, library):
    rows = edges()
    out = bb.decode(bb.encode(documents(spark, rows), RANKS), RANKS)
    assert out.columns == ["doc_id", "ids", "n_tokens", "n_split", "starts", "ends", "bytes", "text"]
    got = sorted(((r.doc_id, r.text, tuple(r.ids), r.n_tokens, bytes(r.bytes)) for r in out.collect()), key=repr)
    want = [(i, t or "", tuple(library(t or "")), len(library(t or "")), (t or "").encode()) for i, t in rows]
    assert got == sorted(want, key=repr)
    assert bb.decode(bb.encode(documents(spark, []), RANKS), RANKS).count() == 0


def test_places_and_split_characters(spark):
    bpe = bb.coder(RANKS)
    rows = [(i, t) for i, t in enumerate(ODD)]
    for r in bb.encode(documents(spark, rows), RANKS).collect():
        text = rows[r.doc_id][1]
        at, part = 0, 0
        for token, a, b in zip(r.ids, r.starts, r.ends):
            size = len(bpe.tokens[token])
            assert len(text[:a].encode()) <= at and at + size <= len(text[:b].encode())
            assert len(text[:a + 1].encode()) > at and len(text[:b - 1].encode()) < at + size
            part += at != len(text[:a].encode()) or at + size != len(text[:b].encode())
            at += size
        assert at == len(text.encode()) and r.n_split == part


def test_decode_parts_of_characters(spark):
    ids = bb.coder(RANKS).encode("x👩y")
    rows = [(1, ids), (2, ids[:2]), (3, ids[2:]), (4, []), (5, None), (6, [1, None]), (7, [60_000]), (8, [-1])]
    out = bb.decode(spark.createDataFrame(rows, "k int, ids array<int>").withColumn("text", F.lit("old")), RANKS)
    got = {r.k: (r.bytes and bytes(r.bytes), r.text) for r in out.collect()}
    assert got[1] == ("x👩y".encode(), "x👩y")
    assert got[2][0] + got[3][0] == "x👩y".encode() and got[2][1] == "x�" and got[3][1].endswith("y") and "�" in got[3][1]
    assert got[4] == (b"", "") and got[5] == got[6] == got[7] == got[8] == (None, None)


def test_query(spark, sf_dir, library):
    out = QUERIES["op11_byte_bpe"](spark, sf_dir)
    assert [f"{c} {t}" for c, t in out.dtypes] == ["doc_id bigint", "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string", "n_split bigint"]
    want = []
    for doc_id, text in texts(sample(spark, sf_dir)):
        ids = library(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert rows_of(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
