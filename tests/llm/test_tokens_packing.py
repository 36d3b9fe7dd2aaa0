"""Token counts and packing against the tokenizer library; packing's plan against its own constraints."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import documents, rows_of, sample, texts
from tokenizers import Tokenizer

from tillwise.llm import packing, token_count

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [
    "", " ", "\n\n\t", "a", "Hello, WORLD!! it's we've I'll", "<|endoftext|>", "x<|endoftext|>y <|startoftext|>", "<|endoftext|", "<| endoftext |>",
    "é é́ é ΑΣ ΣΑΣ İstanbul ﬁ Ǆ", "中文字 テスト 한국어 ไทย हिन्दी", "123 4567 ½ Ⅷ ²", "  a　b​c", "👩‍👩‍👧 🇸🇪 ♥", "a" * 500, "ab" * 300 + "!" * 77,
    "can't CAN'T 'S 'ſ don’t", "tab\tand\r\nline", "x\x00y\x7f", "trailing   ", "   leading", "_under_score__", "İı ß ẞ",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORDS)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_counts_agree(library):
    counter = token_count.Counter(WORDS)
    for text in ODD:
        assert counter.count(text) == library(text), text


def test_random_texts_agree(library):
    counter = token_count.Counter(WORDS)
    rng = np.random.default_rng(5)
    alphabet = list("aeiothsrnlcdu'!.,-#  \n09éñüößÅçæ中") + ["ing", "tion", "'s", "the", "<|endoftext|>"]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet, rng.integers(1, 60)))
        assert counter.count(text) == library(text), text


def test_each_code_point_agrees(library):
    counter = token_count.Counter(WORDS)
    for start in range(0, 0x30000, 0x400):
        points = [chr(c) for c in range(start, start + 0x400) if not 0xD800 <= c < 0xE000]
        text = " ".join(f"a{c}b" for c in points)
        if counter.count(text) != library(text):
            bad = [hex(ord(c)) for c in points if counter.count(f"a{c}b") != library(f"a{c}b")]
            assert not bad


def test_chunk_maps_compose(library, monkeypatch):
    monkeypatch.setattr(token_count, "CHUNK", 7)
    counter = token_count.Counter(WORDS)
    rng = np.random.default_rng(8)
    for _ in range(200):
        text = "".join(rng.choice(list("abcdefg 'sé\n<|>") + ["<|endoftext|>"], rng.integers(0, 90)))
        assert counter.count(text) == library(text), text


def test_token_counts_table(spark, sf_dir, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "x y"), (5, None), (5, "a b"), (5, "a b"), (77, "word " * 30_000)]
    out = token_count.token_counts(documents(spark, rows), WORDS)
    want = [(i, len((t or "").encode()), library(t or ""), library(t or "") > 2048) for i, t in rows]
    assert rows_of(out, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert token_count.token_counts(documents(spark, []), WORDS).count() == 0
    docs = sample(spark, sf_dir)
    assert rows_of(token_count.token_counts(docs, WORDS), "doc_id", "n_tokens") == sorted([(i, library(t)) for i, t in texts(docs)], key=repr)


def check_packing(rows, out, limit=2048):
    t = Tokenizer.from_file(BYTES)
    want = []
    for doc_id, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for a in range(0, len(ids), limit):
            part = ids[a:a + limit]
            want.append((doc_id, a, len(part), zlib.crc32(part.tobytes()), len(ids)))
    assert rows_of(out, "doc_id", "start", "length", "ids_crc32", "doc_tokens") == sorted(want, key=repr)
    by = {}
    for r in out.select("sequence_id", "offset", "length").collect():
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    padding = 0
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
        padding += limit - at
    return padding / (limit * max(1, len(by)))


def test_packing_edges(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "x y"), (5, None), (5, "a b"), (5, "a b"), (77, "word " * 9000), (78, "same length") , (79, "same length")]
    check_packing(rows, packing.pack(documents(spark, rows), RANKS))
    assert packing.pack(documents(spark, []), RANKS).count() == 0


def test_packing_keeps_ids(spark):
    out = packing.pack(documents(spark, [(1, "a few words"), (2, None)]), RANKS, keep_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in out)


def test_packing_real(spark, sf_dir):
    docs = sample(spark, sf_dir)
    assert check_packing(texts(docs), packing.pack(docs, RANKS)) < 0.05


def test_ranks_are_the_librarys_ids():
    t, mine = Tokenizer.from_file(BYTES), packing.encoder(RANKS, packing.SPECIAL)
    for start in range(0, 0x30000, 0x400):
        text = " ".join(f"a{chr(c)}b {chr(c)} " for c in range(start, start + 0x400) if not 0xD800 <= c < 0xE000)
        assert mine.encode(text, allowed_special="all") == t.encode(text, add_special_tokens=False).ids, hex(start)


def test_plan_holds_each_item_once():
    rng = np.random.default_rng(2)
    for n in (1, 5, 40, 5000):
        histogram = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 257, n), return_counts=True))}
        got = {}
        for pattern, times in packing.plan(histogram, 256):
            assert sum(s * k for s, k in pattern.items()) <= 256 and times > 0
            for s, k in pattern.items():
                got[s] = got.get(s, 0) + k * times
        assert got == histogram
    assert packing.plan({}, 256) == []
