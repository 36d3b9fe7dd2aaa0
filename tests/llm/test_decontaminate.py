"""Winnowing against a plain window search."""

import hashlib

import numpy as np
from llm_helpers import documents, rows_of, sample, texts, words

from tillwise.llm import decontaminate as dc, words as W


def plain(rows, items, window=10):
    windows = {}
    for item_id, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i:i + n]), set()).add(item_id)
    lengths = {len(k) for k in windows}
    out = []
    for doc_id, text in rows:
        w, hit, ids = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    ids |= {str(x) for x in windows[tuple(w[i:i + n])] if x is not None}
        out.append((doc_id, len(w), len(hit), ",".join(sorted(ids)), bool(hit)))
    return sorted(out, key=repr)


def found(docs, items):
    out = dc.decontaminate(docs, items)
    return sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r.item_ids), r.contaminated) for r in out.collect()), key=repr)


LONG = " ".join(f"w{i % 701}" for i in range(6000))
ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog near a river bank today"), (2, "short one"), (3, None), (4, ""), (5, "!!!"),
    (10, "the QUICK brown fox jumps over the lazy dog near"), (11, "a a a a a a a a a a a a"), (12, "Ünï cödé wörds are also words in this"),
    (13, " ".join(f"w{i % 701}" for i in range(650, 720))), (None, "quick brown fox jumps over the lazy dog near a"),
]
ROWS = [
    (1, "x y THE QUICK, brown fox; jumps over the lazy dog near a z"), (2, "a short-one here"), (3, None), (4, ""), (5, "a " * 15), (6, "a " * 9),
    (7, LONG), (7, LONG), (None, "ünï cödé wörds are also words in this"), (8, "Ünï cödé wörds are also words in this"),
    (9, "over the lazy dog near a river bank today the quick brown fox jumps"), (10, "short"), (11, "one short one"),
]


def test_edges(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert found(documents(spark, ROWS), items) == plain(ROWS, ITEMS)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert found(documents(spark, ROWS), none) == plain(ROWS, [])
    assert found(documents(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")) == []


def test_real_texts(spark, sf_dir):
    docs, items = sample(spark, sf_dir), sample(spark, sf_dir, "benchmark")
    want = plain(texts(docs), [tuple(r) for r in items.select("item_id", "text").collect()])
    got = found(docs, items)
    assert got == want and any(r[-1] for r in got)
    assert hashlib.sha256(got[0][3].encode()).hexdigest()


def test_every_window_shares_a_fingerprint():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 9, 500).astype(np.uint64)
    grams = W.grams(text, dc.GRAM)
    kept = set(dc.winnow(grams, np.ones(len(grams), bool), 6)[1].tolist())
    for i in range(len(text) - 9):
        own = W.grams(text[i:i + 10], dc.GRAM)
        assert i + int(dc.winnow(own, np.ones(len(own), bool), 6)[1][0]) in kept


def test_word_split_agrees_with_the_pattern():
    rng = np.random.default_rng(1)
    letters = "aZ09 .é中\n{`"
    for _ in range(60):
        parts = ["".join(rng.choice(list(letters), rng.integers(0, 40))) for _ in range(5)] + ["x" * 9000 + " y"]
        data = "".join(parts).encode()
        offsets = np.r_[0, np.cumsum([len(p.encode()) for p in parts])]
        low, starts, ends, first = W.split(np.frombuffer(data, np.uint8), offsets)
        got = [low[a:b].tobytes().decode() for a, b in zip(starts, ends)]
        assert [got[first[i]:first[i + 1]] for i in range(len(parts))] == [words(p) for p in parts]
        hashed = W.hashes(low, starts, ends)
        by = {}
        for w, h in zip(got, hashed.tolist()):
            assert by.setdefault(w, h) == h
        assert len(set(by.values())) == len(by)
