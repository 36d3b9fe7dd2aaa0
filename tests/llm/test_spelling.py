"""Spelling variants against a plain version that compares every pair of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_helpers import documents, rows_of, sample, texts

from tillwise.llm import spelling as sp
from tillwise.llm.queries import QUERIES


def plain_counts(rows, rare=31):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if rare and h % rare == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def edits(a, b):
    """Edit distance by the usual table, two rows of it."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def plain(rows, rare=31, times=10):
    counts = plain_counts(rows, rare)
    near = {w: [] for w in counts}
    words = sorted(counts)
    for i, a in enumerate(words):
        for b in words[i + 1:]:
            if abs(len(a) - len(b)) <= 1 and edits(a, b) == 1:
                near[a].append(b)
                near[b].append(a)
    forms = {}
    for w in words:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = []
    for w in words:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, counts[w], len(near[w]), counts[forms[w]] if forms[w] else None))
    return sorted(out, key=repr)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def repeated(counts):
    return [(i, " ".join([w] * n)) for i, (w, n) in enumerate(counts.items())]


EDGES = repeated({
    "kitchen": 2000, "kitchn": 50, "kitchens": 150, "kitchene": 9, "kitchenez": 2, "kitchenezz": 2, "kithcen": 40, "Kitchen": 3, "KITCHEN": 2, "kitchenx": 100,
    "abcdefg": 20, "abcdefh": 200, "abcdefi": 200, "abcdef": 500, "gfedcba": 20, "abcdegf": 3, "élévation": 30, "elévation": 3, "elevation": 2, "ÉLÉVATION": 2,
    "straße": 9, "strasse": 90, "strassen": 9, "über×mut": 5, "übermut÷": 50, "lonely1word": 2, "once": 100, "singleton": 1, "don't": 4, "xxxxxxxxx": 20, "xxxxxxxx": 2,
}) + [
    (None, "kitchen kitchem kitchem"), (None, None), (900, None), (900, ""), (901, "kitchem"), (901, "kitchem"), (902, "kitchen-kitchen_kitchen\nkitchen9kitchen"),
    (903, "a" * 3000 + " " + "a" * 3000 + " " + "a" * 2999 + "b " + "a" * 2999 + "b " + "a" * 3001 + " " + "a" * 3001), (904, "mañanaś mañanaś " * 40 + "日本語kitchen日本語 "),
]


@pytest.mark.parametrize("rare", [31, None, 2])
def test_edges(spark, rare):
    assert rows_of(sp.spelling_variants(documents(spark, EDGES), rare), *COLUMNS) == plain(EDGES, rare)


def test_small_blocks_and_random_words(spark):
    rng = np.random.default_rng(7)
    words = {"".join(rng.choice(list("abé"), rng.integers(7, 10), p=[0.6, 0.3, 0.1])): int(rng.choice([2, 3, 30, 400])) for _ in range(700)}
    rows = repeated(words)
    want = plain(rows, None)
    assert sum(r[4] for r in want) > 800 and any(r[1] for r in want)
    for block in (4096, 7):
        assert rows_of(sp.spelling_variants(documents(spark, rows), None, block=block), *COLUMNS) == want


def test_long_chain_of_forms(spark):
    rows = repeated({"chainaaa": 2, "chainaab": 20, "chainabb": 200, "chainbbb": 2000, "chaibbbb": 20000})
    got = {r.word: r.root for r in sp.spelling_variants(documents(spark, rows), None).collect()}
    assert set(got.values()) == {"chaibbbb"} and len(got) == 5


def test_one_edit():
    rng = np.random.default_rng(9)
    words = sorted({"".join(rng.choice(list("abÿ"), rng.integers(1, 6))) for _ in range(400)})
    side = sp.Side(words, [2] * len(words))
    i, j = map(np.ravel, np.meshgrid(range(len(words)), range(len(words))))
    i, j = i[i != j], j[i != j]
    assert sp.one_edit(side, i, side, j).tolist() == [edits(words[a], words[b]) == 1 for a, b in zip(i, j)]
    want = {(a, b) for a, b in zip(i.tolist(), j.tolist()) if a < b and edits(words[a], words[b]) == 1}
    assert set(sp.near_pairs(side, side)) == want


def test_no_words(spark):
    for rows in ([], [(1, None)], [(2, "tiny words only")]):
        out = sp.spelling_variants(documents(spark, rows))
        assert out.columns == COLUMNS and out.count() == 0


def test_query(spark, sf_dir):
    out = QUERIES["op13_spelling_variants"](spark, sf_dir)
    assert [f"{c} {t}" for c, t in out.dtypes] == ["word string", "form string", "root string", "n bigint", "n_near bigint", "form_n bigint"]
    rows = texts(sample(spark, sf_dir))
    counts = plain_counts(rows)
    got = {r.word: r for r in out.collect()}
    assert {w: r.n for w, r in got.items()} == counts
    letters = sp.LETTERS
    for w, r in got.items():
        made = {w[:i] + c + w[i + k:] for i in range(len(w) + 1) for c in (*letters, "") for k in (0, 1)} - {w}
        near = sorted((x for x in made if x in counts), key=lambda x: (-counts[x], x))
        form = near[0] if near and counts[near[0]] >= 10 * counts[w] else None
        assert (r.n_near, r.form, r.form_n) == (len(near), form, counts.get(form))
        assert r.root == (got[form].root if form else w)
