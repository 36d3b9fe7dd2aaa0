"""Vector codes against a plain version that compares every part with every entry, and the trees' own invariants."""

import hashlib
import math

import numpy as np
import pytest
from llm_helpers import rows_of, sample
from pyspark.sql import functions as F

from tillwise.llm import vector_codes as vc
from tillwise.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, code int, error string, ids int, of int, n int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 7, 7, 7) for r in rows], SCHEMA)


def plain(rows, parts=16, entries=64, rounds=2):
    """[(vec_id, code, error, label_error)], and the codebooks."""
    kept = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % parts == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    x = np.array([[math.floor(256 * c) for c in v] for _, v, _ in kept], np.int64).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def nearest(p):
        d = ((x[:, p, None, :] - books[p][None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        for p in range(parts):
            chosen = nearest(p)[0]
            for e in range(len(books[p])):
                mine = x[chosen == e, p]
                if len(mine):
                    books[p, e] = [int(s) // len(mine) for s in mine.sum(axis=0)]
    found = [nearest(p) for p in range(parts)]
    error = sum(d for _, d in found)
    by = {}
    for (_, _, label), e in zip(kept, error):
        by[label] = by.get(label, 0) + int(e)
    out = [(i, "".join(f"{found[p][0][k]:02x}" for p in range(parts)), int(error[k]), by[label]) for k, (i, _, label) in enumerate(kept)]
    return sorted(out, key=repr), books


COLUMNS = ["vec_id", "code", "error", "label_error"]


def made(n, dim, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((9, dim))
    x = centers[rng.integers(0, 9, n)] + spread * 0.2 * rng.standard_normal((n, dim))
    return [(int(i), [float(c) for c in v], None if i % 7 == 0 else int(i % 3)) for i, v in zip(rng.permutation(n), np.round(x, 3))]


def odd():
    v = [0.5] * 32
    return [
        (None, [0.1] * 32, 1), (None, None, None), (1, None, 1), (2, [], 1), (3, [None] + v[1:], 1), (4, [float("nan")] + v[1:], 1),
        (5, v[1:] + [float("inf")], 1), (6, [float("-inf")] * 32, 1), (7, v, 2), (7, v, 2), (7, [0.25] * 32, None), (8, [0.0] * 32, None),
        (9, [1.0] * 16, 1), (10, [1.0] * 20, 1), (11, [-0.001] * 32, 1), (12, v, 3), (-1, [0.3] * 32, 4),
    ]


@pytest.mark.parametrize("rows, block", [
    (made(900, 32, 1), 4096), (made(900, 32, 1), 100), (made(300, 64, 2, 9.0), 50), (made(40, 16, 3), 4096), (odd(), 4096), (odd(), 2),
    (made(500, 32, 4) + [(1000 + i, [0.5] * 32, 9) for i in range(400)], 300), ([(i, [1.5] * 16, 0) for i in range(200)], 64),
])
def test_same_as_plain(spark, rows, block):
    out, books = vc.vector_codes(table(spark, rows), block=block)
    want, want_books = plain(rows)
    assert np.array_equal(books, want_books) and rows_of(out, *COLUMNS) == want


def test_other_sizes(spark):
    rows = made(400, 24, 5)
    out, books = vc.vector_codes(table(spark, rows), parts=4, entries=10, rounds=5)
    want, want_books = plain(rows, 4, 10, 5)
    assert np.array_equal(books, want_books) and rows_of(out, *COLUMNS) == want


def test_no_vectors(spark):
    for rows in ([], [(1, None, None), (2, [1.0] * 3, 1)]):
        out, books = vc.vector_codes(table(spark, rows))
        assert out.columns == ["vec_id", "label", "code", "error", "label_error"] and out.count() == 0 and books.size == 0


def test_huge_components(spark):
    rows = [(i, [1e300 * (-1) ** (i + j) for j in range(16)], 1) for i in range(4)] + [(9, [1.0] * 16, 1)]
    out = {r.vec_id: r for r in vc.vector_codes(table(spark, rows), entries=1)[0].collect()}
    assert len(out) == 5 and all(r.error >= 0 and r.label_error >= r.error for r in out.values())


def test_trees():
    rng = np.random.default_rng(6)
    for points in (rng.integers(-500, 500, (3000, 4)), np.repeat(rng.integers(-9, 9, (50, 2)), 60, axis=0), np.zeros((700, 3), np.int64), rng.integers(0, 9, (1, 4))):
        tree = vc.Tree(points)
        assert sorted(tree.order) == list(range(len(points))) and (tree.first[0], tree.last[0]) == (0, len(points))
        for k in range(len(tree.first)):
            mine = points[tree.order[tree.first[k]:tree.last[k]]]
            assert np.array_equal(tree.sums[k], mine.sum(axis=0))
            assert (np.sqrt(((mine - tree.center[k]) ** 2).sum(axis=1)) <= tree.radius[k] * (1 + 1e-12) + 1e-9).all()
            if tree.left[k] >= 0:
                a, b = tree.left[k], tree.right[k]
                assert (tree.first[a], tree.last[a], tree.last[b]) == (tree.first[k], tree.first[b], tree.last[k])


def test_balls_are_owned_whole():
    """On clustered points most are counted through the cached sums of balls, and the sums are exact."""
    rng = np.random.default_rng(8)
    centers = rng.integers(-4000, 4000, (64, 4))
    points = centers[rng.integers(0, 64, 4096)] + rng.integers(-60, 60, (4096, 4))
    tree = vc.Tree(points)
    fields = {name: getattr(tree, name) for name in vc.Tree.FIELDS}
    owned, loose, chosen = vc.owners(fields, points, centers)
    assert len(loose) < 0.2 * len(points)
    count, sums = vc.totals(fields, points, centers)
    want = ((points[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert np.array_equal(count, np.bincount(want, minlength=64)) and all(np.array_equal(sums[e], points[want == e].sum(axis=0)) for e in range(64))
    assert np.array_equal(vc.codes(fields, points, centers)[0], want)


def test_query(spark, sf_dir):
    out = QUERIES["op12_vector_codes"](spark, sf_dir)
    assert [f"{c} {t}" for c, t in out.dtypes] == ["vec_id bigint", "code string", "error bigint", "label_error bigint", "codebooks_sha256 string"]
    rows = [(r.vec_id, r.embedding, r.label) for r in sample(spark, sf_dir, "embeddings").collect()]
    want, books = plain(rows)
    assert rows_of(out, *COLUMNS) == want
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel()).encode()).hexdigest()
    assert [r[0] for r in out.select("codebooks_sha256").distinct().collect()] == [digest] and out.where(F.col("code").isNull()).count() == 0
