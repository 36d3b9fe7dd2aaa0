"""Near copies of texts and vectors against all pairs; sharding against its law."""

import zlib

import numpy as np
import pytest
from llm_helpers import documents, rows_of, sample, texts, words

from tillwise.llm import embedding_dedup as ed, jaccard_join as jj, shard as sh
from tillwise.llm.common import components


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def closure(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def all_pairs(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    links = []
    for i, s in enumerate(sets):
        near = {j for g in s for j in by[g] if j > i}
        links += [(i, j) for j in near if len(s & sets[j]) >= threshold * len(s | sets[j]) - 1e-9]
    label = closure(len(rows), links)
    n_links = np.bincount(np.array([x for pair in links for x in pair], int), minlength=len(rows))
    names = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            names[label[i]] = min(doc_id, names.get(label[i], doc_id))
    return sorted([(d, names.get(label[i]), int(n_links[i])) for i, (d, _) in enumerate(rows)], key=repr)


def near(base, change, rng):
    w = base.split()
    for k in rng.choice(len(w), change, replace=False):
        w[k] = f"new{rng.integers(1000)}"
    return " ".join(w)


BASE = " ".join(f"t{i}" for i in range(200))


def test_jaccard_edges(spark):
    rng = np.random.default_rng(4)
    rows = [(1, None), (2, ""), (3, "!!"), (4, "two words"), (5, "TWO, words"), (6, BASE), (7, BASE), (7, BASE), (None, BASE), (None, None)]
    rows += [(10 + i, near(BASE, i % 6, rng)) for i in range(40)]
    rows += [(100 + i, " ".join(f"u{rng.integers(50)}" for _ in range(30))) for i in range(20)]
    rows += [(200, BASE * 40), (201, BASE * 40 + " end")]
    out = jj.jaccard_join(documents(spark, rows), block=8)
    assert rows_of(out, "doc_id", "class_id", "n_links") == all_pairs(rows)
    kept = out.where("kept").select("doc_id", "class_id").collect()
    assert all(r.doc_id == r.class_id or r.class_id is None or r.doc_id is None for r in kept)
    assert jj.jaccard_join(documents(spark, [])).count() == 0


def test_jaccard_real(spark, sf_dir):
    docs = sample(spark, sf_dir)
    assert rows_of(jj.jaccard_join(docs), "doc_id", "class_id", "n_links") == all_pairs(texts(docs))


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(9)
    rows = [(i, near(BASE, 2, rng)) for i in range(700)]
    out = jj.jaccard_join(documents(spark, rows, False))
    assert rows_of(out, "doc_id", "class_id", "n_links") == all_pairs(rows)


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    least = jj.fewest()
    kept = 0
    for _ in range(300):
        u = rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 500, dtype=np.uint64)
        a, b = u[:450], u[50:]
        a, b = np.sort(a), np.sort(b)
        got = jj.similar(jj.signature(a)[None], jj.signature(b)[None], [a], [b], least, 0.8, False)
        kept += len(got[0])
    assert kept == 300


def brute_vectors(rows, threshold=0.9):
    good = [i for i, (_, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for n, i in enumerate(good):
        for j in good[n + 1:]:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links.append((i, j))
    return links


def test_embedding_edges(spark):
    rng = np.random.default_rng(2)
    rows = [(1, None), (2, [0.0] * 8), (3, [float("nan")] + [1.0] * 7), (4, [None] + [1.0] * 7), (5, [float("inf")] + [1.0] * 7), (6, []), (None, [1.0] * 8), (None, None), (7, [1.0] * 5), (8, [2.0] * 5), (9, [1e-30] * 8), (9, [1e-30] * 8)]
    centres = rng.standard_normal((30, 8))
    rows += [(100 + i, [float(np.float32(x)) for x in centres[i % 30] + 0.2 * rng.standard_normal(8)]) for i in range(300)]
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], "vec_id long, embedding array<float>, key int, blocks int")
    links = brute_vectors(rows)
    out = ed.embedding_dedup(df, block=64)
    n_links = np.bincount(np.array([x for pair in links for x in pair], int), minlength=len(rows))
    label = closure(len(rows), links)
    names = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            names[label[i]] = min(v, names.get(label[i], v))
    want = sorted([(v, names.get(label[i]), v is not None and v == names.get(label[i])) for i, (v, _) in enumerate(rows)], key=repr)
    got_links = sorted(r.n_links for r in out.collect())
    assert sum(got_links) >= 0.97 * n_links.sum() and all(a <= b for a, b in zip(got_links, sorted(n_links)))
    small = [r for r in rows_of(out, "vec_id", "n_links") if r[0] is None or r[0] < 100]
    assert small == sorted([(v, int(n_links[i])) for i, (v, _) in enumerate(rows) if v is None or v < 100], key=repr)
    assert sum(a == b for a, b in zip(rows_of(out, "vec_id", "component_id", "kept"), want)) >= 0.97 * len(want)
    assert ed.embedding_dedup(df.where("false")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_embedding_recall(spark, sf):
    df = sample(spark, f"/root/testdata/{sf}", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    x = np.array([v for _, v in rows], float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    found = sum(r.n_links for r in ed.embedding_dedup(df, block=64).collect())
    true = int((x @ x.T >= 0.9).sum()) - len(x)
    assert 0.95 * true <= found <= true


def test_dense_group_of_vectors(spark):
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(16)
    rows = [(i, [float(v) for v in centre + 0.02 * rng.standard_normal(16)]) for i in range(600)]
    rows += [(1000 + i, [float(v) for v in rng.standard_normal(16)]) for i in range(600)]
    out = ed.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=64)
    dense = [r for r in out.collect() if r.vec_id < 600]
    x = np.array([v for _, v in rows[:600]])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    assert all(r.component_id == 0 for r in dense)
    assert [r.n_links for r in sorted(dense, key=lambda r: r.vec_id)] == ((x @ x.T >= 0.9).sum(axis=1) - 1).tolist()


def against_brute_force(spark, x, block):
    """(n_links, component_id) of embedding_dedup and of all pairs, for vectors with ids 0, 1, ..."""
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    out = ed.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=block)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in out.collect())
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    link = unit @ unit.T >= 0.9
    label = np.arange(len(x))
    while (low := np.array([label[near].min() for near in link])).tolist() != label.tolist():
        label = low
    return got, [(i, int(n), int(c)) for i, (n, c) in enumerate(zip(link.sum(1) - 1, label))]


def around(rng, n, dim, cosine):
    """n vectors around one direction whose mean cosine with each other is ``cosine``."""
    centre = np.zeros(dim)
    centre[0] = np.sqrt(cosine)
    away = rng.standard_normal((n, dim))
    away[:, 0] = 0
    return centre + np.sqrt(1 - cosine) * away / np.sqrt((away * away).sum(1, keepdims=True))


def test_dense_group_many_windows_wide_is_counted_whole(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([around(rng, 1000, 32, 0.95), rng.standard_normal((2000, 32))])[rng.permutation(3000)]
    got, want = against_brute_force(spark, x, 64)
    assert got == want


@pytest.mark.parametrize("cosine, block", [(0.8, 64), (0.84, 64), (0.84, 16)])
def test_sparse_links_in_a_hot_cone(spark, cosine, block):
    rng = np.random.default_rng(12)
    x = np.concatenate([around(rng, 2000, 64, cosine), rng.standard_normal((4000, 64))])[rng.permutation(6000)]
    got, want = against_brute_force(spark, x, block)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= ed.RECALL * sum(w[1] for w in want)
    linked = [g[2] == w[2] for g, w in zip(got, want) if w[1]]
    assert sum(linked) >= ed.RECALL * len(linked)


def test_passes_grow_with_the_table():
    assert ed.passes_for(100) == 4 and ed.passes_for(10**5) < ed.passes_for(10**7) < ed.passes_for(10**9)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 3), (5, 5)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    real = [(a, b) for a, b in edges if a is not None and a != b]
    label = closure(1100, real)
    assert got == {x: label[x] for pair in real for x in pair}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shards(spark, sf_dir):
    rows = [(i, f"text {i}" * (i % 7)) for i in range(3000)] + [(None, "x"), (None, None), (5, None), (5, ""), (5, "é"), (5, "é")]
    out = sh.shard(documents(spark, rows), bucket_bytes=200)
    got = out.collect()
    assert sorted(((r.doc_id, r.text, r.size) for r in got), key=repr) == sorted(((i, t, len((t or "").encode()) + 16) for i, t in rows), key=repr)
    by, shard_of = {}, {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert shard_of.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, 40)
    assert set(by) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert rows_of(out, "doc_id", "slot") == rows_of(sh.shard(documents(spark, rows).repartition(7), bucket_bytes=200), "doc_id", "slot")
    first = sorted((r.slot, r.doc_id) for r in got if r.shard == 3 and r.doc_id is not None)
    assert [d for _, d in first] != sorted(d for _, d in first)
    assert sh.shard(documents(spark, [])).count() == 0
    docs = sample(spark, sf_dir)
    assert sh.shard(docs).count() == docs.count() and zlib.crc32(b"") == 0


def test_written_shards_hold_all_rows_in_order(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(300)] + [(None, None), (5, "long " * 400_000), (5, "text 5"), (6, "")]
    out = sh.shard(documents(spark, rows, clashing=False), 4)
    sh.write_shards(out, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert rows_of(back, "doc_id", "text", "shard", "slot") == rows_of(out, "doc_id", "text", "shard", "slot") and back.count() == len(rows)
    for folder in (tmp_path / "shards").glob("shard=*"):
        for part in folder.glob("*.parquet"):
            slots = [r.slot for r in spark.read.parquet(str(part)).select("slot").collect()]
            assert slots == sorted(slots)
