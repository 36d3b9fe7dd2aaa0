"""The registered queries: their columns, whole rows, SQL twins, and the pipeline stage by stage."""

import hashlib

import pytest
from llm_helpers import documents, rows_of, sample, texts
from oracle_check import compare, connect
from test_decontaminate import plain
from test_language_pii import plain_all, plain_spans
from test_repeats import lines, sequential
from test_tokens_packing import check_packing

import corpus_pipeline
from tillwise.llm.oracle import ORACLE
from tillwise.llm.queries import QUERIES

COLUMNS = {
    "op1_substring_dedup": "doc_id bigint, n_sentences bigint, n_removed bigint, text string",
    "op2_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op3_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op4_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op5_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op6_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op7_sanitise": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op8_jaccard_join": "doc_id bigint, class_id bigint, n_links bigint, kept boolean",
    "op9_line_dedup": "doc_id bigint, n_lines bigint, n_removed bigint, text string",
    "op10_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, sf_dir, name):
    out = QUERIES[name](spark, sf_dir)
    assert ", ".join(f"{c} {t}" for c, t in out.dtypes) == COLUMNS[name]
    table, key = ("embeddings", "vec_id") if name.startswith("op4") else ("documents", "doc_id")
    got = [r[key] for r in out.collect()]
    assert sorted(set(got)) == sorted(r[0] for r in sample(spark, sf_dir, table).select(key).collect())
    assert name == "op6_packing" or len(got) == len(set(got))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE[name]) == ""


def test_op7_digest(spark, sf_dir):
    rows = texts(sample(spark, sf_dir))
    want = {d: b for d, b, _ in plain_all(rows)}
    for r in QUERIES["op7_sanitise"](spark, sf_dir).collect():
        assert r.base_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(want[r.doc_id].split(",")) * bool(want[r.doc_id])
    assert plain_spans("x 1.2.3.4")


def test_pipeline_stages(spark, sf_dir):
    docs = sample(spark, sf_dir)
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, sf_dir)
    assert kept.columns == columns and kept.count() >= 0.95 * docs.count()
    cut = stages["line_dedup"](spark, kept, sf_dir)
    want = [(d, t) for d, _, n, t in sequential(texts(kept), lines, "\n", 0) if not n or t]
    assert cut.columns == columns and rows_of(cut, "doc_id", "text") == sorted(want, key=repr)
    from test_pairs import all_pairs

    one = stages["jaccard_join"](spark, cut, sf_dir)
    first = {d for d, c, _ in all_pairs(texts(cut)) if d == c}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == first
    clean = stages["decontaminate"](spark, one, sf_dir)
    bad = {r[0] for r in plain(texts(one), [tuple(r) for r in sample(spark, sf_dir, "benchmark").select("item_id", "text").collect()]) if r[-1]}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == first - bad and bad
    check_packing(texts(clean), stages["packing"](spark, clean, sf_dir))
    assert rows_of(corpus_pipeline.run(spark, sf_dir), "doc_id", "start", "length") == rows_of(stages["packing"](spark, clean, sf_dir), "doc_id", "start", "length")


def test_stages_take_odd_rows(spark, sf_dir):
    rows = [(1, None), (2, ""), (3, "only one line here"), (3, "only one line here"), (None, "no id here"), (4, "a\nb\nc"), (5, "x\na\nb\nc"), (6, "123")]
    docs = documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.where("false")):
            out = stage(spark, table, sf_dir)
            out.collect()
            assert name == "packing" or out.columns == docs.columns
