"""Line and substring dedup against a sequential version."""

import re

import pytest
from llm_helpers import documents, rows_of, sample, texts

from tillwise.llm.line_dedup import line_dedup
from tillwise.llm.substring_dedup import SENTENCE, SPACELESS, substring_dedup


def sequential(rows, cut, joiner, least):
    """Walks the rows in order of (doc_id, text), remembering every window seen."""
    seen, out = {}, []
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    result = {}
    for doc_id, text in order:
        units = cut(text)
        full = [(i, u.strip()) for i, u in enumerate(units) if u.strip()]
        gone = set()
        for w in zip(full, full[1:], full[2:]):
            body = "\n".join(s for _, s in w)
            if len(body.split()) < least:
                continue
            place = (doc_id, text, w[0][0])
            if seen.setdefault(body, place) != place:
                gone |= set(range(w[0][0], w[2][0] + 1))
        result[doc_id, text] = (len(units), len(gone), joiner.join(u for i, u in enumerate(units) if i not in gone) if gone else text)
    for row in rows:
        out.append((row[0], *result[row]))
    return sorted(out, key=repr)


def passages(rows, least=30, own=False):
    """The rule of substring dedup, document by document in order of (doc_id, text hash is left to distinct ids)."""
    seen, result = {}, {}
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for doc_id, text in order:
        units = sentences(text)
        full = [(i, u.strip(" \t\n\x0b\f\r")) for i, u in enumerate(units) if u.strip(" \t\n\x0b\f\r")]
        found, mine = set(), []
        for w in zip(full, full[1:], full[2:]):
            body = "\n".join(s for _, s in w)
            if body in seen or own and body in mine:
                found |= set(range(w[0][0], w[2][0] + 1))
            mine.append(body)
        for body in mine:
            seen.setdefault(body, doc_id)
        gone, span = set(), []
        for i in range(len(units) + 1):
            if i in found:
                span.append(i)
            else:
                words = sum(len(re.findall(rf"[{SPACELESS}]|[^ \t\n\x0b\f\r{SPACELESS}]+", units[k])) for k in span)
                gone |= set(span) if words >= least else set()
                span = []
        result[doc_id, text] = (len(units), len(gone), "".join(u for i, u in enumerate(units) if i not in gone) if gone else text)
    return sorted(((row[0], *result[row]) for row in rows), key=repr)


def lines(text):
    return [] if text is None else text.split("\n")


def sentences(text):
    return [] if text is None else re.findall(SENTENCE, text)


EDGES = [
    (1, "a\nb\nc\nd"), (2, "x\na\n\nb\nc\ny"), (2, "x\na\n\nb\nc\ny"), (3, None), (4, ""), (5, "a\nb"), (None, "q\na\nb\nc"), (None, None),
    (6, "l\nl\nl\nl\nl\nl"), (7, "\n\n\n"), (8, "\n".join(f"row {i}" for i in range(3000))), (9, "\n".join(f"row {i}" for i in range(3000)) + "\nend"),
    (10, "One two three four. Five six seven! Eight nine ten eleven? Tail."), (11, "Head. One two three four.  Five six seven! Eight nine ten eleven?\nOther."),
    (12, "No. Yes. No. Yes. No. Yes."), (13, "1.2.3.4 and 1.2.3.4 and 1.2.3.4"),
]


@pytest.mark.parametrize("clashing", [True, False])
def test_line_dedup_edges(spark, clashing):
    out = line_dedup(documents(spark, EDGES, clashing))
    assert rows_of(out, "doc_id", "n_lines", "n_removed", "text") == sequential(EDGES, lines, "\n", 0)


FOUND = ["doc_id", "n_sentences", "n_removed", "text"]
PASSAGE = "The miller counted sacks, then barrels; then ropes. " + " ".join(f"Item {i} was in place, said one." for i in range(8))
SHORT = "\n".join(f"we saw {w}" for w in "oak elm ash fir yew box bay fig nut pea rye oat".split())
SIGNS = "".join(f"第{c}章讲述了一个很长的故事。" for c in "一二三四五六七")
PASSAGES = EDGES + [
    (20, PASSAGE), (21, f"My own words and {PASSAGE} and more of mine follow here"), (22, PASSAGE[30:] + "!!"), (23, f"{SHORT}\nend"), (24, f"start,\n\n{SHORT}"),
    (25, f"你好{SIGNS}"), (26, f"再见，{SIGNS}"), (27, "A short line. Another one. And a third."), (28, "A short line. Another one. And a third."),
    (29, " ".join([f"Only here, number {i}; again." for i in range(9)] * 2)), (30, "हिन्दी पाठ यहाँ है। " * 12), (31, "और हिन्दी पाठ यहाँ है। " + "हिन्दी पाठ यहाँ है। " * 12),
]


def test_substring_dedup_edges(spark):
    for own in (False, True):
        out = substring_dedup(documents(spark, PASSAGES), own=own)
        assert rows_of(out, *FOUND) == passages(PASSAGES, own=own)
    got = {r.doc_id: r for r in substring_dedup(documents(spark, PASSAGES)).collect()}
    assert all(got[i].n_removed for i in (21, 22, 24, 26, 31)) and not any(got[i].n_removed for i in (20, 23, 25, 27, 28, 29, 30))
    assert got[21].text == "My own words and The miller counted sacks, and more of mine follow here"


def test_empty_tables_and_columns(spark):
    empty = documents(spark, [])
    assert line_dedup(empty).columns == [*empty.columns, "n_lines", "n_removed"] and line_dedup(empty).count() == 0
    assert substring_dedup(empty).count() == 0


def test_hot_window(spark):
    rows = [(i, f"start {i}\nall\nof\nus\nend {i}") for i in range(400)]
    out = line_dedup(documents(spark, rows))
    assert rows_of(out, "doc_id", "n_lines", "n_removed", "text") == sequential(rows, lines, "\n", 0)


def test_real_texts(spark, sf_dir):
    docs = sample(spark, sf_dir)
    assert rows_of(line_dedup(docs), "doc_id", "n_lines", "n_removed", "text") == sequential(texts(docs), lines, "\n", 0)
    assert rows_of(substring_dedup(docs), "doc_id", "n_sentences", "n_removed", "text") == passages(texts(docs))


def test_no_python_on_the_path(spark, sf_dir):
    plan = line_dedup(sample(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "Cartesian" not in plan and "NestedLoop" not in plan
