"""Language ID by held-out accuracy; personal data against Python's patterns and a plain corpus count."""

import math
import re
import zlib
from collections import Counter

from llm_helpers import documents, rows_of, sample, texts
from pyspark.sql import functions as F

from tillwise.llm import language_id as li, sanitise as sa


def test_held_out_accuracy(spark):
    docs = sample(spark, "/root/testdata/sf0.01")
    learned = li.learn(docs.where(~li.held_out(F.col("doc_id"))))
    out = li.identify(docs, learned).withColumn("held", li.held_out(F.col("doc_id"))).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r.held]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_language_edges(spark):
    rows = [(i, "the cat and the dog went to the house of the king", "en") for i in range(30)]
    rows += [(100 + i, "der hund und die katze gehen in das haus des koenigs", "de") for i in range(30)]
    rows += [(200, None, "en"), (201, "", "en"), (202, "123 !!", "en"), (203, "the dog", None), (None, "die katze", "de"), (204, "the dog", "en"), (204, "the dog", "en"), (205, "und das haus " * 60_000, None)]
    docs = documents(spark, rows)
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in li.identify(docs, li.learn(docs)).collect()}
    assert got[200, None] == got[201, ""] == got[202, "123 !!"] == ("und", 0.0)
    assert got[203, "the dog"][0] == "en" and got[None, "die katze"][0] == "de" and got[205, "und das haus " * 60_000][0] == "de"
    alone = li.identify(documents(spark, [(1, "a"), (2, "1. B 2. c"), (3, "\u0301 4")]), li.learn(docs)).collect()
    assert [(r.lang_pred in ("de", "en"), r.score) for r in sorted(alone)] == [(True, 0.0), (True, 0.0), (False, 0.0)]
    assert li.identify(documents(spark, []), li.learn(docs)).count() == 0
    nothing = li.identify(docs, li.learn(docs.where("lang is null"))).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in nothing)


def test_filter_gives_all_languages_of_an_ngram():
    import numpy as np

    rng = np.random.default_rng(0)
    sets = [rng.integers(0, 1 << 63, 300, dtype=np.uint64) for _ in range(70)]
    sets[69] = np.r_[sets[69], sets[2]]
    filt = li.LanguageFilter([f"l{i:02d}" for i in range(70)], sets)
    for i, s in enumerate(sets):
        assert filt._bits(filt.lookup(s), i).all()
    assert filt._bits(filt.lookup(sets[2]), 69).all() and filt.false.max() < 0.05


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def plain_all(rows):
    """Base spans, then the terms beside entities by corpus counts."""
    words, pairs, entities, near = Counter(), Counter(), Counter(), {}
    for doc_id, text in rows:
        words.update(w for w in re.split(r"[\W\d_]+", (text or "").lower()) if len(w) >= 3)
        spans = plain_spans(text)
        here = []
        for s, _, e, kind in spans:
            entity = f"{kind}:{text[s:e].lower()}"
            entities[entity] += 1
            for lo, hi in ((max(0, s - sa.NEAR), s), (e, min(len(text), e + sa.NEAR))):
                for m in re.finditer(r"[^\W\d_]{3,}", text[lo:hi]):
                    a, b = m.start() + lo, m.end() + lo
                    if (a > lo or lo in (0, e)) and (b < hi or hi in (len(text), s)) and not any(x < b and a < y for x, _, y, _ in spans):
                        here.append((entity, m[0].lower(), a, b))
        pairs.update((e, t) for e, t, _, _ in here)
        near[doc_id, text] = here
    total, out = sum(entities.values()), []
    for doc_id, text in rows:
        added = {}
        for e, t, a, b in near[doc_id, text]:
            n = pairs[e, t]
            p = min(1.0, n / words[t]) if words[t] else 0
            if n >= sa.SUPPORT and p >= sa.GENERALISE and math.log2(p / (entities[e] / total)) >= sa.BITS:
                added[a, b] = max("term" if p >= sa.REMOVE else "hint", added.get((a, b), ""))
        base = plain_spans(text)
        spans = sorted(base + [(a, sa.KINDS.index(k), b, k) for (a, b), k in added.items()])
        out.append((doc_id, show(base), show(spans)))
    return sorted(out, key=repr)


def show(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def found(docs):
    out = sa.find_personal(docs)
    return rows_of(out.select("doc_id", sa.span_text(F.col("base")).alias("b"), sa.span_text(F.col("spans")).alias("s")), "doc_id", "b", "s")


NASTY = [
    "a@b.c_d@e.f", "a@b.c@d.e", "x@y", "x@-.-", "..@a.b", "é@a.bé", "mail jan.doe+x@mail.example.com, now", "a@b.c..d@e.f", "@a.b c@d.e.f.", "a@b.cd@e.fg",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256", "001.02.3.255", "1..2.3.4", "12.34.56", "9" * 40 + ".1.1.1", "1.2.3.4@5.6",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "41111111111111", "4111111111111111 4", "5 a 4111 1111 1111 1111", "4111-1111 1111-1111-", "-4111111111111111-1",
    "+46 (0)70-123 45 67", "+1+12345678901", "+123", "+1 234.567.8901.", "+12345678901234567", "+4 111 111 111 1 11 11", "++46701234567", "+46701234567\n+46701234568",
]


def test_base_spans_agree_with_the_plain_patterns(spark):
    rows = [(i, t) for i, t in enumerate(NASTY)] + [(None, "a@b.c"), (500, None), (501, ""), (502, " ".join(NASTY)), (502, " ".join(NASTY)), (503, "|".join(NASTY))]
    rows += [(600, "9" * 20_000), (601, "1." * 20_000 + "1"), (602, "a" * 50_000), (603, "a@b" + ".c" * 20_000), (604, "1 " * 30_000), (605, "+1" + "-" * 20_000), (606, "é" * 1000 + " x@y.z")]
    assert found(documents(spark, rows)) == plain_all(rows)
    assert sa.find_personal(documents(spark, [])).count() == 0


def test_random_strings_agree(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    rows = [(i, "".join(rng.choice(list("a.@-0123456789+ _é("), rng.integers(5, 120)))) for i in range(1500)]
    rows += [(5000 + i, "".join(rng.choice(list("0123456789") * 3 + list(" -.+"), rng.integers(20, 120)))) for i in range(1500)]
    assert [r[:2] for r in found(documents(spark, rows))] == [r[:2] for r in plain_all(rows)]


def test_terms_beside_an_entity(spark):
    rows = [(i, f"Doctor Zebulon wrote from zeb@home.org about the weather {i}") for i in range(4)]
    rows += [(10 + i, "the weather was fine and nobody wrote about it") for i in range(20)]
    rows += [(70 + i, f"mail p{i}@work.org about the weather") for i in range(12)]
    rows += [(50, "Zebulon was here"), (51, "write to ann@work.org about the weather")]
    docs = documents(spark, rows)
    assert found(docs) == plain_all(rows)
    clean = {r.doc_id: r.text for r in sa.redact(docs, sa.find_personal(docs)).collect()}
    assert "Zebulon" not in clean[0] and "[EMAIL]" in clean[0] and clean[50] == "Zebulon was here" and clean[11] == rows[5][1]


def test_real_texts(spark, sf_dir):
    docs = sample(spark, sf_dir)
    assert found(docs) == plain_all(texts(docs))


def test_no_python_on_the_path(spark, sf_dir):
    plan = sa.find_personal(sample(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
