import random
import re
from datetime import datetime
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tillwise.functions.text import canonical_name
from tillwise.operators import derive, products, stores


def clean(s):
    return re.sub(r"[\W_]+", " ", s.casefold()).strip()


def one_by_one(names, display):
    """The matching rule applied to one name after the other."""
    known, out = [], []
    for raw in names:
        n = clean(raw)
        texts = [k for k in range(len(known)) if n and n in known[k]]
        if not n or texts:
            if not n:
                known.append(set())
            out.append((texts[0] if n else len(known) - 1, 100))
            if n:
                known[texts[0]].add(n)
            continue
        scored = [
            (SequenceMatcher(None, n, c).ratio(), -k) for k, texts in enumerate(known) for c in texts
            if c[0] == n[0] and set(c.split()) & set(n.split()) and abs(len(c) - len(n)) <= max(8, len(n) // 2)
        ]
        score, k = max(scored, default=(0, 0))
        if score >= 0.75:
            known[-k].add(n)
            out.append((-k, int(score * 100)))
        else:
            known.append({n, clean(display[raw])} - {""})
            out.append((len(known) - 1, 100))
    return out


def test_matching_equals_the_sequential_rule(spark):
    rng = random.Random(3)
    words = "milk arla bread red wine beer ipa cheese ost 1l 15l 500g bio organic apple apples".split()
    names = []
    for _ in range(90):
        s = list(" ".join(rng.sample(words, rng.randint(1, 3))))
        if rng.random() < 0.4:
            s[rng.randrange(len(s))] = rng.choice("aeiou")
        names.append("".join(s).upper() if rng.random() < 0.3 else "".join(s))
    names[5] = "!!"
    items = spark.createDataFrame(list(enumerate(names)), "arrival long, raw_name string")
    display = {r[0]: r[1] for r in items.select("raw_name", canonical_name(F.col("raw_name"))).collect()}
    want = one_by_one(names, display)
    matched, aliases = products.match_products(items)
    got = {r.arrival: (r.product_id, r.match_confidence) for r in matched.collect()}
    ids = {}
    for i, (cluster, confidence) in enumerate(want):
        assert ids.setdefault(cluster, got[i][0]) == got[i][0], names[i]
        assert got[i][1] == confidence, names[i]
    assert len(set(ids.values())) == len(ids)
    assert products.new_products(aliases, "2024-01-01").count() == len(ids)


def test_known_products_are_kept(spark):
    ddl = "product_id string, canonical_name string, aliases array<string>, created_at timestamp"
    known = spark.createDataFrame([("P1", "Milk", ["MILK 1l"], datetime(2024, 1, 1))], ddl)
    items = spark.createDataFrame([(1, "Milk 15L"), (2, "Bread"), (3, "milk 1L"), (4, "Milk 15L")], "arrival long, raw_name string")
    matched, aliases = products.match_products(items, known)
    got = {r.arrival: (r.product_id, r.match_confidence) for r in matched.collect()}
    assert got[1] == ("P1", 93) and got[3] == ("P1", 100) and got[4] == ("P1", 100)
    assert got[2][0] != "P1"
    assert [r.canonical_name for r in products.new_products(aliases, "2024-01-01").collect()] == ["Bread"]


def test_derive_and_replace(spark):
    receipts = spark.createDataFrame([("r1", "S", datetime(2024, 1, 1)), ("r2", "S", None)], "receipt_id string, store_name string, purchased_at timestamp")
    items = spark.createDataFrame(
        [("r1", 0, "Milk", 6.0, "2 pcs", None, 1), ("r1", 1, "Milk", 6.0, None, None, 2), ("r1", 2, " ", 6.0, "1", None, 3), ("r2", 0, "Milk", 6.0, "1", None, 4)],
        "receipt_id string, pos int, raw_name string, line_total double, qty_raw string, unit_price_raw double, arrival long")
    found = derive.derive_observations(receipts, items)
    assert found["line_items"].count() == 2
    rows = found["observations"].collect()
    assert [(r.unit_price, r.unit_type, r.confidence) for r in rows] == [(3.0, "pcs", 100)]
    again = derive.replace_rows(found["observations"], found["observations"], receipts)
    assert again.count() == 1


STORE = "store_entity_id string, chain_name string, branch_name string, address string, postal_code string, city string, org_number string, phone string, store_id string, aliases array<string>, created_at timestamp, updated_at timestamp"
HINT = "receipt_id string, chain_name string, branch_name string, address string, postal_code string, city string, org_number string, phone string, store_id string"


def store_rows(spark, rows):
    stamp = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, c, b, a, p, t, o, ph, s, [c], stamp, stamp) for i, c, b, a, p, t, o, ph, s in rows], STORE)


def test_dedupe_hybrid(spark):
    rows = [("s1", "ICA", None, None, None, "Lund", "123", None, None), ("s2", "ica", None, None, None, None, None, None, None),
            ("s3", "ICA", None, None, None, None, "999", None, None), ("s4", "Coop", None, None, None, None, None, None, None)]
    shops = store_rows(spark, rows)
    receipts = spark.createDataFrame([("r1", "s2"), ("r2", "s3"), ("r3", None)], "receipt_id string, store_entity_id string")
    merges = stores.store_merges(shops, receipts)
    assert [(r.from_store, r.to_store) for r in merges.collect()] == [("s2", "s1")]
    moved = {r.receipt_id: r.store_entity_id for r in stores.apply_store_merges(receipts, merges).collect()}
    assert moved == {"r1": "s1", "r2": "s3", "r3": None}
    report = stores.dedupe_report(shops, receipts, merges, delete_orphans=True).first()
    assert (report.stores_before, report.store_merges, report.receipts_updated, report.stores_after) == (4, 1, 1, 2)
    targets = {r.to_store for r in merges.collect()}
    assert not targets & {r.from_store for r in merges.collect()}


def points(h, s):
    words = lambda a: {t for t in re.split(r"\W+", a.casefold()) if len(t) >= 3}
    score, strong = 0, False
    for i, value in ((6, 10), (7, 8), (8, 8)):
        if h[i] and s[i] and h[i] == s[i]:
            score, strong = score + value, True
    chain = bool(h[1]) and clean(h[1]) == clean(s[1])
    if h[1] and not chain and not strong:
        return None
    score += 2 * chain
    if chain or strong:
        score += 4 * bool(h[4] and h[4] == s[4]) + 3 * bool(h[5] and s[5] and h[5].casefold() == s[5].casefold())
        if h[3] and s[3] and words(h[3]) and words(s[3]):
            share = len(words(h[3]) & words(s[3])) / len(words(h[3]))
            score += 6 if share >= 0.6 else 4 if share >= 0.4 else 0
    return score


def test_matching_equals_scoring_every_store(spark):
    rng = random.Random(4)
    pick = lambda options: rng.choice(options)

    def details():
        return (pick([None, "North Mall"]), pick([None, "Main Street 1", "Main Road East", "Harbour Street West"]), pick([None, "111", "222"]),
                pick([None, "Lund", "lund", "Ystad"]), pick([None, "77", "88"]), pick([None, "5551", "5552"]), pick([None, "9"]))

    shops = [(f"s{i:02d}", pick(["ICA", "Coop", "Lidl"]), *details()) for i in range(25)]
    hints = [(f"r{i:03d}", pick([None, "ica", "Coop", "Other"]), *details()) for i in range(120)]
    matched = stores.match_stores(spark.createDataFrame(hints, HINT), store_rows(spark, shops))
    got = {r.receipt_id: (r.store_entity_id, r.match_kind) for r in matched.collect()}
    for h in hints:
        detailed = any(h[3:])
        if h[1] and not detailed:
            same = [s for s in shops if clean(s[1]) == clean(h[1])]
            best = max(same, key=lambda s: (sum(v is not None for v in s[2:]), s[0]), default=None)
            assert got[h[0]] == ((best[0], "chain") if best else (None, "new"))
            continue
        scored = [(points(h, s), s[0]) for s in shops]
        top = max((p for p, _ in scored if p), default=0)
        ok = top >= 10 or (top >= 8 and (h[6] or h[7] or h[8]))
        want = next(i for p, i in scored if p == top) if ok else None
        assert got[h[0]][0] == want, h
        if not ok:
            assert got[h[0]][1] == ("new" if h[1] else "none")
    made = stores.new_stores(matched, "2024-02-01")
    assigned = stores.assign_stores(matched).where("match_kind = 'new'")
    assert assigned.join(made, "store_entity_id", "left_anti").count() == 0


def test_aliases_learnt(spark):
    aliases = spark.createDataFrame([("willy s", "Old")], "key string, canonical string")
    fixes = spark.createDataFrame([("WILLY:S", "Willys", 1), ("WILLY:S", "Willys City", 2), ("x", "x", 3)], "old_name string, new_name string, corrected_at long")
    assert {r.key: r.canonical for r in stores.learn_store_aliases(aliases, fixes).collect()} == {"willy s": "Willys City"}


def test_addresses_pair_only_where_a_field_agrees(spark):
    rows = spark.range(400).selectExpr("concat('house', id, ' street') as _addr", "concat('town', id) as _city", "cast(null as string) as _postal")
    found = stores._address_matches(rows, rows, [], ["postal", "city"])
    assert found.count() == 400 and found.where("_addr = _store_addr").count() == 400


def test_history_answers_every_row_from_its_own_hints(spark):
    ddl = "id string, store_name string, org_number string, phone string, store_id string, address string, postal_code string, city string"
    none = (None,) * 4
    history = spark.createDataFrame([("1", "ICA", "55-1", None, *none), ("2", "Coop", "55-2", "070", *none)], ddl).withColumnRenamed("id", "receipt_id")
    asked = spark.createDataFrame([("a", None, "551", None, *none), ("a", None, "552", "070", *none), ("b", None, "55 1", None, *none), ("c", None, None, None, *none)], ddl)
    rows = stores.infer_store_from_history(asked.drop("store_name").withColumnRenamed("id", "probe_id"), history).collect()
    assert sorted((r.probe_id, r.store_name, r.score) for r in rows) == [("a", "Coop", 18), ("a", "ICA", 10), ("b", "ICA", 10)]


def test_equal_hints_are_learnt_from_once(spark):
    """Stores learn from the earliest of the receipts that say the same, and tell nulls from blanks and joined texts."""
    hints = [("org_number", None), ("phone", None), ("store_id", None), ("address", "Main St 1"), ("postal_code", "1"), ("city", "X")]
    rows = [(i, "s1", "hints", True, "ICA", None, *[v for _, v in hints]) for i in (5, 3, 4)] + [(1, "s1", "hints", False, " ", "B", None, None, None, None, None, None)]
    matched = spark.createDataFrame(rows, "receipt_id long, store_entity_id string, match_kind string, learn_alias boolean, chain_name string, branch_name string, " + ", ".join(f"{n} string" for n, _ in hints))
    known = spark.createDataFrame([("s1", "Ica", None, None, None, None, None, None, None, ["Ica"], None, None)], (
        "store_entity_id string, chain_name string, branch_name string, address string, postal_code string, city string, org_number string, phone string, store_id string, "
        "aliases array<string>, created_at timestamp, updated_at timestamp"))
    found = stores.enrich_stores(known, matched, "2024-01-01")
    got = found.first()
    assert (got.chain_name, got.branch_name, got.address, got.postal_code, got.city, got.aliases) == ("Ica", "B", "Main St 1", "1", "X", ["ICA", "Ica"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2
    texts = spark.createDataFrame([("a", None), (None, "a"), ("a", ""), ("a,1:b", None), ("a", "b"), ("", None), (None, None), ("-", None)], "x string, y string")
    assert texts.select(stores._fingerprint(["x", "y"]).alias("f")).distinct().count() == 8
