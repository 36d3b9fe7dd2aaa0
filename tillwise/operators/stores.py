"""Store entities: matching receipts to stores, merging duplicates, aliases.

Stores have ``store_entity_id, chain_name, branch_name, address, postal_code, city, org_number, phone,
store_id, aliases, created_at, updated_at``.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from tillwise.functions.text import (
    blank_to_null, fold, norm_digits, norm_store_key, norm_text, token_overlap, tokens_of,
)
from tillwise.session import settle

DETAIL_FIELDS = ("branch_name", "address", "postal_code", "city", "org_number", "phone", "store_id")
HINT_FIELDS = ("org_number", "phone", "store_id", "address", "postal_code", "city")
# Points per agreeing field; the address gives ADDRESS_STRONG or ADDRESS_WEAK by token overlap.
POINTS = {"org": 10, "phone": 8, "sid": 8, "chain": 2, "postal": 4, "city": 3}
STRONG_IDS = ("org", "phone", "sid")
ADDRESS_STRONG, ADDRESS_WEAK = 6, 4
ACCEPT, ACCEPT_WITH_ID = 10, 8


def filled_fields() -> Column:
    """How many of the seven detail fields are filled."""
    return sum((norm_text(F.col(f)).isNotNull().cast("int") for f in DETAIL_FIELDS), F.lit(0))


def store_usage(stores: DataFrame, receipts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Filled fields and receipt count of every store."""
    counts = (
        receipts.where(blank_to_null(F.col("store_entity_id")).isNotNull())
        .groupBy(*keys, "store_entity_id").agg(F.count(F.lit(1)).alias("receipts"))
    )
    rows = stores.select(*keys, "store_entity_id", filled_fields().alias("filled"))
    return rows.join(counts, [*keys, "store_entity_id"], "left").fillna(0, ["receipts"])


# ---------------------------------------------------------------- duplicates

def _strict_match(a: str, b: str) -> Column:
    """Same identifier, or same postal code and city with agreeing addresses; ``a`` is the kept store."""

    def pair(field: str, norm) -> tuple[Column, Column]:
        return norm(F.col(f"{a}.{field}")), norm(F.col(f"{b}.{field}"))

    same_id = F.lit(False)
    for field in ("org_number", "store_id", "phone"):
        left, right = pair(field, norm_digits)
        same_id = same_id | F.coalesce(left == right, F.lit(False))
    (postal_a, postal_b), (city_a, city_b) = pair("postal_code", norm_digits), pair("city", norm_text)
    addr_a, addr_b = pair("address", norm_text)
    near = (
        addr_a.isNull() | addr_b.isNull() | (token_overlap(tokens_of(addr_a), tokens_of(addr_b)) >= 0.4)
    )
    same_place = F.coalesce((postal_a == postal_b) & (fold(city_a) == fold(city_b)) & near, F.lit(False))
    return same_id | same_place


def store_merges(stores: DataFrame, receipts: DataFrame, mode: str = "hybrid", keys: Sequence[str] = ()) -> DataFrame:
    """(from_store, to_store, chain, from_receipts, to_receipts): every duplicate points at its chain's best store.

    The kept store of a chain is the one with most details, then most receipts, then the newest. It is
    found by an aggregate and joined back, so a chain of any size gives one pair per store.
    """
    if mode not in ("hybrid", "strict", "chain_only"):
        mode = "hybrid"
    usage = store_usage(stores, receipts, keys)
    keyed = stores.withColumn("_chain", norm_store_key(F.col("chain_name"))).where("_chain <> ''").join(
        usage, [*keys, "store_entity_id"]
    )
    fields = F.struct("chain_name", *DETAIL_FIELDS)
    kept = keyed.groupBy(*keys, "_chain").agg(
        F.max(F.struct("filled", "receipts", "updated_at", "store_entity_id", fields.alias("f"))).alias("_k"),
        F.count(F.lit(1)).alias("_size"),
    ).where("_size > 1")
    pairs = keyed.withColumn("_own", fields).join(kept, [*keys, "_chain"]).where(
        F.col("store_entity_id") != F.col("_k.store_entity_id")
    ).withColumn("_kept", F.col("_k.f"))
    if mode == "strict":
        pairs = pairs.where(_strict_match("_kept", "_own"))
    elif mode == "hybrid":
        pairs = pairs.where((F.col("filled") == 0) | _strict_match("_kept", "_own"))
    return pairs.select(
        *keys, F.col("store_entity_id").alias("from_store"), F.col("_k.store_entity_id").alias("to_store"),
        F.coalesce(F.nullif("_kept.chain_name", F.lit("")), F.col("_chain")).alias("chain"),
        F.col("receipts").alias("from_receipts"), F.col("_k.receipts").alias("to_receipts"),
    )


def apply_store_merges(receipts: DataFrame, merges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Receipts with their store replaced by the kept one."""
    mapping = merges.select(*keys, F.col("from_store").alias("store_entity_id"), "to_store")
    joined = receipts.join(mapping, [*keys, "store_entity_id"], "left")
    moved = F.coalesce("to_store", "store_entity_id")
    return joined.withColumn("store_entity_id", moved).drop("to_store").select(*receipts.columns)


def drop_orphan_stores(stores: DataFrame, receipts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Stores that some receipt still refers to."""
    return stores.join(receipts.select(*keys, "store_entity_id"), [*keys, "store_entity_id"], "left_semi")


def dedupe_report(
    stores: DataFrame, receipts: DataFrame, merges: DataFrame, delete_orphans: bool = False, keys: Sequence[str] = ()
) -> DataFrame:
    """One row: stores before and after, merges, receipts moved, orphans after the merges."""
    used = (
        receipts.where(blank_to_null(F.col("store_entity_id")).isNotNull())
        .groupBy(*keys, "store_entity_id").agg(F.count(F.lit(1)).alias("_receipts"))
        .join(merges.select(*keys, F.col("from_store").alias("store_entity_id"), "to_store"), [*keys, "store_entity_id"], "left")
    )
    moved = used.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("to_store").isNotNull(), F.col("_receipts"))), F.lit(0)).alias("receipts_updated")
    )
    referenced = used.select(*keys, F.coalesce("to_store", "store_entity_id").alias("store_entity_id"))
    left = stores.join(referenced, [*keys, "store_entity_id"], "left_semi")

    def size(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    # One row per measure and key, folded into one row per key: no join.
    parts = size(stores, "stores_before")
    for part in (size(merges, "store_merges"), size(left, "stores_after_projected"), moved):
        parts = parts.unionByName(part, allowMissingColumns=True)
    measures = [c for c in parts.columns if c not in keys]
    report = parts.groupBy(*keys).agg(*[F.max(c).alias(c) for c in measures]).where("stores_before is not null").fillna(0)
    orphans = F.col("stores_before") - F.col("stores_after_projected")
    after = F.col("stores_after_projected") if delete_orphans else F.col("stores_before")
    return report.withColumn("orphans_projected", orphans).withColumn("stores_after", after)


# ---------------------------------------------------------------- matching

def _attributes(prefix: str = "") -> dict[str, Column]:
    def field(name: str) -> Column:
        return F.col(prefix + name)

    return {
        "org": norm_digits(field("org_number")),
        "phone": norm_digits(field("phone")),
        "sid": norm_digits(field("store_id")),
        "postal": norm_digits(field("postal_code")),
        "city": fold(norm_text(field("city"))),
    }


def _subset_keys(names: Sequence[str], allowed) -> list[tuple[str, ...]]:
    found = []
    for size in range(1, len(names) + 1):
        found.extend(s for s in combinations(names, size) if allowed(s))
    return found


def _probe_keys(subsets: list[tuple[str, ...]]) -> Column:
    """Array of one lookup key per subset whose columns are all present."""
    probes = [
        F.when(
            sum((F.col(f"_{name}").isNull().cast("int") for name in subset), F.lit(0)) == 0,
            F.concat_ws("\u0001", F.lit("+".join(subset)), *[F.col(f"_{name}") for name in subset]),
        )
        for subset in subsets
    ]
    return F.filter(F.array(*probes), lambda k: k.isNotNull())


def _address_matches(probes: DataFrame, candidates: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(probe address, candidate address, level) for distinct addresses that share enough tokens.

    An address alone is never enough, so only rows that agree in another field are paired: a common word in addresses
    brings no two places together. At least 40 % of the probe's tokens must occur in the candidate, so one of its
    ``n - ceil(.4 n) + 1`` rarest tokens does: only those are joined on, and only distinct addresses per field value.
    """
    keys = list(keys)
    given = F.filter(
        F.array(*[F.concat(F.lit(f"{n}:"), F.col(f"_{n}")) for n in names]), lambda v: v.isNotNull()
    )

    def addresses(rows: DataFrame, name: str, tokens: str) -> DataFrame:
        rows = rows.where(F.col("_addr").isNotNull()).select(*keys, F.col("_addr").alias(name), F.explode(given).alias("_f"))
        return rows.distinct().withColumn(tokens, tokens_of(F.col(name))).where(F.size(tokens) > 0)

    left, right = addresses(probes, "_addr", "_lt"), addresses(candidates, "_store_addr", "_rt")
    postings = right.select(*keys, "_f", "_store_addr", "_rt", F.explode("_rt").alias("_t"))
    frequency = postings.groupBy(*keys, "_f", "_t").agg(F.count(F.lit(1)).alias("_df"))
    ranked = left.select(*keys, "_f", "_addr", "_lt", F.explode("_lt").alias("_t")).join(frequency, [*keys, "_f", "_t"], "left")
    ordered = ranked.groupBy(*keys, "_f", "_addr", "_lt").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), "_t"))).alias("_o")
    )
    need = F.ceil(F.size("_lt") * F.lit(0.4)).cast("int")
    rare = F.slice("_o", F.lit(1), F.size("_lt") - need + 1)
    pairs = (
        ordered.select(*keys, "_f", "_addr", "_lt", F.explode(rare).alias("_e"))
        .select(*keys, "_f", "_addr", "_lt", F.col("_e._t").alias("_t"))
        .join(postings, [*keys, "_f", "_t"])
        .withColumn("_overlap", token_overlap(F.col("_lt"), F.col("_rt")))
        .where("_overlap >= 0.4")
    )
    level = F.when(F.col("_overlap") >= 0.6, F.lit(ADDRESS_STRONG)).otherwise(F.lit(ADDRESS_WEAK))
    return pairs.select(*keys, "_addr", "_store_addr", level.alias("_level")).distinct()


def _best_by_hints(
    probes: DataFrame, candidates: DataFrame, keys: Sequence[str], names: Sequence[str], allowed, order: str
) -> DataFrame:
    """Highest-scoring candidate per probe, the earliest by ``order`` among equals: (_probe, _target, _score, _chain_hit).

    Both sides carry ``_org, _phone, _sid, _postal, _city`` (and ``_chain``) plus ``_addr``. For every
    combination of fields only the earliest candidate with those values is kept. The best candidate of a probe
    agrees on some combination exactly, and the kept one of that combination scores the same, so joining probes
    with the kept ones gives the true best without pairing the members of a large group.
    """
    keys = list(keys)
    matches = _address_matches(probes, candidates, keys, names)
    with_addr = [*names, "addr"]
    subsets = _subset_keys(with_addr, allowed)
    score_columns = [f"_{n}" for n in names]
    indexed = candidates.select(
        *keys, order, "_target", *score_columns, "_addr", F.explode(_probe_keys(subsets)).alias("_key")
    )
    kept = indexed.groupBy(*keys, "_key").agg(
        F.min(F.struct(order, "_target", *score_columns, "_addr")).alias("_c")
    )
    # A probe looks up its own fields, once without an address and once for each store address close to its own.
    near = matches.withColumnRenamed("_level", "_points")
    own = probes.withColumn("_store_addr", F.lit(None).cast("string")).withColumn("_points", F.lit(0))
    close = probes.join(near, [*keys, "_addr"])
    columns = [*keys, "_probe", *score_columns, "_store_addr", "_points"]
    lookups = own.select(*columns).unionByName(close.select(*columns)).withColumn("_addr", F.col("_store_addr"))
    asked = lookups.withColumn("_key", F.explode(_probe_keys(subsets)))
    scored = asked.join(kept, [*keys, "_key"])
    score = F.lit(0)
    for name in names:
        score = score + F.when(F.col(f"_{name}") == F.col(f"_c._{name}"), F.lit(POINTS[name])).otherwise(F.lit(0))
    score = score + F.when(F.col("_store_addr") == F.col("_c._addr"), F.col("_points")).otherwise(F.lit(0))
    chain_hit = F.col("_chain") == F.col("_c._chain") if "chain" in names else F.lit(False)
    scored = scored.withColumn("_score", score).withColumn("_chain_hit", F.coalesce(chain_hit, F.lit(False)))
    # Highest score first, then the earliest candidate.
    best = scored.groupBy(*keys, "_probe").agg(
        F.min(F.struct((-F.col("_score")).alias("neg"), F.col(f"_c.{order}").alias("o"), F.col("_c._target").alias("target"),
                       (~F.col("_chain_hit")).alias("other_chain"))).alias("_b")
    )
    return best.select(
        *keys, "_probe", F.col("_b.target").alias("_target"), (-F.col("_b.neg")).alias("_score"),
        (~F.col("_b.other_chain")).alias("_chain_hit"),
    )


def _has_any(*names: str) -> Column:
    return sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0)) > 0


def _fingerprint(columns: Sequence[str]) -> Column:
    """Hash of the values; each is told apart by its length, a null by having none."""
    told = [F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat_ws(",", *told)))


def match_stores(hints: DataFrame, stores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Store of every receipt: adds ``store_entity_id`` and ``match_kind`` (hints, chain, new, none).

    ``hints`` has ``receipt_id, chain_name, branch_name`` and the hint fields. Equal hints are matched once.
    New stores get the smallest receipt id of their group as identifier seed; see :func:`new_stores`.
    """
    keys = list(keys)
    signature = ["chain_name", *HINT_FIELDS]
    tagged = hints.withColumn("_probe", _fingerprint(signature))
    distinct = tagged.groupBy(*keys, "_probe").agg(*[F.first(c).alias(c) for c in signature])
    attributes = _attributes()
    for name, column in attributes.items():
        distinct = distinct.withColumn(f"_{name}", column)
        stores = stores.withColumn(f"_{name}", column)
    distinct = distinct.withColumn("_addr", norm_text(F.col("address"))).withColumn(
        "_chain", F.nullif(norm_store_key(F.col("chain_name")), F.lit(""))
    )
    chains = F.array_distinct(
        F.transform(
            F.concat(F.array("chain_name"), F.coalesce("aliases", F.array().cast("array<string>"))), norm_store_key
        )
    )
    by_chain = (
        stores.withColumn("_addr", norm_text(F.col("address"))).withColumn("_filled", filled_fields())
        .withColumn("_chain", F.explode(F.filter(chains, lambda k: k != "")))
        .withColumn("_target", F.col("store_entity_id"))
        .withColumn("_order", F.struct("created_at", "store_entity_id"))
    )
    # Distinct hints and stores per chain name are far fewer than receipts and are read many times below.
    distinct, by_chain = settle(distinct), settle(by_chain)
    detailed = _has_any("_org", "_phone", "_sid", "_addr", "_postal", "_city")

    def allowed(subset: tuple[str, ...]) -> bool:
        strong = any(s in subset for s in STRONG_IDS)
        # A score below 8 is never accepted, and without a strong identifier the chain has to agree.
        points = sum(POINTS.get(s, ADDRESS_STRONG) for s in subset)
        return (strong or "chain" in subset) and points >= ACCEPT_WITH_ID

    names = ["org", "phone", "sid", "chain", "postal", "city"]
    best = _best_by_hints(distinct.where(detailed | F.col("_chain").isNull()), by_chain, keys, names, allowed, "_order")
    given_id = _has_any("_org", "_phone", "_sid")
    best = settle(best)
    by_hints = best.join(distinct, [*keys, "_probe"]).where(
        (F.col("_score") >= ACCEPT) | ((F.col("_score") >= ACCEPT_WITH_ID) & given_id)
    ).select(*keys, "_probe", F.col("_target").alias("_hint_store"), "_chain_hit")
    richest = by_chain.groupBy(*keys, "_chain").agg(
        F.max(F.struct("_filled", "updated_at", "store_entity_id")).alias("_r")
    ).select(*keys, "_chain", F.col("_r.store_entity_id").alias("_chain_store"))
    bare = distinct.where(~detailed & F.col("_chain").isNotNull()).join(richest, [*keys, "_chain"]).select(
        *keys, "_probe", "_chain_store"
    )
    decided = distinct.select(*keys, "_probe", "_chain").join(by_hints, [*keys, "_probe"], "left").join(
        bare, [*keys, "_probe"], "left"
    )
    kind = (
        F.when(F.col("_hint_store").isNotNull(), "hints").when(F.col("_chain_store").isNotNull(), "chain")
        .when(F.col("_chain").isNotNull(), "new").otherwise("none")
    )
    decided = decided.select(
        *keys, "_probe", F.coalesce("_hint_store", "_chain_store").alias("store_entity_id"), kind.alias("match_kind"),
        (F.coalesce("_chain_hit", F.lit(False)) | F.col("_chain_store").isNotNull()).alias("learn_alias"),
    )
    return tagged.join(decided, [*keys, "_probe"]).drop("_probe")


def new_store_key() -> Column:
    """Receipts that describe the same unknown store agree on this key."""
    clean = {name: F.coalesce(column, F.lit("")) for name, column in _attributes().items()}
    place = F.concat_ws(
        "|", norm_store_key(F.col("chain_name")), clean["postal"], clean["city"],
        F.coalesce(fold(norm_text(F.col("address"))), F.lit("")),
    )
    return (
        F.when(clean["org"] != "", F.concat(F.lit("org:"), clean["org"]))
        .when(clean["phone"] != "", F.concat(F.lit("phone:"), clean["phone"]))
        .when(clean["sid"] != "", F.concat(F.lit("sid:"), clean["sid"]))
        .otherwise(F.concat(F.lit("at:"), place))
    )


def _new_store_id(keys: Sequence[str], key: Column) -> Column:
    """An identifier that follows from the tenant and the key."""
    tenant = [F.concat(F.coalesce(F.col(k).cast("string"), F.lit("")), F.lit("\x00")) for k in keys]
    return F.substring(F.sha2(F.concat(*tenant, key), 256), 1, 32)


def new_stores(matched: DataFrame, as_of, keys: Sequence[str] = ()) -> DataFrame:
    """Store rows to create for the receipts that :func:`match_stores` left as ``new``."""
    rows = matched.where("match_kind = 'new'").withColumn("_new", new_store_key())

    def earliest(column: str) -> Column:
        value = blank_to_null(F.col(column))
        return F.min(F.when(value.isNotNull(), F.struct("receipt_id", value.alias("v"))))["v"].alias(column)

    made = rows.groupBy(*keys, "_new").agg(
        *[earliest(c) for c in ("chain_name", *DETAIL_FIELDS)],
        F.array_sort(F.collect_set(blank_to_null(F.col("chain_name")))).alias("aliases"),
    )
    stamp = F.lit(as_of).cast("timestamp")
    return made.withColumn("store_entity_id", _new_store_id(keys, F.col("_new"))).withColumn(
        "created_at", stamp
    ).withColumn("updated_at", stamp).drop("_new")


def assign_stores(matched: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Matched receipts with the identifier of their existing or new store."""
    fresh = _new_store_id(keys, new_store_key())
    return matched.withColumn(
        "store_entity_id", F.when(F.col("match_kind") == "new", fresh).otherwise(F.col("store_entity_id"))
    )


def enrich_stores(stores: DataFrame, matched: DataFrame, as_of, keys: Sequence[str] = ()) -> DataFrame:
    """Stores with empty fields filled and chain aliases learnt from the receipts matched to them."""
    rows = matched.where(F.col("store_entity_id").isNotNull() & F.col("match_kind").isin("hints", "chain"))

    def earliest(column: str) -> Column:
        value = blank_to_null(F.col(column))
        return F.min(F.when(value.isNotNull(), F.struct("receipt_id", value.alias("v"))))["v"].alias(f"_new_{column}")

    # Receipts that say the same are reduced to the earliest before their texts are looked at.
    rows = rows.groupBy(*keys, "store_entity_id", "learn_alias", "chain_name", *DETAIL_FIELDS).agg(F.min("receipt_id").alias("receipt_id"))
    learnt = rows.groupBy(*keys, "store_entity_id").agg(
        *[earliest(c) for c in ("chain_name", *DETAIL_FIELDS)],
        F.collect_set(F.when(F.col("learn_alias"), blank_to_null(F.col("chain_name")))).alias("_names"),
    )
    joined = stores.join(learnt, [*keys, "store_entity_id"], "left")
    known = F.coalesce("aliases", F.array().cast("array<string>"))
    aliases = F.array_sort(F.array_union(known, F.coalesce("_names", F.array().cast("array<string>"))))
    changed = F.size(F.array_except(F.coalesce("_names", F.array().cast("array<string>")), known)) > 0
    for c in ("chain_name", *DETAIL_FIELDS):
        changed = changed | (blank_to_null(F.col(c)).isNull() & F.col(f"_new_{c}").isNotNull())
    joined = joined.withColumn("_changed", changed).withColumn("aliases", aliases)
    for c in ("chain_name", *DETAIL_FIELDS):
        joined = joined.withColumn(c, F.coalesce(blank_to_null(F.col(c)), F.col(f"_new_{c}")))
    joined = joined.withColumn(
        "updated_at", F.when(F.col("_changed"), F.lit(as_of).cast("timestamp")).otherwise(F.col("updated_at"))
    )
    return joined.select(*stores.columns)


def infer_store_from_history(hints: DataFrame, history: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Store name of each hint row from earlier receipts with like hints: (probe_id, store_name, score).

    ``hints`` has ``probe_id`` and the hint fields; ``history`` has ``receipt_id, store_name`` and the hint fields.
    """
    keys = list(keys)
    known = history.where(blank_to_null(F.col("store_name")).isNotNull())
    # Equal hints are matched, and normalised, once: there are far fewer of them than rows.
    probe = _fingerprint(HINT_FIELDS).alias("_probe")
    tagged = hints.where(_has_any(*HINT_FIELDS)).select(*keys, "probe_id", probe, *HINT_FIELDS)
    distinct = tagged.groupBy(*keys, "_probe").agg(*[F.first(c).alias(c) for c in HINT_FIELDS])
    for name, column in _attributes().items():
        distinct, known = distinct.withColumn(f"_{name}", column), known.withColumn(f"_{name}", column)
    distinct = settle(distinct.withColumn("_addr", norm_text(F.col("address"))))
    names = ["org", "phone", "sid", "postal", "city"]
    known = known.withColumn("_addr", norm_text(F.col("address"))).withColumn(
        "_target", blank_to_null(F.col("store_name"))
    ).withColumn("_order", F.struct("receipt_id"))

    def allowed(subset: tuple[str, ...]) -> bool:
        return sum(POINTS.get(s, ADDRESS_STRONG) for s in subset) >= ACCEPT_WITH_ID

    best = _best_by_hints(distinct, known, keys, names, allowed, "_order")
    given = distinct.select(*keys, "_probe", _has_any("_org", "_phone", "_sid").alias("_given"))
    accepted = best.join(given, [*keys, "_probe"]).where(
        (F.col("_score") >= ACCEPT) | ((F.col("_score") >= ACCEPT_WITH_ID) & F.col("_given"))
    )
    found = accepted.select(*keys, "_probe", F.col("_target").alias("store_name"), F.col("_score").cast("long").alias("score"))
    return tagged.select(*keys, "probe_id", "_probe").join(settle(found), [*keys, "_probe"]).drop("_probe")


def learn_store_aliases(aliases: DataFrame, corrections: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Alias table after user corrections (old_name, new_name, corrected_at); the last correction of a name wins."""
    old, new = blank_to_null(F.col("old_name")), blank_to_null(F.col("new_name"))
    learnt = (
        corrections.where(old.isNotNull() & new.isNotNull() & (old != new))
        .withColumn("key", norm_store_key(F.col("old_name"))).where("key <> ''")
        .groupBy(*keys, "key").agg(F.max(F.struct("corrected_at", new.alias("canonical"))).alias("_l"))
        .select(*keys, "key", F.col("_l.canonical").alias("canonical"))
    )
    kept = aliases.select(*keys, "key", "canonical").join(learnt, [*keys, "key"], "left_anti")
    return kept.unionByName(learnt)
