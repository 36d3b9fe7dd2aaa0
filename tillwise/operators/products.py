"""Fuzzy matching of item names to products.

Names arrive in order. A name equal to a known one joins its product; else it joins the product of the most
similar earlier name when the similarity reaches 75 %; else it starts a product of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tillwise.functions.text import canonical_name, norm_name
from tillwise.session import settle

THRESHOLD = 0.75
# Characters from rare to common. Any fixed order gives the same pairs; this one keeps the blocks small.
RARE_FIRST = "qjxzwkvfybhgmpudclnotirsae0123456789 "


def similarity(left: str, right: str) -> Column:
    """Matching-blocks ratio of two text columns; only pairs that passed every exact filter get here."""

    # A local function travels to the workers by value, so they need not have this package installed.
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(ratio, T.DoubleType())(left, right)


def _elements(name: Column) -> Column:
    """The characters of a text with their running number among equal ones: equal elements of two texts are the
    characters they share, counted with repetition."""
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).cast("string")))


def may_be_similar(left: Column, right: Column) -> Column:
    """Whether two texts share enough characters for the ratio to reach the threshold: matching blocks cannot hold more
    characters than the texts share."""
    shared = F.size(F.array_intersect(left, right))
    return 2 * shared >= F.ceil(THRESHOLD * (F.size(left) + F.size(right)))


def block_keys(df: DataFrame, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per blocking key: first character, one token and a pair of rare characters.

    Two names that are 75 % alike and have T characters together share at least .375 T of them, counted with
    repetition, and the shorter has at least .6 of the length of the longer. So at least ``ceil(.6 n)``
    characters of a name of length n are shared, and two of the shared ones are among its first
    ``n - ceil(.6 n) + 2`` in any fixed order of characters. A pair that is alike therefore meets under some
    key, while names that only share a frequent token mostly do not.
    """
    staged = df.withColumn("_chars", F.split(name, "")).withColumn(
        "_elements",
        F.expr(
            "array_sort(transform(_chars, (c, i) -> struct("
            f"instr('{RARE_FIRST}', c) as o, c as c, size(filter(slice(_chars, 1, i + 1), x -> x = c)) as k)))"
        ),
    )
    n = F.length(name)
    prefix = F.least(n - F.ceil(n * F.lit(0.6)).cast("int") + 2, n)
    ids = F.transform(F.slice("_elements", F.lit(1), prefix), lambda e: F.concat(e["c"], e["k"].cast("string")))
    pairs = F.expr("flatten(transform(_ids, (a, i) -> transform(slice(_ids, i + 2, size(_ids)), b -> concat(a, '/', b))))")
    tokens = F.array_distinct(F.filter(F.split(name, " "), lambda t: t != ""))
    return (
        staged.withColumn("_ids", ids).withColumn("_pair", F.explode(pairs)).withColumn("_token", F.explode(tokens))
        .select(*df.columns, F.concat_ws("|", *keys, F.substring(name, 1, 1), "_token", "_pair").alias("_key"))
    )


def similar_pairs(names: DataFrame, surfaces: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, name, surface, ratio) of different texts that reach the threshold.

    A pair also needs the same first character, a common token and a length gap of at most
    ``max(8, half the name)``. ``names`` has ``name``, ``surfaces`` has ``surface``, both normalised and distinct for
    each tenant. Pairs that share too few characters never reach the ratio itself, which runs in Python.
    """
    keys = list(keys)
    left, right = block_keys(names.select(*keys, "name"), "name", keys), block_keys(surfaces.select(*keys, "surface"), "surface", keys)
    a, b = F.length("name"), F.length("surface")
    fits = (F.least(a, b) >= 0.6 * F.greatest(a, b)) & (F.abs(a - b) <= F.greatest(F.lit(8), F.floor(a / 2)))
    candidates = left.join(right, ["_key", *keys]).where((F.col("name") != F.col("surface")) & fits)
    candidates = candidates.select(*keys, "name", "surface").distinct()
    candidates = candidates.where(may_be_similar(_elements(F.col("name")), _elements(F.col("surface"))))
    return candidates.withColumn("ratio", similarity("name", "surface")).where(F.col("ratio") >= THRESHOLD)


def cluster_names(names: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Root name of every distinct name: (*keys, name, root, ratio).

    ``names`` has ``name`` (normalised, distinct, not empty), ``rank`` (arrival order), ``canonical`` (the
    normalised display name its product would get) and ``fixed_root`` (the root of a name that already belongs
    to a product, else null), and the ``keys`` of its tenant. The parent of a name is its most similar earlier surface,
    which is an earlier name or the display name of an earlier root; ties go to the product created first. Parents are
    followed to their roots by doubling. Since ties and display names depend on the roots, this repeats until they are
    stable. It ends: the parent of a name depends on earlier names only, so each round settles at least the first
    unsettled name.
    """
    keys = list(keys)
    names = settle(names.select(*keys, "name", "rank", "canonical", "fixed_root"))
    surfaces = names.select(*keys, F.col("name").alias("surface")).unionByName(
        names.where("canonical <> ''").select(*keys, F.col("canonical").alias("surface"))
    ).distinct()
    open_names = names.where("fixed_root is null")
    same = open_names.select(*keys, "name", F.col("name").alias("surface"), F.lit(1.0).alias("ratio"))
    pairs = settle(similar_pairs(open_names, surfaces, keys).unionByName(same))
    roots = names.select(*keys, "name", F.coalesce("fixed_root", "name").alias("root"), F.lit(None).cast("double").alias("ratio"))
    while True:
        updated = settle(_follow(_parents(names, pairs, roots, keys), keys))
        before = roots.select(*keys, "name", F.col("root").alias("_old"))
        stable = updated.join(before, [*keys, "name"]).where("root <> _old").isEmpty()
        roots = updated
        if stable:
            return roots


def _parents(names: DataFrame, pairs: DataFrame, roots: DataFrame, keys: list[str]) -> DataFrame:
    ranks = names.select(*keys, F.col("name").alias("root"), F.col("rank").alias("root_rank"))
    known = roots.select(*keys, "name", "root").join(ranks, [*keys, "root"]).join(names.select(*keys, "name", "rank", "canonical"), [*keys, "name"])
    own = known.select(*keys, F.col("name").alias("surface"), "name", "rank", "root_rank")
    heads = known.where("root = name and canonical <> ''").select(
        *keys, F.col("canonical").alias("surface"), "name", "rank", "root_rank"
    )
    owners = own.unionByName(heads).select(
        *keys, "surface", F.col("name").alias("owner"), F.col("rank").alias("owner_rank"), "root_rank"
    )
    offers = pairs.join(names.select(*keys, "name", "rank"), [*keys, "name"]).join(owners, [*keys, "surface"]).where("owner_rank < rank")
    best = offers.groupBy(*keys, "name").agg(
        F.min(F.struct((-F.col("ratio")).alias("neg"), "root_rank", "owner_rank", "owner")).alias("_b")
    )
    return names.join(best, [*keys, "name"], "left").select(
        *keys, "name", F.coalesce("fixed_root", "_b.owner", "name").alias("root"), (-F.col("_b.neg")).alias("ratio")
    )


def _follow(parents: DataFrame, keys: list[str]) -> DataFrame:
    """Parents replaced by their roots; the distance covered doubles in every pass."""
    current = settle(parents)
    while True:
        hop = current.select(*keys, F.col("name").alias("root"), F.col("root").alias("_next"))
        moved = current.join(hop, [*keys, "root"])
        if moved.where("_next <> root").isEmpty():
            return current
        current = settle(moved.select(*keys, "name", F.col("_next").alias("root"), "ratio"))


def known_names(products: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, name, product_id, seq, canonical) of the names of existing products; the oldest product owns a name."""
    raw = F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    rows = products.withColumn("seq", F.unix_micros(F.col("created_at").cast("timestamp"))).select(
        *keys, "product_id", "seq", norm_name(F.col("canonical_name")).alias("canonical"), raw.alias("raw")
    )
    rows = rows.withColumn("name", norm_name(F.col("raw"))).where("name <> ''")
    owner = rows.groupBy(*keys, "name").agg(F.min(F.struct("seq", "product_id", "canonical")).alias("_o"))
    return owner.select(*keys, "name", "_o.product_id", "_o.seq", "_o.canonical")


def learnt_names(aliases: DataFrame, known: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The rows that the alias table of :func:`match_products` adds to ``known`` (as from :func:`known_names`).

    A new product takes its place in order from the arrival of its first item, so arrivals have to go on growing
    from batch to batch.
    """
    keys = list(keys)
    rows = aliases.withColumn("name", norm_name(F.col("alias"))).where("name <> ''").join(known.select(*keys, "name"), [*keys, "name"], "left_anti")
    made = aliases.groupBy(*keys, "product_id").agg(F.min("first_at").alias("_at"), F.max(norm_name(F.col("canonical_name"))).alias("_canonical"))
    heads = known.groupBy(*keys, "product_id").agg(F.min("seq").alias("_seq"), F.min("canonical").alias("_known"))
    out = rows.select(*keys, "name", "product_id").distinct().join(made, [*keys, "product_id"]).join(heads, [*keys, "product_id"], "left")
    return out.select(*keys, "name", "product_id", F.coalesce("_seq", "_at").cast("long").alias("seq"), F.coalesce("_known", "_canonical").alias("canonical"))


def _rank(batch: int, seq, tie):
    return F.struct(F.lit(batch).alias("batch"), seq.cast("long").alias("seq"), tie.alias("tie"))


def _new_id(keys: Sequence[str], *parts: Column) -> Column:
    """An identifier that follows from the tenant and the parts."""
    tenant = [F.concat(F.coalesce(F.col(k).cast("string"), F.lit("")), F.lit("\x00")) for k in keys]
    return F.substring(F.sha2(F.concat(*tenant, *parts), 256), 1, 32)


def match_products(
    items: DataFrame, products: DataFrame | None = None, name: str = "raw_name", arrival: str = "arrival",
    keys: Sequence[str] = (), known: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Item rows with ``product_id`` and ``match_confidence``, and the long alias table of all products.

    ``arrival`` is a whole number giving the order of the rows. ``products`` has ``product_id, canonical_name,
    aliases, created_at``; ``known`` gives their names as :func:`known_names` does, where they are kept in that form.
    Rows whose name has no letters or digits each get a product of their own. The alias table has ``product_id,
    canonical_name, alias, is_new, first_at`` (the first arrival of that spelling). Names only meet names of the same
    ``keys``; key columns must not be null.
    """
    keys = list(keys)
    normed = items.withColumn("_name", norm_name(F.col(name)))
    first = normed.where("_name <> ''").groupBy(*keys, "_name").agg(F.min(F.struct(arrival, name)).alias("_f"))
    first = settle(first.select(*keys, F.col("_name").alias("name"), F.col(f"_f.{arrival}").alias("at"), F.col(f"_f.{name}").alias("raw")))
    arriving = first.select(
        *keys, "name", _rank(1, F.col("at"), F.col("name")).alias("rank"),
        norm_name(canonical_name(F.col("raw"))).alias("canonical"), F.lit(None).cast("string").alias("fixed_root"),
    )
    owners = first.where("false").select(*keys, "name", F.lit(None).cast("string").alias("product_id"))
    if products is not None or known is not None:
        known = settle(known_names(products, keys) if known is None else known.select(*keys, "name", "product_id", "seq", "canonical"))
        ranked = known.withColumn("rank", _rank(0, F.col("seq"), F.concat_ws("|", "product_id", "name")))
        heads = ranked.groupBy(*keys, "product_id").agg(F.min(F.struct("rank", "name"))["name"].alias("fixed_root"))
        existing = ranked.join(heads, [*keys, "product_id"]).select(*keys, "name", "rank", "canonical", "fixed_root")
        arriving = existing.unionByName(arriving.join(known.select(*keys, "name"), [*keys, "name"], "left_anti"))
        owners = known.select(*keys, "name", F.col("product_id").cast("string"))
    roots = cluster_names(arriving, keys)
    head_ids = owners.select(*keys, F.col("name").alias("root"), F.col("product_id").alias("_known"))
    ids = roots.join(head_ids, [*keys, "root"], "left").select(
        *keys, F.col("name").alias("_name"), "root", "ratio",
        F.coalesce(F.col("_known"), _new_id(keys, F.col("root"))).alias("product_id"), F.col("_known").isNull().alias("is_new"),
    )
    ids = settle(ids.join(first.select(*keys, F.col("name").alias("_name"), F.col("at").alias("_at")), [*keys, "_name"], "left"))
    matched = normed.join(ids.drop("root", "is_new"), [*keys, "_name"], "left")
    own = _new_id(keys, F.lit("row:"), F.col(arrival).cast("string"))
    fuzzy = (F.col(arrival) == F.col("_at")) & F.col("ratio").isNotNull()
    matched = matched.withColumn("product_id", F.coalesce("product_id", own)).withColumn(
        "match_confidence",
        F.when(fuzzy, F.floor(F.col("ratio") * 100)).otherwise(F.lit(100)).cast("int"),
    ).drop("_name", "ratio", "_at").select(*items.columns, "product_id", "match_confidence")
    heads = ids.where("is_new and root = _name").join(first.select(*keys, F.col("name").alias("_name"), "raw"), [*keys, "_name"])
    display = heads.select(*keys, "product_id", canonical_name(F.col("raw")).alias("canonical_name"))
    spelled = normed.where("_name <> ''").groupBy(*keys, "_name", F.col(name).alias("alias")).agg(F.min(arrival).alias("first_at"))
    aliases = spelled.join(ids, [*keys, "_name"]).select(*keys, "product_id", "alias", "is_new", "first_at").join(display, [*keys, "product_id"], "left")
    blank = normed.where("_name = ''").select(
        *keys, own.alias("product_id"), F.col(name).alias("alias"), F.lit(True).alias("is_new"), F.col(arrival).alias("first_at"),
        canonical_name(F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("Unknown"))).alias("canonical_name"),
    )
    return matched, aliases.unionByName(blank)


def new_products(aliases: DataFrame, as_of, keys: Sequence[str] = ()) -> DataFrame:
    """Product rows to add, from the alias table of :func:`match_products`."""
    stamp = F.lit(as_of).cast("timestamp")
    return aliases.where("is_new").groupBy(*keys, "product_id").agg(F.max("canonical_name").alias("canonical_name")).select(
        *keys, "product_id", "canonical_name", F.lit("unknown").alias("unit_type"),
        stamp.alias("created_at"), stamp.alias("updated_at"),
    )
