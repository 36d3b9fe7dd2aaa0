"""Personal data by patterns, and information-theoretic sanitisation of what stands beside it (DataFrame functions only).

Patterns find emails, IP addresses, card and phone numbers. A word that stands near such an entity may give it away even
when the entity itself is gone. For each entity e and each term t near it, the corpus gives p(e|t), the share of all
occurrences of t that lie beside e, and the information log2(p(e|t) / p(e)) that t tells about e. Terms above the
thresholds are removed (kind ``term``) or generalised (kind ``hint``) where they stand beside that entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillwise.llm.common import keyed
from tillwise.session import settle

_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns. Each is written so that a search takes time in proportion to the text and no deep stack: runs are
#: possessive and start only where a run starts (or where the match before ended); the matches are those of the plain patterns.
#: The card pattern finds the maximal digit chains of 14 to 19 digits at once.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GUARDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
KINDS = [*PATTERNS, "term", "hint"]
#: Characters on either side of an entity whose words count as beside it.
NEAR = 48
#: A term seen SUPPORT times beside an entity, telling at least BITS about it, is removed from p(e|t) = REMOVE on and generalised from
#: GENERALISE on.
SUPPORT, BITS, REMOVE, GENERALISE = 2, 1.0, 0.5, 0.2
_WORD = r"\p{L}{3,}+"


def _luhn(match: Column) -> Column:
    digits = F.reverse(F.regexp_replace(match, "[ -]", ""))

    def worth(d: Column, i: Column) -> Column:
        n = d.cast("int") * (1 + i % 2)
        return F.when(n > 9, n - 9).otherwise(n)

    return F.aggregate(F.transform(F.split(digits, ""), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def located(text: Column, pattern: str, matches: Column) -> Column:
    """Array of (start, end, value) in code points, from the pieces between the matches."""
    steps = F.zip_with(F.split(text, pattern, -1), matches, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m")))
    spot = "array<struct<start:int,end:int,value:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(spot).alias("found"))

    def step(s: Column, x: Column) -> Column:
        start = s.at + x.gap
        end = start + F.length(x.m)
        spot_here = F.struct(start.alias("start"), end.alias("end"), x.m.alias("value"))
        return F.when(x.m.isNull(), s).otherwise(F.struct(end.alias("at"), F.concat(s.found, F.array(spot_here)).alias("found")))

    return F.aggregate(steps, zero, step, lambda s: s.found)


def base_spans(docs: DataFrame) -> DataFrame:
    """(_id, _th, text, spans): (start, rank, end, kind, value) of all valid base matches, by start, then kind."""
    rows = keyed(docs)
    none = F.array().cast("array<string>")
    raw = []
    for kind, pattern in PATTERNS.items():
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        raw.append((F.when(F.contains("text", F.lit(GUARDS[kind])), found).otherwise(none) if GUARDS[kind] else found).alias(f"m_{kind}"))
    rows = rows.select("_id", "_th", "text", *raw)
    parts = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        m = F.col(f"m_{kind}")
        spots = F.filter(located(F.col("text"), pattern, m), lambda x: _valid(kind, x.value))
        shaped = F.transform(spots, lambda x: F.struct(
            x.start.alias("start"), F.lit(rank).alias("rank"), x.end.alias("end"), F.lit(kind).alias("kind"), x.value.alias("value"),
        ))
        parts.append(F.when(F.exists(m, lambda x: _valid(kind, x)), shaped).otherwise(F.array().cast(SPANS)))
    return rows.select("_id", "_th", "text", F.sort_array(F.concat(*parts)).alias("spans"))


SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def _beside(text: Column, spans: Column) -> Column:
    """Array of (entity, term, start, end): the words within NEAR characters of each span and outside all spans."""
    size = F.length(text)

    def of_span(x: Column) -> Column:
        entity = F.concat(x.kind, F.lit(":"), F.lower(x.value))
        out = []
        for lo, hi in ((F.greatest(F.lit(0), x.start - NEAR), x.start), (x.end, F.least(size, x.end + NEAR))):
            part = F.substring(text, lo + 1, hi - lo)
            words = located(part, _WORD, F.regexp_extract_all(part, F.lit(_WORD), F.lit(0)))
            # A word cut by the border of the neighbourhood is no word.
            whole = F.filter(words, lambda w: ((w.start + lo > lo) | (lo == 0) | (lo == x.end)) & ((w.end + lo < hi) | (hi == size) | (hi == x.start)))
            out.append(F.transform(whole, lambda w: F.struct(entity.alias("entity"), F.lower(w.value).alias("term"), (w.start + lo).alias("start"), (w.end + lo).alias("end"))))
        return F.concat(*out)

    near = F.flatten(F.transform(spans, of_span))
    return F.filter(near, lambda w: ~F.exists(spans, lambda s: (s.start < w.end) & (w.start < s.end)))


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, n): how often each word of three or more letters occurs in all whole texts."""
    words = F.explode(F.split(F.lower("text"), r"[^\p{L}]+"))
    return docs.where("text is not null").select(words.alias("term")).where(F.length("term") >= 3).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def disclosing(beside: DataFrame, counts: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, term, kind): the terms beside an entity that tell too much about it.

    beside: (entity, term) per occurrence; counts: (term, n) over the corpus; entities: (entity, n_e) occurrences.
    """
    total = entities.agg(F.sum("n_e")).first()[0] or 1
    pairs = beside.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te")).where(F.col("n_te") >= SUPPORT)
    known = F.least(F.lit(1.0), F.col("n_te") / F.col("n"))
    pairs = pairs.join(counts, "term").withColumn("p", known).where(F.col("p") >= GENERALISE)
    told = F.log2(F.col("p") / (F.col("n_e") / F.lit(total)))
    pairs = pairs.join(entities, "entity")
    return pairs.where(told >= BITS).select("entity", "term", F.when(F.col("p") >= REMOVE, "term").otherwise("hint").alias("kind"))


def find_personal(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, _th, base (the spans of the patterns) and spans (with the added ones), each an
    array of (start, rank, end, kind), start and end in code points, by start, then kind.

    Null and empty texts have no spans. Rows that repeat a doc_id with the same text get the same spans and count
    as occurrences of their own; null ids are kept; other columns are ignored; an empty table gives no rows.
    """
    found = base_spans(docs)
    near = F.when(F.size("spans") > 0, _beside(F.col("text"), F.col("spans"))).otherwise(F.array().cast(NEARBY))
    found = settle(found.select("_id", "_th", "spans", near.alias("near")))
    entity = F.concat(F.col("s.kind"), F.lit(":"), F.lower("s.value"))
    entities = found.select(F.explode("spans").alias("s")).groupBy(entity.alias("entity")).agg(F.count(F.lit(1)).alias("n_e"))
    beside = found.select("_id", "_th", F.explode("near").alias("w")).select("_id", "_th", "w.*")
    flagged = settle(disclosing(beside.select("entity", "term"), term_counts(docs), entities))
    extra = beside.join(flagged, ["entity", "term"])
    # A word beside two entities is removed if either asks for it.
    extra = extra.groupBy("_id", "_th", "start", "end").agg(F.max("kind").alias("kind"))
    rank = F.when(F.col("kind") == "term", KINDS.index("term")).otherwise(KINDS.index("hint"))
    extra = extra.groupBy("_id", "_th").agg(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind")).alias("added"))
    short = F.transform("spans", lambda x: F.struct(x.start.alias("start"), x["rank"].alias("rank"), x.end.alias("end"), x.kind.alias("kind")))
    base = found.select("_id", "_th", short.alias("base"))
    both = base.join(extra.withColumnsRenamed({"_id": "x_id", "_th": "x_th"}), base["_id"].eqNullSafe(F.col("x_id")) & (base["_th"] == F.col("x_th")), "left")
    all_spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "added")))
    return both.select(F.col("_id").alias("doc_id"), "_th", "base", all_spans.alias("spans"))


NEARBY = "array<struct<entity:string,term:string,start:int,end:int>>"


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the spans of :func:`find_personal` replaced: entities by [KIND], terms by nothing, hints by [WORD]."""
    spans = found.select(F.col("doc_id").alias("r_id"), F.col("_th").alias("r_th"), F.col("spans").alias("r_spans")).where(F.size("r_spans") > 0).distinct()
    th = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    both = docs.withColumn("d_th", th)
    both = both.join(spans, both["doc_id"].eqNullSafe(spans["r_id"]) & (both["d_th"] == spans["r_th"]), "left")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        mark = F.when(x.kind == "term", "").when(x.kind == "hint", "[WORD]").otherwise(F.concat(F.lit("["), F.upper(x.kind), F.lit("]")))
        gap = F.concat(s.out, F.substring(F.col("text"), s.at + 1, F.greatest(F.lit(0), x.start - s.at)))
        out = F.when(x.start >= s.at, F.concat(gap, mark)).otherwise(s.out)
        return F.struct(F.greatest(s.at, x.end).alias("at"), out.alias("out"))

    text = F.aggregate("r_spans", zero, step, lambda s: F.concat(s.out, F.substring(F.col("text"), s.at + 1, F.length("text"))))
    return both.withColumn("text", F.coalesce(text, F.col("text"))).select(*docs.columns)
