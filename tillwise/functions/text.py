"""String columns: name keys, store names, markers, filenames, text quality."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Alcohol vocabulary and the class each list stands for, in order of precedence.
ALCOHOL_WORDS = (
    ("Beer", ("öl", "ol", "beer", "lager", "ipa", "ale", "stout", "porter", "pils", "pilsner")),
    ("Cider", ("cider",)),
    ("Wine", ("vin", "wine", "prosecco", "champagne", "cava", "sparkling")),
    (
        "Spirits",
        (
            "sprit", "spirit", "spirits", "whisky", "whiskey", "vodka", "gin", "rom", "rum",
            "tequila", "brandy", "cognac", "likör", "likor", "liqueur",
        ),
    ),
)
VINEGAR_WORDS = ("vinegar", "vinäger", "vinager")
# Units dropped from canonical names.
UNIT_WORDS = ("kg", "g", "l", "ml", "pcs", "pc", "st", "x")
# Anchors of receipt text, words that mark a bad store name.
QUALITY_ANCHORS = ("total", "totalt", "sek", "moms", "vat", "kvitto", "receipt", "summa")
BAD_STORE_WORDS = (
    "vägen", "vagen", "gatan", "gata", "street", "road", "tel", "orgnr", "org nr",
    "affärsidé", "affarside", "welcome", "välkommen", "kvitto", "receipt",
)
# Extension sets.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".heic", ".heif")
RECEIPT_EXTENSIONS = (".pdf",) + IMAGE_EXTENSIONS

LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"
_REGEX_SPECIAL = set(r"\.^$|?*+()[]{}")


def any_of(words) -> str:
    """A regex that finds any of the literal words."""
    return "|".join("".join("\\" + ch if ch in _REGEX_SPECIAL else ch for ch in w) for w in words)


def contains_any(c: Column, words) -> Column:
    return c.rlike(any_of(words))


# Every character that counts as white space.
WHITESPACE = (
    " \t\n\u000b\u000c\r\u001c\u001d\u001e\u001f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITESPACE))


def bound(c: Column, fn) -> Column:
    """``fn(c)`` with ``c`` worked out once, however often ``fn`` mentions it."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def blank_to_null(c: Column) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def fold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s{2,}", " ")


def norm_name(c: Column) -> Column:
    """Matching key of a name: folded, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def norm_store_key(c: Column) -> Column:
    return norm_name(c)


def norm_digits(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c.cast("string"), r"[^0-9]", ""), F.lit(""))


def norm_text(c: Column) -> Column:
    return F.nullif(squeeze(strip(c.cast("string"))), F.lit(""))


def semantic_store_key(c: Column) -> Column:
    return squeeze(fold(strip(F.coalesce(c, F.lit("")))))


def tokens_of(c: Column, min_len: int = 3) -> Column:
    """Distinct word tokens of at least ``min_len`` characters."""
    parts = F.split(fold(c), r"[^\p{L}\p{N}_]+")
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) >= min_len))


def token_overlap(left: Column, right: Column) -> Column:
    """Share of the left tokens that also occur on the right; 0 when either side has none."""
    common = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), F.try_divide(common, F.size(left))).otherwise(F.lit(0.0))


def alcohol_class(c: Column) -> Column:
    """Beer, Cider, Wine or Spirits; null for anything else, vinegars and alcohol-free drinks."""
    norm = norm_name(c)
    words = F.split(norm, " ")

    def has(options) -> Column:
        return F.arrays_overlap(words, F.array(*[F.lit(w) for w in options]))

    alcohol_free = (
        contains_any(norm, ("alkoholfri", "non alcoholic", "nonalcoholic", "alcohol free", "alcoholfree"))
        | (F.array_contains(words, "alkohol") & F.array_contains(words, "fri"))
        | fold(c).rlike(r"\b0[.,]0\b")
    )
    chain = F.when(has(VINEGAR_WORDS) | alcohol_free, F.lit(None).cast("string"))
    for name, options in ALCOHOL_WORDS:
        chain = chain.when(has(options), F.lit(name))
    return chain


def canonical_name(c: Column) -> Column:
    """Display name of a new product: the alcohol class, or the name without sizes and units."""
    raw = strip(c)

    def keep(token: Column) -> Column:
        key = norm_name(token)
        return (key != "") & ~token.rlike(r"[0-9]") & ~key.isin(*UNIT_WORDS)

    kept = F.array_join(F.filter(F.split(raw, r"(?U)\s+"), keep), " ")
    plain = F.when(kept == "", raw).otherwise(kept)
    return F.coalesce(alcohol_class(raw), strip(plain))


def normalize_store_name(c: Column) -> Column:
    """Readable store name without punctuation noise; null when nothing usable is left."""
    def joined(base: Column) -> Column:
        spelled_out = F.replace(base, F.lit(" "), F.lit(""))
        rejoined = F.regexp_replace(base, r"(?<=(?:^| )\p{L}) (?=\p{L}(?: |$))", "")
        rejoined = F.regexp_replace(rejoined, r"(^| )(\p{L}{3,}) (\p{L})$", "$1$2$3")
        name = F.when(base.rlike(r"^\S( \S)*$"), spelled_out).otherwise(rejoined)
        return squeeze(F.regexp_replace(name, r"^[ \-–—|]+|[ \-–—|]+$", ""))

    def cased(name: Column) -> Column:
        letters = F.length(F.regexp_replace(name, r"[^\p{L}]", ""))
        upper = F.length(F.regexp_replace(name, r"[^\p{Lu}]", ""))
        shown = F.when((letters > 0) & (F.try_divide(upper, letters) >= 0.85), F.initcap(F.lower(name))).otherwise(name)
        return F.when(F.length(name) >= 2, shown)

    def named(base: Column) -> Column:
        low = F.lower(base)
        rejected = low.isin("kvitto", "receipt") | (low.contains("kvitto") & (F.length(base) <= 10))
        return F.when(~rejected, bound(joined(base), cased))

    base = strip(squeeze(F.regexp_replace(squeeze(strip(c)), r"[^\p{L}\p{N}_\s&'’-]", " ")))
    return bound(base, named)


def store_name_needs_help(c: Column) -> Column:
    """True for a missing store name and for one that looks like an address, slogan or number."""
    s = strip(F.coalesce(c, F.lit("")))
    digits = F.length(F.regexp_replace(s, r"[^0-9]", ""))
    return (s == "") | contains_any(fold(s), BAD_STORE_WORDS) | (digits >= 3) | (F.length(s) < 3)


def low_text_quality(c: Column) -> Column:
    """True for text too short, too symbol-heavy or without receipt words to be worth parsing."""
    s = strip(F.coalesce(c, F.lit("")))
    dense = F.regexp_replace(s, r"(?U)\s", "")
    n = F.length(dense)
    letters = F.length(F.regexp_replace(dense, r"[^\p{L}]", ""))
    digits = F.length(F.regexp_replace(dense, r"[^0-9]", ""))
    letter_ratio = F.try_divide(letters, n)
    other_ratio = F.try_divide(n - letters - digits, n)
    return (
        (F.length(s) < 80)
        | (n < 80)
        | ((letter_ratio < 0.18) & (digits < 20))
        | (other_ratio > 0.45)
        | (~contains_any(fold(s), QUALITY_ANCHORS) & (letter_ratio < 0.25))
    )


def split_store_tag(c: Column) -> tuple[Column, Column]:
    """(base, store) of ``base @ store``; the tag is the part after the last `` @ ``."""
    raw = strip(F.coalesce(c, F.lit("")))
    base = strip(F.regexp_extract(raw, r"(?s)^(.*) @ (.*)$", 1))
    store = strip(F.regexp_extract(raw, r"(?s)^(.*) @ (.*)$", 2))
    tagged = (base != "") & (store != "")
    return F.when(tagged, base).otherwise(raw), F.when(tagged, store)


def apply_marker(c: Column, marker: str, position: str) -> Column:
    base, mark = strip(c), (marker or "").strip()
    if not mark:
        return base
    marked = F.concat(base, F.lit(" " + mark)) if position == "suffix" else F.concat(F.lit(mark + " "), base)
    return F.when(base == "", base).otherwise(marked)


def strip_marker(c: Column, marker: str, position: str) -> Column:
    text, mark = strip(c), (marker or "").strip()
    if not mark:
        return text
    size = len(mark) + 1
    if position == "suffix":
        kept = strip(F.substring(text, F.lit(1), F.length(text) - size))
        return F.when(F.endswith(text, F.lit(" " + mark)), kept).otherwise(text)
    kept = strip(F.substring(text, F.lit(size + 1), F.length(text)))
    return F.when(F.startswith(text, F.lit(mark + " ")), kept).otherwise(text)


def list_key(c: Column) -> Column:
    return strip(fold(F.coalesce(c, F.lit(""))))


def safe_filename(c: Column, fallback: str) -> Column:
    """Last path component without control characters. Longer than 255 characters, a file system's limit, its stem is shortened; the extension stays."""
    raw = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("/"))
    last = strip(F.element_at(F.split(strip(raw), "/"), -1))
    last = F.regexp_replace(last, r"[\x00-\x1f]", "")
    named = F.when(last.isin("", ".", ".."), F.lit(fallback)).otherwise(last)
    ext = F.regexp_extract(named, r"\.[^.]{1,16}$", 0)
    short = F.concat(F.substring(named, F.lit(1), 255 - F.length(ext)), ext)
    return F.when(F.length(named) > 255, short).otherwise(named)


def file_ext(c: Column) -> Column:
    """Lower-cased extension with its dot; empty for none and for dot files."""
    return F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"[^/.][^/]*(\.[^./]*)$", 1))


def is_pdf(c: Column) -> Column:
    return file_ext(c) == ".pdf"


def is_image(c: Column) -> Column:
    return file_ext(c).isin(*IMAGE_EXTENSIONS)


def text_lines(c: Column) -> Column:
    """Trimmed non-blank lines of a text as an array; whole text, order kept."""
    # Split at one plain character: a pattern would be compiled anew for every text.
    parts = F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), LINE_BREAK, "\n"), "\n"), strip)
    return F.filter(parts, lambda line: line != "")
