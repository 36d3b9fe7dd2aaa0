"""Keyword packs per language and country, used to read receipt text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tillwise.functions.text import any_of

# Keyword packs. Extended packs add to the base pack where the base words also apply.
BASE = {
    "total_strong": ("grand total", "total to pay", "amount due"),
    "total_weak": ("total", "amount", "balance", "grand"),
    "total_minor": (),
    "total_negative": ("subtotal",),
    "date_positive": ("date", "time", "purchase", "cashier"),
    "date_negative": ("expiry", "best before", "due"),
    "stop_exact": ("receipt", "store", "total", "subtotal", "date", "time", "thanks", "welcome", "cashier"),
    "stop_contains": ("vat", "tax", "phone", "tel", "www.", "http", "address", "terminal"),
    "address": ("street", "st ", "road", "rd ", "ave", "avenue", "postcode", "zip"),
    "brands": (),
}
SWEDISH = {
    **BASE,
    "total_strong": ("att betala", "attbetala", "summa att betala", "totalt att betala"),
    "total_weak": ("summa", "total", "totalt", "belopp"),
    "total_negative": ("delsumma", "subtotal"),
    "date_positive": ("datum", "tid", "köp", "kop", "kassa"),
    "date_negative": ("bäst före", "bast fore", "förfall", "forfall"),
    "stop_exact": BASE["stop_exact"] + ("kvitto", "butik", "summa", "datum", "tid", "tack", "välkommen"),
    "stop_contains": BASE["stop_contains"] + ("org.nr", "org nr", "moms", "telefon", "kvitt", "kassa"),
    "address": BASE["address"] + ("gata", "gatan", "väg", "vagen", "vägen", "postnr", "postnummer"),
    "brands": (
        "ica", "coop", "willys", "hemköp", "city gross", "lidl", "maxi", "7-eleven", "seven eleven", "systembolaget",
    ),
}
SPANISH = {
    **BASE,
    "total_strong": ("total a pagar", "importe total", "a pagar"),
    "total_weak": ("total", "importe", "saldo"),
    "date_positive": ("fecha", "hora", "compra"),
    "date_negative": ("caducidad", "venc", "consumir preferentemente"),
    "stop_exact": BASE["stop_exact"] + ("ticket", "gracias", "bienvenido"),
    "stop_contains": BASE["stop_contains"] + ("cif", "nif", "iva", "teléfono", "telefono"),
    "address": BASE["address"] + ("calle", "c/", "av", "avenida", "plaza", "paseo", "cp"),
}
COLOMBIAN = {
    **SPANISH,
    "total_strong": SPANISH["total_strong"] + ("total pagar",),
    "stop_contains": SPANISH["stop_contains"] + ("nit", "régimen", "regimen"),
    "address": SPANISH["address"] + ("carrera", "cra", "cll", "km", "bogotá", "medellín"),
}
# Used where no locale is known at all.
MIXED = {
    **BASE,
    "total_strong": ("att betala", "attbetala", "summa att betala", "totalt att betala"),
    "total_weak": ("summa", "total", "totalt", "belopp"),
    "total_minor": ("amount", "balance", "grand"),
    "date_positive": ("datum", "date", "köp", "kop", "purchase", "kassa", "tid", "time"),
    "date_negative": ("bäst före", "bast fore", "best before", "expiry", "förfall", "forfall", "due"),
    "stop_exact": (
        "kvitto", "receipt", "butik", "store", "total", "summa", "datum", "date", "tid", "time", "tack", "thanks",
        "välkommen", "welcome",
    ),
    "stop_contains": (
        "org.nr", "org nr", "vat", "moms", "affärsidé", "affarside", "tel", "telefon", "phone", "www.", "http",
        "address", "adress", "kvitt", "receipt", "terminal", "kassa", "cashier",
    ),
    "address": (
        "gata", "gatan", "väg", "vagen", "vägen", "street", "st ", "road", "rd ", "ave", "avenue", "postcode",
        "postnr", "postnummer",
    ),
    "brands": ("ica", "coop", "willys", "hemköp", "city gross", "lidl", "maxi", "7-eleven", "seven eleven"),
}
PACKS = {"base": BASE, "sv-SE": SWEDISH, "es-ES": SPANISH, "es-CO": COLOMBIAN, "mixed": MIXED}

# Month names; English ones are known in every pack.
ENGLISH_MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5,
    "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9,
    "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
SWEDISH_MONTHS = {
    "januari": 1, "februari": 2, "mars": 3, "maj": 5, "juni": 6, "juli": 7, "augusti": 8, "okt": 10,
    "oktober": 10, "dek": 12,
}
SPANISH_MONTHS = {
    "ene": 1, "enero": 1, "febrero": 2, "marzo": 3, "abr": 4, "abril": 4, "mayo": 5, "junio": 6, "julio": 7,
    "ago": 8, "agosto": 8, "septiembre": 9, "octubre": 10, "noviembre": 11, "dic": 12, "diciembre": 12,
}
MONTHS = {
    "base": ENGLISH_MONTHS, "mixed": ENGLISH_MONTHS, "sv-SE": {**ENGLISH_MONTHS, **SWEDISH_MONTHS},
    "es-ES": {**ENGLISH_MONTHS, **SPANISH_MONTHS}, "es-CO": {**ENGLISH_MONTHS, **SPANISH_MONTHS},
}
#: Month names of all packs.
MONTH_NAMES = tuple(dict.fromkeys(name for names in MONTHS.values() for name in names))


def locale_id(language: Column, country: Column) -> Column:
    """Pack for a language and country: both, else the language, else the country, else the base pack."""
    lang = F.coalesce(F.nullif(F.lower(F.substring_index(language, "-", 1)), F.lit("")), F.lit("en"))
    land = F.coalesce(F.nullif(F.upper(country), F.lit("")), F.lit("US"))
    return (
        F.when((lang == "sv") & (land == "SE"), "sv-SE")
        .when((lang == "es") & (land == "ES"), "es-ES")
        .when((lang == "es") & (land == "CO"), "es-CO")
        .when(lang == "sv", "sv-SE").when(lang == "es", "es-ES")
        .when(land == "SE", "sv-SE").when(land == "ES", "es-ES").when(land == "CO", "es-CO")
        .otherwise("base")
    )


def any_pack(*kinds: str) -> str:
    """Regex that finds the words which any pack lists under one of the kinds."""
    return any_of(dict.fromkeys(w for lists in PACKS.values() for kind in kinds for w in lists[kind]))


def words(locale: Column, kind: str) -> Column:
    """One keyword list as an array, chosen per row by its pack."""
    chain = None
    for pack, lists in PACKS.items():
        value = F.array(*[F.lit(w) for w in lists[kind]]).cast("array<string>")
        chain = F.when(locale == pack, value) if chain is None else chain.when(locale == pack, value)
    return chain.otherwise(F.array(*[F.lit(w) for w in BASE[kind]]).cast("array<string>"))


def months(locale: Column) -> Column:
    """Month names to numbers, chosen per row by its pack."""
    def table(names: dict) -> Column:
        return F.map_from_arrays(
            F.array(*[F.lit(k) for k in names]), F.array(*[F.lit(v) for v in names.values()])
        )

    return (
        F.when(locale == "sv-SE", table(MONTHS["sv-SE"]))
        .when(locale.isin("es-ES", "es-CO"), table(MONTHS["es-ES"]))
        .otherwise(table(ENGLISH_MONTHS))
    )


def locale_keywords(spark):
    """All packs as a long table (locale, kind, word)."""
    rows = [(pack, kind, w) for pack, lists in PACKS.items() for kind, found in lists.items() for w in found]
    return spark.createDataFrame(rows, "locale string, kind string, word string")
