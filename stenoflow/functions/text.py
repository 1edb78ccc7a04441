"""Text functions as Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: Romanian cedilla letters and their comma forms, and the letters that diacritic folding maps
CEDILLA, COMMA = "şţŞŢ", "șțȘȚ"
_MARKED, _PLAIN = "ăâîșțşţáàäéèëêíïóöôúüûçñйё", "aaiststaaaeeeeiiooouuucnие"


def comma_forms(text: Column) -> Column:
    """Small letters with Romanian comma letters in place of the cedilla ones (null stays null)."""
    return F.translate(F.lower(text), CEDILLA.lower(), COMMA.lower())


def without_diacritics(text: Column) -> Column:
    """Small letters without marks, for comparisons."""
    return F.translate(F.lower(text), _MARKED, _PLAIN)


def words(text: Column) -> Column:
    """Runs of letters, in small letters; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), 0), F.array().cast("array<string>"))


# fixed values: the ordered rewriting rules of the phonetic key (closed vowels and devoiced consonants of the spoken dialect)
PHONETIC_RULES = (
    ("ş", "ș"), ("ţ", "ț"),
    ("che", "ke"), ("chi", "ki"), ("ghe", "ge"), ("ghi", "gi"),
    ("[ăâî]", "a"), ("ș", "s"), ("ț", "t"), ("x", "cs"), ("y", "i"), ("w", "v"), ("q", "c"),
    ("k", "c"), ("ph", "f"), ("th", "t"),
    ("[bp]", "p"), ("[dt]", "t"), ("[gc]", "c"), ("[zs]", "s"), ("[vf]", "f"), ("j", "s"),
    ("e", "i"), ("o", "u"),
)


def phonetic_key(word: Column, collapse: bool = True) -> Column:
    """A key that words of the same sound share; with `collapse`, runs of a letter count once."""
    out = F.lower(word)
    for a, b in PHONETIC_RULES:
        out = F.regexp_replace(out, a, b)
    return F.regexp_replace(out, r"(.)\1+", "$1") if collapse else out


# fixed values: Romanian spelled with Cyrillic letters
_CYRILLIC_TWO = (("ч", "ci"), ("щ", "șt"), ("ю", "iu"), ("я", "ia"), ("ё", "io"), ("ь", ""), ("ъ", ""))
_CYRILLIC_ONE = ("абвгдежзийклмнопрстуфхцшыэ", "abvgdejziiclmnoprstufhțșîe")


def latin_of_cyrillic(text: Column) -> Column:
    """Small letters, Romanian in Cyrillic script rewritten in Latin script."""
    out = F.lower(text)
    for a, b in _CYRILLIC_TWO:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, *_CYRILLIC_ONE)


def latin_of_cyrillic_sql(name: str) -> str:
    """The same of a small-letter value, in SQL."""
    for a, b in _CYRILLIC_TWO:
        name = f"replace({name}, '{a}', '{b}')"
    return f"translate({name}, '{_CYRILLIC_ONE[0]}', '{_CYRILLIC_ONE[1]}')"


def clock(seconds: Column) -> Column:
    """hh:mm:ss, cut to whole seconds."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("long"), (s % 3600 / 60).cast("long"), s % 60)


def seconds_of(stamp: Column) -> Column:
    """Seconds of the first hh:mm:ss or mm:ss in a text, else null."""
    three = F.regexp_extract(stamp, r"(\d{1,2}):(\d{2}):(\d{2})", 0)
    two = F.regexp_extract(stamp, r"(\d{1,2}):(\d{2})", 0)
    part = lambda text, sep, i: F.element_at(F.split(text, sep), i).cast("int")
    return F.when(three != "", part(three, ":", 1) * 3600 + part(three, ":", 2) * 60 + part(three, ":", 3)).when(two != "", part(two, ":", 1) * 60 + part(two, ":", 2))


def sentence_case(text: Column) -> Column:
    """The first letter in capitals, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2_000_000_000))


def html_escape(text: Column, empty: str = "—") -> Column:
    """Markup signs escaped; null and empty texts give `empty`."""
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(text.isNull() | (text == ""), F.lit(empty)).otherwise(out)


def local_date(iso: Column, lang: Column) -> Column:
    """dd.mm.yyyy for ro and ru, the ISO date otherwise; what is no date stays as it is."""
    day = F.try_to_date(F.substring(iso, 1, 10), F.lit("yyyy-MM-dd"))
    return F.when(day.isNotNull() & lang.isin("ro", "ru"), F.date_format(day, "dd.MM.yyyy")).otherwise(iso)


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """Only the first occurrence of old replaced; the text as it is where old does not occur or is null."""
    at = F.instr(text, old)
    return F.when(at > 0, F.overlay(text, new, at, F.length(old))).otherwise(text)


def bed_number(text: Column) -> Column:
    """The number of the bed a text speaks of, in any of the three languages, else null."""
    raw = F.regexp_extract(text, r"(?iu)(?:patul|paturile|bed|койк[аеиу])\s+(\d{1,3})", 1)
    return F.when(raw != "", raw.cast("int"))
