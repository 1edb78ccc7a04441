"""Problem 6: one consistent form for texts that look the same.

Compatibility composition is applied where the compatibility form looks the same (full and half width, ligatures, Roman numeral signs);
signs that look different from their plain replacement (fractions, superscripts, the numero sign) stay. Default-ignorable characters are
removed, spaces mapped to the ordinary one, cedilla letters of Romanian to their comma forms, and look-alike letters to the alphabet that
the rest of the word, or its neighbours, belongs to. For comparisons the key is the full case fold of that form.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: letters that look alike, Latin - Cyrillic - Greek, small letters first
_ALIKE = """
a а -   c с -   e е -   i і -   j ј -   o о ο   p р -   s ѕ -   x х -   y у -   v - ν   ă ӑ -   h һ -   d ԁ -   q ԛ -   w ԝ -
A А Α   B В Β   C С -   E Е Ε   H Н Η   I І Ι   J Ј -   K К Κ   M М Μ   N - Ν   O О Ο   P Р Ρ   S Ѕ -   T Т Τ   X Х Χ   Y У Υ   Z - Ζ
Ă Ӑ -   k к κ
"""
# fixed values: letters of further scripts, and phonetic signs, that look like the Latin letter before them
_FURTHER = """
A Ꭺꓮ  B Ᏼꓐ  C Ꮯꓚ  D Ꭰꓓ  E Ꭼꓰ  G Ꮐꓖ  H Ꮋꓧ  I ꓲ  J Ꭻꓙ  K Ꮶꓗ  L Ꮮꓡ  M Ꮇꓟ  N ꓠ  O Օꓳ  P Ꮲꓑ  R Ꮢꓣ  S Ꮪꓢ  T Ꭲꓔ  U Սꓴ  V Ꮩꓦ  W Ꮃꓪ  X ꓫ  Y ꓬ  Z Ꮓꓜ
a ɑ  g ɡց  h հ  n ո  o օ  q զ  u ս
"""
_ROWS = [_ALIKE.split()[i : i + 3] for i in range(0, len(_ALIKE.split()), 3)]
# k, к and κ differ enough in small letters to be left out of the mapping from Latin, but a Greek kappa still goes to its neighbours' letter
_LATIN = {x: la for la, cy, gr in _ROWS for x in (cy, gr) if x != "-" and la != "-" and la != "k"}
_LATIN |= {x: la for la, xs in zip(_FURTHER.split()[::2], _FURTHER.split()[1::2]) for x in xs}
_CYRILLIC = {x: cy for la, cy, gr in _ROWS for x in (la, gr) if x != "-" and cy != "-" and la not in "kiăĂIhdqw"}
_CYRILLIC |= {"i": "і", "I": "І"}
_SPACE = {c: " " for c in (0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 0x1680)}
# fixed values: the default-ignorable code points of Unicode, as ranges
_IGNORABLE = "AD 34F 61C 115F-1160 17B4-17B5 180B-180F 200B-200F 202A-202E 2060-206F 3164 FE00-FE0F FEFF FFA0 FFF0-FFF8 1BCA0-1BCA3 1D173-1D17A E0000-E0FFF"
_IGNORED = {c: None for first, _, last in (r.partition("-") for r in _IGNORABLE.split()) for c in range(int(first, 16), int(last or first, 16) + 1)}
_COMMA = {ord("ş"): "ș", ord("Ş"): "Ș", ord("ţ"): "ț", ord("Ţ"): "Ț"}


#: Kinds of compatibility forms that always look like what they stand for: width, and the shapes a letter takes within a word.
_SHAPES = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>")


def _compatible() -> dict[int, str]:
    """Signs whose compatibility form looks the same, by rule over all of Unicode.

    These are the forms of width and position, and Latin letters and Roman numerals that are several letters in one sign (ligatures, digraphs).
    Other compatibility forms (fractions, raised and lowered, circled, squared or styled signs) look different and stay.
    """
    out = {}
    for c in range(0x80, 0x20000):
        kind = unicodedata.decomposition(chr(c)).partition(" ")[0]
        if not kind.startswith("<") or c in _IGNORED:
            continue
        plain, name = unicodedata.normalize("NFKC", chr(c)), unicodedata.name(chr(c), "")
        letters = kind == "<compat>" and name.startswith(("LATIN", "ROMAN NUMERAL", "SMALL ROMAN NUMERAL")) and plain.isalpha() and (len(plain) > 1 or "ROMAN" in name)
        if letters or kind in _SHAPES and not plain.startswith(" "):
            out[c] = plain
    return out


_TABLE = {**_SPACE, **_IGNORED, **_COMMA, **_compatible()}
#: Texts of only these characters are in the consistent form already.
_PLAIN = re.compile(r"[\x00-\x7fА-яЁёăâîșțĂÂÎȘȚ«»„”“’–—…№½²♪°€äöüßÄÖÜéèêëàçùûôïœіїєґІЇЄҐӂӁ]*\Z")
_WORD = re.compile(r"[^\W\d_]+")
_CYR, _GRE, _LAT = re.compile(r"[Ѐ-ԯ]"), re.compile(r"[Ͱ-Ͽ]"), re.compile(r"[A-Za-zÀ-ɏ]")
_LATINS, _OTHERS = re.compile(r"[A-Za-zÀ-ɏ]"), re.compile(r"[ɐ-ʯͰ-֏Ꭰ-ᏽꓐ-꓿]")
#: Doubles whose Cyrillic form Russian uses: only they may turn a whole word of doubles Cyrillic.
_RUSSIAN = set("aceopxyABCEHKMOPTXY")


def _alphabet(word: str) -> str:
    """'L', 'C' or 'G' where all letters that have no double elsewhere agree, '?' where all have doubles, '' where they disagree."""
    own = {"L" if _LAT.match(ch) else "C" if _CYR.match(ch) else "G" if _GRE.match(ch) else "O" for ch in word if not (ch in _LATIN or ch in _CYRILLIC)}
    return "?" if not own else own.pop() if len(own) == 1 else ""


def _script(word: str) -> str:
    return "".join(sorted({"L" if _LAT.match(ch) else "C" if _CYR.match(ch) else "G" if _GRE.match(ch) else "O" for ch in word}))


def _to(word: str, alphabet: str) -> str:
    table = _LATIN if alphabet == "L" else _CYRILLIC
    return "".join(table.get(ch, ch) for ch in word)


_SEEN: dict[str, tuple[str, str]] = {}


def _known(word: str) -> tuple[str, str]:
    """The word's alphabet and its form in that alphabet, remembered; the memory is emptied when it is full."""
    got = _SEEN.get(word)
    if got is None:
        kind = _alphabet(word)
        got = kind, (_to(word, kind) if kind in ("L", "C") and _script(word) != kind else word)
        if len(_SEEN) >= 200_000:
            _SEEN.clear()
        _SEEN[word] = got
    return got


def _alike(text: str) -> str:
    """Look-alike letters mapped to the alphabet of their word. A word of doubles only takes the alphabet that both neighbours share."""
    found = list(_WORD.finditer(text))
    words = [m.group() for m in found]
    known = [_known(w) for w in words]
    kinds = [k for k, _ in known]
    new = [w for _, w in known]
    for i, kind in enumerate(kinds):
        if kind == "?":
            new[i] = _doubles(words[i], kinds, i, text[found[i].end() : found[i].end() + 1])
    if new == words:
        return text
    parts, at = [], 0
    for m, w in zip(found, new):
        parts += [text[at : m.start()], w]
        at = m.end()
    return "".join([*parts, text[at:]])


def _doubles(word: str, kinds: list[str], i: int, follows: str) -> str:
    """A word whose letters all have doubles, in the alphabet of its neighbours."""
    mine = _script(word)
    for side in "LC":
        if _both(kinds, i, side):
            break
    else:
        # no agreement around it: a mixed word takes the alphabet of most of its letters, any other stays
        if len(mine) == 1 and mine != "G":
            return word
        side = max("LC", key=lambda s: sum(_script(ch) == s for ch in word))
    if mine == side:
        return word
    if mine == "L" and (not set(word) <= _RUSSIAN or word == word.upper() and (len(word) > 1 or follows != " ")):
        return word  # abbreviations and labels in Latin letters stay so within Cyrillic text
    if mine == "C" and len(word) > 1 and word == word.upper():
        return word
    moved = _to(word, side)
    return moved if _script(moved) == side else word


def _both(kinds: list[str], i: int, side: str) -> bool:
    """Whether the next words that show their alphabet, on each side where there is one, are of this alphabet."""
    before = next((k for k in reversed(kinds[:i]) if k in ("L", "C")), None)
    after = next((k for k in kinds[i + 1 :] if k in ("L", "C")), None)
    return (before is not None or after is not None) and before in (None, side) and after in (None, side)


def consistent(text: str | None) -> str | None:
    """The consistent form of a text; null stays null, an empty text empty."""
    if not text:
        return text
    if text.isascii():
        return text
    if not _PLAIN.match(text):
        text = unicodedata.normalize("NFC", text.translate(_TABLE))
    if _OTHERS.search(text) and _LATINS.search(text):
        text = unicodedata.normalize("NFC", _alike(text))
    return text


def comparison_key(text: str | None) -> str | None:
    """Full case folding of the consistent form, for joins and equality."""
    return None if text is None else unicodedata.normalize("NFC", consistent(text).casefold())


def _batches(parts: Iterator[pd.DataFrame], columns: list[str], form: Callable[[str | None], str | None] = consistent, suffix: str = "_clean") -> Iterator[pd.DataFrame]:
    for pdf in parts:
        for c in columns:
            place, values = pd.factorize(pdf[c].array)
            forms = np.array([*map(form, values), None], dtype=object)  # place -1, a null, is the last
            pdf[c + suffix] = pd.Series(forms[place], index=pdf.index, dtype=object)
        yield pdf


def needs_look(col: Column) -> Column:
    """A cheap test, run in the JVM: a text of ASCII only is in the consistent form. For all others the batch's own tests are faster."""
    return F.octet_length(col) != F.length(col)


def consistent_forms(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with a column <name>_clean for each of the given text columns.

    Nulls stay null, empty texts empty. Each Arrow batch is mapped once per distinct value. Existing columns of such a name are replaced.
    """
    from pyspark.sql import types as T

    df = df.drop(*[f"{c}_clean" for c in columns])
    schema = T.StructType([*df.schema.fields, *[T.StructField(f"{c}_clean", T.StringType()) for c in columns]])
    return df.mapInPandas(lambda parts: _batches(parts, columns), schema)


def changed_fields(df: DataFrame, tab: str, rec_key: Column, columns: list[str]) -> DataFrame:
    """Rows (tab, rec_key, field): the values that differ from their consistent form. Repeated rows count once."""
    rows = df.select(rec_key.alias("rec_key"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns])).alias("x"))
    rows = rows.select("rec_key", "x.field", "x.value").where(F.col("value").isNotNull() & needs_look(F.col("value")))
    done = consistent_forms(rows, ["value"]).where("value != value_clean")
    return done.select(F.lit(tab).alias("tab"), "rec_key", "field").distinct()


def equal_spellings(values: DataFrame) -> DataFrame:
    """Rows (comparison_key, spellings, records): full case-folded keys of a column `value` that stand for more than one spelling.

    Each distinct pair of key and spelling is counted before keys meet, by their hashes, so a value that a third of all rows hold is one row a
    task. Null values are left out; an empty text is a key of its own.
    """
    rows = values.where("value is not null").select("value").mapInPandas(lambda parts: _batches(parts, ["value"], comparison_key, "_key"), "value string, value_key string")
    pairs = rows.groupBy(F.xxhash64("value_key").alias("k"), F.xxhash64("value").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min("value_key").alias("key"))
    keys = pairs.groupBy("k").agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("records"), F.min("key").alias("comparison_key"))
    return keys.where("spellings > 1").select("comparison_key", "spellings", "records")
