"""Problem 3: personal information inside free text, found and replaced by typed placeholders.

Patterns of notations propose e-mail addresses, phone numbers, identity numbers and street addresses; every word proposes a name. What of it is
generalised is decided by information-theoretic sanitisation, from co-occurrence in the whole corpus. For words the names of the participants
are the protected entities: the share of a word's occurrences next to one (or after a form of address) measures how strongly it discloses one.
For the values of the other kinds the protected entity is what the text is about (a meeting, a record): the share of entities whose texts hold
a value is what the value tells about one, in bits; a value that everybody's texts hold, such as an emergency number, discloses nobody. Terms
above the thresholds are generalised wherever they stand, a name in any case or alphabet.

Protected entities, names and values may be any number: tasks get a bit filter of bounded size that only spares them hopeless words, and joins
decide. No result depends on how the texts are partitioned.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Container, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from . import bits, chars

#: A term is a name if this share of its occurrences is next to a protected entity, it tells more bits about one than an average term, it
#: occurs so often at least, and within sentences it is capitalised this often.
DISCLOSURE, BITS, SUPPORT, CAPITAL = 0.5, 2.0, 2, 0.3
#: A value is known to disclose nobody only if so many entities share it.
SHARED = 8
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "idnum": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}

# fixed values: sounds that may interrupt a number or an address
_UH = r"(?:[ăâîэм]{2,3}|ăm|îm|эм|hmm+|uhm?|umm?|ммм)"
_GAP = rf"[\s,]*(?:{_UH}[\s,]+)?"
# fixed values: the digits' names in the three languages, also in the other alphabet
_DIGIT = r"(?:zero|unu|una|doi|două|doua|trei|patru|cinci|șase|sase|șapte|sapte|opt|nouă|noua|oh|one|two|three|four|five|six|seven|eight|nine|ноль|один|два|три|четыре|пять|шесть|семь|восемь|девять|зеро|уну|дой|доуэ|трей|патру|чинч|чинчи|шасе|шапте|опт|ноуэ|nol|odin|dva|tri|chetyre|pyat|shest|sem|vosem|devyat)"
_DOT = r"(?:punct|точка|dot|point|пункт|tochka)"
_AT = r"(?:arond|a\s+rond|собака|собачка|аронд|sobaka|at)"
_DASH = r"(?:subliniere|underscore|minus|cratimă|тире|дефис|dash|plus|плюс|подчёркивание)"
EMAIL_SIGN = re.compile(r"[\w.+\-]*\w\s?@\s?[\w\-]+(?:\s?\.\s?[\w\-]+)+", re.I)
EMAIL_BRACKET = re.compile(r"[\w.+\-]*\w\s*[\[({]\s*(?:at|arond|собака|@)\s*[\])}]\s*[\w\-]+(?:\s*(?:\.|[\[(]\s*(?:dot|punct|точка)\s*[\])])\s*[\w\-]+)+", re.I)
EMAIL_SPOKEN = re.compile(rf"\w+(?:\s+(?:{_DOT}|{_DASH})\s+\w+)*\s+{_AT}\s+[\w\-]+(?:\s+(?:{_DOT}|{_DASH})\s+[\w\-]+)*\s+{_DOT}\s+\w+", re.I)
PHONE_DIGITS = re.compile(
    r"(?<![\d\w])(?:\+|00)[1-9]\d{0,2}(?:[\s.\-]?\(?\d{1,4}\)?){2,5}(?![\d\w])"
    r"|(?<![\d\w.,\-])\(?0[1-9]\d\)?(?:[\s.\-]?\d{3}[\s.\-]?\d{3}|[\s.\-]\d{2}[\s.\-]\d{2}[\s.\-]\d{2})(?![\d\w]|[.\-]\d)"
    r"|(?<![\d\w])(?:\(\d{3}\)\s?|\d{3}[.\-])\d{3}[.\-]\d{4}(?![\d\w])"
)
PHONE_SPOKEN = re.compile(rf"(?<![\w]){_DIGIT}(?:{_GAP}(?<=[\s,]){_DIGIT}){{6,14}}(?!\w)", re.I)
IDNUM = re.compile(
    r"(?<![\d\w+.\-])(?:\d{13}|\d \d{3} \d{3} \d{3} \d{3}|\d{4}-\d{4}-\d{5}|\d{3}-\d{2}-\d{4}|\d{3}-\d{3}-\d{3}[ \-]\d{2})(?![\d\w]|[.\-]\d)"
    r"|(?<![\d\w])(?:[A-Za-z]{2}\d{7}|[A-Za-z]?[A-Z] \d{7})(?![\d\w])"
    r"|(?:(?<=idnp )|(?<=personal )|(?<=scrie )|(?<=код )|(?<=код: )|(?<=паспорт )|(?<=passport )|(?<=cod )|(?<=написано )|(?<=number ))[A-Za-z]{2} \d{7}(?!\d)"
)
#: What stands before numbers of goods and papers.
_GOODS = re.compile(r"(?:\bbare\b|\bbar ?code|barcode|штрих|\blot\w*|парти[июя]|\bbatch|\bserie|серия|\bcomand[aăe]|заказ\w*|\border\b|factur\w*|сч[её]т\w*|invoice\w*|contract\w*|договор\w*|артикул|produs\w*)[^.!?]{0,24}$", re.I)
_NAME1 = r"[^\W\d_][\w’'\-]*"
_HOUSE = r"\d{1,4}[A-Za-zА-Яа-я]?(?:\s?[/\-]\s?\d{1,4})?"
_TAIL = rf"(?:{_GAP}(?:ap\.?|apartamentul|apt\.?|scara|sc\.|bloc(?:ul)?|bl\.|flat|кв\.?|квартира|подъезд|корпус|корп\.|ап\.|апартаментул|скара|kv\.|kvartira|unit)\s*\d+)*"
_NO = rf"(?:{_GAP}(?:nr\.?|numărul|numarul|no\.|нр\.|нумэрул|дом|д\.|dom|d\.|casa)\s*)?"
_STREETS = r"(?:str\.|strada|stradela|bulevardul|bd\.|bd-ul|b-dul|bul\.|aleea|calea|șoseaua|soseaua|piața|страда|стр\.|булевардул|ул\.|улица|улице|переулок|пер\.|проспект|пр-т|бульвар|шоссе|набережная|площадь|ul\.|ulitsa|pereulok)"
ADDRESS_STREET = re.compile(rf"(?<!\w){_STREETS}{_GAP}{_NAME1}(?:\s+{_NAME1}){{0,3}}?{_GAP}{_NO}{_GAP}{_HOUSE}(?!\d){_TAIL}", re.I)
ADDRESS_FLAT = re.compile(
    rf"(?<!\w){_NAME1}(?:\s+{_NAME1}){{0,2}}?{_GAP}(?:numărul|numarul|нумэрул)\s+{_HOUSE}{_GAP}(?:apartamentul|апартаментул|ap\.)\s*\d+"
    rf"|(?<!\w){_NAME1}(?:\s+{_NAME1}){{0,2}}?\s{_HOUSE}{_GAP}(?:ap\.|apartamentul|кв\.|квартира|ап\.)\s*\d+"
    rf"|(?<!\w){_NAME1}(?:\s+{_NAME1}){{0,1}}?{_GAP}дом\s+\d+{_GAP}(?:кв\.|квартира)\s*\d+",
    re.I,
)
ADDRESS_AFTER = re.compile(rf"(?<![\d\w.])\d{{1,4}}[A-Za-z]?{_GAP}{_NAME1}(?:\s+{_NAME1}){{0,2}}?\s+(?:street|road|rd|avenue|ave|lane|drive|boulevard|blvd|square)\b\.?{_TAIL}", re.I)
# what a text must hold, in lower case, for a pattern to be tried
_NEED_STREET = ("str.", "strad", "bulevard", "bd.", "bd-", "b-dul", "bul.", "aleea", "calea", "oseaua", "piața", "страда", "стр.", "булевард", "ул.", "улиц", "переул", "пер.", "проспект", "пр-т", "бульвар", "шоссе", "набереж", "площадь", "ul.", "ulits", "pereul")
_NEED_FLAT = ("ap.", "apartament", "кв.", "квартир", "ап.", "апартамент")
_NEED_AFTER = (" street", " road", " rd", " avenue", " ave", " lane", " drive", " boulevard", " blvd", " square")
_NEED_SPOKEN = (" arond", " rond ", " собак", " собач", "аронд", " sobaka", " dot ", " punct ", " точка ", " пункт ", " tochka ")
_NEED_BRACKET = re.compile(r"[\[({]\s*(?:at|arond|собака|@)\s*[\])}]")
# fixed values: forms of address before a name
_TITLE = re.compile(r"(?:dr|dna|dl|doamna|domnul|mrs|mr|ms|miss|prof|доктор|госпожа|господин|д-р|г-жа|г-н|доамна|домнул)\Z", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_NUMBER = re.compile(r"\d[\d\s().\-+/]{5,}\d")
_ANY_DIGIT = re.compile(r"\d")
_DIGITS = frozenset(_DIGIT[3:-1].split("|"))
# fixed values: Cyrillic letters and the Latin ones that Romanian names have in their place
_LETTERS = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґӂ", "a b v g d e j z i j c l m n o p r s t u f h t c s s - i - a iu ia e i i e g g".split()))
_FOLD = {ord(k): ("" if v == "-" else v) for k, v in _LETTERS.items()} | {ord("k"): "c", ord("q"): "c"}


def fold(word: str) -> str:
    """One form for a name in any case and alphabet: lower case, Latin letters, no diacritics."""
    low = unicodedata.normalize("NFD", word.lower().translate(_FOLD))
    return "".join(ch for ch in low if not unicodedata.combining(ch))


def structured(text: str, words: list[str] | None = None) -> list[tuple[int, int, str]]:
    """Spans of e-mail addresses, phone and identity numbers and street addresses; earlier kinds take precedence.

    words: the text's words in small letters, where they are known.
    """
    spans: list[tuple[int, int, str]] = []

    def add(kind: str, start: int, end: int) -> None:
        if not any(start < e and s < end for s, e, _ in spans):
            spans.append((start, end, kind))

    def add_all(kind: str, pattern: re.Pattern) -> None:
        for m in pattern.finditer(text):
            add(kind, *m.span())

    low = text.lower()
    if "@" in low:
        add_all("email", EMAIL_SIGN)
    if _NEED_BRACKET.search(low):
        add_all("email", EMAIL_BRACKET)
    if any(x in low for x in _NEED_SPOKEN):
        add_all("email", EMAIL_SPOKEN)
    if _NUMBER.search(text):
        for kind, pattern in (("phone", PHONE_DIGITS), ("idnum", IDNUM)):
            for m in pattern.finditer(text):
                enough = kind == "idnum" or 9 <= sum(ch.isdigit() for ch in m.group()) <= 15
                if enough and not _GOODS.search(text, max(0, m.start() - 60), m.start()):
                    add(kind, *m.span())
    if len(low) > 24 and sum(map(_DIGITS.__contains__, _WORD.findall(low) if words is None else words)) >= 7:
        add_all("phone", PHONE_SPOKEN)
    if _ANY_DIGIT.search(low):
        if any(x in low for x in _NEED_STREET):
            add_all("address", ADDRESS_STREET)
        if any(x in low for x in _NEED_FLAT):
            add_all("address", ADDRESS_FLAT)
        if any(x in low for x in _NEED_AFTER):
            add_all("address", ADDRESS_AFTER)
    return sorted(spans)


def _masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    for s, e, _ in spans:
        text = text[:s] + "\x00" * (e - s) + text[e:]
    return text


def name_spans(text: str, is_name: Callable[[str], bool]) -> list[tuple[int, int, str]]:
    """Runs of name words, with the initials beside them."""
    out: list[list[int]] = []
    for m in _WORD.finditer(text):
        if is_name(m.group()):
            if out and re.fullmatch(r"[\s,]{0,2}(?:[^\W\d_]\.\s?){0,2}", text[out[-1][1] : m.start()]):
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end()])
    spans = []
    for s, e in out:
        if before := re.search(r"(?<![^\W\d_])(?:[^\W\d_]\.\s?){1,2}$", text[:s]):
            s = before.start()
        elif after := re.match(r"\s[^\W\d_]\.(?:\s?[^\W\d_]\.)?", text[e:]):
            e += after.end()
        spans.append((s, e, "name"))
    return spans


class _Memory(dict):
    """What a function gives for each word, remembered; the memory is emptied when it is full."""

    def __init__(self, of: Callable[[str], object]):
        super().__init__()
        self.of = of

    def __missing__(self, word: str):
        if len(self) > 500_000:
            self.clear()
        got = self[word] = self.of(word)
        return got


def passing(filter_: np.ndarray) -> Callable[[str], str]:
    """The folded form of each word that a filter lets pass, '' for others."""

    def of(word: str) -> str:
        term = fold(word)
        # the same hash as Spark's xxhash64
        return term if len(word) > 1 and bits.hit(filter_, xxhash.xxh64_intdigest(term, seed=42)) else ""

    return _Memory(of).__getitem__


def value_of(kind: str, text: str) -> str:
    """What all notations of one find of this kind have in common: its letters and digits, folded."""
    return f"{kind}|" + "".join(filter(str.isalnum, fold(text)))


def find(text: str, is_name: Callable[[str], bool]) -> list[tuple[int, int, str]]:
    """All spans of a text in consistent form."""
    spans = structured(text)
    if any(map(is_name, _WORD.findall(text))):
        spans += name_spans(_masked(text, spans), is_name)
    return sorted(spans)


def with_origins(text: str) -> tuple[str, list[int]]:
    """The consistent form, and for each of its characters the place in the text where it begins (one more entry for the end)."""
    clean, origin, i = [], [], 0
    while i < len(text):
        j = i + 1
        while j < len(text) and unicodedata.combining(text[j]):
            j += 1
        piece = unicodedata.normalize("NFC", text[i:j].translate(chars._TABLE))
        clean.append(piece)
        origin += [i] * len(piece)
        i = j
    flat = "".join(clean)
    return chars._alike(flat), [*origin, len(text)]


def redact(text: str, terms: Container[str]) -> tuple[str, list[str]]:
    """The text with a placeholder for each find and nothing else changed, and the kinds found, in order.

    terms: the folded names, and the values (value_of) that disclose somebody.
    """
    if text.isascii():
        clean, origin = text, range(len(text) + 1)
    else:
        clean, origin = with_origins(text)
    out, at, kinds = [], 0, []
    for s, e, kind in find(clean, lambda w: len(w) > 1 and fold(w) in terms):
        if kind == "name" or value_of(kind, clean[s:e]) in terms:
            out += [text[at : origin[s]], PLACEHOLDER[kind]]
            at = origin[e]
            kinds.append(kind)
    return "".join([*out, text[at:]]), kinds


# ---- the corpus' names


def _pieces(value: str) -> list[str]:
    return [fold(w) for w in _WORD.findall(chars.consistent(value) or "") if len(w) > 1]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _name_words(values: pd.Series) -> pd.Series:
    return values.map(lambda v: _pieces(v) if v else [])


def seed_names(participants: DataFrame) -> DataFrame:
    """Rows (term): the folded words of the participants' names, titles left out."""
    words = participants.where("name is not null").select("name").distinct().select(F.explode(_name_words("name")).alias("term")).distinct()
    return words.where("length(term) > 2 and term not in ('dr', 'dna', 'doamna', 'domnul', 'mrs', 'doctor', 'prof')")


_NEXT = re.compile(r"\.?\s|,\s")
#: What before a word says nothing about its capital.
_OPENS = ".!?:>])}*~♪-"
_COUNTS = "term string, before string, after string, titled boolean, n long, near long, capital long, small long"


def _cooccurrence(filter_: np.ndarray):
    """Counts of a batch of texts by folded term: n of all its occurrences; near, capital and small of those beside a word that the filter lets
    pass (before or after it) or after a form of address."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seed = passing(filter_)
        titled_by = _Memory(lambda w: bool(_TITLE.match(w))).__getitem__
        marks = _Memory(lambda w: bool(seed(w)) or titled_by(w)).__getitem__
        folded = _Memory(fold).__getitem__
        for pdf in batches:
            words: Counter = Counter()
            near: Counter = Counter()
            for text in map(chars.consistent, pdf["text"]):
                said = _WORD.findall(text)
                words.update(said)
                if not any(map(marks, said)):
                    continue
                clean = _masked(text, structured(text))
                found = list(_WORD.finditer(clean))
                cased = any(m.group()[0].isupper() for m in found)
                for i, m in enumerate(found):
                    before, after, titled = "", "", False
                    if i and _NEXT.fullmatch(between := clean[found[i - 1].end() : m.start()]):
                        left = found[i - 1].group()
                        before, titled = (seed(left) if between != ", " else ""), titled_by(left)
                    if i + 1 < len(found) and clean[m.end() : found[i + 1].start()] == " ":
                        after = seed(found[i + 1].group())
                    if before or after or titled:
                        w = m.group()
                        inside = cased and i and clean[m.start() - 1 : m.start()] == " " and clean[m.start() - 2 : m.start() - 1] not in _OPENS
                        near[folded(w), before or None, after or None, titled, inside and w[0].isupper(), inside and not w[0].isupper()] += 1
            n: Counter = Counter()
            for w, k in words.items():
                n[folded(w)] += k
            rows = [(t, None, None, False, k, 0, 0, 0) for t, k in n.items()]
            rows += [(t, b, a, d, 0, k, k * bool(up), k * bool(low)) for (t, b, a, d, up, low), k in near.items()]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in _COUNTS.split(", ")])

    return run


@F.pandas_udf(T.StringType())
def _folded(words: pd.Series) -> pd.Series:
    return words.map(fold)


def disclosing_terms(texts: DataFrame, seeds: DataFrame, common: DataFrame | None = None) -> DataFrame:
    """Rows (term, n, near, share, bits, capital): every term of the corpus that occurs next to a protected entity.

    share = near / n is the chance that an occurrence of the term points at a protected entity; bits = log2 of that chance over the chance
    of an average word. texts has one column, text; seeds one, term. common (a column word) names words that are no names whatever their
    neighbours.
    """
    sums = lambda *names: [F.sum(c).alias(c) for c in names]
    counts = texts.where("text is not null and text != ''").mapInPandas(_cooccurrence(_filter(seeds)), _COUNTS)
    counts = counts.groupBy("term", "before", "after", "titled").agg(*sums("n", "near", "capital", "small"))
    for side in ("before", "after"):
        known = seeds.select(F.col("term").alias(side), F.lit(True).alias(f"{side}_is")).distinct()
        counts = counts.join(known, side, "left")
    beside = F.col("titled") | F.col("before_is").isNotNull() | F.col("after_is").isNotNull()
    counts = counts.select("term", "n", *[F.when(beside, F.col(c)).otherwise(0).alias(c) for c in ("near", "capital", "small")])
    terms = cut(counts.groupBy("term").agg(*sums("n", "near", "capital", "small")))
    total = terms.agg(F.sum("n"), F.sum("near")).first()
    average = (total[1] or 0) / max(1, total[0] or 0)
    titles = sorted({fold(w) for w in re.findall(r"[^\W\d_]+", _TITLE.pattern.removesuffix(r"\Z"))})
    out = terms.where((F.col("near") > 0) & (F.length("term") > 2) & ~F.col("term").isin(*titles)).withColumn("share", F.col("near") / F.col("n")).withColumn("bits", F.log2(F.col("share") / F.lit(max(average, 1e-12))))
    out = out.withColumn("capital", F.when(F.col("capital") + F.col("small") > 0, F.col("capital") / (F.col("capital") + F.col("small"))).otherwise(F.lit(1.0)))
    if common is not None:
        out = out.join(common.select(_folded("word").alias("term")).distinct(), "term", "left_anti")
    return out.drop("small")


def _filter(terms: DataFrame) -> np.ndarray:
    return bits.slots(terms.select(F.xxhash64("term").alias("h")))


def names(texts: DataFrame, participants: DataFrame, common: DataFrame | None = None) -> DataFrame:
    """Rows (term): the protected entities and the terms that disclose one beyond the thresholds."""
    seeds = cut(seed_names(participants))
    found = disclosing_terms(texts, seeds, common).where((F.col("share") >= DISCLOSURE) & (F.col("bits") >= BITS) & (F.col("n") >= SUPPORT) & (F.col("capital") >= CAPITAL))
    return cut(seeds.unionByName(found.select("term")).distinct())


# ---- the operator


def _proposed(filter_: np.ndarray):
    """Distinct (rec_key, entity, h, kind, value) that a batch of texts may disclose: values of notations, and words that the filter lets pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        term = passing(filter_)
        for pdf in batches:
            rows = []
            for key, entity, h, text in pdf.itertuples(index=False, name=None):
                clean = chars.consistent(text)
                spans = structured(clean)
                got = {(kind, value_of(kind, clean[s:e])) for s, e, kind in spans}
                if any(map(term, _WORD.findall(clean))):
                    got |= {("name", t) for t in map(term, _WORD.findall(_masked(clean, spans))) if t}
                rows += [(key, entity, h, *g) for g in got]
            yield pd.DataFrame(rows, columns=["rec_key", "entity", "h", "kind", "value"])

    return run


def values_by_bits(proposed: DataFrame, entities: int) -> DataFrame:
    """Rows (kind, value, entities, bits) for proposed values other than names: how many entities' texts hold a value, and what it tells about one."""
    spread = proposed.where("kind != 'name'").select("kind", "value", "entity").distinct().groupBy("kind", "value").agg(F.count(F.lit(1)).alias("entities"))
    return spread.withColumn("bits", F.log2(F.greatest(F.lit(entities), "entities") / F.col("entities")))


def disclosed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (rec_key, h, kind, value): what each text discloses. rows: (rec_key, text) and, where it is known what a text is about, entity, which
    is the rec_key otherwise; h is the text's hash. known has a column term: the names. Null and empty texts give none."""
    if "entity" not in rows.columns:
        rows = rows.withColumn("entity", F.col("rec_key"))
    texts = rows.where("text is not null and text != ''").select("rec_key", "entity", F.xxhash64("text").alias("h"), "text")
    proposed = cut(texts.mapInPandas(_proposed(_filter(known)), "rec_key string, entity string, h long, kind string, value string").distinct())
    named = proposed.where("kind = 'name'").join(known.select(F.col("term").alias("value")).distinct(), "value", "left_semi")
    values = values_by_bits(proposed, rows.select("entity").distinct().count())
    shared = values.where((F.col("bits") < BITS) & (F.col("entities") >= SHARED)).select("value")
    valued = proposed.where("kind != 'name'").join(shared, "value", "left_anti")
    columns = ["rec_key", "h", "kind", "value"]
    return named.select(*columns).unionByName(valued.select(*columns))


def found_kinds(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct rows (rec_key, kind) of what the texts of rows disclose, with arguments as for `disclosed`."""
    return disclosed(rows, known).select("rec_key", "kind").distinct()


def _redacted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        done = [redact(t, frozenset(own)) if t and own is not None else (t, []) for t, own in zip(pdf["text"], pdf["own"])]
        pdf["clean_text"] = pd.Series([d[0] for d in done], index=pdf.index, dtype=object)
        pdf["kinds"] = pd.Series([d[1] for d in done], index=pdf.index, dtype=object)
        yield pdf[["rec_key", "text", "clean_text", "kinds"]]


def redacted(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct rows (rec_key, text, clean_text, kinds): each text with placeholders in place of what it discloses, nothing else changed.

    Null stays null and empty empty, with no kinds. Each text meets the terms it discloses by a join on its key and hash.
    """
    own = disclosed(rows, known).groupBy("rec_key", "h").agg(F.collect_set("value").alias("own"))
    texts = rows.select("rec_key", "text", F.xxhash64("text").alias("h")).dropDuplicates(["rec_key", "h"])
    return texts.join(own, ["rec_key", "h"], "left").select("rec_key", "text", "own").mapInPandas(_redacted, "rec_key string, text string, clean_text string, kinds array<string>")


def keyed(df: DataFrame, tab: str, key: Column, text: str, entity: str | None = None) -> DataFrame:
    """Rows (rec_key, text, entity) with the table's name before the key."""
    named = F.concat(F.lit(tab + "|"), key)
    return df.select(named.alias("rec_key"), F.col(text).alias("text"), (F.col(entity) if entity else named).alias("entity"))
