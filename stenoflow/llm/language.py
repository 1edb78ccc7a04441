"""Problem 1: the language of each text and of each stretch of a text that mixes languages, with a confidence.

Hierarchical discrimination: linear classifiers first tell the language family of a stretch (Romance, Slavic, Germanic), and nothing but the
family's own one-versus-one linear support vector machine then tells its two close languages apart. All are trained here, on a bounded sample
of labelled rows; labels that a first set of machines contradicts are corrected before the final ones are trained. Features are letter n-grams
within words, so a text's margin is the sum of its words' margins, and each distinct word is scored once per worker; stretches are found by
the best path through the words. Language probabilities that a row brings along (lang_probs) keep rows at odds with them from teaching, and
are weak evidence for a text's own language.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chars, personal
from .turns import HESITATION

FAMILIES = {"romance": ("ro", "fr"), "slavic": ("ru", "uk"), "germanic": ("en", "de")}
LANGS = tuple(x for pair in FAMILIES.values() for x in pair)
# fixed values: codes and names of the six languages
_NAMES = {
    "ro": "ro ron rum romanian română romana rumano roumain rumänisch румынский румунська румынский limba-română limba-romana mo mol moldovan moldovenească молдавский",
    "ru": "ru rus russian rusă rusa русский русский-язык русский російська russe russisch",
    "en": "en eng english engleză engleza английский англійська anglais englisch",
    "uk": "uk ukr ukrainian українська украинский ucraineană ucraineana ukrainien ukrainisch ua",
    "fr": "fr fra fre french français francais franceză franceza французский французька französisch",
    "de": "de deu ger german deutsch germană germana немецкий німецька allemand",
}
CODES = {name: lang for lang, names in _NAMES.items() for name in names.split()}

#: Bounds of the training sample, and of nothing else: labelled rows for each label and table, characters of such a row, windows of words for
#: each language.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_WINDOWS = 3000, 600, 6000
WINDOW = 7
DIMENSION = 1 << 17
EPOCHS = 10
BATCH = 64
#: Rounds of correcting labels, and the epochs of the machines that do.
CLEANING, CLEANING_EPOCHS = 2, 3
#: Weight of a row's own language probabilities against the words' margins.
EVIDENCE = 0.3
#: A word's margin between the languages of a family, in units of its margin between families.
WITHIN = 0.6
#: Weight of a language's share of the table's words against the words' margins.
PRIOR = 0.5
#: Words in a row that a stretch needs: up to three borrowed words do not make a text mixed.
LEAST_STRETCH = 4
#: Texts with fewer words are not judged.
LEAST_WORDS = 5
#: Cost of a change of language, in units of a word's margin.
SWITCH = 2.2

_WORD = re.compile(r"[^\W\d_]+")
_SPOKEN = re.compile(r"[^\W_]+(?:['’.,\-/:][^\W_]+)*")
_MARKUP = re.compile(r"<[^<>]{1,60}>|\"[A-Za-z_]{1,20}\"\s*:|https?://\S+|\b(?:[\[(<]?\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?[\])>]?(?:\s*-->)?|\d{1,3}m\d{2}s)")
_NOISE = re.compile(r"\[[^\W\d_][^\[\]]{0,30}\]|\(\(?[^\W\d_A-ZА-ЯĂÂÎȘȚ][^\W\d_A-ZА-ЯĂÂÎȘȚ \-]{0,25}\)\)?|\{\w[\w ]{0,20}\}|~\w[\w ]{0,20}~|\*\w[\w ]{0,20}\*|♪")
_LABELS = re.compile(r"(?:^|(?<=\n))\s*\[?(?:s|spk|speaker|vorb|vorbitor|говорящий|спикер)[\s._\-]*\d{1,4}\s*(?:\]:?|:|[\-–—](?=\s))", re.I)
_UH = re.compile(HESITATION, re.I)
_DIGIT = re.compile(r"\d")


def label_language(label: Column) -> Column:
    """The language a label names: one of LANGS, 'other' for other languages, null where it names none."""
    low = F.lower(F.trim(label))
    # fixed values: words and codes that name no language
    none = low.isin("", "unknown", "und", "undefined", "undetermined", "none", "null", "nan", "n/a", "na", "auto", "mul", "mis", "zxx", "xx", "xxx", "other", "mixed", "necunoscut", "неизвестно", "inconnu") | ~low.rlike(r"\p{L}")
    mapping = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    base = F.element_at(F.split(low, r"[_\-\s]"), 1)
    return F.when(low.isNull() | none, F.lit(None).cast("string")).otherwise(F.coalesce(F.try_element_at(mapping, low), F.try_element_at(mapping, base), F.lit("other")))


def spoken_text(text: str) -> str:
    """The text without markup, time stamps, labels, annotations, addresses and numbers of any kind."""
    return _spoken(text)[0]


def _spoken(text: str) -> tuple[str, list[str]]:
    """The spoken text and all its words in small letters."""
    text = chars.consistent(text)
    digits = _DIGIT.search(text) is not None
    if digits or "<" in text or '"' in text or "://" in text:
        text = _MARKUP.sub(" ", text)
    if digits:
        text = _LABELS.sub(" ", text)
    if "[" in text or "(" in text or "{" in text or "*" in text or "~" in text or "♪" in text:
        text = _NOISE.sub(" ", text)
        if digits:
            text = _LABELS.sub(" ", text)
    words = _WORD.findall(text.lower())
    spans = personal.structured(text, words)
    if not spans:
        return text, words
    for s, e, _ in reversed(spans):
        text = text[:s] + " , " + text[e:]
    return text, _WORD.findall(text.lower())


def _words_of(text: str) -> list[str]:
    """The words of a text, in small letters, without hesitation sounds; of a word said over and over, one."""
    out: list[str] = []
    for w in _WORD.findall(text.lower()):
        if not (out and out[-1] == w) and not _hesitates(w):
            out.append(w)
    return out


def _hesitates(word: str) -> bool:
    return word[0] in "ăâîhmueэмхaа" and _UH.fullmatch(word) is not None


# ---- features


def _grams(word: str) -> list[int]:
    w = f"^{word}$"
    out = {zlib.crc32(w.encode()) % DIMENSION}
    for n in (1, 2, 3, 4):
        for i in range(len(w) - n + 1):
            out.add(zlib.crc32(f"{n}{w[i : i + n]}".encode()) % DIMENSION)
    return sorted(out)


# fixed values: letters for Romanian in Cyrillic and Russian in Latin script
_RO_CYR = [("che", "ке"), ("chi", "ки"), ("ghe", "ге"), ("ghi", "ги"), ("ce", "че"), ("ci", "чи"), ("ge", "ӂе"), ("gi", "ӂи"), ("ea", "я"), ("iu", "ю"), ("ia", "я")] + [(a, b) for a, b in zip("aăâbcdefghiîjklmnopqrsștțuvwxyz", "аэыбкдефгхиыжклмнопкрсштцуввксиз")]
_RU_LAT = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i y k l m n o p r s t u f h ts ch sh sch - y - e yu ya".replace("-", "").split(" ")))


def _to_cyrillic(text: str) -> str:
    for a, b in _RO_CYR:
        text = text.replace(a, b)
    return text


def _to_latin(text: str) -> str:
    return "".join(_RU_LAT.get(ch, ch) for ch in text)


_BARE = str.maketrans("ăâîșțéèêëàçùûôïöäü", "aaisteeeeacuuoioau")


def _bare(word: str) -> str:
    return word.translate(_BARE)


# ---- training


def _windows(text: str) -> list[tuple[str, ...]]:
    words = [w for w in _words_of(spoken_text(text)) if len(w) < 30]
    return [tuple(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW) if len(words[i : i + WINDOW]) >= 3]


def _svm(rows: list[np.ndarray], signs: np.ndarray, rng: np.random.Generator, epochs: int = EPOCHS, strength: float = 1e-5) -> np.ndarray:
    """A linear support vector machine by stochastic subgradients of the hinge loss over small batches, averaged over epochs."""
    w, total, size = np.zeros(DIMENSION), np.zeros(DIMENSION), 1.0  # the weights are size * w
    lengths = np.array([len(x) for x in rows])
    weight = np.where(signs > 0, len(signs) / (2 * max(1, (signs > 0).sum())), len(signs) / (2 * max(1, (signs < 0).sum())))
    weight = np.minimum(weight, 4.0)
    for epoch in range(epochs):
        rate = 0.5 / (1 + epoch)
        order = rng.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            batch = order[i : i + BATCH]
            n = lengths[batch]
            index = np.concatenate([rows[j] for j in batch])
            scale = 1 / np.sqrt(n)
            margin = np.add.reduceat(w[index], np.concatenate(([0], np.cumsum(n)[:-1]))) * scale * size
            step = np.where(signs[batch] * margin < 1, signs[batch] * weight[batch] * scale * rate, 0.0)
            size *= (1 - rate * strength) ** len(batch)
            np.add.at(w, index, np.repeat(step / size, n))
        total += size * w
    return total / epochs


def _machines(rows: list[np.ndarray], langs: np.ndarray, rng: np.random.Generator, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the three family classifiers, and of each family's machine for its two languages. langs: places in LANGS."""
    out = np.zeros((6, DIMENSION))
    for f in range(3):
        out[f] = _svm(rows, np.where(langs // 2 == f, 1.0, -1.0), rng, epochs)
        own = np.flatnonzero(langs // 2 == f)
        first = langs[own] % 2 == 0
        if first.any() and not first.all():
            out[3 + f] = _svm([rows[i] for i in own], np.where(first, 1.0, -1.0), rng, epochs)
        elif len(own):  # the sample knows only one language of this family
            out[3 + f] = 0.05 if first.all() else -0.05
    return out


def _margins(weights: np.ndarray, grams: list[int]) -> np.ndarray:
    """A word's margin by each of the machines, within [-1.5, 1.5]."""
    return np.clip(weights[:, grams].sum(axis=1) / len(grams) ** 0.5, -1.5, 1.5)


#: Words that this worker has scored, by the weights: Model.seen and Model.heard of the last model.
_KEPT: dict[bytes, tuple[dict, dict]] = {}


class Model:
    """Weights of three family classifiers and three one-versus-one machines, and the languages' priors."""

    def __init__(self, weights: np.ndarray, prior: tuple[float, ...] = (0.0,) * 6, by_table: dict[str, tuple[float, ...]] | None = None):
        self.weights, self.prior, self.by_table = weights, prior, by_table or {}
        self.seen: dict[str, tuple] = {}
        self.heard: dict[str, tuple | None] = {}

    def __getstate__(self):
        return self.weights, self.prior, self.by_table

    def __setstate__(self, state):
        self.weights, self.prior, self.by_table = state
        # a worker's tasks bring the same weights, one after the other: what they give for a word is kept
        key = hashlib.blake2b(self.weights.tobytes()).digest()
        if key not in _KEPT:
            _KEPT.clear()
            _KEPT[key] = {}, {}
        self.seen, self.heard = _KEPT[key]

    def spoken(self, words: list[str]) -> list[tuple]:
        """What `word` has for the words of a text as _words_of finds them, given all words in small letters."""
        out, last, heard = [], None, self.heard
        for w in words:
            if w == last:
                continue
            try:
                got = heard[w]
            except KeyError:
                if len(heard) > 300_000:
                    heard.clear()
                got = heard[w] = None if _hesitates(w) else self.word(w)
            if got is not None:
                out.append(got)
                last = w
        return out

    def word(self, word: str) -> tuple[tuple[float, ...], int, tuple[tuple[float, float], ...], tuple[int, ...]]:
        """The word's scores for the families and the best of them; for each family the scores of its two languages and the better one."""
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) > 300_000:
                self.seen.clear()
            m = _margins(self.weights, _grams(word)).tolist()
            family = tuple(m[:3])
            got = self.seen[word] = family, family.index(max(family)), tuple((WITHIN * x, -WITHIN * x) for x in m[3:]), tuple(int(x < 0) for x in m[3:])
        return got


def _prior(langs: np.ndarray, weights: np.ndarray) -> tuple[float, ...]:
    """The log share of each of LANGS by weight; one more window each, so that a language without any keeps a small share."""
    share = np.bincount(langs, weights, minlength=len(LANGS)) * (len(langs) / weights.sum())
    return tuple(PRIOR * math.log((n + 1) / (len(langs) + len(LANGS))) for n in share.tolist())


@functools.lru_cache(1024)
def _families(prior: tuple[float, ...]) -> list[float]:
    """The prior of each family from those of its languages."""
    return [PRIOR * math.log(math.exp(prior[2 * f] / PRIOR) + math.exp(prior[2 * f + 1] / PRIOR)) for f in range(3)]


def _corrected(windows: list[tuple[str, ...]], langs: np.ndarray, tabs: np.ndarray, weights: np.ndarray, known: dict[str, list[int]], rng: np.random.Generator) -> np.ndarray:
    """The windows' languages as machines see them that were trained on the given ones, family first, and again on what these say; each table's
    languages have its own priors."""
    rows = [np.array(sorted({g for w in words for g in known[w]}), dtype=np.int64) for words in windows]
    index, lengths = np.concatenate(rows), np.array([len(x) for x in rows])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    for _ in range(CLEANING):
        machines = _machines(rows, langs, rng, CLEANING_EPOCHS)
        # whole windows are judged, as the machines were trained on them; a window weighs as the root of its words against the priors
        sums = np.stack([np.add.reduceat(w[index], starts) for w in machines], axis=1) * (WINDOW / lengths)[:, None] ** 0.5
        moved = langs.copy()
        for tab in set(tabs.tolist()):
            here = tabs == tab
            prior, own = _prior(langs[here], weights[here]), sums[here]
            family = (own[:, :3] + _families(prior)).argmax(axis=1)
            pair = np.array(prior).reshape(3, 2)
            second = own[np.arange(len(own)), 3 + family] + pair[family, 0] - pair[family, 1] < 0
            moved[here] = 2 * family + second
        if (moved == langs).all():
            break
        langs = moved
    return langs


def train(labelled: list[tuple[str, str, str]], seed: int = 7, totals: dict[tuple[str, str], int] | None = None) -> Model:
    """The model from rows (tab, lang, text).

    totals: the words of all rows of each (tab, lang). The sample holds a small label whole and little of a large one, so each window stands
    for as many as its table and label have more; the priors are shares of all rows, for each table its own.
    """
    rng = np.random.default_rng(seed)
    by: dict[str, list] = defaultdict(list)
    counted: Counter = Counter()
    for tab, lang, text in labelled:
        counted[tab, lang] += text.count(" ") + 1
        by[lang] += [(tab, words) for words in _windows(text)]
    chosen = [(tab, lang, words) for lang in LANGS if lang in by for tab, words in (by[lang][i] for i in rng.permutation(len(by[lang]))[: 2 * SAMPLE_WINDOWS])]
    if not chosen:
        return Model(np.zeros((6, DIMENSION), dtype=np.float32), (PRIOR * math.log(1 / len(LANGS)),) * len(LANGS))
    sampled: Counter = Counter()
    for tab, lang, words in chosen:
        sampled[tab, lang] += len(words)
    weights = np.array([(totals or counted)[tab, lang] / sampled[tab, lang] for tab, lang, _ in chosen])
    known = {w: _grams(w) for w in sorted({w for _, _, words in chosen for w in words})}
    given = np.array([LANGS.index(lang) for _, lang, _ in chosen])
    tabs = np.array([tab for tab, _, _ in chosen])
    langs = _corrected([words for _, _, words in chosen], given, tabs, weights, known, rng)
    by_table = {tab: _prior(langs[tabs == tab], weights[tabs == tab]) for tab in sorted(set(tabs.tolist()))}
    examples: list[tuple[tuple[str, ...], int]] = []
    for x, lang in enumerate(LANGS):
        own = sorted({words for (_, _, words), y in zip(chosen, langs.tolist()) if y == x})
        for i in rng.permutation(len(own))[:SAMPLE_WINDOWS]:
            words = own[i]
            examples.append((words, x))
            k = int(rng.integers(0, len(words)))
            examples.append((words[k : k + int(rng.integers(1, 3))], x))
            if lang == "ro":
                examples.append((tuple(w.translate(_BARE) for w in words), x))
                if rng.random() < 0.5:
                    examples.append((tuple(_to_cyrillic(w) for w in words), x))
            elif lang == "ru":
                examples.append((tuple(_to_latin(w) for w in words), x))
    rows = []
    for words, _ in examples:
        for w in words:
            if w not in known:
                known[w] = _grams(w)
        rows.append(np.array(sorted({g for w in words for g in known[w]}), dtype=np.int64))
    machines = _machines(rows, np.array([x for _, x in examples]), rng)
    return Model(machines.astype(np.float32), _prior(langs, weights), by_table)


def _at_odds(rows: DataFrame) -> Column:
    """Whether a row's language probabilities, where it has any, find another language most probable than its label names."""
    if "lang_probs" not in rows.columns:
        return F.lit(False)
    top = F.array_max(F.transform(F.map_entries("lang_probs"), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("x"))))["x"]
    return F.coalesce(top != F.col("lang"), F.lit(False))


def sample(rows: DataFrame, bound: int = SAMPLE_ROWS) -> list[tuple[str, str, str]]:
    """About `bound` rows for each table and label that names one of LANGS, chosen by a hash of the key: (tab, lang, text)."""
    return sample_and_totals(rows, bound)[0]


def sample_and_totals(rows: DataFrame, bound: int = SAMPLE_ROWS) -> tuple[list[tuple[str, str, str]], dict[tuple[str, str], int]]:
    """The sample, and the words of all rows of each (tab, lang) that it is taken from, however short."""
    named = rows.withColumn("lang", label_language(F.col("lang"))).where(F.col("lang").isin(*LANGS) & F.col("text").isNotNull())
    # words as train counts them in the sample: one more than the spaces
    words = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1
    named = named.withColumn("__teaches", (F.length("text") >= 20) & ~_at_odds(named))
    every = named.groupBy("tab", "lang").agg(F.count_if("__teaches").alias("n"), F.sum(words.cast("long")).alias("words")).collect()
    totals = {(r["tab"], r["lang"]): r["words"] for r in every}
    counts = {(r["tab"], r["lang"]): r["n"] for r in every if r["n"]}
    if not counts:
        return [], totals
    part = F.create_map(*[F.lit(x) for (tab, lang), n in counts.items() for x in (f"{tab}|{lang}", min(1.0, bound / n))])
    # a sample row is text to learn from: of very long ones a part is enough, here and only here
    chosen = named.where(F.col("__teaches") & (F.pmod(F.xxhash64("rec_key"), F.lit(1_000_000)) < F.element_at(part, F.concat_ws("|", "tab", "lang")) * 1_000_000))
    got = chosen.select("tab", "lang", F.substring("text", 1, SAMPLE_CHARS).alias("text")).collect()
    return sorted((r["tab"], r["lang"], r["text"]) for r in got), totals


# ---- stretches


def _path(scores: Sequence[tuple[float, ...]], x: int, y: int, prior: Sequence[float], start: Sequence[float]) -> list[int]:
    """The best path through the scores of two choices; of equal ones the first."""
    bx, by, px, py = start[x], start[y], prior[x], prior[y]
    back = []
    for s in scores:
        top = bx if bx >= by else by
        first = bx >= by
        move = top - SWITCH + px
        if bx >= move:
            nx, fx = bx, True
        else:
            nx, fx = move, first
        move = top - SWITCH + py
        if by >= move:
            ny, fy = by, False
        else:
            ny, fy = move, first
        back.append((fx, fy))
        bx, by = nx + s[x], ny + s[y]
    at = bx >= by
    path = [x if at else y]
    for fx, fy in back[:0:-1]:
        at = fx if at else fy
        path.append(x if at else y)
    path.reverse()
    return path


def _runs(scores: Sequence[tuple[float, ...]], best_of: Sequence[int], prior: Sequence[float], start: Sequence[float], totals: Sequence[float]) -> list[list[int]]:
    """Runs [first, end, choice] of the best path through the scores, less SWITCH for each change of choice.

    best_of is the best choice by each of the scores, prior the handicap of a choice where it takes over, start its lead at the beginning, totals its lead with all scores. A run other than the main one stands only if it is
    long enough for a clause and clearly ahead; else it goes to a neighbour.
    """
    n = len(scores)
    only = totals.index(max(totals))
    # a stretch of another choice needs words that are best in it
    if n - best_of.count(only) < LEAST_STRETCH:
        return [[0, n, only]]
    langs = [x for x in range(len(prior)) if x == only or best_of.count(x) >= LEAST_STRETCH]
    if len(langs) == 1:
        return [[0, n, only]]
    if len(langs) == 2:
        path = _path(scores, *langs, prior, start)
    else:
        best = {x: start[x] for x in langs}
        back: list[dict[int, int]] = []
        for s in scores:
            top = max(langs, key=best.__getitem__)
            step, frm = {}, {}
            for x in langs:
                stay, move = best[x], best[top] - SWITCH + prior[x]
                step[x], frm[x] = (stay, x) if stay >= move else (move, top)
                step[x] += s[x]
            back.append(frm)
            best = step
        path = [max(langs, key=best.__getitem__)]
        for frm in reversed(back[1:]):
            path.append(frm[path[-1]])
        path.reverse()
    runs: list[list[int]] = []
    for i, x in enumerate(path):
        if runs and runs[-1][2] == x:
            runs[-1][1] = i + 1
        else:
            runs.append([i, i + 1, x])
    main = max(langs, key=lambda x: sum(e - b for b, e, y in runs if y == x))

    def holds(run: list[int]) -> bool:
        b, e, x = run
        rival = main if x != main else max((y for y in langs if y != x), key=lambda y: sum(s[y] for s in scores[b:e]))
        ahead = [s[x] - s[rival] for s in scores[b:e]]
        return sum(a > 0.3 for a in ahead) >= LEAST_STRETCH and sum(ahead) > 0.5 * (e - b)

    while len(runs) > 1:
        weak = [r for r in runs if not holds(r)]
        if not weak:
            return runs
        run = min(weak, key=lambda r: r[1] - r[0])
        i = runs.index(run)
        sides = [r for r in (runs[i - 1] if i else None, runs[i + 1] if i + 1 < len(runs) else None) if r]
        run[2] = max(sides, key=lambda r: (r[2] == main, r[1] - r[0]))[2]
        merged: list[list[int]] = []
        for r in runs:
            if merged and merged[-1][2] == r[2]:
                merged[-1][1] = r[1]
            else:
                merged.append(list(r))
        runs = merged
    # one choice: the one with the best total, as the path's may have come from a weak stretch
    return [[0, n, only]]


def stretches(model: Model, text: str | None, tab: str | None = None, probs: dict[str, float] | None = None) -> tuple[int, list[tuple[int, int, str, float]]]:
    """The number of spoken words of a text, and its stretches as (first word, end word, language, confidence).

    tab is the table whose prior counts, probs the row's own language probabilities, if any. The families' stretches are found first; within
    each, the machine of that family alone finds the stretches of its two languages. A text with no words has no stretches.
    """
    if not text:
        return 0, []
    clean, words = _spoken(text)
    known = model.spoken(words)
    n = spoken = len(known)
    if spoken < LEAST_WORDS:  # numbers are spoken too
        spoken = sum(not _UH.fullmatch(w) for w in _SPOKEN.findall(clean))
    if not known:
        return spoken, []
    prior = model.by_table.get(tab, model.prior)
    start = list(prior)
    for x, p in (probs or {}).items():
        if x in LANGS and p is not None:
            start[LANGS.index(x)] += EVIDENCE * math.log(min(1.0, max(p, 0.05)))
    by_family = [k[0] for k in known]
    family_prior = _families(prior)
    family_start = _families(tuple(start)) if probs else family_prior
    totals = _totals(by_family, family_start)
    out: list[tuple[int, int, str, float]] = []
    for b, e, f in _runs(by_family, [k[1] for k in known], family_prior, family_start, totals):
        sure = _confidence(totals if e - b == n else _totals(by_family[b:e], family_start), f, e - b)
        own = known if e - b == n else known[b:e]
        within = [k[2][f] for k in own]
        pair = [p - family_prior[f] for p in prior[2 * f : 2 * f + 2]]
        pair_start = [p - family_start[f] for p in start[2 * f : 2 * f + 2]]
        both = _totals(within, pair_start)
        for b2, e2, x in _runs(within, [k[3][f] for k in own], pair, pair_start, both):
            close = _confidence(both if e2 - b2 == e - b else _totals(within[b2:e2], pair_start), x, e2 - b2)
            out.append((b + b2, b + e2, LANGS[2 * f + x], round(sure * close, 4)))
    return spoken, out


def _totals(scores: Sequence[tuple[float, ...]], start: Sequence[float]) -> list[float]:
    return [p + sum(x) for p, x in zip(start, zip(*scores))]


def _confidence(totals: list[float], x: int, n: int) -> float:
    """Logistic of the mean margin over the best rival, sharper for longer stretches."""
    ahead = totals[x] - max(t for i, t in enumerate(totals) if i != x)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, ahead / n**0.5))))


def _identify(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known: dict = {}
            spoken, found = [], []
            for tab, text, probs in zip(pdf["tab"], pdf["text"], pdf["lang_probs"]):
                given = tuple((x["key"], x["value"]) for x in probs) if probs is not None else ()
                got = known.get((tab, text, given))
                if got is None:
                    n, parts = stretches(model, text, tab, dict(given))
                    got = known[tab, text, given] = n, [{"first_word": b, "end_word": e, "lang": x, "confidence": c} for b, e, x, c in parts]
                spoken.append(got[0])
                found.append(got[1])
            yield pd.DataFrame({"tab": pdf["tab"], "rec_key": pdf["rec_key"], "label": pdf["label"], "spoken_words": spoken, "stretches": found})

    return run


SCHEMA = "tab string, rec_key string, label string, spoken_words int, stretches array<struct<first_word:int,end_word:int,lang:string,confidence:double>>"


def identify(rows: DataFrame, model: Model) -> DataFrame:
    """Rows (tab, rec_key, label, spoken_words, stretches) for rows (tab, rec_key, lang, text); label is the language the label names.

    rows may have lang_probs, a map of probabilities by language. Null, empty and blank texts have no stretches. A row delivered twice comes
    out twice.
    """
    if "lang_probs" not in rows.columns:
        rows = rows.withColumn("lang_probs", F.lit(None).cast("map<string,double>"))
    return rows.select("tab", "rec_key", label_language(F.col("lang")).alias("label"), "text", F.array_sort(F.map_entries("lang_probs")).alias("lang_probs")).mapInPandas(_identify(model), SCHEMA)


def cases(identified: DataFrame) -> DataFrame:
    """Distinct rows (tab, rec_key, lang, confidence): each language of a record whose label is missing or wrong or whose text mixes languages."""
    langs = F.array_distinct(F.transform("stretches", lambda s: s["lang"]))
    out = identified.where((F.col("spoken_words") >= LEAST_WORDS) & (F.size("stretches") > 0)).withColumn("langs", langs)
    out = out.where((F.size("langs") > 1) | F.col("label").isNull() | (F.col("label") != F.element_at("langs", 1)))
    each = out.select("tab", "rec_key", F.explode("stretches").alias("s"))
    return each.groupBy("tab", "rec_key", F.col("s.lang").alias("lang")).agg(F.max("s.confidence").alias("confidence"))
