"""Join queries; each names its inventory ids."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fuzzy, text as X
from ..operators import bestmatch, folds
from ..session import cut, partitions, table
from .base import DEC, SEG, Registry, items, segments
from .corpus import q_fuzzy_vocabulary

query = Registry()
EVIDENCE, VERIFIED = 55.0, 72.0


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    quote = F.lower(F.trim(F.regexp_replace("evidence_quote", '^[\\s"„”«»]+|[\\s"„”«»]+$', "")))
    return items(spark, sf_dir, "decision").select("meeting_id", "part_idx", "item_idx", quote.alias("quote"), X.seconds_of(F.col("timestamp")).alias("ts")).where("length(quote) >= 8")


#: Quotes and segments of a meeting that are compared at a time, and most blocks of a meeting: each block of one is copied for each of the other.
QUOTE_BLOCK, TURN_BLOCK, QUOTE_BLOCKS, TURN_BLOCKS = 2000, 4000, 4, 32
_WORD = re.compile(r"\w+")
#: Segments of a block that a quote is measured with first.
LIKELY = 6


def _letters(texts: list[str], place: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(place), len(texts)), dtype=np.int32)
    for i, text in enumerate(texts):
        for ch, n in Counter(text).items():
            if ch in place:
                out[place[ch], i] = n
    return out


def best_turns(quotes: list[dict], turns: list[dict]) -> Iterator[tuple]:
    """(part_idx, item_idx, seg_idx, start, score) of each quote's best segment, with the bonus, if it reaches the quote's `least`; earlier wins ties."""
    texts = [t["text"] for t in turns]
    place = {ch: i for i, ch in enumerate(sorted({ch for q in quotes for ch in q["quote"]}))}
    said, sizes = _letters(texts, place), np.array([len(t) for t in texts])
    starts = np.array([np.inf if t["start"] is None else t["start"] for t in turns])
    asked = _letters([q["quote"] for q in quotes], place)
    for k, q in enumerate(quotes):
        ts = np.nan if q["ts"] is None else q["ts"]
        bonus = np.where(np.abs(starts - ts) < 120, 3.0, 0.0)
        own = np.flatnonzero(asked[:, k])
        common = np.minimum(said[own], asked[own, k][:, None]).sum(axis=0)
        # a window of w letters has at most min(common, w) of them in order: most where w is all that is common
        reach = 200.0 * common / np.maximum(1, np.minimum(sizes, len(q["quote"])) + common) + bonus
        best, floor = None, q["least"]
        places = np.flatnonzero(reach >= floor - 1e-9)
        for i in places[np.argsort(-reach[places], kind="stable")]:
            if reach[i] < floor - 1e-9:
                break
            t = turns[i]
            score = fuzzy.partial_ratio_from(q["quote"], t["text"], floor - float(bonus[i]) - 1e-9)
            if not score:
                continue
            rank = (score + float(bonus[i]), -starts[i], -t["seg_idx"])
            if best is None or rank > best[0]:
                best, floor = (rank, t), max(floor, rank[0])
        if best:
            yield q["part_idx"], q["item_idx"], best[1]["seg_idx"], best[1]["start"], best[0][0]


def likely_scores(quotes: list[dict], turns: list[dict]) -> Iterator[tuple]:
    """(part_idx, item_idx, score) of each quote with the best of the few segments whose words agree with it best, with the bonus: a least value of
    the best score. It decides nothing, but spares best_turns most segments."""
    held: dict[str, list[int]] = {}
    weights, starts = np.ones(len(turns)), np.array([np.nan if t["start"] is None else t["start"] for t in turns])
    for i, t in enumerate(turns):
        words = set(_WORD.findall(t["text"]))
        weights[i] = max(1, sum(map(len, words)))
        for w in words:
            held.setdefault(w, []).append(i)
    for q in quotes:
        words = set(_WORD.findall(q["quote"]))
        known = [(w, held[w]) for w in words if w in held]
        if not known:
            continue
        shared = np.bincount(np.concatenate([x for _, x in known]), np.repeat([len(w) for w, _ in known], [len(x) for _, x in known]), len(turns))
        bonus = np.where(np.abs(starts - (np.nan if q["ts"] is None else q["ts"])) < 120, 3.0, 0.0)
        agree = np.where(shared > 0, 100.0 * shared / np.minimum(weights, sum(map(len, words))) + bonus, 0.0)
        best = 0.0
        for i in np.argpartition(-agree, min(LIKELY, len(turns)) - 1)[:LIKELY]:
            if agree[i] >= EVIDENCE and (score := fuzzy.partial_ratio_from(q["quote"], turns[i]["text"], max(EVIDENCE, best - bonus[i]))):
                best = max(best, score + float(bonus[i]))
        if best:
            yield q["part_idx"], q["item_idx"], best


class Held:
    """Segments of a block, and those of them that hold a quote word for word or are held by it: no others reach 100 without the bonus."""

    def __init__(self, turns: list[dict]) -> None:
        at = [np.inf if t["start"] is None else t["start"] for t in turns]
        order = sorted(range(len(turns)), key=lambda i: (at[i], turns[i]["seg_idx"]))
        self.turns, self.starts = [turns[i] for i in order], np.array([at[i] for i in order])
        #: distinct texts with their earliest segments
        self.first: dict[str, int] = {}
        self.having: dict[str, list[str]] = {}
        self.within: dict[str, list[str]] = {}
        self.bare: list[str] = []
        self.counts: dict[int, Counter] = {}
        for i, t in enumerate(self.turns):
            if t["text"] in self.first:
                continue
            self.first[t["text"]] = i
            words = _WORD.findall(t["text"])
            for w in set(words):
                self.having.setdefault(w, []).append(t["text"])
            # the first and the last word of a text may be parts of words where it is found, all others are whole
            if len(words) > 2:
                self.within.setdefault(max(words[1:-1], key=len), []).append(t["text"])
            else:
                self.bare.append(t["text"])

    def equal(self, quote: str) -> int | None:
        """The earliest segment whose text holds the quote, or that the quote holds."""
        words = _WORD.findall(quote)
        longer = min((self.having.get(w, []) for w in words[1:-1]), key=len) if len(words) > 2 else self.first
        found = [self.first[t] for t in longer if quote in t]
        found += [self.first[t] for t in self.bare if t in quote]
        found += [self.first[t] for w in set(words) if w in self.within for t in self.within[w] if t in quote]
        return min(found, default=None)

    def sure(self, quote: str, ts: float | None) -> tuple[float, int] | None:
        """The best score of all segments, with the bonus, and the earliest that has it, if that is 100 or more."""
        i = self.equal(quote)
        best = None if i is None else (100.0, i)
        if ts is None:
            return best
        own, n = Counter(quote), len(quote)
        for i in range(*np.searchsorted(self.starts, (ts - 120, ts + 120), side="right").tolist()):
            if not abs(self.starts[i] - ts) < 120:
                continue
            floor, text = 100.0 if best is None else best[0], self.turns[i]["text"]
            if i not in self.counts:
                self.counts[i] = Counter(text)
            letters = self.counts[i]
            common = sum(min(k, letters[ch]) for ch, k in own.items() if ch in letters)
            if 200.0 * common / max(1, min(len(text), n) + common) + 3.0 < floor - 1e-9:
                continue
            score = fuzzy.partial_ratio_from(quote, text, floor - 3.0 - 1e-9) + 3.0
            if score >= floor and (best is None or (score, -i) > (best[0], -best[1])):
                best = score, i
        return best


def found_turns(quotes: list[dict], turns: list[dict], alone: bool) -> Iterator[tuple]:
    """Rows as best_turns has them: of each quote's best segment if its score is 100 or more, and where the block is all of the meeting, of any score."""
    held, rest = Held(turns), []
    for q in quotes:
        if best := held.sure(q["quote"], q["ts"]):
            t = held.turns[best[1]]
            yield q["part_idx"], q["item_idx"], t["seg_idx"], t["start"], best[0]
        else:
            rest.append(q)
    if alone and rest:
        least = {(part, item): score for part, item, score in likely_scores(rest, turns)}
        yield from best_turns([q | {"least": max(q["least"], least.get((q["part_idx"], q["item_idx"]), 0.0))} for q in rest], turns)


def _found_in_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(m, *x) for m, a, q, t in zip(pdf["meeting_id"], pdf["alone"], pdf["quotes"], pdf["turns"]) for x in found_turns(list(q), list(t), a)]
        yield pd.DataFrame(rows, columns=["meeting_id", "part_idx", "item_idx", "seg_idx", "start", "score"])


def _likely_of_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(m, *x) for m, q, t in zip(pdf["meeting_id"], pdf["quotes"], pdf["turns"]) for x in likely_scores(list(q), list(t))]
        yield pd.DataFrame(rows, columns=["meeting_id", "part_idx", "item_idx", "least"])


def _cut(rows: DataFrame, size: int, most: int, name: str) -> DataFrame:
    """Meetings with more than `size` rows, and the number of their blocks: at most one for each `size` rows of the table."""
    return rows.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size).select("meeting_id", F.least(F.lit(most), F.ceil(F.col("n") / size)).cast("int").alias(name))


def _met(quotes: DataFrame, turns: DataFrame) -> DataFrame:
    """Each block of a meeting's quotes with each of its segments, and whether its segments are one block. Segments may come more than once.

    Segments are moved once: repeated ones are dropped, and blocks gathered, where their block is.
    """
    parts, places = _cut(quotes, QUOTE_BLOCK, QUOTE_BLOCKS, "parts"), _cut(turns, TURN_BLOCK, TURN_BLOCKS, "places")
    one = F.coalesce("places", F.lit(1))
    held = turns.join(F.broadcast(places), "meeting_id", "left").withColumn("turns_block", F.pmod(F.xxhash64("seg_idx"), one).cast("int"))
    held = held.select("meeting_id", "turns_block", "seg_idx", F.col("start").cast("double").alias("start"), "text").repartition("meeting_id", "turns_block")
    held = held.dropDuplicates(["meeting_id", "turns_block", "seg_idx"]).groupBy("meeting_id", "turns_block").agg(F.collect_list(F.struct("seg_idx", "start", "text")).alias("turns"))
    asked = quotes.join(F.broadcast(parts), "meeting_id", "left").join(F.broadcast(places), "meeting_id", "left")
    asked = asked.withColumn("quotes_block", F.pmod(F.xxhash64("part_idx", "item_idx"), F.coalesce("parts", F.lit(1))).cast("int"))
    asked = asked.select("*", F.col("places").isNull().alias("alone"), F.explode(F.sequence(F.lit(0), one - 1)).alias("turns_block")).repartition("meeting_id", "turns_block")
    asked = asked.groupBy("meeting_id", "turns_block", "quotes_block", "alone").agg(F.collect_list(F.struct("part_idx", "item_idx", "quote", F.col("ts").cast("double").alias("ts"), "least")).alias("quotes"))
    return asked.join(held, ["meeting_id", "turns_block"]).select("meeting_id", "turns_block", "alone", "quotes", "turns")


def _best_of_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(m, *x) for m, q, t in zip(pdf["meeting_id"], pdf["quotes"], pdf["turns"]) for x in best_turns(list(q), list(t))]
        yield pd.DataFrame(rows, columns=["meeting_id", "part_idx", "item_idx", "seg_idx", "start", "score"])


@query()
def q_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment that a quote is taken from, by the best partial match, with a small bonus near the stated time; earlier wins ties.

    Quotes and segments of a meeting meet in blocks. Those that are equal, and those near the stated time that can come to as much with the bonus, are
    found by their words and letters. A quote without any is measured with the few segments that have most of its words and then, by the best
    score so far, with all segments that can reach it: at once where the meeting is one block, else in two more passes over the large meetings only.
    """
    quotes = _quotes(spark, sf_dir).withColumn("least", F.lit(EVIDENCE))
    turns = table(spark, sf_dir, "segment").where("length(text) > 0").select("meeting_id", "seg_idx", "start", F.lower("text").alias("text"))
    key = ["meeting_id", "part_idx", "item_idx"]
    schema = "meeting_id string, part_idx long, item_idx long, seg_idx long, start double, score double"
    found = cut(_met(quotes, turns).mapInPandas(_found_in_blocks, schema))
    large = F.broadcast(_cut(turns, TURN_BLOCK, TURN_BLOCKS, "places"))
    left, said = quotes.join(large, "meeting_id", "left_semi").join(found, key, "left_anti"), turns.join(large, "meeting_id", "left_semi")
    spread = lambda df: df.repartition(2 * partitions(spark), "meeting_id", "turns_block")
    likely = spread(_met(left, said)).mapInPandas(_likely_of_blocks, "meeting_id string, part_idx long, item_idx long, least double")
    reached = cut(likely.groupBy(*key).agg(F.max("least").alias("reached")))
    asked = left.join(reached, key, "left").withColumn("least", F.greatest("least", "reached")).drop("reached")
    scored = found.unionByName(spread(_met(asked, said)).mapInPandas(_best_of_blocks, schema))
    best = scored.groupBy(*key).agg(F.max_by(F.struct("seg_idx", "score"), F.struct("score", -F.col("start"), -F.col("seg_idx"))).alias("b"))
    out = best.select(*key, F.col("b.seg_idx").alias("seg_idx"), F.least(F.lit(100.0), F.col("b.score")).alias("evidence_score"))
    return out.where(F.col("evidence_score") >= EVIDENCE).withColumn("verified", F.col("evidence_score") >= VERIFIED)


@query(f"""
with {SEG}, {DEC}, q as (select meeting_id, part_idx, item_idx, lower(trim(evidence_quote, ' "„”«»')) as quote from dec where length(trim(evidence_quote, ' "„”«»')) >= 8)
select q.meeting_id, q.part_idx, q.item_idx, count(*) as segments_with_quote, min(s.seg_idx) as first_seg from q join seg s on s.meeting_id = q.meeting_id and contains(lower(s.text), q.quote) group by 1, 2, 3""")
def q_exact_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3, exact case: the segments that contain a quote word for word."""
    turns = segments(spark, sf_dir, "text").where("text is not null").select("meeting_id", "seg_idx", F.lower("text").alias("text"))
    quote = F.lower(F.expr("trim(BOTH ' \"„”«»' FROM evidence_quote)"))
    quotes = items(spark, sf_dir, "decision").select("meeting_id", "part_idx", "item_idx", quote.alias("quote")).where("length(quote) >= 8")
    # a text that contains the quote has the words between its first and last whole: the longest of them is the key
    words = X.words(F.col("quote"))
    inner = F.array_sort(F.slice(words, F.lit(2), F.greatest(F.lit(0), F.size(words) - 2)), lambda a, b: F.length(b) - F.length(a))
    quotes = quotes.withColumn("word", F.get(inner, F.lit(0)))
    held = turns.withColumn("word", F.explode(F.array_distinct(X.words(F.col("text")))))
    columns = ["meeting_id", "part_idx", "item_idx", "quote", "seg_idx", "text"]
    keyed = quotes.where("word is not null").join(held, ["meeting_id", "word"]).select(*columns)
    short = quotes.where("word is null").join(turns, "meeting_id").select(*columns)
    hit = keyed.unionByName(short).where(F.col("text").contains(F.col("quote")))
    return hit.groupBy("meeting_id", "part_idx", "item_idx").agg(F.count(F.lit(1)).alias("segments_with_quote"), F.min("seg_idx").alias("first_seg"))


_WORDS = "w as (select meeting_id, seg_idx, lang, unnest(regexp_extract_all(lower(text), '\\p{L}+')) as word from seg where text is not null and lang in ('ro', 'ru', 'en'))"


@query(f"""
with {SEG}, {_WORDS}, l as (select distinct lang, lower(word) as word from lexicon where word is not null), k as (select lang, word from l union select 'ro', word from l where lang = 'en' union select 'ru', word from l where lang = 'en')
select w.meeting_id, w.seg_idx, count(*) as words, count(k.word) as known, round(count(k.word) / count(*), 6) as rate from w left join k on w.lang = k.lang and w.word = k.word group by 1, 2""")
def q_lexicon_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a segment's words that its own language's lexicon or the English one knows."""
    return _known_words(spark, sf_dir).groupBy("meeting_id", "seg_idx").agg(F.count(F.lit(1)).alias("words"), F.count("known").alias("known"), F.round(F.count("known") / F.count(F.lit(1)), 6).alias("rate"))


def _known_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = table(spark, sf_dir, "lexicon").where("word is not null").select("lang", F.lower("word").alias("word")).distinct()
    english = lexicon.where("lang = 'en'").select(F.explode(F.array(F.lit("ro"), F.lit("ru"))).alias("lang"), "word")
    known = lexicon.unionByName(english).distinct().withColumn("known", F.lit(1))
    words = segments(spark, sf_dir, "text", "lang").where("text is not null and lang in ('ro', 'ru', 'en')").select("meeting_id", "seg_idx", "lang", F.explode(X.words(F.col("text"))).alias("word"))
    return words.join(known, ["lang", "word"], "left")


@query(f"""
with {SEG}, {_WORDS}, l as (select distinct lang, lower(word) as word from lexicon where word is not null), k as (select lang, word from l union select 'ro', word from l where lang = 'en' union select 'ru', word from l where lang = 'en')
select lang, word, count(*) as n from w where length(word) >= 4 and not exists (select 1 from k where k.lang = w.lang and k.word = w.word) group by 1, 2""")
def q_unknown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of four letters or more that no lexicon knows."""
    return _known_words(spark, sf_dir).where("known is null and length(word) >= 4").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


@query("select d.doc_id from documents d where not exists (select 1 from job j where j.id = d.meeting_id)")
def q_unmatched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that belong to no known meeting."""
    docs, jobs = table(spark, sf_dir, "documents").select("doc_id", "meeting_id"), table(spark, sf_dir, "job").select(F.col("id").alias("meeting_id"))
    return docs.join(jobs, "meeting_id", "left_anti").select("doc_id")


@query("select d.doc_id from documents d where exists (select 1 from job j where j.id = d.meeting_id and j.status = 'done')")
def q_documents_of_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of meetings that are done."""
    jobs = table(spark, sf_dir, "job").where("status = 'done'").select(F.col("id").alias("meeting_id"))
    return table(spark, sf_dir, "documents").select("doc_id", "meeting_id").join(jobs, "meeting_id", "left_semi").select("doc_id")


LANGS = ("ro", "ru", "en")


def _key(lang: Column, word: Column) -> Column:
    """What candidates are compared by: the sound in Romanian, the small letters otherwise."""
    return F.when(lang == "ro", X.phonetic_key(word)).otherwise(F.lower(word))


def _unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_unknown_words(spark, sf_dir).where("length(word) >= 5").select("lang", "word").distinct()


def _unknown_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unknown(spark, sf_dir).withColumn("key", _key(F.col("lang"), F.col("word")))


def _lexicon_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "lexicon").where("length(word) >= 5").select("lang", F.lower("word").alias("right_word")).distinct()
    return words.withColumn("right_key", _key(F.col("lang"), F.col("right_word")))


def _nearest(words: DataFrame, lexicon: DataFrame, k: int, cutoff: float) -> DataFrame:
    """nearest_words within each language."""
    words, lexicon = cut(words), lexicon.select("lang", "right_word", "right_key")
    each = [bestmatch.nearest_words(words.where(F.col("lang") == x), lexicon.where(F.col("lang") == x), k, cutoff).withColumn("lang", F.lit(x)) for x in LANGS]
    return reduce(DataFrame.unionByName, each)


def _common_prefix(a: str, b: str) -> Column:
    """The number of letters that two columns begin with alike."""
    return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), F.least(F.length(a), F.length(b))), lambda i: F.col(a).substr(F.lit(1), i) == F.col(b).substr(F.lit(1), i))), F.lit(0))


@query()
def q_nearest_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each unknown word the word of its own language's lexicon with the best ratio, both folded, if it reaches 88, begins with the same
    letter, is about as long and no mere inflection.

    The best is ranked over all lexicon words first and filtered then.
    """
    lexicon = q_fuzzy_vocabulary(spark, sf_dir).select("lang", F.lower("word").alias("right_word"), F.col("key").alias("right_key"))
    words = _unknown(spark, sf_dir).where("length(word) >= 7").withColumn("key", X.without_diacritics(F.col("word")))
    keep = (F.left("key", F.lit(1)) == F.left("right_key", F.lit(1))) & (F.abs(F.length("key") - F.length("right_key")) <= 2)
    keep &= _common_prefix("key", "right_key") < F.least(F.length("key"), F.length("right_key")) - 4
    return _nearest(words, lexicon, 1, 88.0).where(keep).select("lang", "word", "right_word", "score")


@query()
def q_phonetic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above on phonetic keys of Romanian, from 92 on, with the same first sound and no mere inflection."""
    best = bestmatch.nearest_words(_unknown_keys(spark, sf_dir).where("lang = 'ro'"), _lexicon_keys(spark, sf_dir).where("lang = 'ro'"), 1, 92.0)
    prefix = _common_prefix("key", "right_key")
    shorter = F.least(F.length("key"), F.length("right_key"))
    keep = (F.left("key", F.lit(1)) == F.left("right_key", F.lit(1))) & (F.abs(F.length("key") - F.length("right_key")) <= 2) & (prefix < shorter - 3)
    return best.where(keep).select("word", "right_word", "score")


@query()
def q_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best candidates of a word's own language from 78 on, then those with a key of about the same length."""
    return _nearest(_unknown_keys(spark, sf_dir), _lexicon_keys(spark, sf_dir), 3, 78.0).where("abs(length(key) - length(right_key)) <= 3").select("lang", "word", "rank", "right_word", "score")


#: Distinct tasks of a meeting that a decision is compared with at a time, and decisions of a task.
TASK_BLOCK, DECISION_BLOCK = 4000, 500


def repeated(decisions: list[dict], tasks: list[dict]) -> Iterator[tuple[str, str | None]]:
    """(decision, timestamp) of the decisions that one of the tasks repeats: at the same time with a token set ratio of 35, or at any with 80."""
    known = fuzzy.WordSets()
    for t in tasks:
        known.put(t["task"])
    at: dict[str, list[int]] = {}
    for i, t in enumerate(tasks):
        for time in t["times"]:
            at.setdefault(time, []).append(i)
    for d in decisions:
        reach = known.reach(d["decision"])
        places = np.flatnonzero(reach >= 80 - 1e-6)
        measured = lambda i: fuzzy.token_set_ratio(d["decision"], tasks[i]["task"])
        # the likeliest first: one is enough
        found = any(measured(i) >= 80 for i in places[np.argsort(-reach[places], kind="stable")])
        for time in d["times"]:
            if found or any(reach[i] >= 35 - 1e-6 and measured(i) >= 35 for i in at.get(time, ())):
                yield d["decision"], time


def _repeated_of_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(m, *x) for m, d, t in zip(pdf["meeting_id"], pdf["decisions"], pdf["tasks"]) for x in repeated(list(d), list(t))]
        yield pd.DataFrame(rows, columns=["meeting_id", "decision", "timestamp"])


@query()
def q_decisions_not_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions that no task of the meeting repeats: at the same time with a token set ratio of 35, or at any time with 80.

    Distinct decisions meet all distinct tasks of their meeting, in blocks; only pairs whose letters and words can reach the ratio are measured.
    """
    said = items(spark, sf_dir, "action_item").select("meeting_id", F.coalesce("task", F.lit("")).alias("task"), "timestamp")
    decisions = items(spark, sf_dir, "decision").select("meeting_id", "part_idx", "item_idx", F.coalesce("decision", F.lit("")).alias("decision"), "timestamp")
    # no time is the same as no other; a decision without one is still among those that are asked for
    tasks = said.groupBy("meeting_id", "task").agg(F.collect_set("timestamp").alias("times"))
    asked = decisions.groupBy("meeting_id", "decision").agg(F.array_union(F.collect_set("timestamp"), F.array(F.lit(None).cast("string"))).alias("times"))
    block = lambda c, n: F.floor((F.row_number().over(Window.partitionBy("meeting_id").orderBy(c)) - 1) / n).alias("b")
    held = tasks.select("*", block("task", TASK_BLOCK)).groupBy("meeting_id", F.col("b").alias("tb")).agg(F.collect_list(F.struct("task", "times")).alias("tasks"))
    asked = asked.select("*", block("decision", DECISION_BLOCK)).groupBy("meeting_id", F.col("b").alias("db")).agg(F.collect_list(F.struct("decision", "times")).alias("decisions"))
    pairs = asked.join(held, "meeting_id").repartition("meeting_id", "db", "tb").select("meeting_id", "decisions", "tasks")
    out = pairs.mapInPandas(_repeated_of_blocks, "meeting_id string, decision string, timestamp string").distinct()
    same = (F.col("d.meeting_id") == F.col("r.meeting_id")) & (F.col("d.decision") == F.col("r.decision")) & F.col("d.timestamp").eqNullSafe(F.col("r.timestamp"))
    return decisions.alias("d").join(out.alias("r"), same, "left_anti").select("meeting_id", "part_idx", "item_idx")


@query("""
with s as (select distinct meeting_id, seg_idx, "start" as s, "end" as e from segment where "end" > "start"), m as (select meeting_id, cast(floor(greatest(0, max(e)) / 120) as bigint) as last from s group by 1),
w as (select id, unnest(generate_series(0, last)) * 120.0 as ws from (select distinct id from job) join m on id = m.meeting_id)
select w.id as meeting_id, cast(w.ws as double) as win, s.seg_idx, greatest(s.s, w.ws) as part_start, least(s.e, w.ws + 60) as part_end from w join s on s.meeting_id = w.id and s.s < w.ws + 60 and s.e > w.ws where least(s.e, w.ws + 60) - greatest(s.s, w.ws) > 0.3""")
def q_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments within the evaluation windows, a minute in every two up to the last end of each meeting, cut to them, where more than 0.3 s is left."""
    spans = _spans(spark, sf_dir)
    last = spans.where("e > s").groupBy("meeting_id").agg(F.floor(F.greatest(F.lit(0.0), F.max("e")) / 120).cast("int").alias("last"))
    windows = table(spark, sf_dir, "job").select(F.col("id").alias("meeting_id")).distinct().join(last, "meeting_id")
    return _within(_every_other_minute(windows), spans)


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir, "start", "end").select("meeting_id", "seg_idx", F.col("start").alias("s"), F.col("end").alias("e"))


def _every_other_minute(meetings: DataFrame) -> DataFrame:
    windows = meetings.withColumn("win", F.explode(F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: i * 120.0))).drop("last")
    return windows.withColumn("win_end", F.col("win") + 60)


def _within(windows: DataFrame, spans: DataFrame) -> DataFrame:
    both = bestmatch.overlap_join(windows, spans, ["meeting_id"], 120.0, "win", "win_end", "s", "e")
    out = both.select("meeting_id", "win", "seg_idx", F.greatest("s", "win").alias("part_start"), F.least("e", "win_end").alias("part_end"))
    return out.where(F.col("part_end") - F.col("part_start") > 0.3)


_ALIGNED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])


@F.pandas_udf(_ALIGNED)
def place(quote: pd.Series, text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fuzzy.partial_alignment(q, t) for q, t in zip(quote, text)], columns=["score", "begin", "end"])


@query()
def q_uncertain_in_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncertain critical words of a segment that lie within the part of it that a quote matches best."""
    found = q_evidence(spark, sf_dir).join(_quotes(spark, sf_dir), ["meeting_id", "part_idx", "item_idx"])
    conf = table(spark, sf_dir, "segment").select("meeting_id", "seg_idx", "word_conf").where(F.exists("word_conf", lambda w: w["critical"] & (w["p"] < 0.5)))
    conf = conf.dropDuplicates(["meeting_id", "seg_idx"])
    rows = found.join(conf, ["meeting_id", "seg_idx"]).withColumn("said", F.array_join(F.transform("word_conf", lambda x: F.lower(x["word"])), " "))
    rows = rows.withColumn("at", place("quote", "said"))
    each = rows.select("meeting_id", "part_idx", "item_idx", "at", F.posexplode("word_conf").alias("pos", "w"), F.transform("word_conf", lambda x: F.length(x["word"]) + 1).alias("lengths"))
    begin = F.aggregate(F.slice("lengths", F.lit(1), F.col("pos")), F.lit(0), lambda a, x: a + x)
    each = each.withColumn("b", begin).where((F.col("b") + F.length("w.word") >= F.col("at.begin")) & (F.col("b") <= F.col("at.end")))
    return each.where("w.critical and w.p < 0.5").select("meeting_id", "part_idx", "item_idx", "pos", F.col("w.word").alias("word"), F.round("w.p", 2).alias("p"))


@query("""
with r as (select distinct meeting_id, seg_idx, cast(round("start" * 100) as bigint) as k from segment), d as (select meeting_id, k, min(seg_idx) as first from r group by 1, 2)
select r.meeting_id, r.seg_idx, d.first as same_start from r left join d on r.meeting_id = d.meeting_id and r.k = d.k and d.first != r.seg_idx""")
def q_rounded_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equi-join on a rounded start, left outer."""
    rows = segments(spark, sf_dir, "start").withColumn("k", F.round(F.col("start") * 100).cast("long")).select("meeting_id", "seg_idx", "k")
    first = rows.groupBy("meeting_id", "k").agg(F.min("seg_idx").alias("same_start"))
    return rows.join(first, ["meeting_id", "k"], "left").select("meeting_id", "seg_idx", F.when(F.col("same_start") != F.col("seg_idx"), F.col("same_start")).alias("same_start"))


@query(f"""
with {SEG}, a as (select meeting_id, seg_idx, unnest(corrections)."from" as a, generate_subscripts(corrections, 1) as pos from seg), b as (select meeting_id, seg_idx, unnest(word_conf).word as b, generate_subscripts(word_conf, 1) as pos from seg)
select a.meeting_id, a.seg_idx, cast(a.pos - 1 as int) as pos, a.a, b.b from a join b using (meeting_id, seg_idx, pos)""")
def q_positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of a row joined by position; the shorter one decides."""
    rows = segments(spark, sf_dir, "corrections", "word_conf").where("corrections is not null and word_conf is not null")
    n = F.least(F.size("corrections"), F.size("word_conf"))
    zipped = F.slice(F.arrays_zip(F.transform("corrections", lambda x: x["from"]).alias("a"), F.transform("word_conf", lambda x: x["word"]).alias("b")), F.lit(1), n)
    return rows.select("meeting_id", "seg_idx", F.posexplode(zipped).alias("pos", "x")).select("meeting_id", "seg_idx", "pos", F.col("x").getField("a").alias("a"), F.col("x").getField("b").alias("b"))


@query("""
with p as (select distinct on (meeting_id, speaker) meeting_id, speaker, name from participant where speaker is not null order by meeting_id, speaker, part_idx desc, item_idx desc, name desc nulls last), s as (select distinct meeting_id, speaker from segment where speaker is not null)
select s.meeting_id, s.speaker, p.name from s left join p on s.meeting_id = p.meeting_id and s.speaker = p.speaker""")
def q_every_speaker_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every speaker heard, once, with the name of the last entry for them, if any; entries for others are left out."""
    people = table(spark, sf_dir, "participant").where("speaker is not null").groupBy("meeting_id", "speaker").agg(F.max_by(F.struct("name"), F.struct("part_idx", "item_idx", "name")).alias("x"))
    heard = segments(spark, sf_dir, "speaker").where("speaker is not null").select("meeting_id", "speaker").distinct()
    return heard.join(people, ["meeting_id", "speaker"], "left").select("meeting_id", "speaker", F.col("x.name").alias("name"))


def _bounded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordinal = (F.col("part_idx").cast("long") * 1_000_000 + F.col("item_idx")).alias("item")  # part_idx is an int
    return items(spark, sf_dir, "action_item").select("meeting_id", ordinal, "part_idx", "item_idx", F.lower(F.coalesce("task", F.lit(""))).alias("text"), F.coalesce("evidence_quote", F.lit("")).alias("quote"))


@query()
def q_leader_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks gathered under the first similar one (token set ratio 85); a newcomer with a longer quote takes the lead."""
    return folds.fold(_bounded_items(spark, sf_dir), ["meeting_id"], [F.col("part_idx"), F.col("item_idx")], lambda: folds.Leaders(fuzzy.token_set_ratio, index=fuzzy.WordSets()), "meeting_id string, item long, leader long, leads boolean")


@query()
def q_subject_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of decisions, then of tasks, under the first similar subject of the meeting."""
    def part(name: str, kind: int) -> DataFrame:
        item = F.lit(kind) * 10**12 + F.col("part_idx").cast("long") * 1_000_000 + F.col("item_idx")  # part_idx is an int
        return items(spark, sf_dir, name).where("subject is not null and subject != ''").select("meeting_id", item.alias("item"), F.lit(kind).alias("kind"), "part_idx", "item_idx", F.lower("subject").alias("text"), F.lit("").alias("quote"))

    both = part("decision", 0).unionByName(part("action_item", 1))
    order = [F.col("kind"), F.col("part_idx"), F.col("item_idx")]
    return folds.fold(both, ["meeting_id"], order, lambda: folds.Leaders(fuzzy.token_set_ratio, index=fuzzy.WordSets()), "meeting_id string, item long, subject_no long, leads boolean")


@query(f"""
with {SEG}, l as (select distinct lang, lower(word) as word from lexicon where word is not null),
h as (select meeting_id, seg_idx, lang, unnest(regexp_extract_all(translate(lower(text), 'şţ', 'șț'), '\\p{{L}}+(?:-\\p{{L}}+)*')) as w from seg where lang in ('ro', 'ru') and text is not null),
s as (select meeting_id, seg_idx, count(*) as suspicious from h where length(w) >= 4 and not exists (select 1 from l where l.lang = h.lang and (l.word = h.w or l.word = replace(h.w, '-', ''))) and not exists (select 1 from l where l.lang = 'en' and l.word = h.w) group by 1, 2),
t as (select meeting_id, seg_idx, lang, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) as w from seg where lang in ('ro', 'ru') and text is not null),
r as (select meeting_id, seg_idx, count(*) as n, count(*) filter (where exists (select 1 from l where l.lang in (t.lang, 'en') and l.word = t.w)) as known from t group by 1, 2)
select seg.meeting_id, seg.seg_idx, coalesce(suspicious, 0) as suspicious, coalesce(coalesce(suspicious, 0) > 0 or n >= 3 and known / n < 0.85 or coalesce(confidence, 1) < 0.55, false) as needed
from seg left join s using (meeting_id, seg_idx) left join r using (meeting_id, seg_idx) where lang in ('ro', 'ru') and text is not null""")
def q_needs_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments worth a correction: with words that no lexicon knows, hyphens or not, with under 85 % known words of three or more, or unsure."""
    rows = segments(spark, sf_dir, "text", "lang", "confidence").where("lang in ('ro', 'ru') and text is not null")
    lexicon = table(spark, sf_dir, "lexicon").where("word is not null").select("lang", F.lower("word").alias("w")).distinct()
    english = lexicon.where("lang = 'en'").select("w", F.lit(True).alias("en"))
    hyphened = rows.select("meeting_id", "seg_idx", "lang", F.explode(F.regexp_extract_all(X.comma_forms(F.col("text")), F.lit(r"\p{L}+(?:-\p{L}+)*"), 0)).alias("w")).where("length(w) >= 4")
    hyphened = hyphened.join(lexicon.withColumn("own", F.lit(True)), ["lang", "w"], "left").join(english, "w", "left").where("own is null and en is null")
    joined = lexicon.select("lang", F.col("w").alias("j"), F.lit(True).alias("joined"))
    hyphened = hyphened.withColumn("j", F.replace("w", F.lit("-"), F.lit(""))).join(joined, ["lang", "j"], "left").where("joined is null")
    suspicious = hyphened.groupBy("meeting_id", "seg_idx").agg(F.count(F.lit(1)).alias("suspicious"))
    rate = _known_words(spark, sf_dir).groupBy("meeting_id", "seg_idx").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("k"))
    out = rows.join(suspicious, ["meeting_id", "seg_idx"], "left").join(rate, ["meeting_id", "seg_idx"], "left").withColumn("suspicious", F.coalesce("suspicious", F.lit(0)))
    needed = (F.col("suspicious") > 0) | ((F.col("n") >= 3) & (F.col("k") / F.col("n") < 0.85)) | (F.coalesce("confidence", F.lit(1.0)) < 0.55)
    return out.select("meeting_id", "seg_idx", "suspicious", F.coalesce(needed, F.lit(False)).alias("needed"))


@query()
def q_edit_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which recorded corrections pass: changed, contained, short, digits kept, and alike (in sound, in Romanian) by 70, or by 55 if the
    lexicon of the language has a word of the new text."""
    rows = segments(spark, sf_dir, "raw_text", "corrections", "lang").select("meeting_id", "seg_idx", "raw_text", "lang", F.explode("corrections").alias("c"))
    rows = rows.select("meeting_id", "seg_idx", "raw_text", "lang", F.col("c.from").alias("a"), F.col("c.to").alias("b")).where("a is not null and b is not null")
    lexicon = table(spark, sf_dir, "lexicon").where("word is not null").select("lang", F.lower("word").alias("w")).distinct()
    real = rows.select("lang", "b", F.explode(X.words(F.col("b"))).alias("w")).distinct().join(lexicon, ["lang", "w"], "left_semi").select("lang", "b").distinct().withColumn("real", F.lit(True))
    rows = rows.join(real, ["lang", "b"], "left").withColumn("alike", fuzzy.column(fuzzy.ratio)(_key(F.col("lang"), F.col("a")), _key(F.col("lang"), F.col("b"))))
    digits = lambda c: F.regexp_replace(c, r"[^0-9]", "")
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    ok = (F.col("a") != "") & (F.col("b") != "") & (F.col("a") != F.col("b")) & F.coalesce(F.contains("raw_text", F.col("a")), F.lit(False)) & (words("a") <= 4) & (words("b") <= 5) & (digits("a") == digits("b"))
    alike = (F.col("alike") >= 70) | ((F.col("alike") >= 55) & F.col("real").isNotNull())
    return rows.groupBy("meeting_id", "seg_idx", "a", "b").agg(F.max("alike").alias("alike"), F.max(ok & alike).alias("passes"))


QUERIES, ORACLE = query.queries, query.oracle
