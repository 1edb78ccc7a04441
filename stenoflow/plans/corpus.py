"""Corpus queries: P18, P22, P24, F9, F17, O6."""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.checks import pressure_alerts
from ..session import table
from .base import SEG, Registry, segments

query = Registry()
_RUN = re.compile(r"[^\W_]+")


@query(f"""with {SEG}, n as (select *, len(regexp_extract_all(text, '\\p{{L}}+')) as n from seg where text is not null)
select meeting_id, seg_idx, coalesce(not regexp_matches(text, '[0-9]') and n between 5 and 45 and case lang when 'ru' then not regexp_matches(lower(text), '[a-z]') when 'ro' then not regexp_matches(lower(text), '[а-яё]') when 'en' then not regexp_matches(lower(text), '[а-яё]') end, false) as valid from n""")
def q_valid_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances fit for a speech corpus: no digits, one script, 5 to 45 words."""
    n = F.size(F.regexp_extract_all("text", F.lit(r"\p{L}+"), 0))
    script = F.when(F.col("lang") == "ru", ~F.lower("text").rlike("[a-z]")).when(F.col("lang").isin("ro", "en"), ~F.lower("text").rlike("[а-яё]"))
    ok = ~F.col("text").rlike("[0-9]") & n.between(5, 45) & script
    return segments(spark, sf_dir, "text", "lang").where("text is not null").select("meeting_id", "seg_idx", F.coalesce(ok, F.lit(False)).alias("valid"))


@query("""select lang, translate(lower(word), 'ăâîșțşţáàäéèëêíïóöôúüûçñйё', 'aaiststaaaeeeeiiooouuucnие') as key, arg_max(word, (n, word)) as word from (select lang, word, sum(count) as n from lexicon where length(word) >= 7 group by 1, 2) group by 1, 2""")
def q_fuzzy_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of seven letters or more by folded key; the most frequent wins, the last in the alphabet of equals."""
    words = table(spark, sf_dir, "lexicon").where("length(word) >= 7").groupBy("lang", "word").agg(F.sum("count").alias("n"))
    return words.groupBy("lang", X.without_diacritics(F.col("word")).alias("key")).agg(F.max_by("word", F.struct("n", "word")).alias("word"))


@query(f"""with {SEG}, u as (select 'segment' as source, coalesce(lang, 'ro') as lang, text from seg union all select 'hypothesis', 'ro', hyp from exp_asr union all select 'document', coalesce(lang, 'ro'), text from documents)
select source, lang, count(*) as n, cast(sum(length(text)) as bigint) as chars from u where text is not null and text != '' group by 1, 2""")
def q_tagged_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources in one corpus, tagged, with a language for those without one, counted."""
    a = segments(spark, sf_dir, "text", "lang").select(F.lit("segment").alias("source"), F.coalesce("lang", F.lit("ro")).alias("lang"), "text")
    b = table(spark, sf_dir, "exp_asr").select(F.lit("hypothesis").alias("source"), F.lit("ro").alias("lang"), F.col("hyp").alias("text"))
    c = table(spark, sf_dir, "documents").select(F.lit("document").alias("source"), F.coalesce("lang", F.lit("ro")).alias("lang"), "text")
    return a.unionByName(b).unionByName(c).where("text is not null and text != ''").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))


@query(f"""with {SEG}, c as (select unnest(corrections)."from" as a, unnest(corrections)."to" as b from seg) select a as wrong, b as correct, count(*) as n from c where a != b and a != '' group by 1, 2""")
def q_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded corrections as variants, pairs that change nothing left out, longest first."""
    c = segments(spark, sf_dir, "corrections").select(F.explode("corrections").alias("c"))
    pairs = c.select(F.col("c.from").alias("wrong"), F.col("c.to").alias("correct")).where("wrong != correct and wrong != ''")
    return pairs.groupBy("wrong", "correct").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc(F.length("wrong")), "wrong", "correct")


class Variants:
    """Variants replaced as whole words in any case, longest first, each in the text that the longer ones left.

    Only those whose first word the text has are tried, and after a replacement those whose first word it brought in.
    """

    def __init__(self, pairs: list[tuple[str, str]]):
        self.pairs = sorted(pairs, key=lambda p: (-len(p[0]), p))
        self.by_word: dict[str, list[int]] = defaultdict(list)
        for i, (wrong, _) in enumerate(self.pairs):
            self.by_word[next(iter(self._words(wrong)), "")].append(i)  # '' for a variant without letters and digits
        self.patterns: dict[int, re.Pattern] = {}

    @staticmethod
    def _words(text: str) -> list[str]:
        return [w.lower() for w in _RUN.findall(text)]

    def _tried(self, text: str, after: int = -1) -> set[int]:
        return {i for w in ["", *self._words(text)] if w in self.by_word for i in self.by_word[w] if i > after}

    def apply(self, text: str) -> tuple[str, list[str]]:
        """The text with variants replaced, and those that applied, in that order."""
        applied, tried = [], self._tried(text)
        queue = sorted(tried)
        while queue:
            i = heapq.heappop(queue)
            wrong, correct = self.pairs[i]
            if i not in self.patterns:
                self.patterns[i] = re.compile(rf"(?<![^\W_]){re.escape(wrong)}(?![^\W_])", re.I)
            text, n = self.patterns[i].subn(lambda _, to=correct: to, text)
            if n:
                applied.append(wrong)
                for k in self._tried(correct, i) - tried:
                    tried.add(k)
                    heapq.heappush(queue, k)
        return text, applied


@query()
def q_variants_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """all variants replaced in raw texts, whole words in any case, longest first, with the list of those that applied.

    The distinct variants, a vocabulary of misspellings, go to every task.
    """
    pairs = [(r["wrong"], r["correct"]) for r in q_variants(spark, sf_dir).select("wrong", "correct").collect()]

    def run(batches: Iterator[pd.DataFrame], pairs=pairs) -> Iterator[pd.DataFrame]:
        variants = Variants(pairs)
        for pdf in batches:
            done = [(m, i, *variants.apply(t)) for m, i, t in zip(pdf["meeting_id"], pdf["seg_idx"], pdf["raw_text"])]
            yield pd.DataFrame([x for x in done if x[3]], columns=["meeting_id", "seg_idx", "fixed", "applied"])

    return segments(spark, sf_dir, "raw_text").where("raw_text is not null").mapInPandas(run, "meeting_id string, seg_idx long, fixed string, applied array<string>")


@query(f"""with {SEG}, r as (select meeting_id, seg_idx, unnest(regexp_extract_all(' ' || regexp_replace(text, '[ ,.;?!()]', '  ', 'g') || ' ', ' [0-9]{{2,3}}/[0-9]{{2,3}} ')) as r from seg where text is not null)
select meeting_id, count(*) as alerts from (select meeting_id, cast(string_split(trim(r), '/')[1] as int) as hi, cast(string_split(trim(r), '/')[2] as int) as lo from r) where hi >= 160 or hi < 90 or lo >= 100 or lo < 60 group by 1""")
def q_pressure_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F17, pressures only: readings beyond the limits, counted by meeting."""
    spaced = F.concat(F.lit(" "), F.regexp_replace("text", r"[ ,.;?!()]", "  "), F.lit(" "))
    readings = F.regexp_extract_all(spaced, F.lit(r" [0-9]{2,3}/[0-9]{2,3} "), 0)
    rows = segments(spark, sf_dir, "text").where("text is not null").select("meeting_id", F.explode(F.transform(readings, lambda r: pressure_alerts(F.trim(r)))).alias("x"))
    return rows.where("size(x) > 0").groupBy("meeting_id").agg(F.count(F.lit(1)).alias("alerts"))


QUERIES, ORACLE = query.queries, query.oracle
