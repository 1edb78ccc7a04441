"""Ranking, evaluation and vector queries; each names its inventory ids."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.speech import compression_ratio
from ..functions.text import latin_of_cyrillic_sql
from ..operators import vectors
from ..session import table
from . import aggregates as A
from .base import SEG, Registry, segments

query = Registry()

# fixed values: thresholds of acceptance, weights and penalties of the score
ACCEPT_LEXICAL, ACCEPT_LOGPROB, COMPRESSION, SECOND_PASS = 0.72, -0.8, 2.2, 0.08
# fixed values: what recognition makes up of silence, within a text and as a whole text
MADE_UP = r"mul[țţ]umi\w* pentru vizionare|abona[țţ]i-v[ăa]|subtitr\w*|nu uita[țţ]i s[ăa] v[ăa] abona[țţ]i|продолжение следует|субтитры|спасибо за просмотр|подписывайтесь|редактор субтитров|thanks? (you )?for watching|please subscribe|subtitles by|amara\.org"
PHANTOM = r"^\W*(и т\.? ?д\.?|и прочее\.?|и так далее\.?|and so on\.?|i'?m just kidding\.?|s[ăa] v[ăa] mul[țţ]umim!?|v[ăa] mul[țţ]umim!?|спасибо\.?|thank you\.?|(ha)+h?|(mm-?)?hmm+|mh-hm)\W*$"
_PLAIN = {r"\w": r"[\p{L}\p{N}_]", r"\W": r"[^\p{L}\p{N}_]"}
for _short, _long in _PLAIN.items():
    MADE_UP, PHANTOM = MADE_UP.replace(_short, _long), PHANTOM.replace(_short, _long)
_hall = lambda text: f"regexp_matches({text}, '{MADE_UP}', 'i')"
_TOKENS = "len(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+'))"

# what the lexicon says about the words of a text: n words, of which ro, ru and en are in the lexicon of that language or the English one
_LEX = """known as (select word, max(lang in ('ro', 'en')) as ro, max(lang in ('ru', 'en')) as ru, max(lang = 'en') as en from (select distinct lang, lower(word) as word from lexicon where word is not null) where lang in ('ro', 'ru', 'en') group by 1),
tok as (select meeting_id, seg_idx, which, unnest(regexp_extract_all(lower(t), '\\p{L}+')) as word from (select meeting_id, seg_idx, 'text' as which, text as t from seg union all select meeting_id, seg_idx, 'raw', coalesce(raw_text, text) from seg) where t is not null),
lex as (select meeting_id, seg_idx, which, count(*) as n, count(*) filter (where ro) as ro, count(*) filter (where ru) as ru, count(*) filter (where en) as en from tok left join known on tok.word = known.word group by 1, 2, 3)"""
_SHRUNK = "(least(1.0, coalesce(n, 0) / 4.0) * coalesce({0} / n, 0) + (1 - least(1.0, coalesce(n, 0) / 4.0)) * 0.5)"


def lexical_counts(spark: SparkSession, sf_dir: str, texts: DataFrame) -> DataFrame:
    """For rows (meeting_id, seg_idx, which, t): n words of each text, and how many of them the lexicon of ro, ru or en, or the English one, has."""
    entries = table(spark, sf_dir, "lexicon").where("word is not null and lang in ('ro', 'ru', 'en')").select("lang", F.lower("word").alias("word")).distinct()
    flag = lambda *langs: F.bool_or(F.col("lang").isin(*langs)).alias(langs[0])
    known = entries.groupBy("word").agg(flag("ro", "en"), flag("ru", "en"), flag("en"))
    tokens = texts.where("t is not null").select("meeting_id", "seg_idx", "which", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"\p{L}+"), 0)).alias("word"))
    return tokens.join(known, "word", "left").groupBy("meeting_id", "seg_idx", "which").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(x).alias(x) for x in ("ro", "ru", "en")])


def shrunk(known: Column) -> Column:
    """the known share of a text's words, drawn to one half where there are fewer than four."""
    k = F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / 4.0)
    return k * F.coalesce(known / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)) + (1 - k) * 0.5


def made_up(text: Column) -> Column:
    return F.coalesce(text.rlike(f"(?iu){MADE_UP}"), F.lit(False))


def _prompts(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    """The words of each language's prompt: three texts of 380 characters at most."""
    from .aggregates import q_budgeted_prompt

    return {r["lang"]: sorted(set(re.findall(r"\w+", r["prompt"].lower()))) for r in q_budgeted_prompt(spark, sf_dir).collect()}


def _leaks(text: Column, prompt: list[str]) -> Column:
    """P6 for a known prompt: two distinct words or more, of which over 70 % are the prompt's."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0))
    hits = F.size(F.filter(words, lambda w: w.isin(*prompt) if prompt else F.lit(False)))
    return F.coalesce((F.size(words) >= 2) & (hits / F.size(words) > 0.7), F.lit(False))


_HYP = f"""{SEG}, {_LEX},
h as (select seg.meeting_id, seg.seg_idx, kv.key as hyp_lang, ln(kv.value + 0.001) as logprob, case when kv.key = seg.lang then 'text' else 'raw' end as which, case when kv.key = seg.lang then text else coalesce(raw_text, text) end as t
  from (select *, unnest(map_entries(lang_probs)) as kv from seg where text is not null) seg),
c as (select h.*, lex.n, case hyp_lang when 'ro' then lex.ro when 'ru' then lex.ru else lex.en end as known, {_TOKENS.format('t')} as words, len(list_filter(ws, lambda x: list_contains({A.RO_WORDS!r}, {latin_of_cyrillic_sql('x')}))) as ro_words, len(list_filter(ws, lambda x: list_contains({A.RU_WORDS!r}, x))) as ru_words, len(ws) as cyr
  from (select *, regexp_extract_all(lower(t), '[а-яё]+') as ws from h) h left join lex using (meeting_id, seg_idx, which)),
m as (select *, max(words) over (partition by meeting_id, seg_idx) as most from c)"""


def _hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hypothesis for each language a segment may be in: its text if it is the label's language, else the raw text, with the score of F33 but
    for compression: log probability, prior, twice the lexical evidence, penalties for made-up texts, for Romanian in Cyrillic letters and Cyrillic
    letters elsewhere, and for covering under half of the longest hypothesis."""
    rows = segments(spark, sf_dir, "text", "raw_text", "lang", "lang_probs").where(F.col("text").isNotNull())
    sides = F.array(F.struct(F.lit("text").alias("which"), F.col("text").alias("t")), F.struct(F.lit("raw").alias("which"), F.coalesce("raw_text", "text").alias("t")))
    counts = lexical_counts(spark, sf_dir, rows.select("meeting_id", "seg_idx", F.explode(sides).alias("x")).select("meeting_id", "seg_idx", "x.*"))
    own = F.col("hyp_lang").eqNullSafe(F.col("lang"))
    h = rows.select("meeting_id", "seg_idx", "text", "raw_text", "lang", F.explode("lang_probs").alias("hyp_lang", "p"))
    h = h.select("meeting_id", "seg_idx", "hyp_lang", F.log(F.col("p") + 0.001).alias("logprob"), F.when(own, "text").otherwise("raw").alias("which"), F.when(own, F.col("text")).otherwise(F.coalesce("raw_text", "text")).alias("t"))
    h = h.join(counts, ["meeting_id", "seg_idx", "which"], "left").withColumn("words", F.size(F.regexp_extract_all("t", F.lit(r"[\p{L}\p{N}_]+"), 0)))
    h = h.withColumn("most", F.max("words").over(Window.partitionBy("meeting_id", "seg_idx")))
    known = F.when(F.col("hyp_lang") == "ro", F.col("ro")).when(F.col("hyp_lang") == "ru", F.col("ru")).otherwise(F.col("en"))
    russian = F.col("hyp_lang") == "ru"
    score = (
        F.col("logprob") + F.when(F.col("hyp_lang") == "ro", 0.3).otherwise(0.0) + 2 * shrunk(known) - F.when(made_up(F.col("t")), 2.0).otherwise(0.0)
        - F.when(russian & (A.cyrillic_romanian(F.col("t")) > 0.5), 1.0).otherwise(0.0) - F.when(~russian & F.lower("t").rlike("[а-яё]"), 1.0).otherwise(0.0)
        - F.when((F.col("most") >= 4) & (F.col("words") < 0.5 * F.col("most")), 1.5).otherwise(0.0)
    )
    return h.withColumn("score", score)


@query(f"""with {_HYP} select meeting_id, seg_idx, hyp_lang, round(logprob + case when hyp_lang = 'ro' then 0.3 else 0 end + 2 * {_SHRUNK.format('known')} - case when {_hall('t')} then 2 else 0 end
  - case when hyp_lang = 'ru' and cyr >= 3 and ro_words / greatest(1, ro_words + ru_words) > 0.5 then 1 else 0 end - case when hyp_lang != 'ru' and regexp_matches(lower(t), '[а-яё]') then 1 else 0 end - case when most >= 4 and words < 0.5 * most then 1.5 else 0 end, 6) as score from m""")
def q_hypothesis_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the score of every hypothesis, all terms but that for compression."""
    return _hypotheses(spark, sf_dir).select("meeting_id", "seg_idx", "hyp_lang", F.round("score", 6).alias("score"))


@query()
def q_best_hypothesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the hypothesis with the best score, all terms, ties by language. Texts that compress too well lose two points."""
    rows = _hypotheses(spark, sf_dir).withColumn("score", F.col("score") - F.when(compression_ratio("t") > COMPRESSION, 2.0).otherwise(0.0))
    best = rows.groupBy("meeting_id", "seg_idx").agg(F.min_by(F.struct("hyp_lang", "score"), F.struct(-F.round("score", 9), "hyp_lang")).alias("b"))
    return best.select("meeting_id", "seg_idx", "b.hyp_lang", F.round("b.score", 6).alias("score"))


@query()
def q_fallback_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: of the runs of one model and audio, in order, the first; if it loops or is made up, the first later one that does neither, else it stays."""
    rows = table(spark, sf_dir, "exp_asr").where("hyp is not null")
    bad = made_up(F.col("hyp")) | (compression_ratio("hyp") > COMPRESSION)
    rows = rows.select("model", "audio", "run_id", bad.alias("bad"))
    first = rows.groupBy("model", "audio").agg(F.min("run_id").alias("first"), F.min_by("bad", "run_id").alias("looped"), F.min(F.when(~F.col("bad"), F.col("run_id"))).alias("good"))
    return first.select("model", "audio", F.when(F.col("looped"), F.coalesce("good", "first")).otherwise(F.col("first")).alias("run_id"), F.col("looped").alias("fell_back"))


_PROMPT_SQL = "prompt as (with u as (select distinct lang, word, sum(count) over (partition by lang, word) as n from lexicon where word is not null), r as (select *, sum(length(word) + 2) over (partition by lang order by n desc, word rows unbounded preceding) as used from u) select lang, list_distinct(flatten(list(regexp_extract_all(lower(word), '[\\p{L}\\p{N}_]+')))) as ws from r where used <= 380 group by 1)"
_LEAK = "coalesce(len(ws) >= 2 and len(list_intersect(ws, {0})) / len(ws) > 0.7, false)"


@query(f"""with {SEG}, {_LEX}, {_PROMPT_SQL}, t as (select seg.*, lex.n, lex.ro, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) as ws, (select p.ws from prompt p where p.lang = 'ro') as pw from seg left join lex on seg.meeting_id = lex.meeting_id and seg.seg_idx = lex.seg_idx and which = 'text' where text is not null and "end" > "start")
select meeting_id, seg_idx, {_SHRUNK.format('ro')} >= 0.72 as lexical, coalesce(ln(confidence) >= -0.8, false) as sure, {_hall('text')} as made_up, {_LEAK.format('pw')} as leak, regexp_matches(lower(text), '[а-яё]') as cyrillic, "end" - "start" >= 2.5 and {_TOKENS.format('text')} / ("end" - "start") < 1.0 as cut_short from t""")
def q_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks for and against taking the first decode, in Romanian, as it is: all conditions but compression."""
    rows = segments(spark, sf_dir, "start", "end", "text", "confidence").where((F.col("end") > F.col("start")) & F.col("text").isNotNull())
    counts = lexical_counts(spark, sf_dir, rows.select("meeting_id", "seg_idx", F.lit("text").alias("which"), F.col("text").alias("t"))).drop("which")
    dur, text = F.col("end") - F.col("start"), F.col("text")
    short = (dur >= 2.5) & (F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), 0)) / dur < 1.0)
    return rows.join(counts, ["meeting_id", "seg_idx"], "left").select(
        "meeting_id", "seg_idx", (shrunk(F.col("ro")) >= ACCEPT_LEXICAL).alias("lexical"), F.coalesce(F.log("confidence") >= ACCEPT_LOGPROB, F.lit(False)).alias("sure"),
        made_up(text).alias("made_up"), _leaks(text, _prompts(spark, sf_dir).get("ro", [])).alias("leak"), F.lower(text).rlike("[а-яё]").alias("cyrillic"), short.alias("cut_short"),
    )


@query()
def q_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first decode is taken as it is: all seven conditions."""
    loops = segments(spark, sf_dir, "text").where("text is not null").select("meeting_id", "seg_idx", (compression_ratio("text") > COMPRESSION).alias("loops"))
    rows = q_acceptance(spark, sf_dir).join(loops, ["meeting_id", "seg_idx"])
    return rows.select("meeting_id", "seg_idx", F.expr("lexical and sure and not loops and not made_up and not leak and not cyrillic and not cut_short").alias("accepted"))


@query(f"with {SEG}, e as (select meeting_id, seg_idx, unnest(map_entries(lang_probs)) as kv from seg) select meeting_id, seg_idx, kv.key as lang from e where kv.key != 'ro' and kv.value >= 0.08")
def q_second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Further languages worth a decode."""
    return segments(spark, sf_dir, "lang_probs").select("meeting_id", "seg_idx", F.explode("lang_probs").alias("lang", "p")).where((F.col("lang") != "ro") & (F.col("p") >= SECOND_PASS)).select("meeting_id", "seg_idx", "lang")


@query(f"""with {SEG}, {_PROMPT_SQL}, t as (select seg.*, trim(text) as t, len(list_filter(string_split_regex(trim(text), '[ \\t\\n\\r]+'), lambda w: w != '')) as n, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) as ws, p.ws as pw, list_max(map_values(lang_probs)) as top from seg left join prompt p on seg.lang = p.lang)
select meeting_id, seg_idx, case when coalesce(t, '') = '' then 'empty' when {_hall('t')} and n <= 8 or regexp_matches(t, '{PHANTOM.replace("'", "''")}', 'i') then 'phantom' when lang != 'ro' and n <= 3 and ln(confidence) < -0.75 then 'weak' when {_LEAK.format('pw')} then 'leak' when 1 - top > 0.6 and ln(confidence) < -1 then 'silence' else 'kept' end as verdict from t""")
def q_drop_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: ordered rules by which segments are dropped; the first that holds is named. That no language is likely stands for the chance of no speech."""
    text = F.trim("text")
    n = F.size(F.filter(F.split(text, r"[ \t\n\r]+"), lambda w: w != ""))
    log = F.log("confidence")
    leak = F.lit(False)
    for lang, words in _prompts(spark, sf_dir).items():
        leak = leak | ((F.col("lang") == lang) & _leaks(F.col("text"), words))
    verdict = (
        F.when(F.coalesce(text, F.lit("")) == "", "empty")
        .when(made_up(text) & (n <= 8) | text.rlike(f"(?iu){PHANTOM}"), "phantom")
        .when((F.col("lang") != "ro") & (n <= 3) & (log < -0.75), "weak")
        .when(leak, "leak")
        .when((1 - F.array_max(F.map_values("lang_probs")) > 0.6) & (log < -1), "silence")
        .otherwise("kept")
    )
    return segments(spark, sf_dir, "text", "lang", "confidence", "lang_probs").select("meeting_id", "seg_idx", verdict.alias("verdict"))


@query(f"""with {SEG} select meeting_id, bool_and(length(coalesce(text, '')) / ("end" - "start") between 5 and 30) as keep, round(exp(avg(ln(confidence + 0.001))), 6) as confidence, cast(least(224, max(cast(floor(9 * ("end" - "start")) as int) + 12)) as int) as token_cap from seg where "end" > "start" group by 1""")
def q_keep_all_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording is kept only if every part's pace is plausible; mean log confidence, and the token cap of a batch."""
    rows = segments(spark, sf_dir, "start", "end", "text", "confidence").where(F.col("end") > F.col("start"))
    dur = F.col("end") - F.col("start")
    return rows.groupBy("meeting_id").agg(
        F.bool_and((F.length(F.coalesce("text", F.lit(""))) / dur).between(5, 30)).alias("keep"), F.round(F.exp(F.avg(F.log(F.col("confidence") + 0.001))), 6).alias("confidence"), F.least(F.lit(224), F.max(F.floor(9 * dur).cast("int") + 12)).cast("int").alias("token_cap")
    )


# ---- evaluation: word and character error rates


def word_edits(ref: list[str], hyp: list[str]) -> int:
    """Insertions, deletions and substitutions between two word lists: each word becomes one character, and the characters are compared."""
    signs: dict[str, str] = {}
    as_text = lambda words: "".join([signs.setdefault(w, chr(len(signs))) for w in words])
    return char_edits(as_text(ref), as_text(hyp))


def _edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        edits = [word_edits(list(r), list(h)) for r, h in zip(pdf["ref_words"], pdf["hyp_words"])]
        yield pdf.assign(edits=edits)[["meeting_id", "seg_idx", "lang", "script", "ref_n", "edits"]]


@query()
def q_word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word edits of the raw text against the corrected one, summed by language and script, digits left out.

    script 'all' has all words; 'latin' and 'cyrillic' have the words of that script only, where the corrected text has any. A segment whose
    corrected text has words of both scripts counts as 'mixed', not for the language of its label.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), 0)
    rows = segments(spark, sf_dir, "text", "raw_text", "lang").where("text is not null and raw_text is not null")
    rows = rows.select("meeting_id", "seg_idx", F.coalesce("lang", F.lit("?")).alias("lang"), words("text").alias("ref"), words("raw_text").alias("hyp"))
    cyrillic = lambda w: w.rlike("[а-яё]")
    rows = rows.withColumn("lang", F.when(F.exists("ref", cyrillic) & F.exists("ref", lambda w: ~cyrillic(w)), "mixed").otherwise(F.col("lang")))
    part = lambda script, keep: F.struct(F.lit(script).alias("script"), F.filter("ref", keep).alias("ref_words"), F.filter("hyp", keep).alias("hyp_words"))
    parts = F.array(part("all", lambda w: F.lit(True)), part("latin", lambda w: ~cyrillic(w)), part("cyrillic", cyrillic))
    rows = rows.select("meeting_id", "seg_idx", "lang", F.explode(parts).alias("p")).select("meeting_id", "seg_idx", "lang", "p.*").withColumn("ref_n", F.size("ref_words"))
    edits = rows.where("script = 'all' or ref_n > 0").mapInPandas(_edits, "meeting_id string, seg_idx long, lang string, script string, ref_n int, edits long")
    return edits.groupBy("lang", "script").agg(F.sum("edits").alias("edits"), F.sum("ref_n").alias("words"), F.round(100 * F.sum("edits") / F.nullif(F.sum("ref_n"), F.lit(0)), 4).alias("wer"))


def char_edits(ref: str, hyp: str) -> int:
    """Least number of changed, left-out and added characters between two texts, with one bit for each character of the reference."""
    same = 0
    while same < min(len(ref), len(hyp)) and ref[same] == hyp[same]:
        same += 1
    ref, hyp = ref[same:], hyp[same:]
    if not ref or not hyp:
        return len(ref) + len(hyp)
    masks: dict[str, int] = {}
    for i, ch in enumerate(ref):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full, last, edits = (1 << len(ref)) - 1, 1 << len(ref) - 1, len(ref)
    up, down = full, 0  # where the column grows by one downwards, and where it falls
    for ch in hyp:
        hit = masks.get(ch, 0)
        diagonal = ((hit & up) + up ^ up) | hit | down
        more, less = down | ~(diagonal | up) & full, up & diagonal
        edits += (more & last != 0) - (less & last != 0)
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(diagonal | more)) & full, more & diagonal & full
    return edits


def _char_edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(edits=[char_edits(a, b) for a, b in zip(pdf["a"], pdf["b"])], n=pdf["a"].str.len())[["lang", "edits", "n"]].astype({"edits": "int64", "n": "int64"})


# one sign for each letter, so that SQL's distance, which counts bytes, counts characters
_FOLDED = "translate(regexp_replace(translate(lower({0}), 'ăâîșțşţáàäéèëêíïóöôúüûçñйё', 'aaiststaaaeeeeiiooouuucnие'), '[^a-zа-я0-9 ]', '', 'g'), 'абвгдежзийклмнопрстуфхцчшщъыьэюя', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&*')"


@query(f"""with {SEG}, t as (select lang, {_FOLDED.format('text')} as a, {_FOLDED.format('raw_text')} as b from seg where lang in ('ro', 'ru', 'en') and text is not null and raw_text is not null)
select lang, cast(sum(levenshtein(a, b)) as bigint) as edits, cast(sum(length(a)) as bigint) as chars from t group by 1""")
def q_character_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character edits on accent-folded text of any length, in Romanian, Russian and English."""
    from ..functions.text import without_diacritics

    fold = lambda c: F.regexp_replace(without_diacritics(F.col(c)), "[^a-zа-я0-9 ]", "")
    rows = segments(spark, sf_dir, "text", "raw_text", "lang").where("lang in ('ro', 'ru', 'en') and text is not null and raw_text is not null")
    edits = rows.select("lang", fold("text").alias("a"), fold("raw_text").alias("b")).mapInPandas(_char_edits, "lang string, edits long, n long")
    return edits.groupBy("lang").agg(F.sum("edits").alias("edits"), F.sum("n").alias("chars"))


@query(f"""with {SEG}, n as (select meeting_id, seg_idx, unnest(list_distinct(regexp_extract_all(text, '[0-9]+'))) as num, raw_text from seg where text is not null and raw_text is not null)
select meeting_id, count(*) as numbers, count(*) filter (where regexp_matches(' ' || regexp_replace(raw_text, '[^0-9]+', ' ', 'g') || ' ', ' ' || num || ' ')) as hits from n group by 1""")
def q_number_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the corrected text that the raw text has as well."""
    rows = segments(spark, sf_dir, "text", "raw_text").where("text is not null and raw_text is not null")
    nums = rows.select("meeting_id", "raw_text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), 0))).alias("num"))
    padded = F.concat(F.lit(" "), F.regexp_replace("raw_text", "[^0-9]+", " "), F.lit(" "))
    return nums.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("numbers"), F.count_if(F.contains(padded, F.concat(F.lit(" "), "num", F.lit(" ")))).alias("hits"))


@query("select model, round(sum(seconds) / nullif(sum(maxseg), 0), 6) as real_time_factor, round(sum(seconds), 4) as seconds from exp_asr group by 1")
def q_real_time_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds spent for each second of the longest segment allowed."""
    return table(spark, sf_dir, "exp_asr").groupBy("model").agg(F.round(F.sum("seconds") / F.nullif(F.sum("maxseg"), F.lit(0.0)), 6).alias("real_time_factor"), F.round(F.sum("seconds"), 4).alias("seconds"))


# ---- vectors


@query("""with c as (select label, generate_subscripts(embedding, 1) as d, unnest(embedding) as x from embeddings), m as (select label, d, avg(cast(x as double)) as x from c group by 1, 2), n as (select label, sqrt(sum(x * x)) as n from m group by 1)
select m.label, cast(m.d - 1 as int) as dim, round(m.x / (n.n + 1e-9), 6) + 0.0 as x from m join n on m.label = n.label""")
def q_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit-length mean vector of each label."""
    return vectors.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", F.posexplode("centroid").alias("dim", "x")).select("label", "dim", (F.round("x", 6) + F.lit(0.0)).alias("x"))


@query("""with c as (select label, generate_subscripts(embedding, 1) as d, unnest(embedding) as x from embeddings), m as (select label, d, avg(cast(x as double)) as x from c group by 1, 2), n as (select label, sqrt(sum(x * x)) as n from m group by 1),
u as (select m.label, list(m.x / (n.n + 1e-9) order by m.d) as v from m join n on m.label = n.label group by 1), s as (select e.vec_id, u.label, round(list_dot_product(cast(e.embedding as double[]), u.v), 9) as s from embeddings e cross join u)
select vec_id, arg_min(label, (-s, label)) as nearest from s group by 1""")
def q_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label whose centroid is nearest, ties to the smallest label."""
    rows = table(spark, sf_dir, "embeddings")
    return vectors.nearest(rows, vectors.centroids(rows, "label", "embedding"), "vec_id", "embedding", "label", "centroid").select("vec_id", F.col("label").alias("nearest"))


@query("""with q as (select vec_id, cast(embedding as double[]) as e from embeddings where vec_id % 100 = 0), a as (select vec_id, cast(embedding as double[]) as e from embeddings),
s as (select q.vec_id as query_id, a.vec_id, round(greatest(0.0, least(1.0, list_dot_product(q.e, a.e))), 6) as sim from q cross join a where a.vec_id != q.vec_id), r as (select *, row_number() over (partition by query_id order by sim desc, vec_id) as rank from s)
select query_id, vec_id, sim, cast(rank as int) as rank from r where rank <= 5""")
def q_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar vectors of every vector whose id is divisible by 100, against all vectors, in blocks."""
    rows = table(spark, sf_dir, "embeddings")
    return vectors.top_k(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding", 5)


@query("""with s as (select a.vec_id as a, b.vec_id as b, a.label, greatest(0.0, least(1.0, round(list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])), 9))) as w from embeddings a join embeddings b on a.label = b.label and a.vec_id != b.vec_id),
k as (select * from (select *, row_number() over (partition by label, a order by w desc, b) as r from s) where r <= 3), u as (select label, a, b, w / 2 as w from k union all select label, b, a, w / 2 from k)
select label, a, b, round(sum(w), 4) as w from u group by 1, 2, 3""")
def q_knn_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: within each label the three strongest neighbours of every vector, made symmetric by halves; labels of any size go chunk by chunk."""
    return vectors.pruned_graph(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 3).withColumn("w", F.round("w", 4))


@query()
def q_spectral_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectral clustering with the number of clusters from the eigenvalue gap, small clusters absorbed.

    The embeddings name no recording, so a hundred consecutive ids stand for one.
    """
    rows = table(spark, sf_dir, "embeddings").withColumn("grp", F.floor(F.col("vec_id") / 100).cast("long"))
    return vectors.spectral(rows, "grp", "vec_id", "embedding")


QUERIES, ORACLE = query.queries, query.oracle
