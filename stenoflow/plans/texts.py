"""Text function queries; each names its inventory ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numerals, speech, text as X
from ..session import table
from .base import ACT, DEC, SEG, Registry, items, segments

query = Registry()


@query("select distinct word, translate(lower(word), 'şţ', 'șț') as comma, translate(lower(word), 'ăâîșțşţáàäéèëêíïóöôúüûçñйё', 'aaiststaaaeeeeiiooouuucnие') as bare from lexicon where word is not null")
def q_word_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """comma letters and diacritic folding of the lexicon's words."""
    return table(spark, sf_dir, "lexicon").where("word is not null").select("word", X.comma_forms(F.col("word")).alias("comma"), X.without_diacritics(F.col("word")).alias("bare")).distinct()


_KEY = "lower(word)"
for _a, _b in X.PHONETIC_RULES:
    _KEY = f"regexp_replace({_KEY}, '{_a}', '{_b}', 'g')"


@query(f"select distinct word, {_KEY} as sound from lexicon where lang = 'ro' and word is not null")
def q_phonetic_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the rules of the phonetic key, before runs of a letter are collapsed."""
    return table(spark, sf_dir, "lexicon").where("lang = 'ro' and word is not null").select("word", X.phonetic_key(F.col("word"), collapse=False).alias("sound")).distinct()


@query()
def q_phonetic_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of one sound, with the most frequent of them, the first in the alphabet of equals."""
    words = table(spark, sf_dir, "lexicon").where("lang = 'ro' and word is not null").groupBy(F.lower("word").alias("word")).agg(F.sum("count").alias("n"))
    return words.groupBy(X.phonetic_key(F.col("word")).alias("sound")).agg(F.min_by("word", F.struct(-F.col("n"), F.col("word"))).alias("canonical"), F.count(F.lit(1)).alias("forms"))


@query(f"select distinct word, {X.latin_of_cyrillic_sql('lower(word)')} as latin from lexicon where lang = 'ru' and word is not null")
def q_transliterated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cyrillic words in Latin letters."""
    return table(spark, sf_dir, "lexicon").where("lang = 'ru' and word is not null").select("word", X.latin_of_cyrillic(F.col("word")).alias("latin")).distinct()


@query(f"with {SEG}, w as (select unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) as word from seg where text is not null) select word, count(*) as n from w group by word having count(*) >= 2")
def q_word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by number of occurrences, from two on."""
    words = segments(spark, sf_dir, "text").select(F.explode(X.words(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query()
def q_compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how well each text compresses; loops of speech recognition compress far too well."""
    return segments(spark, sf_dir, "text").where("text is not null").select("meeting_id", "seg_idx", speech.compression_ratio("text").alias("ratio"))


@query()
def q_repeats_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and syllables said over and over, kept twice."""
    rows = segments(spark, sf_dir, "text").where("text is not null")
    return rows.select("meeting_id", "seg_idx", speech.collapsed("text").alias("short"), "text").where("short != array_join(filter(split(text, '\\\\s+'), w -> w != ''), ' ')").drop("text")


@query()
def q_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Romanian numerals in digits, where a text has any."""
    has = F.lower("text").rlike(r"(?U)\b(?:" + "|".join(numerals.PROPER) + r")\b")
    return segments(spark, sf_dir, "text", "lang").where(has).select("meeting_id", "seg_idx", numerals.numerals_to_digits("text").alias("digits"))


@query()
def q_word_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word probabilities carried over to the corrected text."""
    rows = segments(spark, sf_dir, "text", "word_conf").where("word_conf is not null and text is not null")
    raw = F.transform("word_conf", lambda x: F.struct(x["word"].alias("word"), x["p"].alias("p")))
    return rows.select("meeting_id", "seg_idx", F.posexplode(speech.aligned(raw, "text")).alias("pos", "x")).select("meeting_id", "seg_idx", "pos", "x.word", "x.p")


@query(f"with {SEG} select meeting_id, seg_idx, upper(substring(text, 1, 1)) || substring(text, 2) as cased from seg where text is not null")
def q_sentence_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first letter of each text in capitals."""
    return segments(spark, sf_dir, "text").where("text is not null").select("meeting_id", "seg_idx", X.sentence_case(F.col("text")).alias("cased"))


@query("""
with w as (select distinct lang, word from lexicon where length(word) >= 3), p as (select a.lang, a.word, b.word as b from w a join w b on a.lang = b.lang and left(a.word, 3) = left(b.word, 3) and a.word != b.word),
n as (select lang, word, b, unnest(generate_series(3, least(length(word), length(b)))) as i from p)
select lang, word, cast(max(case when left(word, i) = left(b, i) then i end) as int) as prefix from n group by 1, 2""")
def q_common_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: the longest prefix, of three letters or more, that each word shares with another word of its language.

    In the order of the alphabet the word that shares most is a neighbour, so each word meets two others and not all of its group.
    """
    words = table(spark, sf_dir, "lexicon").where("length(word) >= 3").select("lang", "word", F.left("word", F.lit(3)).alias("k")).distinct()
    near = Window.partitionBy("lang", "k").orderBy("word")
    same = lambda other: F.coalesce(F.array_max(F.filter(F.sequence(F.lit(3), F.least(F.length("word"), F.length(other))), lambda i: F.col("word").substr(F.lit(1), i) == F.col(other).substr(F.lit(1), i))), F.lit(0))
    rows = words.where("lang is not null").withColumn("a", F.lag("word").over(near)).withColumn("b", F.lead("word").over(near))
    return rows.where("a is not null or b is not null").select("lang", "word", F.greatest(same("a"), same("b")).cast("int").alias("prefix"))


@query(f"with {SEG}, b as (select meeting_id, seg_idx, try_cast(nullif(regexp_extract(text, '(?i)(?:patul|paturile|bed|койк[аеиу])\\s+([0-9]{{1,3}})', 1), '') as int) as bed from seg) select * from b where bed is not null")
def q_bed_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first bed each segment speaks of."""
    return segments(spark, sf_dir, "text").select("meeting_id", "seg_idx", X.bed_number(F.col("text")).alias("bed")).where("bed is not null")


@query(f"with {SEG}, b as (select meeting_id, unnest(regexp_extract_all(text, '(?i)(?:patul|paturile|bed|койк[аеиу])\\s+([0-9]{{1,3}})', 1)) as bed from seg where text is not null) select meeting_id, bed, count(*) as mentions from b group by 1, 2")
def q_all_bed_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every bed mention, counted by meeting."""
    each = segments(spark, sf_dir, "text").select("meeting_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?iu)(?:patul|paturile|bed|койк[аеиу])\s+(\d{1,3})"), 1)).alias("bed"))
    return each.groupBy("meeting_id", "bed").agg(F.count(F.lit(1)).alias("mentions"))


@query(f"with {DEC} select meeting_id, part_idx, item_idx, case when regexp_matches(lower(subject), '^(?:patul|bed|койка)\\s+[0-9]+$') then 'patient' when subject is null or subject = '' then 'general' else 'theme' end as kind from dec")
def q_subject_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: whether an item's subject is a patient, a theme or nothing."""
    kind = F.when(F.lower("subject").rlike(r"^(?:patul|bed|койка)\s+\d+$"), "patient").when(F.col("subject").isNull() | (F.col("subject") == ""), "general").otherwise("theme")
    return items(spark, sf_dir, "decision").select("meeting_id", "part_idx", "item_idx", kind.alias("kind"))


@query(f"""with {DEC} select meeting_id, part_idx, item_idx, case when decision is null or decision = '' then '—' else replace(replace(replace(replace(replace(decision, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') end as html, base64(encode(coalesce(rationale, ''))) as b64 from dec""")
def q_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """markup escaped, and base64."""
    return items(spark, sf_dir, "decision").select("meeting_id", "part_idx", "item_idx", X.html_escape(F.col("decision")).alias("html"), F.regexp_replace(F.base64(F.encode(F.coalesce("rationale", F.lit("")), "UTF-8")), r"\s", "").alias("b64"))


@query(f"with {ACT} select meeting_id, part_idx, item_idx, regexp_replace(lower(coalesce(subject, '')), '^(?:patul|pacientul din patul|bed|койка)\\s+', '') as bare from act")
def q_subject_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subjects without their prefix."""
    return items(spark, sf_dir, "action_item").select("meeting_id", "part_idx", "item_idx", F.regexp_replace(F.lower(F.coalesce("subject", F.lit(""))), r"^(?:patul|pacientul din patul|bed|койка)\s+", "").alias("bare"))


@query(f"""
with {SEG}, c as (select meeting_id, seg_idx, raw_text, corrections[1]."from" as a, corrections[1]."to" as b from seg where len(corrections) > 0 and raw_text is not null)
select meeting_id, seg_idx, case when a != '' and instr(raw_text, a) > 0 then left(raw_text, instr(raw_text, a) - 1) || b || substring(raw_text, instr(raw_text, a) + length(a)) else raw_text end as fixed from c""")
def q_first_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first correction applied to its first occurrence only."""
    rows = segments(spark, sf_dir, "raw_text", "corrections").where("size(corrections) > 0 and raw_text is not null").withColumn("c", F.element_at("corrections", 1))
    fixed = F.when(F.col("c.from") != "", X.replace_first(F.col("raw_text"), F.col("c.from"), F.col("c.to"))).otherwise(F.col("raw_text"))
    return rows.select("meeting_id", "seg_idx", fixed.alias("fixed"))


@query(f"""with {SEG} select meeting_id, seg_idx, printf('%02d:%02d:%02d', cast(floor("start") as bigint) // 3600, cast(floor("start") as bigint) % 3600 // 60, cast(floor("start") as bigint) % 60) as stamp from seg where "start" is not null""")
def q_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seconds as hh:mm:ss."""
    return segments(spark, sf_dir, "start").where("start is not null").select("meeting_id", "seg_idx", X.clock(F.col("start")).alias("stamp"))


@query(f"""
with {ACT}, d as (select a.*, try_strptime(left(deadline_date, 10), '%Y-%m-%d') as day, j.output_language as lang from act a left join (select distinct on (id) * from job order by id) j on a.meeting_id = j.id)
select meeting_id, part_idx, item_idx, case when day is not null and regexp_matches(left(deadline_date, 10), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') and lang in ('ro', 'ru') then strftime(day, '%d.%m.%Y') else deadline_date end as shown,
  case when day is not null and regexp_matches(left(deadline_date, 10), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') then ['luni', 'marți', 'miercuri', 'joi', 'vineri', 'sâmbătă', 'duminică'][isodow(day)] end as weekday from d""")
def q_dates_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines in the output language's date format, with the weekday."""
    jobs = table(spark, sf_dir, "job").dropDuplicates(["id"]).select(F.col("id").alias("meeting_id"), F.col("output_language").alias("lang"))
    rows = items(spark, sf_dir, "action_item").join(jobs, "meeting_id", "left")
    exact = F.substring("deadline_date", 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$")
    day = F.when(exact, F.try_to_date(F.substring("deadline_date", 1, 10), "yyyy-MM-dd"))
    names = F.array(*[F.lit(x) for x in ("luni", "marți", "miercuri", "joi", "vineri", "sâmbătă", "duminică")])
    shown = F.when(day.isNotNull() & F.col("lang").isin("ro", "ru"), F.date_format(day, "dd.MM.yyyy")).otherwise(F.col("deadline_date"))
    return rows.select("meeting_id", "part_idx", "item_idx", shown.alias("shown"), F.when(day.isNotNull(), F.element_at(names, F.weekday(day) + 1)).alias("weekday"))


@query(f"""
with {ACT} select meeting_id, part_idx, item_idx, case when coalesce(deadline_date, '') = '' then coalesce(nullif(deadline_text, ''), '-') when coalesce(deadline_text, '') = '' or instr(deadline_date, deadline_text) > 0 then deadline_date else deadline_date || ' (' || deadline_text || ')' end as deadline,
  case when coalesce(owner, '') != '' and coalesce(owner_speaker, '') != '' then owner || ' (' || owner_speaker || ')' when coalesce(owner, '') != '' then owner when coalesce(owner_speaker, '') != '' then owner_speaker else '-' end as who from act""")
def q_task_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how deadline and owner of a task are shown."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    deadline = F.when(~has("deadline_date"), F.when(has("deadline_text"), F.col("deadline_text")).otherwise("-")).when(~has("deadline_text") | (F.instr("deadline_date", F.col("deadline_text")) > 0), F.col("deadline_date")).otherwise(F.concat("deadline_date", F.lit(" ("), "deadline_text", F.lit(")")))
    who = F.when(has("owner") & has("owner_speaker"), F.concat("owner", F.lit(" ("), "owner_speaker", F.lit(")"))).when(has("owner"), F.col("owner")).when(has("owner_speaker"), F.col("owner_speaker")).otherwise("-")
    return items(spark, sf_dir, "action_item").select("meeting_id", "part_idx", "item_idx", deadline.alias("deadline"), who.alias("who"))


@query(f"""
with {SEG}, p as (select meeting_id, seg_idx, unnest(map_entries(lang_probs)) as kv from seg), a as (select meeting_id, seg_idx, kv.key as lang, kv.value as p from p where kv.key in ('ro', 'ru')),
z as (select meeting_id, seg_idx, sum(p) as z from a group by 1, 2)
select a.meeting_id, a.seg_idx, a.lang, round(a.p / case when z = 0 then 1 else z end, 6) as p from a join z using (meeting_id, seg_idx)""")
def q_renormalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """language probabilities over the allowed languages only, adding up to one."""
    rows = segments(spark, sf_dir, "lang_probs").withColumn("m", F.map_filter("lang_probs", lambda k, v: k.isin("ro", "ru")))
    total = F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, x: a + x)
    new = F.transform_values("m", lambda k, v: F.round(v / F.when(total == 0, F.lit(1.0)).otherwise(total), 6))
    return rows.select("meeting_id", "seg_idx", F.explode(new).alias("lang", "p"))


@query(f"with {SEG} select meeting_id, seg_idx, regexp_matches(lower(text), '[а-яё]') as cyrillic, regexp_matches(text, '[0-9]') as digits from seg where text is not null")
def q_script_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """which scripts and digits a text has."""
    return segments(spark, sf_dir, "text").where("text is not null").select("meeting_id", "seg_idx", F.lower("text").rlike("[а-яё]").alias("cyrillic"), F.col("text").rlike("[0-9]").alias("digits"))


@query("select id, coalesce(meeting_type, 'general') || ' - ' || coalesce(strftime(meeting_date, '%d.%m.%Y'), '?') || ' - ' || coalesce(source_name, '') as subject_line from job")
def q_subject_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one line that names a job."""
    return table(spark, sf_dir, "job").select("id", F.concat_ws(" - ", F.coalesce("meeting_type", F.lit("general")), F.coalesce(F.date_format("meeting_date", "dd.MM.yyyy"), F.lit("?")), F.coalesce("source_name", F.lit(""))).alias("subject_line"))


@query(f"""
with {SEG}, r as (select run_id, hyp, prompt from exp_asr where hyp is not null and prompt is not null),
t as (select run_id, list_distinct(regexp_extract_all(lower(hyp), '[\\p{{L}}0-9_]+')) as a, list_distinct(regexp_extract_all(lower(prompt), '[\\p{{L}}0-9_]+')) as b from r)
select run_id, len(a) >= 2 and len(list_intersect(a, b)) / len(a) > 0.7 as leak from t""")
def q_prompt_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a hypothesis mostly repeats the words of its prompt."""
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}0-9_]+"), 0))
    rows = table(spark, sf_dir, "exp_asr").where("hyp is not null and prompt is not null").select("run_id", tokens("hyp").alias("a"), tokens("prompt").alias("b"))
    share = F.size(F.array_intersect("a", "b")) / F.when(F.size("a") > 0, F.size("a"))
    return rows.select("run_id", ((F.size("a") >= 2) & F.coalesce(share > 0.7, F.lit(False))).alias("leak"))


QUERIES, ORACLE = query.queries, query.oracle
