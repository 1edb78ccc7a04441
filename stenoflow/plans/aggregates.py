"""Aggregates and set queries; each names its inventory ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import table
from .base import ACT, DEC, SEG, Registry, items, segments
from .sequences import _TS

query = Registry()


@query(f"with {SEG} select meeting_id, count(*) as segments, count(*) filter (where text is null or text = '') as without_text, count(*) filter (where list_contains(flags, 'low_confidence')) as low_confidence, count(*) filter (where len(corrections) > 0) as corrected from seg group by 1")
def q_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind for each meeting."""
    rows = segments(spark, sf_dir, "text", "flags", "corrections")
    return rows.groupBy("meeting_id").agg(
        F.count(F.lit(1)).alias("segments"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("without_text"), F.count_if(F.array_contains("flags", "low_confidence")).alias("low_confidence"), F.count_if(F.size("corrections") > 0).alias("corrected")
    )


@query(f"""with {SEG}, l as (select unnest(['ro', 'ru', 'en', 'fr']) as lang), d as (select lang, "end" - "start" as s from seg where "end" > "start") select l.lang, round(coalesce(sum(d.s), 0), 1) as seconds from l left join d on l.lang = d.lang group by 1""")
def q_seconds_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: speech by language, with a row for languages that do not occur."""
    langs = spark.createDataFrame([("ro",), ("ru",), ("en",), ("fr",)], "lang string")
    spoken = segments(spark, sf_dir, "start", "end", "lang").where(F.col("end") > F.col("start")).groupBy("lang").agg(F.sum(F.col("end") - F.col("start")).alias("s"))
    return langs.join(spoken, "lang", "left").select("lang", F.round(F.coalesce("s", F.lit(0.0)), 1).alias("seconds"))


@query(f"""with {SEG} select meeting_id, coalesce(speaker, 'S?') as speaker, round(sum("end" - "start"), 2) as seconds from seg where "end" > "start" group by 1, 2""")
def q_talk_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: speech by raw speaker."""
    rows = segments(spark, sf_dir, "start", "end", "speaker").where(F.col("end") > F.col("start"))
    return rows.groupBy("meeting_id", F.coalesce("speaker", F.lit("S?")).alias("speaker")).agg(F.round(F.sum(F.col("end") - F.col("start")), 2).alias("seconds"))


@query("""with s as (select user_id, event_type, sum(cast(round(value * 100) as bigint)) as total, min(event_id) as seen from events group by 1, 2)
select user_id, arg_min(event_type, (-total, seen)) as majority from s group by 1""")
def q_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: the type with most value for each user; of equals the one seen first."""
    each = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"), F.min("event_id").alias("seen"))
    return each.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("total"), F.col("seen"))).alias("majority"))


@query(f"""with {SEG}, f as (select meeting_id, lang, min(("start", seg_idx)) as k from seg where lang is not null group by 1, 2) select meeting_id, string_agg(lang, '/' order by k) as langs from f group by 1""")
def q_languages_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: the labels of a meeting in the order they first occur."""
    first = segments(spark, sf_dir, "start", "lang").where("lang is not null").groupBy("meeting_id", "lang").agg(F.min(F.struct("start", "seg_idx")).alias("k"))
    return first.groupBy("meeting_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "lang"))), lambda x: x["lang"]), "/").alias("langs"))


# fixed values: function words by which Romanian in Cyrillic letters is told from Russian
RO_WORDS = """de la cu pe și si din în in care ce nu da am ai are e a este sunt el ea noi voi ei ele
un o unui unei să sa mai deci acum dar sau pentru după dupa până pana ca că foarte fost face îi ii le lui ei
dânsul dansul dânsa pacientul pacienta patul azi mâine maine bine așa asa tot toate""".split()
RU_WORDS = """и в не на что я он она с это как а мы у нас есть по но вы его ее её к за то так же
бы уже или да нет был была были мне тоже там здесь все всё только вот ну если когда""".split()


@query(f"""with {SEG}, w as (select meeting_id, seg_idx, regexp_extract_all(lower(text), '[а-яё]+') as ws from seg where text is not null),
c as (select *, len(list_filter(ws, lambda x: list_contains({RO_WORDS!r}, {X.latin_of_cyrillic_sql('x')}))) as ro, len(list_filter(ws, lambda x: list_contains({RU_WORDS!r}, x))) as ru from w)
select meeting_id, seg_idx, case when len(ws) < 3 then 0.0 else round(ro / greatest(1, ro + ru), 6) end as ratio from c where len(ws) > 0""")
def q_function_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of Romanian, read in Latin letters, among the function words of Cyrillic texts; 0 under three words."""
    rows = segments(spark, sf_dir, "text").where("text is not null and lower(text) rlike '[а-яё]'")
    return rows.select("meeting_id", "seg_idx", F.round(cyrillic_romanian(F.col("text")), 6).alias("ratio"))


def cyrillic_romanian(text: Column) -> Column:
    """Romanian function words as a share of the Romanian and Russian ones among a text's Cyrillic words; 0 under three words."""
    ws = F.regexp_extract_all(F.lower(text), F.lit("[а-яё]+"), 0)
    ro, ru = F.size(F.filter(ws, lambda x: X.latin_of_cyrillic(x).isin(*RO_WORDS))), F.size(F.filter(ws, lambda x: x.isin(*RU_WORDS)))
    return F.when(F.size(ws) < 3, F.lit(0.0)).otherwise(ro / F.greatest(F.lit(1), ro + ru))


@query("""select source, doc_kind, arg_min(doc_id, (-n_chars, doc_id)) as longest, max(n_chars) as n_chars from documents group by 1, 2""")
def q_longest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest document of each source and kind, the first of equals."""
    return table(spark, sf_dir, "documents").groupBy("source", "doc_kind").agg(F.min_by("doc_id", F.struct(-F.col("n_chars"), F.col("doc_id"))).alias("longest"), F.max("n_chars").alias("n_chars"))


@query(f"with {DEC} select meeting_id, string_agg(coalesce(decision, ''), ' | ' order by part_idx, item_idx) as all_decisions from dec group by 1")
def q_ordered_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a group joined in order."""
    part = F.array_sort(F.collect_list(F.struct("part_idx", "item_idx", F.coalesce("decision", F.lit("")).alias("d"))))
    return items(spark, sf_dir, "decision").groupBy("meeting_id").agg(F.array_join(F.transform(part, lambda x: x["d"]), " | ").alias("all_decisions"))


@query(f"""
with {DEC}, {ACT}, a as (
  select meeting_id, coalesce(nullif(subject, ''), 'general') as key, coalesce({_TS}, 0) as t, part_idx * 1000000 + item_idx as ord, 0 as kind, decision as what from dec
  union all select meeting_id, coalesce(nullif(subject, ''), 'general'), coalesce({_TS}, 0), part_idx * 1000000 + item_idx, 1, task from act)
select meeting_id, key, min(t) as first_seconds, count(*) filter (where kind = 0) as decisions, count(*) filter (where kind = 1) as tasks, coalesce(string_agg(what, ' | ' order by t, ord) filter (where kind = 1), '') as plan,
  cast(row_number() over (partition by meeting_id order by case when key = 'general' then 1 else 0 end, case when key like 'patul%' then 0 else 1 end, min(t), key) as int) as place
from a group by 1, 2""")
def q_subject_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions and tasks grouped by subject: patients first, the general block last."""
    ordinal = F.col("part_idx").cast("long") * 1_000_000 + F.col("item_idx")  # part_idx is an int
    key = F.when(F.coalesce("subject", F.lit("")) == "", "general").otherwise(F.col("subject"))
    t = F.coalesce(X.seconds_of(F.col("timestamp")), F.lit(0))
    a = items(spark, sf_dir, "decision").select("meeting_id", key.alias("key"), t.alias("t"), ordinal.alias("ord"), F.lit(0).alias("kind"), F.col("decision").alias("what"))
    b = items(spark, sf_dir, "action_item").select("meeting_id", key.alias("key"), t.alias("t"), ordinal.alias("ord"), F.lit(1).alias("kind"), F.col("task").alias("what"))
    plan = F.array_sort(F.collect_list(F.when((F.col("kind") == 1) & F.col("what").isNotNull(), F.struct("t", "ord", "what"))))
    blocks = a.unionByName(b).groupBy("meeting_id", "key").agg(
        F.min("t").alias("first_seconds"), F.count_if(F.col("kind") == 0).alias("decisions"), F.count_if(F.col("kind") == 1).alias("tasks"), F.array_join(F.transform(plan, lambda x: x["what"]), " | ").alias("plan")
    )
    place = Window.partitionBy("meeting_id").orderBy(F.when(F.col("key") == "general", 1).otherwise(0), F.when(F.col("key").startswith("patul"), 0).otherwise(1), "first_seconds", "key")
    return blocks.withColumn("place", F.row_number().over(place))


@query("""
with n as (select meeting_id, speaker, name, min((part_idx, item_idx)) as k from participant where name is not null group by 1, 2, 3), r as (select meeting_id, speaker, role, min((part_idx, item_idx)) as k from participant where role is not null group by 1, 2, 3)
select p.meeting_id, p.speaker, (select arg_min(name, (k, name)) from n where n.meeting_id = p.meeting_id and n.speaker = p.speaker) as name, (select arg_min(role, (k, role)) from r where r.meeting_id = p.meeting_id and r.speaker = p.speaker) as role
from (select distinct meeting_id, speaker from participant where speaker is not null) p""")
def q_merged_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per speaker, with the first name and the first role that is not null, each for itself."""
    order = lambda c: F.struct("part_idx", "item_idx", c)
    return table(spark, sf_dir, "participant").where("speaker is not null").groupBy("meeting_id", "speaker").agg(
        F.min_by("name", F.when(F.col("name").isNotNull(), order("name"))).alias("name"), F.min_by("role", F.when(F.col("role").isNotNull(), order("role"))).alias("role")
    )


@query("select word, lang, cast(sum(count) as bigint) as n from lexicon where word is not null and length(word) > 1 group by 1, 2 having sum(count) >= 3")
def q_term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by word and language, from three on."""
    return table(spark, sf_dir, "lexicon").where("word is not null and length(word) > 1").groupBy("word", "lang").agg(F.sum("count").alias("n")).where("n >= 3")


@query("""
with w as (select lang, word, sum(count) as n from lexicon where word is not null group by 1, 2), b as (select *, translate(lower(word), 'ăâîșțşţáàäéèëêíïóöôúüûçñйё', 'aaiststaaaeeeeiiooouuucnие') as bare from w)
select lang, bare, arg_min(word, (-n, word)) as accented from b group by 1, 2""")
def q_accented_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent spelling of each unaccented word, the first in the alphabet of equals."""
    words = table(spark, sf_dir, "lexicon").where("word is not null").groupBy("lang", "word").agg(F.sum("count").alias("n"))
    return words.groupBy("lang", X.without_diacritics(F.col("word")).alias("bare")).agg(F.min_by("word", F.struct(-F.col("n"), F.col("word"))).alias("accented"))


@query("select model, count(*) as runs, round(median(wer), 6) as wer, round(quantile_cont(cer, 0.1), 6) as cer_p10, round(avg(med), 6) as med, round(avg(case when len(missing) > 0 then 1 else 0 end), 6) as with_missing from exp_asr group by 1")
def q_run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians, percentiles and shares by model."""
    return table(spark, sf_dir, "exp_asr").groupBy("model").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.percentile("wer", 0.5), 6).alias("wer"), F.round(F.percentile("cer", 0.1), 6).alias("cer_p10"), F.round(F.avg("med"), 6).alias("med"), F.round(F.avg(F.when(F.size("missing") > 0, 1).otherwise(0)), 6).alias("with_missing")
    )


@query("""
with c as (select lang, lower(word) as form, sum(count) as n from lexicon where length(word) >= 5 group by 1, 2 union all select lang, lower(word), 1000 from (select distinct lang, word from lexicon where length(word) >= 9)),
s as (select lang, form, cast(sum(n) as bigint) as n from c group by 1, 2)
select lang, translate(form, 'ăâîșțşţáàäéèëêíïóöôúüûçñйё', 'aaiststaaaeeeeiiooouuucnие') as key, arg_max(form, (n, form)) as form, cast(max(n) as bigint) as n from s where lang is not null group by 1, 2""")
def q_weighted_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two lists added up, each entry of the preferred one (words of nine letters or more) for a thousand, and the heaviest form of each key."""
    words = table(spark, sf_dir, "lexicon").where("lang is not null")
    counts = words.where("length(word) >= 5").select("lang", F.lower("word").alias("form"), F.col("count").alias("n"))
    preferred = words.where("length(word) >= 9").select("lang", "word").distinct().select("lang", F.lower("word").alias("form"), F.lit(1000).cast("long").alias("n"))
    sums = counts.unionByName(preferred).groupBy("lang", "form").agg(F.sum("n").alias("n"))
    return sums.groupBy("lang", X.without_diacritics(F.col("form")).alias("key")).agg(F.max_by("form", F.struct("n", "form")).alias("form"), F.max("n").alias("n"))


@query(r"""
with t as (select distinct unnest(missing) as term from exp_asr), h as (select run_id, ' ' || trim(regexp_replace(translate(lower(hyp), 'şţ', 'șț'), '[^\p{L}\p{N}_]+', ' ', 'g')) || ' ' as h from exp_asr where hyp is not null),
f as (select h.run_id, t.term, contains(h.h, ' ' || trim(regexp_replace(translate(lower(t.term), 'şţ', 'șț'), '[^\p{L}\p{N}_]+', ' ', 'g'))) as hit from h join t on t.term != '')
select run_id, round(avg(case when hit then 1 else 0 end), 6) as recall, coalesce(string_agg(term, ', ' order by term) filter (where not hit), '') as missed from f group by 1""")
def q_term_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of all terms that each hypothesis has, and those it has not; the terms, one row's list, are a vocabulary of bounded size."""
    plain = lambda c: F.trim(F.regexp_replace(X.comma_forms(c), r"[^\p{L}\p{N}_]+", " "))
    runs = table(spark, sf_dir, "exp_asr")
    terms = runs.select(F.explode("missing").alias("term")).where("term != ''").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    rows = runs.where("hyp is not null").select("run_id", F.concat(F.lit(" "), plain(F.col("hyp")), F.lit(" ")).alias("h")).join(F.broadcast(terms)).where("size(terms) > 0")
    missed = F.filter("terms", lambda t: ~F.contains(F.col("h"), F.concat(F.lit(" "), plain(t))))
    return rows.select("run_id", F.round(1 - F.size(missed) / F.size("terms"), 6).alias("recall"), F.array_join(missed, ", ").alias("missed"))


@query("""with f as (select event_type, date_trunc('hour', ts) as h, sqrt(avg(value * value) + 1e-12) as rms from events group by 1, 2) select event_type, round(20 * log10(quantile_cont(rms, 0.1)), 6) as floor_db from f group by 1""")
def q_noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tenth percentile of the root mean square by frame, in decibels."""
    frames = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.sqrt(F.avg(F.col("value") * F.col("value")) + 1e-12).alias("rms"))
    return frames.groupBy("event_type").agg(F.round(20 * F.log10(F.percentile("rms", 0.1)), 6).alias("floor_db"))


@query(f"""
with {DEC}, {SEG}, n as (select meeting_id, {_TS} as t, 'decision ' || cast(part_idx as varchar) || '/' || cast(item_idx as varchar) as what, 0 as kind from dec where coalesce(evidence_quote, '') = ''),
u as (select meeting_id, cast(floor("start") as int) as t, word as what, 1 as kind from (select meeting_id, "start", unnest(word_conf).word as word, unnest(word_conf).p as p, unnest(word_conf).critical as c from seg where word_conf is not null) where c and p < 0.5)
select meeting_id, coalesce(t, 0) as seconds, what, min(kind) as kind from (select * from n union all select * from u) group by 1, 2, 3""")
def q_review_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a person should look at: decisions without evidence and uncertain critical words, each time and words once."""
    a = items(spark, sf_dir, "decision").where("coalesce(evidence_quote, '') = ''").select("meeting_id", X.seconds_of(F.col("timestamp")).alias("t"), F.format_string("decision %d/%d", "part_idx", "item_idx").alias("what"), F.lit(0).alias("kind"))
    words = segments(spark, sf_dir, "start", "word_conf").select("meeting_id", F.floor("start").cast("int").alias("t"), F.explode("word_conf").alias("w")).where("w.critical and w.p < 0.5")
    both = a.unionByName(words.select("meeting_id", "t", F.col("w.word").alias("what"), F.lit(1).alias("kind")))
    return both.groupBy("meeting_id", F.coalesce("t", F.lit(0)).alias("seconds"), "what").agg(F.min("kind").alias("kind"))


@query(f"with {DEC}, {ACT} select distinct subject from (select subject from dec union all select subject from act) where subject is not null and subject != ''")
def q_subject_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct subjects of decisions and tasks, in order."""
    both = items(spark, sf_dir, "decision").select("subject").unionByName(items(spark, sf_dir, "action_item").select("subject"))
    return both.where("subject is not null and subject != ''").distinct().orderBy("subject")


@query("select word from lexicon where lang = 'ro' and word is not null except select word from lexicon where lang = 'en'")
def q_word_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Romanian words that are no English words."""
    words = table(spark, sf_dir, "lexicon").where("word is not null")
    return words.where("lang = 'ro'").select("word").distinct().join(words.where("lang = 'en'").select("word").distinct(), "word", "left_anti")


@query("select word from lexicon where lang = 'ro' intersect select word from lexicon where lang = 'en'")
def q_word_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: words that both languages have."""
    words = table(spark, sf_dir, "lexicon")
    return words.where("lang = 'ro'").select("word").intersect(words.where("lang = 'en'").select("word"))


@query("""with u as (select distinct lang, word, sum(count) over (partition by lang, word) as n from lexicon where word is not null), r as (select *, sum(length(word) + 2) over (partition by lang order by n desc, word rows unbounded preceding) as used from u)
select lang, string_agg(word, ', ' order by n desc, word) as prompt from r where used <= 380 group by 1""")
def q_budgeted_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent words of each language, as many as fit 380 characters."""
    words = table(spark, sf_dir, "lexicon").where("word is not null").groupBy("lang", "word").agg(F.sum("count").alias("n"))
    used = F.sum((F.length("word") + 2).cast("long")).over(Window.partitionBy("lang").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, 0))
    kept = words.withColumn("used", used).where("used <= 380")
    return kept.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "word"))), lambda x: x["word"]), ", ").alias("prompt"))


@query("""select distinct speaker, coalesce(try_cast(nullif(regexp_replace(speaker, '[^0-9]', '', 'g'), '') as int), 999) as place from participant where speaker is not null""")
def q_numeric_speaker_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers by their number, those without one last."""
    digits = F.regexp_replace("speaker", "[^0-9]", "")
    return table(spark, sf_dir, "participant").where("speaker is not null").select("speaker", F.coalesce(F.when(digits != "", digits.cast("int")), F.lit(999)).alias("place")).distinct().orderBy("place", "speaker")


@query()
def q_sample_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents of 100 to 20,000 characters from each source, chosen by a seeded hash.

    The five of each source and hash bucket are found first, so that no source meets in one task with more than five rows a bucket.
    """
    rows = table(spark, sf_dir, "documents").where("n_chars between 100 and 20000").select("source", "doc_id", F.xxhash64("doc_id", F.lit(42)).alias("h"))
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))
    few = rows.withColumn("n", first("source", F.pmod("h", F.lit(1024)))).where("n <= 5")
    return few.withColumn("n", first("source")).where("n <= 5").select("source", "doc_id", "n")


@query()
def q_train_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One in twenty of the documents for validation, at most 120, chosen by a seeded hash; all rows come out with their part."""
    rows = table(spark, sf_dir, "documents").select("doc_id").distinct()
    n = min(120, rows.count() // 20)
    chosen = rows.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(n).withColumn("part", F.lit("validation"))
    return rows.join(chosen, "doc_id", "left").select("doc_id", F.coalesce("part", F.lit("training")).alias("part"))


@query("select m.model, c.compute, b.beam, count(e.run_id) as runs from (select distinct model from exp_asr) m cross join (select distinct compute from exp_asr) c cross join (select distinct beam from exp_asr) b left join exp_asr e on e.model = m.model and e.compute = c.compute and e.beam = b.beam group by 1, 2, 3")
def q_settings_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of experiment settings, with its number of runs, spread out from one row of the settings' distinct values."""
    runs = table(spark, sf_dir, "exp_asr")
    grid = runs.agg(*[F.collect_set(c).alias(c) for c in ("model", "compute", "beam")])
    for c in ("model", "compute", "beam"):
        grid = grid.withColumn(c, F.explode(c))
    return grid.join(runs.groupBy("model", "compute", "beam").agg(F.count("run_id").alias("n")), ["model", "compute", "beam"], "left").select("model", "compute", "beam", F.coalesce("n", F.lit(0)).alias("runs"))


@query(f"""
with {SEG} select meeting_id, seg_idx, array_to_string(list_filter([case when confidence < 0.4 then 'low_confidence' end, case when len(corrections) > 1 then 'corrected' end, case when len(list_filter(word_conf, lambda x: x.p < 0.5)) > 0 then 'uncertain_words' end], lambda x: x is not null), ',') as marks from seg""")
def q_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags as a compact list."""
    rows = segments(spark, sf_dir, "confidence", "corrections", "word_conf")
    marks = F.array_compact(F.array(F.when(F.col("confidence") < 0.4, "low_confidence"), F.when(F.size("corrections") > 1, "corrected"), F.when(F.size(F.filter("word_conf", lambda x: x["p"] < 0.5)) > 0, "uncertain_words")))
    return rows.select("meeting_id", "seg_idx", F.array_join(marks, ",").alias("marks"))


# fixed value: wordings of a deadline that nobody named
INVENTED = "implicit|standard|nu s-a (specificat|precizat|stabilit)|nespecificat|probabil|continuu|în continuare|la nevoie|dacă e necesar|not specified|не указан"


@query(f"""
with {ACT}, j as (select distinct on (id) id, meeting_date from job order by id), d as (select a.*, j.meeting_date, coalesce(regexp_matches(deadline_text, '{INVENTED}', 'i'), false) as invented, case when regexp_matches(left(deadline_date, 10), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') then cast(try_strptime(left(deadline_date, 10), '%Y-%m-%d') as date) end as day from act a left join j on a.meeting_id = j.id)
select meeting_id, part_idx, item_idx, case when not invented then deadline_text end as deadline_text, case when not invented and day between meeting_date and meeting_date + 730 then day end as deadline from d""")
def q_valid_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines that are dates within two years of the meeting, else null; wordings that nobody named void text and date."""
    jobs = table(spark, sf_dir, "job").dropDuplicates(["id"]).select(F.col("id").alias("meeting_id"), "meeting_date")
    day = F.when(F.substring("deadline_date", 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(F.substring("deadline_date", 1, 10), "yyyy-MM-dd"))
    named = ~F.coalesce(F.col("deadline_text").rlike(f"(?iu){INVENTED}"), F.lit(False))
    rows = items(spark, sf_dir, "action_item").join(jobs, "meeting_id", "left").withColumn("day", day)
    valid = F.when(named & F.col("day").between(F.col("meeting_date"), F.date_add("meeting_date", 730)), F.col("day"))
    return rows.select("meeting_id", "part_idx", "item_idx", F.when(named, F.col("deadline_text")).alias("deadline_text"), valid.alias("deadline"))


@query(f"with {ACT}, p as (select distinct meeting_id, speaker from participant) select a.meeting_id, a.part_idx, a.item_idx, p.speaker as owner_speaker from act a left join p on a.meeting_id = p.meeting_id and a.owner_speaker = p.speaker")
def q_known_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner speakers that the meeting has, else null."""
    people = table(spark, sf_dir, "participant").select("meeting_id", "speaker").distinct()
    rows = items(spark, sf_dir, "action_item").select("meeting_id", "part_idx", "item_idx", F.col("owner_speaker").alias("o"))
    return rows.join(people.withColumn("o", F.col("speaker")), ["meeting_id", "o"], "left").select("meeting_id", "part_idx", "item_idx", F.col("speaker").alias("owner_speaker"))


QUERIES, ORACLE = query.queries, query.oracle
