"""Queries over clinical text as it is shown: abbreviations, units, alerts, labels, and the normal forms of evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clinic, numerals, text as X
from ..session import table
from .base import ACT, DEC, SEG, Registry, items, segments

query = Registry()
_LANGS = tuple(clinic.ABBREVIATIONS)


@query(f"""with {SEG}, t as (select meeting_id, seg_idx, text, case lang {' '.join(f"when '{x}' then {clinic.abbreviated_sql('text', x)}" for x in _LANGS)} end as short from seg where text is not null and lang in {_LANGS})
select meeting_id, seg_idx, short from t where short != text""")
def q_abbreviated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordered rewriting rules per language, on whole words, in any case."""
    rows = segments(spark, sf_dir, "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isin(*_LANGS))
    short = F.col("text")
    for lang in _LANGS:
        short = F.when(F.col("lang") == lang, clinic.abbreviated(F.col("text"), lang)).otherwise(short)
    return rows.select("meeting_id", "seg_idx", short.alias("short"), "text").where("short != text").drop("text")


_SPOKEN = ", ".join("bool_or(" + " or ".join(f"contains(' ' || lower(text) || ' ', '{w}')" for w in forms) + f") as u{i}" for i, (_, forms) in enumerate(clinic.UNITS))
_STRIP = ", ".join(f"t{i + 1} as (select *, case when coalesce(u{i}, false) then x{i} else {clinic.unit_sql(f'x{i}', unit)} end as x{i + 1} from t{i})" for i, (unit, _) in enumerate(clinic.UNITS))
_LAST = len(clinic.UNITS)


@query(f"""with {SEG}, {DEC}, {ACT}, said as (select meeting_id, {_SPOKEN} from seg where text is not null group by 1),
i as (select meeting_id, part_idx, item_idx, 'decision' as tab, decision as text from dec union all select meeting_id, part_idx, item_idx, 'action_item', task from act),
t0 as (select i.*, said.* exclude (meeting_id), {clinic.edged_sql('i.text')} as x0 from i left join said on i.meeting_id = said.meeting_id where i.text is not null), {_STRIP}
select meeting_id, part_idx, item_idx, tab, {clinic.plain_sql(f'x{_LAST}')} as plain from t{_LAST}""")
def q_spoken_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """units taken out of decisions and tasks where no segment of the meeting speaks of them. A segment is looked at with a space before and after it."""
    said = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    flags = [F.bool_or(F.exists(F.array(*map(F.lit, forms)), lambda w: F.contains(said, w))).alias(f"u{i}") for i, (_, forms) in enumerate(clinic.UNITS)]
    spoken = segments(spark, sf_dir, "text").where("text is not null").groupBy("meeting_id").agg(*flags)
    part = lambda tab, c: items(spark, sf_dir, tab).select("meeting_id", "part_idx", "item_idx", F.lit(tab).alias("tab"), F.col(c).alias("plain"))
    rows = part("decision", "decision").unionByName(part("action_item", "task")).where("plain is not null").join(spoken, "meeting_id", "left")
    plain = F.col("plain")
    for i, (unit, _) in enumerate(clinic.UNITS):
        plain = F.regexp_replace(plain, F.when(F.coalesce(F.col(f"u{i}"), F.lit(False)), F.lit(r"(?!)")).otherwise(F.lit(clinic.unit_pattern(unit))), F.lit(""))
    return rows.select("meeting_id", "part_idx", "item_idx", "tab", plain.alias("plain"))


@query()
def q_alert_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """where a segment speaks of doses, vasopressors, and pressures and measurements beyond their limits."""
    rows = segments(spark, sf_dir, "text").where(F.col("text").rlike("[0-9]"))
    return rows.select("meeting_id", "seg_idx", "text").mapInPandas(clinic.span_rows(["meeting_id", "seg_idx"]), "meeting_id string, seg_idx long, begin int, end int, alert string")


@query()
def q_bold_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """decisions, abbreviated in the meeting's language, in runs of plain and bold text."""
    jobs = table(spark, sf_dir, "job").dropDuplicates(["id"]).select(F.col("id").alias("meeting_id"), "output_language")
    rows = items(spark, sf_dir, "decision").where("decision is not null").select("meeting_id", "part_idx", "item_idx", "decision").join(jobs, "meeting_id", "left")
    short = F.col("decision")
    for lang in _LANGS:
        short = F.when(F.col("output_language") == lang, clinic.abbreviated(F.col("decision"), lang)).otherwise(short)
    keys = ["meeting_id", "part_idx", "item_idx"]
    return rows.select(*keys, short.alias("text")).mapInPandas(clinic.run_rows(keys), "meeting_id string, part_idx int, item_idx long, pos int, run string, bold boolean")


# fixed values: labels of subjects, in the order ro, ru, en: a patient by bed in full and short, a patient, and the general subject
LABELS = {"ro": ("Pacient — Patul ", "Patul ", "Pacient", "General"), "ru": ("Пациент — койка ", "Койка ", "Пациент", "Общее"), "en": ("Patient — Bed ", "Bed ", "Patient", "General")}
_BED_KEY = r"(?:patul|paturile|bed|койк[аеиу])\s+([0-9]{1,3})"


def _label_sql(i: int) -> str:
    return "case lang " + " ".join(f"when '{x}' then '{v[i]}'" for x, v in LABELS.items()) + f" else '{LABELS['en'][i]}' end"


@query(f"""
with {DEC}, d as (select d.*, j.output_language as lang, nullif(regexp_extract(lower(subject), '{_BED_KEY}', 1), '') as bed, trim(coalesce(subject, '')) as s from dec d left join (select distinct on (id) * from job order by id) j on d.meeting_id = j.id),
c as (select *, upper(left(s, 1)) || substring(s, 2) as short, regexp_matches(lower(s), '(pacient|patient|пациент|больн|bolnav)') as patient from d)
select meeting_id, part_idx, item_idx, case when bed is not null then {_label_sql(0)} || bed when s = '' then {_label_sql(3)} when patient and not starts_with(lower(short), lower({_label_sql(2)})) then {_label_sql(2)} || ' — ' || short else short end as label,
  case when bed is not null then {_label_sql(1)} || bed when s = '' then '' else short end as short from c""")
def q_subject_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """long and short labels of subjects in the meeting's language: a bed, nothing (general), or the subject itself, with a prefix for patients."""
    jobs = table(spark, sf_dir, "job").dropDuplicates(["id"]).select(F.col("id").alias("meeting_id"), F.col("output_language").alias("lang"))
    rows = items(spark, sf_dir, "decision").select("meeting_id", "part_idx", "item_idx", F.trim(F.coalesce("subject", F.lit(""))).alias("s")).join(jobs, "meeting_id", "left")

    def said(i: int):
        out = F.lit(LABELS["en"][i])
        for lang, v in LABELS.items():
            out = F.when(F.col("lang") == lang, v[i]).otherwise(out)
        return out

    bed = F.regexp_extract(F.lower("s"), _BED_KEY, 1)
    short = X.sentence_case(F.col("s"))
    patient = F.lower("s").rlike("(pacient|patient|пациент|больн|bolnav)") & ~F.startswith(F.lower(short), F.lower(said(2)))
    label = F.when(bed != "", F.concat(said(0), bed)).when(F.col("s") == "", said(3)).when(patient, F.concat(said(2), F.lit(" — "), short)).otherwise(short)
    return rows.select("meeting_id", "part_idx", "item_idx", label.alias("label"), F.when(bed != "", F.concat(said(1), bed)).when(F.col("s") == "", "").otherwise(short).alias("short"))


@query(rf"""with {SEG}, n as (select meeting_id, seg_idx, replace(translate(lower(text), 'şţ', 'șț'), '-', ' ') as t from seg where text is not null)
select meeting_id, seg_idx, trim(regexp_replace(regexp_replace(t, '[^\p{{L}}\p{{M}}\p{{N}}_ \t\n\r]', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) as normal from n""")
def q_normal_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11, first form: small letters, comma letters, no hyphens and no punctuation."""
    rows = segments(spark, sf_dir, "text").where("text is not null")
    bare = F.regexp_replace(F.replace(X.comma_forms(F.col("text")), F.lit("-"), F.lit(" ")), r"[^\p{L}\p{M}\p{N}_ \t\n\r]", " ")
    return rows.select("meeting_id", "seg_idx", F.trim(F.regexp_replace(bare, r"[ \t\n\r]+", " ")).alias("normal"))


@query()
def q_normal_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11, second form: numerals in digits, brackets out, decimal signs as a word, no hyphens and no punctuation."""
    rows = segments(spark, sf_dir, "text").where("text is not null").select("meeting_id", "seg_idx", numerals.numerals_to_digits(X.comma_forms(F.col("text"))).alias("t"))
    t = F.regexp_replace("t", r"\[[^\]]*\]", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"([0-9])[.,]([0-9])", "$1 virgulă $2"), "[-–]", " ")
    return rows.select("meeting_id", "seg_idx", F.trim(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{M}\p{N}_ \t\n\r]", " "), r"[ \t\n\r]+", " ")).alias("normal"))


# fixed values: sentences with places for values, and values
TEMPLATES = ("pacientul de pe patul {n} primește {drug} de mâine dimineață", "am scăzut doza de {drug} la {d}", "se menține {diso}, continuăm {drug}")
FILLERS = {"n": ("unu", "doi", "trei", "patru", "cinci"), "d": ("zero virgulă zero opt", "jumătate", "o sută cincizeci", "cinci miligrame")}


@query(f"""
with t as (select unnest({list(TEMPLATES)!r}) as t), n as (select unnest({list(FILLERS['n'])!r}) as n), d as (select unnest({list(FILLERS['d'])!r}) as d), w as (select distinct word from lexicon where lang = 'ro' and length(word) >= 9), x as (select distinct word as diso from lexicon where lang = 'ro' and length(word) = 8)
select distinct replace(replace(replace(replace(t, '{{n}}', n), '{{d}}', d), '{{drug}}', word), '{{diso}}', diso) as sentence from t, n, d, w, x""")
def q_template_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sentences from templates, with every value of the lists each of their places takes; a place that a template lacks multiplies nothing."""
    words = table(spark, sf_dir, "lexicon").where("lang = 'ro'").select("word").distinct()
    lists = words.agg(F.array_sort(F.collect_set(F.when(F.length("word") >= 9, F.col("word")))).alias("drug"), F.array_sort(F.collect_set(F.when(F.length("word") == 8, F.col("word")))).alias("diso"))
    rows = lists.withColumn("sentence", F.explode(F.array(*map(F.lit, TEMPLATES))))
    for place in ("n", "d", "drug", "diso"):
        values = F.array(*map(F.lit, FILLERS[place])) if place in FILLERS else F.col(place)
        slot = F.lit("{" + place + "}")
        rows = rows.withColumn("v", F.explode(F.when(F.contains(F.col("sentence"), slot), values).otherwise(F.array(F.lit(""))))).withColumn("sentence", F.replace("sentence", slot, F.col("v")))
    return rows.select("sentence").distinct()


QUERIES, ORACLE = query.queries, query.oracle
