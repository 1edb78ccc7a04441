"""Speaker labels: a number in any spelling, a name of a participant, or a label at the beginning of a text, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: words that announce a speaker number
_WORDS = r"(?:s|spk|speaker|vorb|vorbitor|vorbitorul|говорящий|спикер|участник)"
#: A whole speaker field that is a number in some spelling.
NUMBER = rf"(?iu)^[\s\[(<]*{_WORDS}?[\s._:#\-]*0*(\d{{1,6}})[\s\])>:.\-]*$"
_STAMP = r"(?:[\[(<]?\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?[\])>]?(?:\s*-->)?|\d{1,3}m\d{2}s|\d{1,2}h\d{2}m(?:\d{2}s)?)"
_NOISE = r"(?:\[\p{L}[\p{L} \-]*(?: \d{1,2}:\d{2})?\]|\(\p{Ll}[\p{Ll} \-]*\)|\(\(\p{L}[\p{L} \-]*\)\)|<\p{L}[\p{L} \-]*>|\{\p{L}[\p{L} \-]*\}|~\p{L}[\p{L} \-]*~|\*\p{L}[\p{L} \-]*\*|♪+)"
_LABEL = rf"(?:\[\s*{_WORDS}[\s._\-]*0*\d{{1,6}}\s*\]:?|{_WORDS}[\s._\-]*0*\d{{1,6}}\s*(?::|[\-–—](?=\s)))"
#: What may stand before a label, then the label with its number in group 1.
LEADING_LABEL = rf"(?iu)^(?:\s|{_STAMP}|{_NOISE})*(?:\[\s*{_WORDS}[\s._\-]*0*(\d{{1,6}})\s*\]:?|{_WORDS}[\s._\-]*0*(\d{{1,6}})\s*(?::|[\-–—](?=\s)))"
STAMP, NOISE, LABEL = _STAMP, _NOISE, _LABEL
_INVISIBLE = r"[\u00ad\u200b-\u200f\u2060\ufeff]"


def visible(text: Column) -> Column:
    """The text without invisible characters, with ordinary spaces and the composed Romanian letters the patterns here look for."""
    out = F.regexp_replace(text, _INVISIBLE, "")
    out = F.regexp_replace(out, r"[\u00a0\u2000-\u200a\u202f\u205f\u3000]", " ")
    for base, mark, whole in (("a", "\u0306", "ă"), ("A", "\u0306", "Ă"), ("i", "\u0302", "î"), ("I", "\u0302", "Î")):
        out = F.replace(out, F.lit(base + mark), F.lit(whole))
    return out


def name_key(name: Column) -> Column:
    """Name words in a comparable form: lower case, no diacritics, no titles, sorted."""
    low = F.translate(F.lower(visible(name)), "ăâîșşțţ", "aaisstt")
    bare = F.regexp_replace(low, r"(?u)\b(?:dr|dna|dl|doamna|domnul|mrs|mr|ms|доктор|д-р|г-жа|г-н)\b\.?", " ")
    words = F.filter(F.split(F.regexp_replace(bare, r"[^\p{L}\-]+", " "), " "), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def _number(col: Column) -> Column:
    raw = F.regexp_extract(visible(col), NUMBER, 1)
    return F.when(raw != "", F.concat(F.lit("S"), F.regexp_replace(raw, r"^0+(?=\d)", "")))


def label_in_text(text: Column) -> Column:
    """S<number> of a label at the beginning of the text, else null."""
    vis = visible(text)
    raw = F.concat(F.regexp_extract(vis, LEADING_LABEL, 1), F.regexp_extract(vis, LEADING_LABEL, 2))
    return F.when(raw != "", F.concat(F.lit("S"), F.regexp_replace(raw, r"^0+(?=\d)", "")))


def resolve_speakers(segments: DataFrame, participants: DataFrame, out: str = "speaker_id") -> DataFrame:
    """Add `out`: S<number> from the speaker column (number or participant's name), or from the text if that is null; else 'S?'.

    segments needs meeting_id, speaker and text. A name is looked up among the participants of the same meeting, by full name or, where only
    one word is given, by a word that a single speaker of the meeting bears; a name that fits several speakers stays 'S?'. Only rows whose
    speaker is neither null nor a number take part in the join.
    """
    base = segments.withColumn(out, F.when(F.col("speaker").isNull(), F.coalesce(label_in_text(F.col("text")), F.lit("S?"))).otherwise(_number(F.col("speaker"))))
    named = base.where(F.col(out).isNull()).withColumn("__key", name_key(F.col("speaker")))
    people = participants.select("meeting_id", _number(F.col("speaker")).alias("__no"), name_key(F.col("name")).alias("__key")).where("__no is not null and __key is not null and __key != ''")
    forms = people.select("meeting_id", "__no", F.explode(F.array_union(F.array("__key"), F.split("__key", " "))).alias("__key"))
    single = forms.groupBy("meeting_id", "__key").agg(F.min("__no").alias("__no"), F.max("__no").alias("__hi")).where("__no = __hi").drop("__hi")
    found = named.join(single, ["meeting_id", "__key"], "left").withColumn(out, F.coalesce(F.col("__no"), F.lit("S?"))).drop("__key", "__no")
    return base.where(F.col(out).isNotNull()).unionByName(found.select(*base.columns))
