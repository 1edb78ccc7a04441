"""Queries of problem 5: continuous periods of speech per speaker of a meeting, and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.speakers import resolve_speakers
from ..operators.periods import periods_and_gaps
from ..session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "segment").select("meeting_id", "speaker", "text", "start", "end").where(F.col("end") > F.col("start"))
    rows = resolve_speakers(segments, table(spark, sf_dir, "participant")).where("speaker_id != 'S?'")
    rows = rows.select("meeting_id", F.col("speaker_id").alias("speaker"), F.round(F.col("start") * 100).cast("long").alias("begin_cs"), F.round(F.col("end") * 100).cast("long").alias("end_cs"))
    out = periods_and_gaps(rows, ["meeting_id", "speaker"])
    return out.select("kind", "meeting_id", "speaker", "begin_cs", "end_cs")


def p5_speaking_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of speech and of pauses, and the number of each, per speaker of a meeting."""
    each = p5_found(spark, sf_dir).withColumn("cs", F.col("end_cs") - F.col("begin_cs"))
    return each.groupBy("meeting_id", "speaker").agg(
        F.count_if(F.col("kind") == "period").alias("periods"),
        F.count_if(F.col("kind") == "gap").alias("gaps"),
        F.coalesce(F.sum(F.when(F.col("kind") == "period", F.col("cs"))), F.lit(0)).alias("speech_cs"),
        F.coalesce(F.sum(F.when(F.col("kind") == "gap", F.col("cs"))), F.lit(0)).alias("pause_cs"),
    )


QUERIES = {"p5_found": p5_found, "p5_speaking_time": p5_speaking_time}

_FOUND = r"""
with vis as (
  select meeting_id, speaker, "start" as s, "end" as e,
    replace(replace(replace(replace(regexp_replace(regexp_replace(text, '[\x{00ad}\x{200b}-\x{200f}\x{2060}\x{feff}]', '', 'g'), '[\x{00a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]', ' ', 'g'), 'a' || chr(774), 'ă'), 'A' || chr(774), 'Ă'), 'i' || chr(770), 'î'), 'I' || chr(770), 'Î') as t,
    regexp_replace(regexp_replace(speaker, '[\x{00ad}\x{200b}-\x{200f}\x{2060}\x{feff}]', '', 'g'), '[\x{00a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]', ' ', 'g') as sp
  from segment where "end" is not null and "end" > "start"),
num as (
  select *, regexp_extract(sp, '(?i)^[\s\[(<]*(?:s|spk|speaker|vorb|vorbitor|vorbitorul|говорящий|спикер|участник)?[\s._:#\-]*0*([0-9]{1,6})[\s\])>:.\-]*$', 1) as n,
    regexp_extract(t, '(?i)^(?:\s|(?:[\[(<]?[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?:[.,][0-9]{1,3})?[\])>]?(?:\s*-->)?|[0-9]{1,3}m[0-9]{2}s)|\[\p{L}[\p{L} \-]*(?: [0-9]{1,2}:[0-9]{2})?\]|\(\p{L}[\p{L} \-]*\)|\(\(\p{L}[\p{L} \-]*\)\)|<\p{L}[\p{L} \-]*>|\{\p{L}[\p{L} \-]*\}|~\p{L}[\p{L} \-]*~|\*\p{L}[\p{L} \-]*\*|♪+)*\[?\s*(?:s|spk|speaker|vorb|vorbitor|vorbitorul|говорящий|спикер|участник)[\s._\-]*0*([0-9]{1,6})\s*(?:\]:?|:|[\-–—]\s)', 1) as l
  from vis),
keyed as (
  select *, list_aggregate(list_sort(list_filter(string_split_regex(regexp_replace(regexp_replace(translate(lower(sp), 'ăâîșşțţ', 'aaisstt'), '\b(?:dr|dna|dl|doamna|domnul|mrs|mr|ms)\b\.?', ' ', 'g'), '[^\p{L}\-]+', ' ', 'g'), ' +'), lambda w: w != '')), 'string_agg', ' ') as k
  from num),
people as (
  select meeting_id, 'S' || ltrim(regexp_extract(speaker, '(?i)^[\s\[(<]*(?:s|spk|speaker|vorb|vorbitor|говорящий)?[\s._:#\-]*0*([0-9]{1,6})[\s\])>:.\-]*$', 1), '0') as no,
    list_sort(string_split(translate(lower(name), 'ăâîșşțţ', 'aaisstt'), ' ')) as ws
  from participant where name is not null),
forms as (
  select meeting_id, no, unnest(list_append(ws, list_aggregate(ws, 'string_agg', ' '))) as k from people where no != 'S'),
single as (select meeting_id, k, min(no) as no from forms group by 1, 2 having min(no) = max(no)),
who as (
  select distinct a.meeting_id, case when speaker is null then case when l != '' then 'S' || l end when n != '' then 'S' || n else single.no end as speaker,
    cast(round(s * 100) as bigint) as b, cast(round(e * 100) as bigint) as e
  from keyed a left join single on a.meeting_id = single.meeting_id and a.k = single.k),
marked as (
  select *, max(e) over (partition by meeting_id, speaker order by b, e rows between unbounded preceding and 1 preceding) as before from who where speaker is not null),
island as (
  select *, sum(case when before is null or b > before then 1 else 0 end) over (partition by meeting_id, speaker order by b, e rows unbounded preceding) as i from marked),
period as (select meeting_id, speaker, i, min(b) as b, max(e) as e from island group by 1, 2, 3),
gap as (select meeting_id, speaker, e as b, lead(b) over (partition by meeting_id, speaker order by i) as e from period)
select 'period' as kind, meeting_id, speaker, b as begin_cs, e as end_cs from period
union all select 'gap', meeting_id, speaker, b, e from gap where e is not null
"""

ORACLE = {
    "p5_found": _FOUND,
    "p5_speaking_time": f"""
select meeting_id, speaker, count(*) filter (where kind = 'period') as periods, count(*) filter (where kind = 'gap') as gaps,
  cast(coalesce(sum(end_cs - begin_cs) filter (where kind = 'period'), 0) as bigint) as speech_cs,
  cast(coalesce(sum(end_cs - begin_cs) filter (where kind = 'gap'), 0) as bigint) as pause_cs
from ({_FOUND}) group by 1, 2""",
}
