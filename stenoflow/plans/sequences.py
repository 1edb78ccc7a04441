"""Sequence and as-of queries; each names its inventory ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import bed_number, seconds_of
from ..operators import folds
from ..operators.asof import asof_backward, islands
from ..operators.blocks import blocked, neighbours, ranked, running
from ..session import cut, table
from .base import ACT, DEC, SEG, Registry, items, segments

query = Registry()
_BY, _ORDER = ["meeting_id"], ["start", "seg_idx"]


@query("""
with e as (select user_id, event_type, ts, event_id, last_value(case when event_type = 'purchase' then ts end ignore nulls) over (partition by user_id order by ts, case when event_type = 'purchase' then 0 else 1 end, event_id rows unbounded preceding) as p from events)
select user_id, count(p) as errors_after_purchase, max(p) as last_purchase from e where event_type = 'error' group by user_id""")
def q_asof_last_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 on events: for each error the user's latest purchase at or before it, counted by user."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    left = events.where("event_type = 'error'").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    right = events.where("event_type = 'purchase'").withColumn("p", F.unix_micros(F.col("ts").cast("timestamp"))).select("user_id", "p", F.col("ts").alias("bought"))
    hit = asof_backward(left, right, ["user_id"], "t", "p", ["bought"])
    return hit.groupBy("user_id").agg(F.count("bought").alias("errors_after_purchase"), F.max("bought").alias("last_purchase"))


@query(f"""
with {SEG}, {DEC},
bed as (select meeting_id, "start" as ts, seg_idx, try_cast(nullif(regexp_extract(text, '(?i)(?:patul|paturile|bed|койк[аеиу])\\s+([0-9]{{1,3}})', 1), '') as int) as bed from seg),
d as (select *, case when regexp_extract("timestamp", '([0-9]{{1,2}}):([0-9]{{2}}):([0-9]{{2}})') != '' then cast(string_split("timestamp", ':')[1] as int) * 3600 + cast(string_split("timestamp", ':')[2] as int) * 60 + cast(string_split("timestamp", ':')[3] as int)
  when regexp_extract("timestamp", '([0-9]{{1,2}}):([0-9]{{2}})') != '' then cast(string_split("timestamp", ':')[1] as int) * 60 + cast(string_split("timestamp", ':')[2] as int) end as t from dec)
select meeting_id, part_idx, item_idx, (select max_by(b.bed, (b.ts, b.seg_idx)) from bed b where b.meeting_id = d.meeting_id and b.bed is not null and b.ts <= d.t + 1) as bed from d where t is not null""")
def q_asof_bed_of_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bed spoken of last at the time of a decision, one second ahead allowed."""
    beds = segments(spark, sf_dir, "start", "text").select("meeting_id", "start", "seg_idx", bed_number(F.col("text")).alias("bed")).where("bed is not null")
    left = items(spark, sf_dir, "decision").select("meeting_id", "part_idx", "item_idx", seconds_of(F.col("timestamp")).alias("t")).where("t is not null")
    return asof_backward(left, beds, ["meeting_id"], "t", "start", ["bed"], ahead=1.0, tie=["seg_idx"]).select("meeting_id", "part_idx", "item_idx", "bed")


@query("""
with s as (select user_id, event_id, ts, event_type from events),
hit as (select e.user_id, e.event_id, max_by(p.event_id, (p.ts, p.event_id)) as p, max(p.ts) as pts from s e left join s p on p.user_id = e.user_id and p.event_type = 'login' and epoch_us(p.ts) <= epoch_us(e.ts) + 5000000 where e.event_type = 'error' group by 1, 2)
select h.event_id, case when epoch_us(e.ts) - epoch_us(h.pts) <= 86400000000 then h.p end as login_id from hit h join events e on h.event_id = e.event_id""")
def q_asof_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest login up to 5 seconds after an error, unless it is more than a day back."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id")
    right = events.where("event_type = 'login'").select("user_id", F.col("t").alias("lt"), F.col("event_id").alias("login_id"))
    return asof_backward(events.where("event_type = 'error'"), right, ["user_id"], "t", "lt", ["login_id"], tolerance=86_400e6, ahead=5e6, tie=["login_id"]).select("event_id", "login_id")


@query(f"""
with {SEG}, r as (select *, coalesce(speaker, 'S?') as who from seg where "end" is not null),
m as (select *, case when lag(who) over w = who and "start" - lag("end") over w <= 2.0 then 0 else 1 end as b from r window w as (partition by meeting_id order by "start", seg_idx)),
i as (select *, sum(b) over (partition by meeting_id order by "start", seg_idx rows unbounded preceding) as turn from m)
select meeting_id, cast(turn as bigint) as turn, min(who) as speaker, min("start") as turn_start, max("end") as turn_end, count(*) as segments, min(seg_idx) as first_seg from i group by 1, 2""")
def q_turns_by_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 without a cap: runs of one raw speaker with pauses of at most two seconds."""
    rows = segments(spark, sf_dir, "start", "end", "speaker").where(F.col("end").isNotNull()).withColumn("who", F.coalesce("speaker", F.lit("S?")))
    rows, hot = blocked(rows, _BY, "start")
    near = neighbours(rows, _BY, _ORDER, lag={"before": "who", "ended": "end"}, hot=hot)
    runs = islands(near, _BY, _ORDER, ~((F.col("before") == F.col("who")) & (F.col("start") - F.col("ended") <= 2.0)), "turn", hot)
    return runs.groupBy("meeting_id", "turn").agg(F.min("who").alias("speaker"), F.min("start").alias("turn_start"), F.max("end").alias("turn_end"), F.count(F.lit(1)).alias("segments"), F.min("seg_idx").alias("first_seg"))


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir, "start", "end", "speaker", "text", "lang").where(F.col("end").isNotNull())


@query(f"""
with recursive {SEG}, o as (select *, row_number() over (partition by meeting_id order by "start", seg_idx) as n from seg where "end" is not null),
f as (select meeting_id, n, 0 as turn, coalesce(nullif(speaker, ''), 'S?') as who, "start" as s, "end" as e, seg_idx as first_seg, seg_idx as last_seg, 1 as segments, length(coalesce(text, '')) as chars, [lang] as langs from o where n = 1
  union all select o.meeting_id, o.n, case when k then f.turn else f.turn + 1 end, case when k then f.who else me end, case when k then f.s else o."start" end, o."end", case when k then f.first_seg else o.seg_idx end, o.seg_idx,
    case when k then f.segments + 1 else 1 end, case when k then f.chars + 1 else 0 end + length(coalesce(o.text, '')), case when not k then [o.lang] when len(list_filter(f.langs, lambda x: x is not distinct from o.lang)) > 0 then f.langs else list_append(f.langs, o.lang) end
    from f join (select *, coalesce(nullif(speaker, ''), 'S?') as me from o) o on f.meeting_id = o.meeting_id and o.n = f.n + 1, lateral (select coalesce(f.who = me and o."start" - f.e <= 2.0 and f.e - f.s < 90.0, false) as k))
select meeting_id, cast(turn as bigint) as turn, arg_max(who, n) as speaker, arg_max(s, n) as turn_start, arg_max(e, n) as turn_end, arg_max(first_seg, n) as first_seg, arg_max(last_seg, n) as last_seg, cast(max(segments) as bigint) as segments, cast(arg_max(chars, n) as bigint) as chars,
  arg_max(array_to_string(list_transform(langs, lambda x: coalesce(x, '')), '/'), n) as langs from f group by 1, 2""")
def q_turns_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that stop growing after 90 seconds. The cap depends on where the turn began, so rows are folded in order."""
    schema = "meeting_id string, turn long, speaker string, turn_start double, turn_end double, first_seg long, last_seg long, segments long, chars long, langs string"
    return folds.fold(_timed(spark, sf_dir), ["meeting_id"], [F.col("start"), F.col("seg_idx")], folds.CappedTurns, schema)


@query(f"""
with recursive {SEG}, o as (select meeting_id, seg_idx, length(coalesce(text, '')) + 30 as size, row_number() over (partition by meeting_id order by "start", seg_idx) as n from seg),
f as (select meeting_id, n, seg_idx, size as last, size as total, 0 as chunk, false as fresh, seg_idx as before from o where n = 1
  union all select o.meeting_id, o.n, o.seg_idx, o.size, case when k then f.last + o.size else f.total + o.size end, case when k then f.chunk + 1 else f.chunk end, k, f.seg_idx
    from f join o on f.meeting_id = o.meeting_id and o.n = f.n + 1, lateral (select f.total + o.size > 15000 as k))
select meeting_id, cast(chunk as bigint) as chunk, seg_idx, false as overlap from f union all select meeting_id, cast(chunk as bigint), before, true from f where fresh""")
def q_chunk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments packed into chunks of 15,000 characters with one row of overlap."""
    rows = segments(spark, sf_dir, "start", "text").select("meeting_id", "seg_idx", "start", F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    return folds.fold(rows, ["meeting_id"], [F.col("start"), F.col("seg_idx")], folds.Chunks, "meeting_id string, chunk long, seg_idx long, overlap boolean")


def _beds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, bool]:
    """Slim rows with the bed spoken of last, written once, as several windows read them."""
    rows = segments(spark, sf_dir, "start", "text").select("meeting_id", "seg_idx", "start", F.length(F.coalesce("text", F.lit(""))).alias("chars"), bed_number(F.col("text")).alias("spoken"))
    rows, hot = blocked(cut(rows), _BY, "start")
    return running(rows, _BY, _ORDER, F.col("spoken"), "bed", "last", hot=hot), hot


_BEDS = f"""{SEG},
b as (select meeting_id, seg_idx, "start", text, last_value(try_cast(nullif(regexp_extract(text, '(?i)(?:patul|paturile|bed|койк[аеиу])\\s+([0-9]{{1,3}})', 1), '') as int) ignore nulls) over (partition by meeting_id order by "start", seg_idx rows unbounded preceding) as bed from seg),
n as (select *, case when row_number() over w = 1 or bed is distinct from lag(bed) over w then 1 else 0 end as c from b window w as (partition by meeting_id order by "start", seg_idx)),
i as (select *, cast(sum(c) over (partition by meeting_id order by "start", seg_idx rows unbounded preceding) as bigint) as island from n)"""


def _bed_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    beds, hot = _beds(spark, sf_dir)
    near = neighbours(beds, _BY, _ORDER, lag={"before": "bed", "earlier": "seg_idx"}, hot=hot)
    return islands(near, _BY, _ORDER, F.col("earlier").isNull() | ~F.col("bed").eqNullSafe(F.col("before")), hot=hot)


@query(f"with {_BEDS} select meeting_id, island, min(bed) as bed, count(*) as segments, cast(sum(length(coalesce(text, '')) + 30) as bigint) as size, min(seg_idx) as first_seg from i group by 1, 2")
def q_topic_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3, first half: runs of segments about the same bed, where none is a value."""
    return _bed_islands(spark, sf_dir).groupBy("meeting_id", "island").agg(
        F.min("bed").alias("bed"), F.count(F.lit(1)).alias("segments"), F.sum(F.col("chars") + 30).alias("size"), F.min("seg_idx").alias("first_seg")
    )


@query(f"""
with recursive {_BEDS}, r as (select meeting_id, island, min(bed) as bed, sum(length(coalesce(text, '')) + 30) as size, row_number() over (partition by meeting_id order by island) as n from i group by 1, 2),
f as (select meeting_id, n, island, bed, size, size as total, 0 as grp, false as merged from r where n = 1
  union all select r.meeting_id, r.n, r.island, r.bed, r.size, case when k then f.total + r.size else r.size end, case when k then f.grp else f.grp + 1 end, k
    from f join r on f.meeting_id = r.meeting_id and r.n = f.n + 1, lateral (select f.total + r.size <= 7500 as k))
select meeting_id, cast(grp as bigint) as grp, island, bed, cast(size as bigint) as size, merged from f""")
def q_topic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3, second half: neighbouring runs merged while they fit half a chunk."""
    runs = q_topic_islands(spark, sf_dir)
    return folds.fold(runs, ["meeting_id"], [F.col("island")], folds.MergedGroups, "meeting_id string, grp long, island long, bed int, size long, merged boolean")


@query(f"with {_BEDS}, m as (select *, lag(bed) over (partition by meeting_id order by \"start\", seg_idx) as before from b) select meeting_id, seg_idx, bed from m where bed is not null and bed is distinct from before")
def q_topic_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A marker where the bed spoken of changes; the last marker holds across segments that name none."""
    beds, hot = _beds(spark, sf_dir)
    return neighbours(beds, _BY, _ORDER, lag={"before": "bed"}, hot=hot).where("bed is not null and not (bed <=> before)").select("meeting_id", "seg_idx", "bed")


@query("""
with r as (select user_id, event_id, event_type, lag(event_type) over w as a, lead(event_type) over w as c from events window w as (partition by user_id order by ts, event_id))
select event_id, case when a = event_type or c = event_type then event_type when a is not null and a = c then a else least(event_type, coalesce(a, event_type), coalesce(c, event_type)) end as smooth from r""")
def q_mode_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent of three neighbouring labels; ties go to the smallest, the edges have two."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_type").alias("b"))
    rows, hot = blocked(rows, ["user_id"], "t")
    rows = neighbours(rows, ["user_id"], ["t", "event_id"], lag={"a": "b"}, lead={"c": "b"}, hot=hot)
    pick = F.when((F.col("a") == F.col("b")) | (F.col("c") == F.col("b")), F.col("b")).when(F.col("a") == F.col("c"), F.col("a")).otherwise(F.least("b", F.coalesce("a", "b"), F.coalesce("c", "b")))
    return rows.select("event_id", pick.alias("smooth"))


@query(f"""
with {SEG}, f as (select meeting_id, speaker, min(("start", seg_idx)) as k from seg where speaker is not null group by 1, 2)
select meeting_id, speaker, 'S' || cast(row_number() over (partition by meeting_id order by k) as varchar) as number from f""")
def q_first_seen_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers numbered in order of their first segment."""
    first = segments(spark, sf_dir, "start", "speaker").where("speaker is not null").groupBy("meeting_id", "speaker").agg(F.min(F.struct("start", "seg_idx")).alias("k"))
    return first.select("meeting_id", "speaker", F.concat(F.lit("S"), F.row_number().over(Window.partitionBy("meeting_id").orderBy("k"))).alias("number"))


_TS = """case when regexp_extract("timestamp", '([0-9]{1,2}):([0-9]{2}):([0-9]{2})') != '' then cast(string_split("timestamp", ':')[1] as int) * 3600 + cast(string_split("timestamp", ':')[2] as int) * 60 + cast(string_split("timestamp", ':')[3] as int)
  when regexp_extract("timestamp", '([0-9]{1,2}):([0-9]{2})') != '' then cast(string_split("timestamp", ':')[1] as int) * 60 + cast(string_split("timestamp", ':')[2] as int) end"""


@query(f"""
with {DEC}, t as (select *, coalesce({_TS}, 0) as t from dec)
select meeting_id, part_idx, item_idx, t as seconds, 'D' || cast(row_number() over (partition by meeting_id order by t, part_idx, item_idx) as varchar) as id from t""")
def q_sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions in order of time, unknown times first, with sequential ids."""
    rows = items(spark, sf_dir, "decision").withColumn("seconds", F.coalesce(seconds_of(F.col("timestamp")), F.lit(0)))
    rows, hot = blocked(rows.select("meeting_id", "part_idx", "item_idx", "seconds"), _BY, "seconds")
    rows = ranked(rows, _BY, ["seconds", "part_idx", "item_idx"], "n", hot=hot)
    return rows.select("meeting_id", "part_idx", "item_idx", "seconds", F.concat(F.lit("D"), "n").alias("id"))


@query(f"""
with {ACT}, o as (select *, coalesce(subject, '') as s from act)
select meeting_id, part_idx, item_idx, cast(row_number() over (partition by meeting_id order by case when s = '' then 1 else 0 end, s, part_idx, item_idx) as int) as number,
  cast(row_number() over (partition by meeting_id, s order by part_idx, item_idx) as int) as within from o""")
def q_continuous_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks numbered through the groups of a meeting, the general group last, and within their group."""
    rows = items(spark, sf_dir, "action_item").select("meeting_id", "part_idx", "item_idx", F.coalesce("subject", F.lit("")).alias("s"))
    rows, hot = blocked(rows, ["meeting_id", "s"], "part_idx")
    rows = ranked(rows, ["meeting_id", "s"], ["part_idx", "item_idx"], "within", hot=hot).drop("__block")
    # a group's numbers follow those of the groups before it: one row for each group, not for each task
    groups = rows.groupBy("meeting_id", "s").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("meeting_id").orderBy(F.when(F.col("s") == "", 1).otherwise(0), "s").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("meeting_id", "s", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    rows = rows.join(groups, ["meeting_id", "s"])
    return rows.select("meeting_id", "part_idx", "item_idx", (F.col("off") + F.col("within")).cast("int").alias("number"), F.col("within").cast("int").alias("within"))


@query(f"""
with {SEG}, w as (select meeting_id, seg_idx, unnest(string_split(trim(regexp_replace(text, '[ \\t\\n]+', ' ', 'g')), ' ')) as word, generate_subscripts(string_split(trim(regexp_replace(text, '[ \\t\\n]+', ' ', 'g')), ' '), 1) as pos from seg where text is not null)
select meeting_id, seg_idx, cast(pos as int) as pos, word, cast(coalesce(sum(length(word) + 1) over (partition by meeting_id, seg_idx order by pos rows between unbounded preceding and 1 preceding), 0) as bigint) as char_offset from w where word != ''""")
def q_word_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each word of a segment begins, counting one space between words."""
    clean = F.trim(F.regexp_replace("text", r"[ \t\n]+", " "))
    rows = segments(spark, sf_dir, "text").where("text is not null").select("meeting_id", "seg_idx", F.posexplode(F.split(clean, " ")).alias("p", "word")).where("word != ''")
    w = Window.partitionBy("meeting_id", "seg_idx").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("meeting_id", "seg_idx", (F.col("p") + 1).cast("int").alias("pos"), "word", F.coalesce(F.sum((F.length("word") + 1).cast("long")).over(w), F.lit(0)).alias("char_offset"))


@query(f"""
with {SEG}, v as (select meeting_id, "start" as s, "end" as e, seg_idx from seg where "end" > "start"),
m as (select *, max(e) over (partition by meeting_id order by s, e, seg_idx rows between unbounded preceding and 1 preceding) as before from v),
i as (select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by meeting_id order by s, e, seg_idx rows unbounded preceding) as i from m)
select meeting_id, cast(i as bigint) as span, min(s) as span_start, max(e) as span_end, count(*) as members from i group by 1, 2""")
def q_merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping or touching spans merged, by the running largest end."""
    rows = segments(spark, sf_dir, "start", "end").where(F.col("end") > F.col("start"))
    order = [F.col("start"), F.col("end"), F.col("seg_idx")]
    rows, hot = blocked(rows, _BY, "start")
    reach = running(rows, _BY, order, F.col("end"), "reach", "max", current=False, hot=hot)
    runs = islands(reach, _BY, order, F.col("start") > F.col("reach"), "span", hot)
    return runs.groupBy("meeting_id", "span").agg(F.min("start").alias("span_start"), F.max("end").alias("span_end"), F.count(F.lit(1)).alias("members"))


@query("select id, case when status = 'queued' then cast(row_number() over (partition by status order by created, id) as int) else 0 end as queue_position from job")
def q_queue_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place in the queue by age, 0 for jobs that do not wait."""
    jobs = table(spark, sf_dir, "job").select("id", "status", "created")
    waiting, hot = blocked(jobs.where("status = 'queued'"), ["status"], "created")
    waiting = ranked(waiting, ["status"], ["created", "id"], "queue_position", hot=hot).select("id", F.col("queue_position").cast("int").alias("queue_position"))
    return waiting.unionByName(jobs.where("not (status <=> 'queued')").select("id", F.lit(0).alias("queue_position")))


@query(f"""
with {SEG} select meeting_id, seg_idx, right(lag(coalesce(text, '')) over w, 160) as before, left(lead(coalesce(text, '')) over w, 160) as after from seg window w as (partition by meeting_id order by "start", seg_idx)""")
def q_neighbour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 160 characters before and the first 160 after each segment."""
    t = F.coalesce("text", F.lit(""))
    rows = segments(spark, sf_dir, "start", "text").select("meeting_id", "seg_idx", "start", F.right(t, F.lit(160)).alias("tail"), F.left(t, F.lit(160)).alias("head"))
    rows, hot = blocked(rows, _BY, "start")
    near = neighbours(rows, _BY, _ORDER, lag={"before": "tail"}, lead={"after": "head"}, hot=hot)
    return near.select("meeting_id", "seg_idx", "before", "after")


@query(f"""
with {SEG}, v as (select meeting_id, seg_idx, cast(floor("start" * 100) as bigint) as a, cast(floor("end" * 100) as bigint) as b from seg where "end" - "start" >= 0.5),
r as (select *, unnest(generate_series(a, greatest(a, b - 150), 75)) as k from v),
l as (select meeting_id, seg_idx, a, b, max(k) as last from r group by 1, 2, 3, 4),
u as (select meeting_id, seg_idx, b, k from r union all select meeting_id, seg_idx, b, greatest(a, b - 150) from l where b - (last + 150) > 37)
select meeting_id, seg_idx, k as from_cs, least(b, k + 150) as to_cs from u""")
def q_voice_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 1.5 s every 0.75 s over spans of half a second or more, and one at the tail if more than half a step is left."""
    rows = segments(spark, sf_dir, "start", "end").where(F.col("end") - F.col("start") >= 0.5)
    rows = rows.select("meeting_id", "seg_idx", F.floor(F.col("start") * 100).cast("long").alias("a"), F.floor(F.col("end") * 100).cast("long").alias("b"))
    steps = F.sequence(F.col("a"), F.greatest(F.col("a"), F.col("b") - 150), F.lit(75).cast("long"))
    tail = F.when(F.col("b") - (F.element_at(steps, -1) + 150) > 37, F.array(F.greatest(F.col("a"), F.col("b") - 150))).otherwise(F.array().cast("array<bigint>"))
    return rows.select("meeting_id", "seg_idx", "b", F.explode(F.concat(steps, tail)).alias("from_cs")).select("meeting_id", "seg_idx", "from_cs", F.least(F.col("b"), F.col("from_cs") + 150).alias("to_cs"))


_VOICE = """v as (select meeting_id, seg_idx, cast(floor("start" * 100) as bigint) as a, cast(floor("end" * 100) as bigint) as z from seg where "end" > "start"),
r as (select *, unnest(generate_series(a, greatest(a, z - 150), 75)) as k from v where z - a >= 50),
l as (select meeting_id, seg_idx, a, z, max(k) as last from r group by 1, 2, 3, 4),
u as (select meeting_id, seg_idx, a, z, k from r union all select meeting_id, seg_idx, a, z, greatest(a, z - 150) from l where z - (last + 150) > 37),
w as (select meeting_id, seg_idx, a, z, k as b, least(z, k + 150) as e, (k // 400) % 2 as label from u)"""


@query(f"""
with {SEG}, {_VOICE},
c as (select *, case when label is distinct from lag(label) over o then 1 else 0 end as new from w window o as (partition by meeting_id, seg_idx order by b)),
p as (select meeting_id, seg_idx, a, z, run, min(b) as b, max(e) as e, min(label) as label from (select *, sum(new) over (partition by meeting_id, seg_idx order by b rows unbounded preceding) as run from c) group by 1, 2, 3, 4, 5),
s as (select *, run = 1 or e - b >= 200 as long from p),
g as (select *, case when long and (lag(case when long then label end ignore nulls) over o) is distinct from label then 1 else 0 end as new from s window o as (partition by meeting_id, seg_idx order by run)),
h as (select meeting_id, seg_idx, a, z, part, min(b) as b, max(e) as e, arg_min(label, run) as label from (select *, sum(new) over (partition by meeting_id, seg_idx order by run rows unbounded preceding) as part from g) group by 1, 2, 3, 4, 5),
n as (select *, count(*) over (partition by meeting_id, seg_idx) as parts, first_value(e - b) over (partition by meeting_id, seg_idx order by part) < 200 as short from h),
m as (select meeting_id, seg_idx, a, z, case when part = 1 and parts > 1 and short then 2 else part end as part, min(b) as b, max(e) as e, arg_max(label, part) as label from n group by 1, 2, 3, 4, 5),
x as (select *, case when e > lead(b) over o then (e + lead(b) over o) / 2.0 else lead(b) over o end as edge from m window o as (partition by meeting_id, seg_idx order by part))
select meeting_id, seg_idx, cast(row_number() over o as int) as piece, cast(coalesce(lag(edge) over o, a) as double) as from_cs, cast(coalesce(edge, z) as double) as to_cs, cast(label as bigint) as label from x window o as (partition by meeting_id, seg_idx order by part)
union all select meeting_id, seg_idx, 1, cast(a as double), cast(z as double), -1 from v where z - a < 50""")
def q_speaker_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span's voice windows, by label, in pieces: runs of one label, runs under two seconds glued to the piece before (the first one to the
    piece after it), the outer ends those of the span and the inner ones midway where pieces overlap; spans too short for a window are one piece
    without a label.

    The tables hold no labels of windows; every other four seconds of a recording stand for a second voice. Windows of one span meet in a task.
    """
    spans = segments(spark, sf_dir, "start", "end").where(F.col("end") > F.col("start"))
    spans = spans.select("meeting_id", "seg_idx", F.floor(F.col("start") * 100).cast("long").alias("a"), F.floor(F.col("end") * 100).cast("long").alias("z"))
    steps = F.sequence(F.col("a"), F.greatest(F.col("a"), F.col("z") - 150), F.lit(75).cast("long"))
    tail = F.when(F.col("z") - (F.element_at(steps, -1) + 150) > 37, F.array(F.greatest(F.col("a"), F.col("z") - 150))).otherwise(F.array().cast("array<bigint>"))
    key = ["meeting_id", "seg_idx", "a", "z"]
    by = lambda c: Window.partitionBy("meeting_id", "seg_idx").orderBy(c)
    so_far = lambda c: by(c).rowsBetween(Window.unboundedPreceding, 0)
    w = spans.where("z - a >= 50").select(*key, F.explode(F.concat(steps, tail)).alias("b")).withColumn("e", F.least(F.col("z"), F.col("b") + 150)).withColumn("label", F.floor(F.col("b") / 400) % 2)
    w = w.withColumn("new", (~F.lag("label").over(by("b")).eqNullSafe(F.col("label"))).cast("int")).withColumn("run", F.sum("new").over(so_far("b")))
    runs = w.groupBy(*key, "run").agg(F.min("b").alias("b"), F.max("e").alias("e"), F.min("label").alias("label"))
    # a piece begins where a run that is long enough has another label than the last such run
    runs = runs.withColumn("own", F.when((F.col("run") == 1) | (F.col("e") - F.col("b") >= 200), F.col("label")))
    before = F.last("own", ignorenulls=True).over(by("run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("new", (F.col("own").isNotNull() & ~before.eqNullSafe(F.col("own"))).cast("int")).withColumn("part", F.sum("new").over(so_far("run")))
    parts = runs.groupBy(*key, "part").agg(F.min("b").alias("b"), F.max("e").alias("e"), F.min_by("label", "run").alias("label"))
    whole = Window.partitionBy("meeting_id", "seg_idx")
    short = (F.col("part") == 1) & (F.max("part").over(whole) > 1) & (F.col("e") - F.col("b") < 200)
    parts = parts.withColumn("to", F.when(short, 2).otherwise(F.col("part")))
    parts = parts.groupBy(*key, "to").agg(F.min("b").alias("b"), F.max("e").alias("e"), F.max_by("label", "part").alias("label"))
    after = F.lead("b").over(by("to"))
    parts = parts.withColumn("edge", F.when(F.col("e") > after, (F.col("e") + after) / 2).otherwise(after.cast("double")))
    out = parts.select("meeting_id", "seg_idx", F.row_number().over(by("to")).alias("piece"), F.coalesce(F.lag("edge").over(by("to")), F.col("a").cast("double")).alias("from_cs"), F.coalesce("edge", F.col("z").cast("double")).alias("to_cs"), "label")
    return out.unionByName(spans.where("z - a < 50").select("meeting_id", "seg_idx", F.lit(1).alias("piece"), F.col("a").cast("double").alias("from_cs"), F.col("z").cast("double").alias("to_cs"), F.lit(-1).cast("long").alias("label")))


QUERIES, ORACLE = query.queries, query.oracle
