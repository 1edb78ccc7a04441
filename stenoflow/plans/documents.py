"""Document, job and routing queries; each names its inventory ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import table
from ..sinks.office import docx_files
from .base import ACT, DEC, Registry, items

query = Registry()


@query(f"""
with {DEC}, {ACT}, d as (select meeting_id, '## Decizii' || chr(10) || string_agg(cast(n as varchar) || '. ' || coalesce(decision, '—'), chr(10) order by n) as body from (select *, row_number() over (partition by meeting_id order by part_idx, item_idx) as n from dec) group by 1),
t as (select meeting_id, '| # | Sarcina | Termen |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || cast(n as varchar) || ' | ' || replace(coalesce(task, '—'), '|', '/') || ' | ' || replace(coalesce(deadline_date, deadline_text, '—'), '|', '/') || ' |', chr(10) order by n) as body from (select *, row_number() over (partition by meeting_id order by part_idx, item_idx) as n from act) group by 1)
select coalesce(d.meeting_id, t.meeting_id) as meeting_id, coalesce(d.body, '') || chr(10) || chr(10) || coalesce(t.body, '') as markdown from d full join t on d.meeting_id = t.meeting_id""")
def q_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes as Markdown; numbers go on through a meeting, bars in table cells become slashes."""
    def lines(rows: DataFrame, line) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("part_idx", "item_idx", *[c for c in rows.columns if c not in ("meeting_id", "part_idx", "item_idx")])))
        return rows.groupBy("meeting_id").agg(ordered.alias("x")).select("meeting_id", F.array_join(F.transform("x", lambda r, i: line(r, (i + 1).cast("string"))), "\n").alias("body"))

    cell = lambda c: F.replace(F.coalesce(c, F.lit("—")), F.lit("|"), F.lit("/"))
    d = lines(items(spark, sf_dir, "decision").select("meeting_id", "part_idx", "item_idx", "decision"), lambda r, n: F.concat(n, F.lit(". "), F.coalesce(r["decision"], F.lit("—"))))
    tasks = items(spark, sf_dir, "action_item").select("meeting_id", "part_idx", "item_idx", "task", F.coalesce("deadline_date", "deadline_text").alias("due"))
    t = lines(tasks, lambda r, n: F.concat(F.lit("| "), n, F.lit(" | "), cell(r["task"]), F.lit(" | "), cell(r["due"]), F.lit(" |")))
    both = d.select("meeting_id", F.concat(F.lit("## Decizii\n"), "body").alias("a")).join(t.select("meeting_id", F.concat(F.lit("| # | Sarcina | Termen |\n|---|---|---|\n"), "body").alias("b")), "meeting_id", "full")
    return both.select("meeting_id", F.concat(F.coalesce("a", F.lit("")), F.lit("\n\n"), F.coalesce("b", F.lit(""))).alias("markdown"))


@query(f"""
with {DEC} select meeting_id, '<ol>' || string_agg('<li>' || case when decision is null or decision = '' then '—' else replace(replace(replace(replace(replace(decision, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') end || '</li>', '' order by part_idx, item_idx) || '</ol>' as html from dec group by 1""")
def q_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: decisions as an HTML list, in order."""
    rows = items(spark, sf_dir, "decision").select("meeting_id", "part_idx", "item_idx", X.html_escape(F.col("decision")).alias("d"))
    li = F.transform(F.array_sort(F.collect_list(F.struct("part_idx", "item_idx", "d"))), lambda r: F.concat(F.lit("<li>"), r["d"], F.lit("</li>")))
    return rows.groupBy("meeting_id").agg(F.concat(F.lit("<ol>"), F.array_join(li, ""), F.lit("</ol>")).alias("html"))


@query("select id, status, source_name, meeting_type, created from job order by id desc")
def q_job_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job list, newest id first."""
    return table(spark, sf_dir, "job").select("id", "status", "source_name", "meeting_type", "created").orderBy(F.desc("id"))


# fixed values: share of the work that each stage stands for, in the order of the stages
STAGE_WEIGHTS = {"audio": 0.03, "asr": 0.45, "diarize": 0.04, "minutes": 0.44, "document": 0.02, "delivery": 0.02}
_NAMES = list(STAGE_WEIGHTS)
_PAST = "'done', 'skipped'"
_WORK = " + ".join(
    f"case when {' and '.join([f'coalesce(stages[{p!r}].status in ({_PAST}), false)' for p in _NAMES[:i]] or ['true'])} then case when stages[{n!r}].status in ({_PAST}) then {w} when stages[{n!r}].status in ('running', 'error') then {w} * coalesce(stages[{n!r}].progress, 0) else 0 end else 0 end"
    for i, (n, w) in enumerate(STAGE_WEIGHTS.items())
)


@query(f"""with s as (select id, unnest(map_entries(stages)) as e from job), c as (select id, count(*) as stages, count(*) filter (where e.value.status = 'done') as done, round(sum(coalesce(e.value.seconds, 0)), 2) as seconds from s group by 1)
select c.*, round({_WORK.replace("stages[", "j.stages[")}, 4) as progress from c join job j on c.id = j.id""")
def q_job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages done, seconds spent, and progress: the weights of the stages up to the first unfinished one, of which its own share counts."""
    job = table(spark, sf_dir, "job").select("id", "stages").where("size(stages) > 0")
    progress, open_ = F.lit(0.0), F.lit(True)
    for name, weight in STAGE_WEIGHTS.items():
        status, share = F.col("stages")[name]["status"], F.coalesce(F.col("stages")[name]["progress"], F.lit(0.0))
        past = F.coalesce(status.isin("done", "skipped"), F.lit(False))
        progress = progress + F.when(open_ & past, weight).when(open_ & status.isin("running", "error"), share * weight).otherwise(0.0)
        open_ = open_ & past
    values = F.map_values("stages")
    done = F.size(F.filter(values, lambda s: s["status"] == "done")).cast("long")
    seconds = F.aggregate(values, F.lit(0.0), lambda a, s: a + F.coalesce(s["seconds"], F.lit(0.0)))
    return job.select("id", F.size("stages").cast("long").alias("stages"), done.alias("done"), F.round(seconds, 2).alias("seconds"), F.round(progress, 4).alias("progress"))


@query("""select id, case meeting_type when 'medical' then 'branch_medical' when 'executive' then 'branch_executive' when 'administrative' then 'branch_administrative' end as branch, case when meeting_type in ('medical', 'executive') then 'high' else 'normal' end as priority from job where meeting_type in ('medical', 'executive', 'administrative')""")
def q_route_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routing graph: split by type, a projection in each branch, union. Types without a branch go nowhere."""
    jobs = table(spark, sf_dir, "job")
    parts = [jobs.where(F.col("meeting_type") == kind).select("id", F.lit(f"branch_{kind}").alias("branch"), F.lit(priority).alias("priority")) for kind, priority in (("medical", "high"), ("executive", "high"), ("administrative", "normal"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""with {ACT}, p as (select meeting_id, part_idx, item_idx, unnest(string_split_regex(coalesce(owner, ''), '[,;]')) as x from act) select meeting_id, part_idx, item_idx, trim(x) as address from p where regexp_full_match(trim(x), '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+')""")
def q_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in owner fields, split at commas and semicolons, that match in full. Duplicates are kept."""
    parts = F.transform(F.split(F.coalesce("owner", F.lit("")), "[,;]"), lambda x: F.trim(x))
    rows = items(spark, sf_dir, "action_item").select("meeting_id", "part_idx", "item_idx", F.explode(parts).alias("address"))
    return rows.where(F.col("address").rlike(r"^[A-Za-z0-9._+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+$"))


@query(f"with {ACT} select meeting_id, part_idx, item_idx, '[' || coalesce(\"timestamp\", '-') || '] ' || coalesce(task, '?') || ' / ' || coalesce(nullif(owner, ''), '?') || ' / ' || coalesce(nullif(deadline_text, ''), 'fără termen') as line from act")
def q_compact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One compact line for each task, with defaults."""
    filled = lambda c, d: F.when(F.coalesce(F.col(c), F.lit("")) == "", d).otherwise(F.col(c))
    line = F.concat(F.lit("["), F.coalesce("timestamp", F.lit("-")), F.lit("] "), F.coalesce("task", F.lit("?")), F.lit(" / "), filled("owner", "?"), F.lit(" / "), filled("deadline_text", "fără termen"))
    return items(spark, sf_dir, "action_item").select("meeting_id", "part_idx", "item_idx", line.alias("line"))


@query(f"with {DEC} select meeting_id, part_idx, item_idx, regexp_replace(decision, '\\s*\\((?:probabil|вероятно|probably)[^)]*(?:\\)|$)', '', 'g') as plain, coalesce(decided_by, subject, rationale) as first_known from dec where decision is not null")
def q_without_speculation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remarks in brackets that guess are taken out, even unclosed ones; the first field that is known."""
    plain = F.regexp_replace("decision", r"\s*\((?:probabil|вероятно|probably)[^)]*(?:\)|$)", "")
    return items(spark, sf_dir, "decision").where("decision is not null").select("meeting_id", "part_idx", "item_idx", plain.alias("plain"), F.coalesce("decided_by", "subject", "rationale").alias("first_known"))


@query(f"with {DEC} select meeting_id, to_json(list({{'decision': decision, 'seconds': \"timestamp\"}} order by part_idx, item_idx)) as minutes from dec where decision is not null and \"timestamp\" is not null group by 1")
def q_minutes_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions of a meeting as one JSON array, in order."""
    rows = items(spark, sf_dir, "decision").where("decision is not null and timestamp is not null")
    ordered = F.array_sort(F.collect_list(F.struct("part_idx", "item_idx", "decision", F.col("timestamp").alias("seconds"))))
    return rows.groupBy("meeting_id").agg(F.to_json(F.transform(ordered, lambda r: F.struct(r["decision"].alias("decision"), r["seconds"].alias("seconds")))).alias("minutes"))


@query()
def q_docx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: the minutes as word-processor files, with their size."""
    return docx_files(q_markdown(spark, sf_dir)).select("meeting_id", F.length("docx").alias("bytes"))


QUERIES, ORACLE = query.queries, query.oracle
