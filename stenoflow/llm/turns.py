"""Problem 2: transcript segments into clean, ordered speaker turns.

Speakers and the marks to remove come from SQL expressions, so nothing leaves the JVM. Turns are gaps-and-islands over (start, seg_idx): a
new island begins where the speaker changes. A meeting may hold a large part of all rows, so islands are made per block of a hot meeting
(operators.blocks); only the first and last island of each block are then joined across block edges. Turns without a known speaker also get
the last known one, forward-filled by a window over turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.speakers import LABEL, NOISE, STAMP, resolve_speakers, visible
from ..operators.blocks import BLOCK, HOT_ROWS, PIECE_ROWS, hot_bounds, neighbours, with_block

# fixed values: hesitation sounds of the three languages
HESITATION = r"(?:[ăâ]{2,}m*|[ăâ]+m+|î{2,}m*|î+m+|h+m+|m{2,}|u+h+m*|u+m+|e+r+m|э{2,}м*|э+м+|х+м+|м{2,}|[aа]{3,})"
_LEAD = rf"(?iu)^(?:[\s,.…\-–—]*(?:{STAMP}|{NOISE}|{LABEL}|{HESITATION}(?![\p{{L}}\p{{N}}])))+[\s,.…:\-–—]*"
_ANYWHERE = rf"(?iu)(?:[\[(<{{]\s*\d{{1,2}}:\d{{2}}(?::\d{{2}})?(?:[.,]\d{{1,3}})?\s*[\])>}}]|{NOISE})"
_HESITATIONS = rf"(?iu)(?:,\s*)?(?<![\p{{L}}\p{{N}}\-'’]){HESITATION}(?![\p{{L}}\p{{N}}\-'’])(?:\s*(?:,|\.\.\.|…))?"


def spoken(text: Column) -> Column:
    """The text without time stamps, speaker labels, hesitation sounds and sound annotations.

    Bare time stamps and labels are removed only at the beginning, where they are marks and not speech; a null text stays null. Case and the
    rest of the punctuation stay as they were.
    """
    out = F.regexp_replace(visible(text), _LEAD, "")
    out = F.regexp_replace(out, _ANYWHERE, " ")
    out = F.regexp_replace(out, _HESITATIONS, "")
    out = F.regexp_replace(out, _LEAD, "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"^[\s,.…\-–—]+", ""))


def counts_as_speech(clean: Column) -> Column:
    return F.coalesce(clean.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def speaker_turns(segments: DataFrame, participants: DataFrame, hot_rows: int = HOT_ROWS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Rows (meeting_id, first_seg, last_seg, speaker, start, end, segments, text) and the block column, one for each turn.

    Order is by start, then seg_idx; a null start comes first. Segments without a spoken word (null, empty, noise only) neither count nor
    break a turn. A segment delivered twice counts once. `end` is the latest end that lies after its start, or null. No segments give no turns.
    """
    wanted = segments.select("meeting_id", "seg_idx", "start", "end", "speaker", "text")
    rows = resolve_speakers(wanted, participants).select(
        "meeting_id", "seg_idx", F.col("start").alias("__s"), F.when(F.col("end") > F.col("start"), F.col("end")).alias("__e"), F.col("speaker_id").alias("__who"), spoken(F.col("text")).alias("__text")
    )
    rows = rows.where(counts_as_speech(F.col("__text")))
    bounds = hot_bounds(segments.select("meeting_id", "start"), ["meeting_id"], "start", hot_rows, piece_rows)
    rows = with_block(rows, bounds, ["meeting_id"], "__s")
    order = [F.col("__s"), F.col("seg_idx")]
    within = Window.partitionBy("meeting_id", BLOCK).orderBy(*order)
    # a repeated row has the same place in the order as its first delivery
    rows = rows.withColumn("__again", F.lag("seg_idx").over(within).eqNullSafe(F.col("seg_idx")))
    rows = rows.where(~F.col("__again"))
    change = F.coalesce((F.lag("__who").over(within) != F.col("__who")).cast("int"), F.lit(1))
    rows = rows.withColumn("__island", F.sum(change).over(within))
    islands = rows.groupBy("meeting_id", BLOCK, "__island").agg(
        F.first("__who").alias("speaker"),
        F.min_by("seg_idx", F.struct(*order)).alias("first_seg"),
        F.max_by("seg_idx", F.struct(*order)).alias("last_seg"),
        F.min("__s").alias("start"),
        F.max("__e").alias("end"),
        F.count(F.lit(1)).alias("segments"),
        F.sort_array(F.collect_list(F.struct("__s", "seg_idx", "__text"))).alias("__parts"),
    )
    # the first and last islands of the blocks of a meeting meet again; all others are whole turns
    islands = islands.withColumn("__last", F.max("__island").over(Window.partitionBy("meeting_id", BLOCK)))
    edge = (F.col("__island") == 1) | (F.col("__island") == F.col("__last"))
    islands = islands.withColumn("__part", F.when((F.col(BLOCK) > 0) & edge, F.lit(-1)).otherwise(F.col(BLOCK)))
    seam = Window.partitionBy("meeting_id", "__part").orderBy(BLOCK, "__island")
    same = (F.lag("speaker").over(seam) == F.col("speaker")) & (F.lag(BLOCK).over(seam) < F.col(BLOCK))
    islands = islands.withColumn("__turn", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(seam))
    at = F.struct(BLOCK, "__island")
    turns = islands.groupBy("meeting_id", "__part", "__turn").agg(
        F.min(BLOCK).alias(BLOCK),
        F.first("speaker").alias("speaker"),
        F.min_by("first_seg", at).alias("first_seg"),
        F.max_by("last_seg", at).alias("last_seg"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum("segments").alias("segments"),
        F.array_join(F.transform(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col(BLOCK), F.col("__island"), F.col("__parts")))), lambda x: x["__parts"])), lambda p: p["__text"]), " ").alias("text"),
    )
    return turns.select("meeting_id", "first_seg", "last_seg", "speaker", "start", "end", "segments", "text", BLOCK)


def filled(turns: DataFrame, hot: bool = True) -> DataFrame:
    """Add speaker_filled; hot=False where no meeting was cut into blocks. Two turns with no known speaker are never neighbours, so the turn before is enough."""
    near = neighbours(turns, ["meeting_id"], [F.col("start"), F.col("first_seg")], lag={"__before": "speaker"}, hot=hot)
    return near.withColumn("speaker_filled", F.when(F.col("speaker") != "S?", F.col("speaker")).otherwise(F.col("__before"))).drop("__before", BLOCK)
