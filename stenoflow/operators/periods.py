"""Problem 5: overlapping and gapped intervals per entity, merged into periods, with the gaps between them.

Starts and ends are ranked independently within each entity. After the k-th end every interval that began is over exactly if the next
start, of rank k+1, lies later: there is the gap (e_k, s_{k+1}). Boundaries in order give the periods. Ranks, pairing and the final
neighbour step are all cut into blocks for hot entities (operators.blocks), so no entity is ever sorted in one task. The slim rows
(keys, start, end) are written once to the checkpoint folder, as starts and ends both read them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .blocks import BLOCK, HOT_ROWS, PIECE_ROWS, hot_bounds, neighbours, ranked, with_block


def periods_and_gaps(
    df: DataFrame, keys: Sequence[str], begin: str = "begin_cs", end: str = "end_cs", hot_rows: int = HOT_ROWS, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """Rows (kind, *keys, begin, end): kind 'period' for merged intervals, 'gap' for the spaces between neighbouring periods of an entity.

    Intervals that overlap, nest or touch merge. Rows with a null bound, or an end not after the start, are left out; a null key is an
    entity of its own only if the caller fills it (null keys are left out). Repeated rows change nothing. An empty input gives no rows.
    """
    keys = list(keys)
    ok = F.col(begin).isNotNull() & F.col(end).isNotNull() & (F.col(end) > F.col(begin))
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    rows = cut(df.where(ok).select(*keys, F.col(begin).cast("long").alias("__s"), F.col(end).cast("long").alias("__e")))
    bounds = hot_bounds(rows, keys, "__s", hot_rows, piece_rows)
    point = lambda c: with_block(rows.select(*keys, F.col(c).alias("__t")), bounds, keys, "__t")
    hot = bounds is not None
    starts = ranked(point("__s"), keys, [F.col("__t")], "__k", hot=hot)
    ends = ranked(point("__e"), keys, [F.col("__t")], "__k", hot=hot)
    paired = (
        starts.select(*keys, (F.col("__k") - 1).alias("__k"), F.col("__t").alias("__next_s"), F.lit(None).cast("long").alias("__this_e"))
        .unionByName(ends.select(*keys, "__k", F.lit(None).cast("long").alias("__next_s"), F.col("__t").alias("__this_e")))
        .groupBy(*keys, "__k")
        .agg(F.max("__next_s").alias("__next_s"), F.max("__this_e").alias("__this_e"))
    )
    cuts = paired.where("__this_e is null or __next_s is null or __next_s > __this_e")
    cuts = with_block(cuts.withColumn("__t", F.coalesce("__this_e", "__next_s")), bounds, keys, "__t")
    near = neighbours(cuts, keys, [F.col("__k")], lead={"__period_e": "__this_e"}, hot=hot)
    both = F.filter(
        F.array(
            F.struct(F.lit("period").alias("kind"), F.col("__next_s").alias(begin), F.col("__period_e").alias(end)),
            F.struct(F.lit("gap").alias("kind"), F.col("__this_e").alias(begin), F.col("__next_s").alias(end)),
        ),
        lambda x: x[begin].isNotNull() & x[end].isNotNull(),
    )
    return near.select(*keys, F.explode(both).alias("__x")).select(F.col("__x.kind").alias("kind"), *keys, F.col(f"__x.{begin}").alias(begin), F.col(f"__x.{end}").alias(end))


__all__ = ["BLOCK", "periods_and_gaps"]
