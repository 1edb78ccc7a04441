"""As-of lookups: for each row the last row of another table at or before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import HOT_ROWS, PIECE_ROWS, blocked, running


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    value: Sequence[str],
    tolerance: float | None = None,
    ahead: float = 0.0,
    tie: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """left with the columns `value` of right's last row with right_on <= left_on + ahead, within `tolerance` back from left_on if given.

    Union and one running window, so each key is sorted once and nothing is paired: O(n log n) however many rows match; hot keys are cut into
    blocks. Ties of right_on go to the
    row that is last by `tie`. Rows of left without a match get nulls; null keys match nothing; rows of right with a null right_on are left out.
    Order columns are compared as doubles.
    """
    names = left.columns
    packed = F.struct(*[F.col(v) for v in value])
    a = left.withColumn("__t", F.col(left_on).cast("double") + F.lit(ahead)).withColumn("__k", F.lit(1)).withColumn("__tie", F.lit(None).cast("struct<a:double>"))
    a = a.withColumn("__row", F.struct(*names)).withColumn("__v", F.lit(None).cast(right.select(packed.alias("v")).schema["v"].dataType))
    order = [F.col(t).cast("double") for t in tie] or [F.lit(0.0)]
    b = right.where(F.col(right_on).isNotNull()).withColumn("__t", F.col(right_on).cast("double")).withColumn("__k", F.lit(0))
    b = b.withColumn("__v", packed).withColumn("__tie", F.struct(order[0].alias("a")))
    for k in by:
        a, b = a.withColumn(f"__by_{k}", F.col(k)), b.withColumn(f"__by_{k}", F.col(k))
    keys = [f"__by_{k}" for k in by]
    both = a.select(*keys, "__t", "__k", "__tie", "__row", "__v").unionByName(b.select(*keys, "__t", "__k", "__tie", "__v"), allowMissingColumns=True)
    cut, hot = blocked(both, keys, "__t", hot_rows, piece_rows)
    hit = F.when(F.col("__k") == 0, F.struct("__t", "__v"))
    out = running(cut, keys, [F.col("__t"), F.col("__k"), F.col("__tie")], hit, "__hit", "last", hot=hot).where("__k = 1")
    near: Column = F.col("__hit").isNotNull()
    for k in keys:
        near = near & F.col(k).isNotNull()
    if tolerance is not None:
        near = near & (F.col("__t") - F.lit(ahead) - F.col("__hit.__t") <= tolerance)
    return out.select("__row.*", *[F.when(near, F.col(f"__hit.__v.{v}")).alias(v) for v in value])


def islands(df: DataFrame, by: Sequence[str], order: Sequence[Column], starts: Column, name: str = "island", hot: bool = True) -> DataFrame:
    """Number the runs of rows within `by` from 1: a new run begins where `starts` is true or null. df has block numbers (operators.blocks)."""
    return running(df, by, order, F.coalesce(starts.cast("int"), F.lit(1)).cast("long"), name, "sum", hot=hot)
