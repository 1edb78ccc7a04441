"""Ordered operators over groups that may hold a third of all rows.

A window partitioned by a hot key sorts that whole key in one task. Here a hot key is first cut into blocks along the order column,
with bounds found by one light aggregation; windows then run per (key, block), and what one block hands to the next is a small table of
blocks that is joined back. Keys that are not hot stay in block 0; blocks of hot keys count from 1. Where no key is hot, hot_bounds gives
None and all operators below are one plain window (hot=False).

A block holds about `piece_rows` rows, and more only where the table has more than piece_rows * MOST_BLOCKS rows: so there are at most
MOST_BLOCKS blocks and half as many hot keys however large the table is, and that is all that comes to the driver or is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is hot if it has more rows than one task should sort.
HOT_ROWS = 50_000
PIECE_ROWS = 25_000
#: Blocks of a table at most, all hot keys together; beyond piece_rows * MOST_BLOCKS rows the blocks grow instead.
MOST_BLOCKS = 1 << 16
#: Bounds are looked up in two steps, first among every FAN-th of them.
FAN = 256
BLOCK = "__block"


def hot_bounds(df: DataFrame, keys: Sequence[str], order: str, hot_rows: int = HOT_ROWS, piece_rows: int = PIECE_ROWS) -> DataFrame | None:
    """Every key with more than hot_rows rows, with ascending bounds of `order` that cut it into pieces of about piece_rows; None if no key is hot.

    Null keys and null order values are ignored here. Bounds come in groups of FAN, so that with_block finds a block in two short steps.
    """
    spark = df.sparkSession
    counts = df.where(F.col(order).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows)
    total = counts.agg(F.sum("__n")).first()[0]
    if not total:
        return None
    piece_rows = max(piece_rows, -(-total // MOST_BLOCKS))
    fields = [df.schema[k] for k in keys]
    # at most total / piece_rows keys have a whole piece or more, which is MOST_BLOCKS or less
    pieces = {tuple(r[k] for k in keys): -(-r["__n"] // piece_rows) for r in counts.where(F.col("__n") > max(hot_rows, piece_rows)).collect()}
    if not pieces:
        return None
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    out = []
    # keys with like numbers of pieces share one grid of quantiles
    for step in sorted({n.bit_length() for n in pieces.values()}):
        most = 1 << step
        named = spark.createDataFrame([k for k, n in pieces.items() if n.bit_length() == step], schema)
        grid = [i / most for i in range(1, most)]
        of = df.where(F.col(order).isNotNull()).join(F.broadcast(named), list(keys))
        got = of.groupBy(*keys).agg(F.percentile_approx(F.col(order).cast("double"), grid, 8 * most).alias("__g")).collect()
        for r in got:
            bounds = sorted(set(r["__g"]))
            out.append((*(r[k] for k in keys), [bounds[i : i + FAN] for i in range(0, len(bounds), FAN)]))
    return spark.createDataFrame(out, T.StructType([*schema.fields, T.StructField("__bounds", T.ArrayType(T.ArrayType(T.DoubleType())))]))


def with_block(df: DataFrame, bounds: DataFrame | None, keys: Sequence[str], order: str, name: str = BLOCK) -> DataFrame:
    """Add the block number: 1 and how many of the key's bounds lie below the order value for hot keys, 0 for all others."""
    if bounds is None:
        return df.withColumn(name, F.lit(0))
    value = F.col(order).cast("double")
    group = F.size(F.filter("__bounds", lambda g: g[0] < value))
    inside = F.size(F.filter(F.get("__bounds", group - 1), lambda b: b < value))
    place = F.when(group > 0, (group - 1) * FAN + inside).otherwise(0) + 1
    joined = df.join(F.broadcast(bounds), list(keys), "left")
    return joined.withColumn(name, F.when(F.col("__bounds").isNull(), F.lit(0)).otherwise(F.coalesce(place, F.lit(1))).cast("int")).drop("__bounds")


def neighbours(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], lag: dict[str, str] | None = None, lead: dict[str, str] | None = None, block: str = BLOCK, hot: bool = True
) -> DataFrame:
    """lag/lead by one row over (keys, order) without gathering a hot key in one task.

    lag and lead map a new column to the column it looks at. Within a block an ordinary window answers; the first and last row of a block
    look at what the block before or after hands over, by a table with one row for each block of a hot key.
    """
    lag, lead = lag or {}, lead or {}
    inner = Window.partitionBy(*keys, block).orderBy(*order) if hot else Window.partitionBy(*keys).orderBy(*order)
    out = df
    if hot:
        at = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)])
        edges = df.where(F.col(block) > 0).groupBy(*keys, block).agg(
            F.max_by(F.struct(F.lit(1).alias("__one"), *[F.col(old).alias(f"__x_{new}") for new, old in lag.items()]), at).alias("__end"),
            F.min_by(F.struct(F.lit(1).alias("__one"), *[F.col(old).alias(f"__x_{new}") for new, old in lead.items()]), at).alias("__begin"),
        )
        along = Window.partitionBy(*keys).orderBy(block)
        edges = edges.select(*keys, block, F.lag("__end").over(along).alias("__from_before"), F.lead("__begin").over(along).alias("__from_after"))
        out = out.withColumn("__first", F.row_number().over(inner) == 1).withColumn("__last", F.lead(F.lit(1)).over(inner).isNull())
    for new, old in lag.items():
        out = out.withColumn(f"__in_{new}" if hot else new, F.lag(old).over(inner))
    for new, old in lead.items():
        out = out.withColumn(f"__in_{new}" if hot else new, F.lead(old).over(inner))
    if not hot:
        return out
    out = out.join(F.broadcast(edges), [*keys, block], "left")
    for new in lag:
        out = out.withColumn(new, F.when(F.col("__first"), F.col(f"__from_before.__x_{new}")).otherwise(F.col(f"__in_{new}")))
    for new in lead:
        out = out.withColumn(new, F.when(F.col("__last"), F.col(f"__from_after.__x_{new}")).otherwise(F.col(f"__in_{new}")))
    return out.drop("__first", "__last", "__from_before", "__from_after", *[f"__in_{n}" for n in (*lag, *lead)])


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str, block: str = BLOCK, hot: bool = True) -> DataFrame:
    """row_number from 1 over (keys, order), hot keys included: number within the block plus the rows of the blocks before."""
    if not hot:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    inner = Window.partitionBy(*keys, block).orderBy(*order)
    sizes = df.where(F.col(block) > 0).groupBy(*keys, block).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__off", F.sum("__n").over(before)).select(*keys, block, "__off")
    return (
        df.withColumn("__rn", F.row_number().over(inner))
        .join(F.broadcast(offsets), [*keys, block], "left")
        .withColumn(name, F.col("__rn") + F.coalesce(F.col("__off"), F.lit(0)))
        .drop("__rn", "__off")
    )


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column, name: str, how: str, current: bool = True, block: str = BLOCK, hot: bool = True
) -> DataFrame:
    """Running 'sum', 'max' or 'last' (of non-null values) over (keys, order), hot keys included: within the block, joined with what the blocks
    before give. `current` says whether a row sees itself."""
    aggregate = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    if not hot:
        plain = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
        return df.withColumn(name, aggregate(value).over(plain))
    rows = df.withColumn("__value", value)
    inner = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    whole = F.max_by("__value", F.when(F.col("__value").isNotNull(), F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)]))) if how == "last" else aggregate("__value")
    blocks = rows.where(F.col(block) > 0).groupBy(*keys, block).agg(whole.alias("__whole"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("__carried", aggregate("__whole").over(before)).select(*keys, block, "__carried")
    out = rows.withColumn("__own", aggregate("__value").over(inner)).join(F.broadcast(carried), [*keys, block], "left")
    if how == "sum":
        both = F.when(F.col("__own").isNull() & F.col("__carried").isNull(), F.lit(None)).otherwise(F.coalesce("__own", F.lit(0)) + F.coalesce("__carried", F.lit(0)))
    else:
        both = F.greatest("__own", "__carried") if how == "max" else F.coalesce("__own", "__carried")
    return out.withColumn(name, both).drop("__value", "__own", "__carried")


def blocked(df: DataFrame, keys: Sequence[str], order: str, hot_rows: int = HOT_ROWS, piece_rows: int = PIECE_ROWS) -> tuple[DataFrame, bool]:
    """df with its block numbers, by bounds found in df itself, and whether any key is hot."""
    bounds = hot_bounds(df.select(*keys, order), keys, order, hot_rows, piece_rows)
    return with_block(df, bounds, keys, order), bounds is not None
