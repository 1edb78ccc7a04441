"""A registry that keeps each query beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.oracle[f.__name__] = sql
            return f

        return add


def segments(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Segments by key, each delivered row counted once: repeated deliveries differ in nothing but loaded_at."""
    keep = ["meeting_id", "seg_idx", *[c for c in columns if c not in ("meeting_id", "seg_idx")]]
    return table(spark, sf_dir, "segment").select(*keep).dropDuplicates(["meeting_id", "seg_idx"])


def items(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Decisions or action items by key."""
    return table(spark, sf_dir, name).dropDuplicates(["meeting_id", "part_idx", "item_idx"])


#: The same two views in SQL, to begin a query with.
SEG = 'seg as (select * from (select *, row_number() over (partition by meeting_id, seg_idx order by loaded_at) as rn_ from segment) where rn_ = 1)'
DEC = "dec as (select distinct on (meeting_id, part_idx, item_idx) * from decision order by meeting_id, part_idx, item_idx)"
ACT = "act as (select distinct on (meeting_id, part_idx, item_idx) * from action_item order by meeting_id, part_idx, item_idx)"
