"""Problem 8: items of varying length in containers of fixed capacity, by best-fit decreasing.

Best-fit decreasing looks only at sizes, and there are at most `capacity` different sizes. So the plan is made from the histogram of sizes:
a segment tree over remaining capacities finds the tightest open container for a whole run of equal items at once, which gives exactly the
containers that the document-by-document algorithm gives. Containers are kept as intervals of numbers with the same remaining space. The
plan has one row for each size, with its few intervals in order, and is broadcast; items are ranked within their size (hot sizes in blocks)
and look up their container in that row, so that no item meets more than one row.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.blocks import HOT_ROWS, PIECE_ROWS, hot_bounds, ranked, with_block
from ..session import cut

CAPACITY = 2048


class TightestFit:
    """Open containers by remaining capacity; a segment tree of counts finds the least remaining capacity that is enough."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size < capacity + 1:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.runs: dict[int, deque[tuple[int, int]]] = defaultdict(deque)

    def _add(self, remaining: int, n: int) -> None:
        i = self.size + remaining
        while i:
            self.count[i] += n
            i //= 2

    def push(self, remaining: int, first: int, n: int) -> None:
        if n > 0 and remaining > 0:
            self.runs[remaining].append((first, n))
            self._add(remaining, n)

    def take(self, remaining: int, n: int) -> list[tuple[int, int]]:
        """n containers of this remaining capacity, as runs of numbers."""
        out = []
        self._add(remaining, -n)
        while n:
            first, k = self.runs[remaining].popleft()
            use = min(k, n)
            out.append((first, use))
            if use < k:
                self.runs[remaining].appendleft((first + use, k - use))
            n -= use
        return out

    def find(self, need: int) -> int | None:
        """The least remaining capacity >= need with an open container, in logarithmic time."""
        i = self.size + need
        if not self.count[i]:
            while i and (i & 1 or not self.count[i + 1]):  # up, until a right sibling has something
                i //= 2
            if not i:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.size

    def open_in(self, remaining: int) -> int:
        return self.count[self.size + remaining]


def plan(sizes: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (size, rank_from, rank_to, first_container, each): items of this size with ranks in [from, to), `each` to a container, in turn."""
    tree, made, rows = TightestFit(capacity), 0, []
    for size in sorted((s for s in sizes if s > 0), reverse=True):
        left, rank = sizes[size], 0

        def put(runs: list[tuple[int, int]], each: int, remaining: int) -> None:
            nonlocal left, rank
            for first, n in runs:
                rows.append((size, rank, rank + n * each, first, each))
                rank += n * each
                left -= n * each
                tree.push(remaining - each * size, first, n)

        while left:
            remaining = tree.find(size)
            fresh = remaining is None
            if fresh:
                remaining = capacity
            fit = remaining // size
            whole, rest = divmod(left, fit)
            if not fresh:
                there = tree.open_in(remaining)
                whole, rest = min(whole, there), (rest if whole < there else 0)
            for n, each in ((whole, fit), (1 if rest else 0, rest)):
                if n:
                    if fresh:
                        put([(made, n)], each, remaining)
                        made += n
                    else:
                        put(tree.take(remaining, n), each, remaining)
    return rows


def pack(items: DataFrame, capacity: int = CAPACITY, hot_rows: int = HOT_ROWS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Rows (doc_id, part, parts, from_token, to_token, tokens, container) for items (doc_id, tokens).

    Only an item longer than the capacity is split: into full containers and one rest. Items with no tokens (or null) take no space and go to
    container 0. Containers count from 0. Repeated rows are items of their own; other columns are ignored; no items give no rows. Ranks go
    by doc_id and part, so the result is the same on every run for distinct doc_ids.
    """
    spark = items.sparkSession
    sized = items.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("__n"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("__n") / F.lit(capacity)).cast("int"))
    cutup = sized.select("doc_id", "__n", parts.alias("parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    begin = F.col("part").cast("long") * capacity
    rows = cut(
        cutup.select("doc_id", "part", "parts", begin.alias("from_token"), F.least(F.col("__n"), begin + capacity).alias("to_token")).withColumn("tokens", (F.col("to_token") - F.col("from_token")).cast("int"))
    )
    # at most capacity + 1 rows come to the driver
    sizes = {r["tokens"]: r["n"] for r in rows.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    made = plan(sizes, capacity)
    by_size: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    for size, *interval in made:
        by_size[size].append(tuple(interval))
    interval = T.StructType([T.StructField(n, T.LongType()) for n in ("from", "to", "container", "each")])
    schema = T.StructType([T.StructField("tokens", T.IntegerType()), T.StructField("__plan", T.ArrayType(interval))])
    table = spark.createDataFrame([(size, sorted(v)) for size, v in by_size.items()], schema)
    bounds = hot_bounds(rows.where("tokens > 0"), ["tokens"], "doc_id", hot_rows, piece_rows)
    placed = with_block(rows.where("tokens > 0"), bounds, ["tokens"], "doc_id")
    placed = ranked(placed, ["tokens"], [F.col("doc_id"), F.col("part")], "__rank", hot=bounds is not None)
    # ranks count from 1, the plan's from 0
    rank = F.col("__rank") - 1
    full = placed.join(F.broadcast(table), "tokens").withColumn("__in", F.get(F.filter("__plan", lambda x: (rank >= x["from"]) & (rank < x["to"])), F.lit(0)))
    full = full.withColumn("container", F.col("__in.container") + F.floor((rank - F.col("__in.from")) / F.col("__in.each")))
    columns = ["doc_id", "part", "parts", "from_token", "to_token", "tokens", "container"]
    return full.select(*columns).unionByName(rows.where("tokens = 0").withColumn("container", F.lit(0).cast("long")).select(*columns))


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: number of containers, tokens in them and share of space used. No containers give a null share."""
    per = packed.groupBy("container").agg(F.sum("tokens").alias("used"))
    return per.where("used > 0").agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), (F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("share_used"), F.max("used").alias("fullest"))
