"""Ordered operators over hot keys agree with brute force, whatever the block size."""

import random

import pytest
from pyspark.sql import functions as F

from stenoflow.operators.blocks import hot_bounds, neighbours, ranked, running, with_block
from stenoflow.operators.periods import periods_and_gaps


def brute(rows):
    by = {}
    for k, s, e in rows:
        if k is not None and s is not None and e is not None and e > s:
            by.setdefault(k, set()).add((s, e))
    out = set()
    for k, spans in by.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {("period", k, s, e) for s, e in merged} | {("gap", k, a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("hot", [10**9, 5])
def test_periods(spark, hot):
    rng = random.Random(4)
    rows = []
    for _ in range(400):
        k = rng.choice(["hot"] * 6 + list("abc") + [None])
        s = rng.choice([None] + [rng.randrange(0, 3000)] * 20)
        e = None if s is None or rng.random() < 0.05 else s + rng.choice([0, -3, 1, 5, 5, 20, 200])
        rows.append((k, s, e))
    rows += rows[:40]
    df = spark.createDataFrame(rows, "key string, begin_cs long, end_cs long").withColumn("__s", F.lit("clash")).withColumn("kind", F.lit(1))
    got = periods_and_gaps(df, ["key"], hot_rows=hot, piece_rows=7).collect()
    assert {tuple(r) for r in got} == brute(rows)
    assert len(got) == len(brute(rows))


def test_periods_of_nothing(spark):
    empty = spark.createDataFrame([], "key string, begin_cs long, end_cs long")
    assert periods_and_gaps(empty, ["key"]).collect() == []
    touching = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("a", 2, 3), ("a", 5, 6)], "key string, begin_cs long, end_cs long")
    assert {tuple(r) for r in periods_and_gaps(touching, ["key"]).collect()} == {("period", "a", 1, 3), ("gap", "a", 3, 5), ("period", "a", 5, 6)}


def test_rank_and_neighbours(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else "cold", rng.randrange(50), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, id long")
    bounds = hot_bounds(df, ["k"], "t", hot_rows=10, piece_rows=20)
    assert bounds.count() == 2 and hot_bounds(df, ["k"], "t") is None
    cut = with_block(df, bounds, ["k"], "t")
    order = [F.col("t"), F.col("id")]
    got = neighbours(ranked(cut, ["k"], order, "n"), ["k"], order, lag={"before": "id"}, lead={"after": "id"}).collect()
    assert len({r["__block"] for r in got}) > 5
    for key in ("hot", "cold"):
        mine = sorted((t, i) for k, t, i in rows if k == key)
        want = {i: (n, mine[n - 2][1] if n > 1 else None, mine[n][1] if n < len(mine) else None) for n, (_, i) in enumerate(mine, 1)}
        assert {r["id"]: (r["n"], r["before"], r["after"]) for r in got if r["k"] == key} == want


@pytest.mark.parametrize("current", [True, False])
def test_running(spark, current):
    rng = random.Random(8)
    rows = [("hot" if i % 3 else "cold", rng.randrange(60), i, rng.choice([None, *range(9)])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, id long, v long")
    cut = with_block(df, hot_bounds(df, ["k"], "t", hot_rows=10, piece_rows=20), ["k"], "t")
    order = [F.col("t"), F.col("id")]
    out = cut
    for how in ("sum", "max", "last"):
        out = running(out, ["k"], order, F.col("v"), how, how, current)
    got = {r["id"]: (r["sum"], r["max"], r["last"]) for r in out.collect()}
    for key in ("hot", "cold"):
        seen = []
        for _, i, v in sorted(((t, i, v) for k, t, i, v in rows if k == key), key=lambda x: x[:2]):
            now = seen + [v] if current else seen
            known = [x for x in now if x is not None]
            assert got[i] == ((sum(known), max(known), known[-1]) if known else (None, None, None))
            seen = seen + [v]


def test_many_hot_keys_with_many_pieces(spark):
    """More hot keys, and more pieces of a key, than one group of bounds has."""
    rows = [(k, t, t) for k in range(300) for t in range(12)] + [(1000, t // 2, t) for t in range(2500)] + [(1000, None, -1), (None, 3, 5)]
    df = spark.createDataFrame(rows, "k int, t long, id long")
    bounds = hot_bounds(df, ["k"], "t", hot_rows=10, piece_rows=3)
    assert bounds.count() == 301
    cut = with_block(df, bounds, ["k"], "t")
    order = [F.col("t"), F.col("id")]
    got = neighbours(ranked(cut, ["k"], order, "n"), ["k"], order, lag={"before": "id"}, lead={"after": "id"}).where("k is not null").collect()
    assert max(r["__block"] for r in got) > 256
    for key in (0, 299, 1000):
        mine = sorted(((t is not None, t or 0, i) for k, t, i in rows if k == key))
        want = {i: (n, mine[n - 2][2] if n > 1 else None, mine[n][2] if n < len(mine) else None) for n, (_, _, i) in enumerate(mine, 1)}
        assert {r["id"]: (r["n"], r["before"], r["after"]) for r in got if r["k"] == key} == want


def test_plain_windows_agree(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 3), ("a", 2, 4)], "k string, t long, id long")
    assert hot_bounds(df, ["k"], "t") is None
    rows = with_block(df, None, ["k"], "t")
    order = [F.col("t"), F.col("id")]
    for hot in (True, False):
        out = neighbours(running(ranked(rows, ["k"], order, "n", hot=hot), ["k"], order, F.col("id"), "s", "sum", hot=hot), ["k"], order, lag={"b": "id"}, lead={"c": "id"}, hot=hot)
        assert {r["id"]: (r["n"], r["s"], r["b"], r["c"]) for r in out.collect()} == {1: (1, 1, None, 2), 2: (2, 3, 1, 4), 4: (3, 7, 2, None), 3: (1, 3, None, None)}
