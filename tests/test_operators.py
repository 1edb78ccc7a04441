"""As-of lookups, overlap joins, folds and vectors against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stenoflow.operators import bestmatch, folds, vectors
from stenoflow.operators.asof import asof_backward


@pytest.mark.parametrize("hot", [10**9, 5])
@pytest.mark.parametrize("tolerance", [None, 7.0])
def test_asof(spark, tolerance, hot):
    rng = random.Random(3)
    left = [(rng.choice(["a", "b", None]), rng.choice([None, *range(60)]), i) for i in range(120)]
    right = [(rng.choice(["a", "b", None]), rng.choice([None, *range(60)]), i) for i in range(60)]
    a = spark.createDataFrame(left, "k string, t int, id int").withColumn("v", F.lit("clash"))
    b = spark.createDataFrame(right, "k string, u int, v int")
    got = {r["id"]: r["w"] for r in asof_backward(a, b.withColumnRenamed("v", "w"), ["k"], "t", "u", ["w"], tolerance=tolerance, ahead=1.0, tie=["w"], hot_rows=hot, piece_rows=7).collect()}
    for k, t, i in left:
        fit = [(u, v) for rk, u, v in right if k is not None and rk == k and t is not None and u is not None and u <= t + 1]
        best = max(fit) if fit else None
        want = best[1] if best and (tolerance is None or t - best[0] <= tolerance) else None
        assert got[i] == want


def test_asof_of_nothing(spark):
    a = spark.createDataFrame([("x", 1)], "k string, t int")
    b = spark.createDataFrame([], "k string, u int, w int")
    assert asof_backward(a, b, ["k"], "t", "u", ["w"]).collect()[0]["w"] is None
    assert asof_backward(a.limit(0), b, ["k"], "t", "u", ["w"]).collect() == []


def test_overlap(spark):
    rng = random.Random(2)
    make = lambda n: [(rng.choice("ab"), float(s := rng.randrange(100)), float(s + rng.choice([0, 1, 5, 40])), i) for i in range(n)]
    a, b = make(60), make(60)
    got = bestmatch.overlap_join(spark.createDataFrame(a, "k string, s double, e double, i int"), spark.createDataFrame(b, "k string, s2 double, e2 double, j int"), ["k"], 10.0, "s", "e", "s2", "e2").select("i", "j").collect()
    want = {(x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[2] > x[1] and y[2] > y[1] and x[1] < y[2] and x[2] > y[1]}
    assert sorted(map(tuple, got)) == sorted(want)


def test_capped_turns(spark):
    rows = [("m", i, 10.0 * i, 10.0 * i + 9, "S1", "x", "ro") for i in range(15)] + [("m", 99, 500.0, 501.0, None, None, None)]
    df = spark.createDataFrame(rows, "meeting_id string, seg_idx long, start double, end double, speaker string, text string, lang string")
    got = folds.fold(df, ["meeting_id"], [F.col("start")], folds.CappedTurns, "meeting_id string, turn long, speaker string, turn_start double, turn_end double, first_seg long, last_seg long, segments long, chars long, langs string").orderBy("turn").collect()
    assert [(r["first_seg"], r["last_seg"]) for r in got] == [(0, 9), (10, 14), (99, 99)]
    assert got[2]["speaker"] == "S?"


def test_chunks_cover_all_rows(spark):
    rows = [("m", i, float(i), 400) for i in range(100)]
    got = folds.fold(spark.createDataFrame(rows, "meeting_id string, seg_idx long, start double, chars int"), ["meeting_id"], [F.col("start")], lambda: folds.Chunks(2000), "meeting_id string, chunk long, seg_idx long, overlap boolean").collect()
    assert sorted(r["seg_idx"] for r in got if not r["overlap"]) == list(range(100))
    by = {}
    for r in got:
        by.setdefault(r["chunk"], []).append(r)
    assert all(len(v) * 430 <= 2000 for v in by.values())
    assert all(sum(r["overlap"] for r in v) == (c > 0) for c, v in by.items())


def test_top_k(spark):
    rng = np.random.default_rng(1)
    e = rng.normal(size=(80, 6))
    e[40] = e[7]
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(e)], "id long, v array<double>")
    got = vectors.top_k(rows.where("id % 10 = 0"), rows, "id", "v", 4).collect()
    for q in range(0, 80, 10):
        sims = np.round(np.clip(e @ e[q], 0, 1), 6)
        want = sorted((i for i in range(80) if i != q), key=lambda i: (-sims[i], i))[:4]
        assert [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_spectral_clusters_find_groups():
    rng = np.random.default_rng(0)
    centers = np.eye(8)[:3]
    e = np.vstack([centers[i % 3] + rng.normal(scale=0.05, size=8) for i in range(60)])
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    assert vectors.cluster(e, fixed=3).tolist() == [i % 3 for i in range(60)]
    free = vectors.cluster(e)
    assert all(len({i % 3 for i in np.flatnonzero(free == c)}) == 1 for c in set(free)), "no cluster mixes two groups"
    assert vectors.cluster(e[:3]).tolist() == [0, 0, 0]


@pytest.mark.parametrize("chunk", [2048, 7])
def test_pruned_graph(spark, monkeypatch, chunk):
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    e = rng.normal(size=(50, 5))
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    group = [None if i % 7 == 0 else i % 2 for i in range(50)]
    rows = spark.createDataFrame([(g, i, [float(x) for x in v]) for i, (g, v) in enumerate(zip(group, e))] + [(0, 99, None)], "g int, id long, v array<double>")
    got = {(r["a"], r["b"]): round(r["w"], 6) for r in vectors.pruned_graph(rows, "g", "id", "v", 2).collect()}
    want = {}
    for i in range(50):
        mine = [j for j in range(50) if j != i and group[j] == group[i]]
        sims = {j: min(1.0, max(0.0, round(float(e[i] @ e[j]), 9))) for j in mine}
        for j in sorted(mine, key=lambda j: (-sims[j], j))[:2]:
            for pair in ((i, j), (j, i)):
                want[pair] = want.get(pair, 0) + sims[j] / 2
    assert got == {k: round(w, 6) for k, w in want.items() if w > 0}


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 2)
    centers = spark.createDataFrame([(i, [float(i == d) for d in range(5)]) for i in range(5)] + [(9, [1.0, 0.0, 0.0, 0.0, 0.0])], "label int, c array<double>")
    rows = spark.createDataFrame([(i, [float(i == d) + 0.1 for d in range(5)]) for i in range(5)] + [(7, None)], "id long, v array<double>")
    assert {r["id"]: r["label"] for r in vectors.nearest(rows, centers, "id", "v", "label", "c").collect()} == {i: i for i in range(5)}
    assert {r["label"] for r in vectors.nearest(rows, centers.limit(0), "id", "v", "label", "c").collect()} == {None}
