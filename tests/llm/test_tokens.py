"""Token ids against the library, the round trip, and packing against the plain algorithm."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stenoflow.llm import packing, tokens

pytestmark = pytest.mark.skipif(not Path(tokens.TOKENIZER_DIR).exists(), reason="no tokenizer files")


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


TEXTS = ["Hello world, it's 12:30 - we'll see", "", None, "Больной на койке ２６ дышит  лучше\n\n", "   ", " 　x\t y", "<|endoftext|> ok", "a" * 5000, "ș̦ 😀👩‍👩‍👧 ½ № ", "'s 's'll don't", "да " * 700, "\x1c\x85 z"]


def test_ids(spark):
    t = library()
    rows = [(i, x) for i, x in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, "null id"), (0, "other text"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pos", F.lit("clash")).withColumn("word", F.lit("clash"))
    got = sorted(((r["doc_id"], tuple(r["ids"])) for r in tokens.encode(df).collect()), key=str)
    want = sorted({(i, tuple(t.encode(x, add_special_tokens=False).ids if x else [])) for i, x in rows}, key=str)
    assert got == want
    assert tokens.encode(df.limit(0)).collect() == []


def test_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(tokens, "HOT_WORDS", 3)
    t = library()
    rows = [(i, f"la patul {i} și la salonul {i * 7} vine cuvântul{i}") for i in range(30)]
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids for i, x in rows}


def test_round_trip(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS) if x is not None], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(df)).collect()}
    assert got == {i: x for i, x in enumerate(TEXTS) if x is not None}
    odd = spark.createDataFrame([(1, [99999]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in tokens.decode(odd).collect()} == {1: None, 2: None, 3: ""}


def best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in bins if r >= s]
        if fit:
            bins.remove(min(fit))
            bins.append(min(fit) - s)
        else:
            bins.append(capacity - s)
    return sorted(bins)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([7, 20, 50, 100])
        sizes = {rng.randint(1, capacity): rng.randint(1, 9) for _ in range(rng.randint(1, 25))}
        used, ranks = {}, {}
        for size, a, b, first, each in packing.plan(sizes, capacity):
            for r in range(a, b):
                used[first + (r - a) // each] = used.get(first + (r - a) // each, 0) + size
            ranks.setdefault(size, []).append((a, b))
        assert sorted(capacity - u for u in used.values()) == best_fit([s for s, n in sizes.items() for _ in range(n)], capacity)
        for size, n in sizes.items():
            edges = sorted(ranks[size])
            assert edges[0][0] == 0 and edges[-1][1] == n and all(x[1] == y[0] for x, y in zip(edges, edges[1:]))


@pytest.mark.parametrize("hot", [10**9, 5])
def test_pack(spark, hot):
    rng = random.Random(5)
    sizes = [rng.choice([30, 30, 30, rng.randint(0, 99), 250]) for _ in range(120)] + [None]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, tokens int").withColumn("container", F.lit("clash")).withColumn("part", F.lit(9))
    got = packing.pack(df, 100, hot_rows=hot, piece_rows=4).collect()
    fill = {}
    for r in got:
        assert r["to_token"] - r["from_token"] == r["tokens"] and (r["parts"] == 1 or sizes[r["doc_id"]] > 100)
        fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
    for i, n in enumerate(sizes):
        parts = sorted((r["from_token"], r["to_token"]) for r in got if r["doc_id"] == i)
        assert parts[0][0] == 0 and parts[-1][1] == (n or 0) and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
    items = [p for n in sizes for p in ([100] * ((n or 0) // 100) + ([(n or 0) % 100] if (n or 0) % 100 else []))]
    assert sorted(100 - u for u in fill.values() if u) == best_fit(items, 100)
    assert packing.pack(df.limit(0), 100).collect() == []
