"""Best matches by a fuzzy measure: rank all candidates of a block first, then filter, so that a second-best never takes a place."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fuzzy


#: Vocabulary words that are sent to the tasks at a time.
BLOCK = 50_000


def nearest_words(words: DataFrame, vocabulary: DataFrame, k: int, cutoff: float) -> DataFrame:
    """Rows (word, key, right_word, right_key, score, rank): the k best-scoring entries of a vocabulary for each word, ties in the alphabet's
    order; those under the cutoff are dropped after ranking.

    words: (word, key), vocabulary: (right_word, right_key); the keys are compared. The vocabulary goes out in blocks of a fixed size, and each
    task keeps its k best of a block, so that pairs are never rows.
    """
    blocks = max(1, -(-vocabulary.count() // BLOCK))
    out = None
    for b in range(blocks):
        part = sorted(map(tuple, vocabulary.where(F.pmod(F.xxhash64("right_word"), F.lit(blocks)) == b).select("right_word", "right_key").distinct().collect()))
        if not part:
            continue

        def run(batches: Iterator[pd.DataFrame], part=part) -> Iterator[pd.DataFrame]:
            keys = [p[1] for p in part]
            for pdf in batches:
                rows = []
                for word, key in zip(pdf["word"], pdf["key"]):
                    scores = fuzzy.ratios(key, keys)
                    best = sorted(range(len(part)), key=lambda i: (-scores[i], part[i][0]))[:k]
                    rows += [(word, key, *part[i], scores[i]) for i in best]
                yield pd.DataFrame(rows, columns=["word", "key", "right_word", "right_key", "score"])

        near = words.select("word", "key").mapInPandas(run, "word string, key string, right_word string, right_key string, score double")
        out = near if out is None else out.unionByName(near)
    if out is None:
        out = words.select("word", "key", F.lit("").alias("right_word"), F.lit("").alias("right_key"), F.lit(0.0).alias("score")).limit(0)
    return top_k(out, ["word"], k, ["right_word"], cutoff)


def top_k(pairs: DataFrame, by: list[str], k: int, ties: list[str], cutoff: float = 0.0) -> DataFrame:
    """The k best-scoring pairs of each `by`, ties by the given columns; those under the cutoff are dropped after ranking."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), *ties)
    return pairs.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (F.col("score") >= cutoff))


def overlap_join(a: DataFrame, b: DataFrame, by: list[str], bucket: float, a_from: str, a_to: str, b_from: str, b_to: str) -> DataFrame:
    """Pairs of intervals of a key that overlap: both sides are split into time buckets, so that the join is an equi-join and no pair of a
    key that is far apart is ever formed. A pair is given once, by the bucket in which its overlap begins."""
    cut = lambda df, s, e: df.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(s) / bucket).cast("long"), F.floor(F.col(e) / bucket).cast("long"))))
    left = cut(a.where(F.col(a_to) > F.col(a_from)), a_from, a_to)
    right = cut(b.where(F.col(b_to) > F.col(b_from)), b_from, b_to)
    both = left.join(right, [*by, "__bucket"])
    hit = (F.col(a_from) < F.col(b_to)) & (F.col(a_to) > F.col(b_from))
    return both.where(hit & (F.col("__bucket") == F.floor(F.greatest(a_from, b_from) / bucket).cast("long"))).drop("__bucket")
