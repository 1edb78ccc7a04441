"""Functions over recognised speech that need a loop: repeated phrases, compression, word probabilities."""

from __future__ import annotations

import difflib
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONGEST_PHRASE = 8


def _surplus(ids: np.ndarray, n: int, most: int) -> np.ndarray:
    """Which words to drop so that no phrase of n words is said more than `most` times in a row.

    A phrase said k times is a stretch of (k-1)*n words or more that equal the word n places on. Such stretches are found at once, as runs of
    the comparison of the list with itself, n places apart; a stretch may begin within what the one before it took up.
    """
    drop = np.zeros(len(ids), dtype=bool)
    same = np.concatenate(([False], ids[n:] == ids[:-n], [False]))
    edges = np.flatnonzero(same[1:] != same[:-1])
    taken = 0
    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        begin = max(begin, taken)
        if end - begin >= n * most:
            taken = begin + n * ((end - begin) // n + 1)
            drop[begin + n * most : taken] = True
    return drop


def collapse_repeats(text: str | None, most: int = 2) -> str | None:
    """Phrases of 1 to 8 words said more than `most` times in a row are kept `most` times, until nothing changes; then syllable loops."""
    if text is None:
        return None
    words = np.array(text.split(), dtype=object)
    ids = pd.factorize(words)[0] if len(words) else np.zeros(0, dtype=int)
    size = -1
    while size != len(ids):
        size = len(ids)
        for n in range(1, LONGEST_PHRASE + 1):
            if len(ids) > n * most:
                keep = ~_surplus(ids, n, most)
                ids, words = ids[keep], words[keep]
    # fixed value: a syllable with its hyphen, four times or more
    return re.sub(r"(\b\w{1,3}-)\1{3,}", r"\1\1", " ".join(words))


def compression(text: str | None) -> float | None:
    """Bytes of the text for each byte of its compressed form."""
    if text is None:
        return None
    raw = text.encode()
    return len(raw) / max(1, len(zlib.compress(raw)))


def align_words(raw: list[tuple[str, float | None]] | None, final: str) -> list[tuple[str, float | None]]:
    """Probabilities of recognised words carried over to the words of a corrected text: equal words keep theirs, words that replace others
    get the least of them, new words get none."""
    words = final.split()
    bare = lambda w: re.sub(r"\W", "", w.lower())
    out: list[float | None] = [None] * len(words)
    if raw:
        blocks = difflib.SequenceMatcher(None, [bare(w) for w, _ in raw], [bare(w) for w in words], autojunk=False).get_opcodes()
        for kind, a1, a2, b1, b2 in blocks:
            if kind == "equal":
                out[b1:b2] = [p for _, p in raw[a1:a2]]
            elif kind == "replace":
                known = [p for _, p in raw[a1:a2] if p is not None]
                out[b1:b2] = [min(known) if known else None] * (b2 - b1)
    return list(zip(words, out))


@F.pandas_udf(T.StringType())
def collapsed(texts: pd.Series) -> pd.Series:
    return texts.map(collapse_repeats)


@F.pandas_udf(T.DoubleType())
def compression_ratio(texts: pd.Series) -> pd.Series:
    return texts.map(compression).astype("float64")


_WORD_P = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("p", T.DoubleType())]))


@F.pandas_udf(_WORD_P)
def aligned(word_conf: pd.Series, texts: pd.Series) -> pd.Series:
    out = []
    for raw, text in zip(word_conf, texts):
        pairs = [(r["word"], r["p"]) for r in raw] if raw is not None else None
        out.append([{"word": w, "p": p} for w, p in align_words(pairs, text or "")])
    return pd.Series(out)
