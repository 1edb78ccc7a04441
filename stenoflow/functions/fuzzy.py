"""Fuzzy string measures, 0 to 100, as plain functions and as Arrow UDFs.

ratio is the share of letters in the longest common subsequence; partial_ratio the best ratio of the shorter text against a window of the
longer one; token_set_ratio compares the words that both have with what each has beyond them. All are computed on code points.
"""

from __future__ import annotations

from collections.abc import Callable

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _masks(a: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(a):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


def _lcs(masks: dict[str, int], n: int, b: str) -> int:
    """Length of the longest common subsequence, with one bit for each letter of the first text."""
    full = (1 << n) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = (row + hit | row - hit) & full
    return n - row.bit_count()


def ratio(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    return 200.0 * _lcs(_masks(a), len(a), b) / (len(a) + len(b))


def ratios(a: str, many: list[str]) -> list[float]:
    """The ratio of one text with each of many."""
    masks, n = _masks(a), len(a)
    return [200.0 * _lcs(masks, n, b) / (n + len(b)) if n or b else 100.0 for b in many]


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with any window of its length, or any shorter prefix or suffix, of the longer one."""
    return partial_alignment(a, b)[0]


def partial_alignment(a: str, b: str) -> tuple[float, int, int]:
    """The best score with the window's place in the longer text; of equal scores the first window."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n, m = len(short), len(long)
    if not n:
        return (100.0 if not m else 0.0), 0, 0
    masks = _masks(short)
    at = long.find(short)
    if at >= 0:
        return 100.0, at, at + n
    best = (0.0, 0, min(n, m))
    letters = set(short)
    windows = [(0, i) for i in range(1, n)] + [(i, i + n) for i in range(m - n + 1)] + [(i, m) for i in range(m - n + 1, m)]
    for s, e in windows:
        # a window that ends, or a suffix that begins, with a letter the short text lacks is never better than its neighbour
        if (e < m or s == 0) and long[e - 1] not in letters or e == m and s and long[s] not in letters:
            continue
        if 200.0 * min(n, e - s) / (n + e - s) <= best[0]:
            continue
        score = 200.0 * _lcs(masks, n, long[s:e]) / (n + e - s)
        if score > best[0]:
            best = (score, s, e)
    return best


def partial_ratio_from(a: str, b: str, least: float) -> float:
    """partial_ratio where it reaches `least`, 0 otherwise: only windows that have letters enough in common are measured."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n, m = len(short), len(long)
    if not n or short in long:
        return 100.0 if n or not m else 0.0
    if least > 200.0 * (n - 1) / (2 * n - 1):  # only an equal window has more than all letters but one
        return 0.0
    begin = np.concatenate((np.zeros(n - 1, dtype=int), np.arange(m - n + 1), np.arange(m - n + 1, m)))
    end = np.concatenate((np.arange(1, n), np.arange(n, m + 1), np.full(n - 1, m)))
    codes, common = np.frombuffer(long.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.zeros(len(begin), dtype=int)
    for ch, k in Counter(short).items():
        seen = np.concatenate(([0], np.cumsum(codes == ord(ch))))
        common += np.minimum(k, seen[end] - seen[begin])
    bound = 200.0 * common / (n + end - begin)
    masks, best = _masks(short), 0.0
    for i in np.argsort(-bound, kind="stable"):
        if bound[i] < least or bound[i] <= best:
            break
        best = max(best, 200.0 * _lcs(masks, n, long[begin[i] : end[i]]) / (n + int(end[i] - begin[i])))
    return best if best >= least else 0.0


def token_set_ratio(a: str, b: str) -> float:
    """Words split at white space; the case counts."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_x or not only_y):
        return 100.0
    base, left, right = " ".join(both), " ".join(only_x), " ".join(only_y)
    joined_left, joined_right = (base + " " + left).strip(), (base + " " + right).strip()
    scores = [ratio(joined_left, joined_right)]
    if base:
        scores += [ratio(base, joined_left), ratio(base, joined_right)]
    return max(scores)


class WordSets:
    """Texts by number, and which of them can reach a token set ratio with another text: none that does is left out.

    A text's distinct words have the same letters in any order, so the letters that two texts have in common bound how well their words agree;
    words that both have, set against all of one text's, give the other terms of the ratio. Letters are counted by `least`, 0 to 100.
    """

    def __init__(self) -> None:
        self.n, self.place, self.letters, self.sizes = 0, {}, np.zeros((64, 256), dtype=np.int16), np.zeros(256, dtype=np.int32)
        self.words: dict[str, list[int]] = {}

    @staticmethod
    def _count(text: str) -> tuple[set[str], Counter, int]:
        words = set(text.split())
        joined = " ".join(words)
        return words, Counter(joined), len(joined)

    def put(self, text: str, i: int | None = None, before: str = "") -> None:
        """Text as number i, where `before` was, or as the next number."""
        words, letters, size = self._count(text)
        if i is None:
            i, self.n = self.n, self.n + 1
            if i == self.letters.shape[1]:
                self.letters, self.sizes = np.hstack((self.letters, np.zeros_like(self.letters))), np.hstack((self.sizes, np.zeros_like(self.sizes)))
        else:
            for w in set(before.split()):
                self.words[w].remove(i)
            self.letters[:, i] = 0
        for ch, k in letters.items():
            row = self.place.setdefault(ch, len(self.place))
            if row == len(self.letters):
                self.letters = np.vstack((self.letters, np.zeros_like(self.letters)))
            self.letters[row, i] = min(k, 32_767)
        for w in words:
            self.words.setdefault(w, []).append(i)
        self.sizes[i] = size

    def reach(self, text: str) -> np.ndarray:
        """For each number, a ratio that the text's token set ratio with it does not pass."""
        words, letters, size = self._count(text)
        sizes = self.sizes[: self.n]
        if not words or not self.n:
            return np.zeros(self.n)
        known = [(self.place[ch], min(k, 32_767)) for ch, k in letters.items() if ch in self.place]
        common = np.zeros(self.n, dtype=np.int32)
        for row, k in known:
            common += np.minimum(self.letters[row, : self.n], np.int16(k))
        # counts beyond the letters' type make no bound
        if max(letters.values()) >= 32_767:
            common[:] = size
        held, shared = [self.words[w] for w in words if w in self.words], np.zeros(self.n)
        if held:
            weights = np.repeat([len(w) + 1 for w in words if w in self.words], [len(x) for x in held])
            shared = np.maximum(0, np.bincount(np.concatenate(held).astype(np.int64), weights, self.n) - 1)
        shorter = np.maximum(1, np.minimum(size, sizes))
        return np.where(sizes == 0, 0.0, np.maximum(200.0 * common / np.maximum(1, size + sizes), 200.0 * shared / (shared + shorter)))


def column(measure: Callable[[str, str], float]):
    """A measure as an Arrow UDF of two string columns; null if either is null. Equal pairs of a batch are computed once."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for x, y in zip(a, b):
            if x is None or y is None:
                out.append(None)
                continue
            if (x, y) not in known:
                known[x, y] = measure(x, y)
            out.append(known[x, y])
        return pd.Series(out, dtype="float64")

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.DoubleType())
