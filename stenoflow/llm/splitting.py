"""Problem 4: texts over a size limit cut into pieces under it, at natural boundaries, with some overlap.

Balanced targets: the least number of pieces gives equally spaced targets; each is moved to the strongest boundary near it, and if any
piece then exceeds the limit, one more piece is tried. Only texts over the limit leave the JVM.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 600, 60
#: Seconds a character takes to say where a segment has no valid end.
CHAR_SECONDS = 1 / 15
_SENTENCE = re.compile(r"(?:[.!?…]+[\"'»”)\]]*|\n)\s+(?=\S)|\n(?=\S)")
_CLAUSE = re.compile(r"[,;:–—]\s+(?=\S)|\s+-\s+(?=\S)")
_WORD = re.compile(r"\s+(?=\S)")
#: How far from its target a cut may move, as a share of the piece length, by strength of boundary.
_REACH = {"sentence": 0.5, "clause": 0.3, "word": 0.2}


def _boundaries(text: str) -> list[tuple[str, list[int]]]:
    return [(kind, [m.end() for m in rx.finditer(text)]) for kind, rx in (("sentence", _SENTENCE), ("clause", _CLAUSE), ("word", _WORD))]


def _joins(text: str, at: int) -> bool:
    """Whether a cut here would part a letter from its combining mark or joiner."""
    import unicodedata

    return 0 < at < len(text) and (unicodedata.combining(text[at]) > 0 or text[at] in "‍️" or text[at - 1] == "‍")


def _snap(text: str, kinds: list[tuple[str, list[int]]], target: int, low: int, high: int, each: float) -> int:
    """The strongest boundary near the target within [low, high]; without any, the target itself."""
    for kind, places in kinds:
        reach = each * _REACH[kind]
        i = bisect.bisect_left(places, target)
        near = [p for p in places[max(0, i - 1) : i + 1] if low <= p <= high and abs(p - target) <= reach]
        if near:
            return min(near, key=lambda p: (abs(p - target), p))
    # no boundary in reach: the nearest word end that is allowed at all, else the target
    words = kinds[-1][1]
    i = bisect.bisect_right(words, high) - 1
    if i >= 0 and words[i] >= low:
        return words[i]
    at = back = min(max(target, low), high)
    while back > low and _joins(text, back):
        back -= 1
    return back if back > low else at  # a run of marks longer than the piece is cut where it must be


def _back(text: str, words: list[int], cut_at: int, overlap: int, least: int) -> int:
    """Where the piece after a cut begins: at a word start at most `overlap` before it, after `least`."""
    i = bisect.bisect_left(words, max(cut_at - overlap, least + 1))
    if i < len(words) and words[i] < cut_at:
        return words[i]
    if i < len(words) and words[i] == cut_at and overlap and cut_at - overlap > least and text[cut_at - 1 : cut_at].isspace():
        at = cut_at - overlap  # one word longer than the overlap: repeat part of it
    else:
        at = max(cut_at - overlap, least + 1) if overlap else cut_at
    while at < cut_at and _joins(text, at):
        at += 1
    return at


def split_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(begin, end) of each piece, in code points. Pieces cover the text, each is at most `limit` long and begins up to `overlap` before the
    end of the one before it. A text within the limit is one piece; an empty one gives none.

    More pieces are added until all are within the limit. That ends: a cut misses its target by a few target lengths at most, whatever the
    boundaries, so that all targets are in reach once they are some times closer than limit - overlap; the tests try texts that ask for it.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    kinds = _boundaries(text)
    words = kinds[-1][1]
    count, tries = max(2, -(-(n - overlap) // (limit - overlap))), 0
    while True:
        each, out, begin, last = n / count, [], 0, 0
        for k in range(1, count):
            low, high = last + 1, min(n - 1, begin + limit)
            if low > high:
                break
            last = _snap(text, kinds, round(each * k), low, high, each)
            out.append((begin, last))
            begin = _back(text, words, last, overlap, out[-1][0])
        out.append((begin, n))
        if all(0 < e - b <= limit for b, e in out):
            return out
        # one piece more; for texts of thousands of pieces that fail again and again, a few percent more
        tries += 1
        count += 1 if tries <= 16 else max(1, count // 32)


def _pieces(limit: int, overlap: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for m, s, begin, end, text in pdf[["meeting_id", "seg_idx", "start", "end", "text"]].itertuples(index=False, name=None):
                points = split_points(text, limit, overlap)
                known = begin is not None and begin == begin
                pace = (end - begin) / len(text) if known and end is not None and end == end and end > begin else CHAR_SECONDS
                for i, (b, e) in enumerate(points):
                    rows.append((m, s, i, len(points), b, e, text[b:e], round(begin + b * pace, 2) if known else None))
            yield pd.DataFrame(rows, columns=["meeting_id", "seg_idx", "piece", "pieces", "begin_char", "end_char", "piece_text", "start_estimate"]).astype({"start_estimate": "float64"})

    return run


SCHEMA = "meeting_id string, seg_idx long, piece int, pieces int, begin_char int, end_char int, piece_text string, start_estimate double"


def split_long(segments: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every segment whose text has more than `limit` code points, in order, each with an estimated start.

    The estimate runs evenly from start to end; where the end is null or not after the start it assumes 15 characters a second; a null start
    gives a null estimate. Null, empty and short texts give no rows; repeated rows give their pieces once. Other columns are ignored.
    """
    long = segments.where(F.length("text") > limit).select("meeting_id", "seg_idx", "start", "end", "text")
    return long.mapInPandas(_pieces(limit, overlap), SCHEMA).dropDuplicates(["meeting_id", "seg_idx", "piece", "begin_char", "end_char", "piece_text"])
