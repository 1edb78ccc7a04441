"""Order-dependent folds over the rows of one meeting, streamed: rows arrive sorted and only the current state is kept.

Each fold is a small state machine: feed(row) gives the finished results, close() the last ones. `fold` runs one per key over partitions
that hold whole keys sorted within, so no key is ever gathered in memory; a key's rows pass one task, as its order demands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame


def fold(df: DataFrame, by: Sequence[str], order: Sequence[Column], machine: Callable[[], object], schema: str, batch: int = 10_000) -> DataFrame:
    """The results of `machine` for each key. df: the columns the machine reads, with the keys. Null keys are keys of their own."""
    keys = list(by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, out = None, None, []
        for pdf in batches:
            names = list(pdf.columns)
            at = [names.index(k) for k in keys]
            for row in pdf.itertuples(index=False, name=None):
                key = tuple(None if pd.isna(row[i]) else row[i] for i in at)
                if state is None or key != now:
                    if state is not None:
                        out += [(*now, *r) for r in state.close()]
                    now, state = key, machine()
                out += [(*now, *r) for r in state.feed(dict(zip(names, row)))]
                if len(out) >= batch:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        if state is not None:
            out += [(*now, *r) for r in state.close()]
        if out:
            yield pd.DataFrame(out, columns=columns)

    columns = [c.strip().split(" ")[0] for c in schema.split(",")]
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


class CappedTurns:
    """Turns of one speaker with at most `gap` seconds between segments; a turn that has lasted `cap` seconds takes no more."""

    def __init__(self, gap: float = 2.0, cap: float = 90.0):
        self.gap, self.cap, self.n, self.turn = gap, cap, -1, None

    def feed(self, row: dict) -> list[tuple]:
        t = self.turn
        who = row["speaker"] or "S?"
        if t and t["who"] == who and row["start"] - t["end"] <= self.gap and t["end"] - t["start"] < self.cap:
            t["end"], t["last"], t["count"] = row["end"], row["seg_idx"], t["count"] + 1
            t["chars"] += 1 + len(row["text"] or "")
            if row["lang"] not in t["langs"]:
                t["langs"].append(row["lang"])
            return []
        done = self.close()
        self.n += 1
        self.turn = {"who": who, "start": row["start"], "end": row["end"], "first": row["seg_idx"], "last": row["seg_idx"], "count": 1, "chars": len(row["text"] or ""), "langs": [row["lang"]]}
        return done

    def close(self) -> list[tuple]:
        t, self.turn = self.turn, None
        return [(self.n, t["who"], t["start"], t["end"], t["first"], t["last"], t["count"], t["chars"], "/".join(x or "" for x in t["langs"]))] if t else []


class Chunks:
    """Rows packed in order into chunks of `limit` characters, each row counting `extra` more; a chunk begins with the last row of the one before."""

    def __init__(self, limit: int = 15_000, extra: int = 30):
        self.limit, self.extra, self.chunk, self.size, self.members, self.last = limit, extra, 0, 0, 0, None

    def feed(self, row: dict) -> list[tuple]:
        size = int(row["chars"]) + self.extra
        out = []
        if self.members and self.size + size > self.limit:
            self.chunk += 1
            self.size, self.members = self.last[1], 1
            out.append((self.chunk, self.last[0], True))
        out.append((self.chunk, row["seg_idx"], False))
        self.size, self.members, self.last = self.size + size, self.members + 1, (row["seg_idx"], size)
        return out

    def close(self) -> list[tuple]:
        return []


class MergedGroups:
    """Neighbouring groups merged while their joint size stays within half the limit; a merged group has no topic of its own."""

    def __init__(self, limit: int = 15_000):
        self.half, self.group, self.size, self.topic = limit // 2, -1, 0, None

    def feed(self, row: dict) -> list[tuple]:
        size = int(row["size"])
        if self.group >= 0 and self.size + size <= self.half:
            self.size, merged = self.size + size, True
        else:
            self.group, self.size, merged = self.group + 1, size, False
        return [(self.group, row["island"], row["bed"] if not pd.isna(row["bed"]) else None, size, merged)]

    def close(self) -> list[tuple]:
        return []


class Leaders:
    """Near-duplicates by the first leader in order that is similar enough; a newcomer with a longer quote takes over the leader's place.

    `index` (as fuzzy.WordSets) keeps the leaders' texts by number and tells how similar each can be at most, so that only those that can reach
    `least` are measured; without it all are. A text seen before is measured again only with the leaders that changed since.
    """

    def __init__(self, similar: Callable[[str, str], float], least: float = 85.0, text: str = "text", quote: str = "quote", key: str = "item", index: object = None):
        self.similar, self.least, self.text, self.quote, self.key, self.leaders, self.index = similar, least, text, quote, key, [], index
        self.changed: list[int] = []
        self.known: dict[str, tuple[int, int]] = {}

    def _first(self, text: str, begin: int = 0) -> int | None:
        if self.index is None:
            places = range(begin, len(self.leaders))
        else:
            places = (np.flatnonzero(self.index.reach(text)[begin:] >= self.least - 1e-6) + begin).tolist()
        return next((i for i in places if self.similar(text, self.leaders[i][0]) >= self.least), None)

    def _leader(self, text: str) -> int | None:
        if text not in self.known:
            return self._first(text)
        at, then = self.known[text]
        since = sorted({i for i in self.changed[then:] if i <= at})
        for i in since:
            if self.similar(text, self.leaders[i][0]) >= self.least:
                return i
        return at if at not in since else self._first(text, at + 1)

    def feed(self, row: dict) -> list[tuple]:
        text, quote = row[self.text] or "", row[self.quote] or ""
        i = self._leader(text)
        if i is None:
            i, took = len(self.leaders), True
            self.leaders.append((text, quote))
            if self.index is not None:
                self.index.put(text)
        elif took := len(quote) > len(self.leaders[i][1]):
            before = self.leaders[i][0]
            self.leaders[i] = (text, quote)
            if before != text:
                self.changed.append(i)
                if self.index is not None:
                    self.index.put(text, i, before)
        if self.similar(text, text) >= self.least:  # an empty text is like none, not even itself
            self.known[text] = (i, len(self.changed))
        return [(row[self.key], i, took)]

    def close(self) -> list[tuple]:
        return []
