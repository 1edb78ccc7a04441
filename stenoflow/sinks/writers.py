"""Sinks: job state, JSON, appended lines, frequency lists and deliveries with a second way."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def put_json(text: str, path: str) -> None:
    """K1: a file is replaced as a whole or not at all, by writing beside it and renaming."""
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    handle, beside = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(beside, path)
    except BaseException:
        if os.path.exists(beside):
            os.remove(beside)
        raise


def write_json(rows: DataFrame, folder: str, by: str | None = None) -> None:
    """K2: rows as JSON, in a folder for each value of `by`; only the values that are written are replaced."""
    rows.sparkSession.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(folder)


def append_lines(rows: DataFrame, folder: str) -> None:
    """K6: one JSON record a line, appended."""
    rows.write.mode("append").json(folder)


def write_frequency_list(words: DataFrame, folder: str, word: str = "word", count: str = "n") -> None:
    """K7: lines 'word<TAB>count', the most frequent first, equals in the alphabet's order."""
    ordered = words.orderBy(F.desc(count), word).select(F.concat_ws("\t", word, F.col(count).cast("string")).alias("value"))
    ordered.write.mode("overwrite").text(folder)


def delete_job(status: str, remove: Callable[[], None]) -> None:
    """Refused while a job waits or runs."""
    if status in ("queued", "running"):
        raise ValueError("a job that waits or runs cannot be deleted")
    remove()


def deliver(rows: DataFrame, first: Callable[[dict], None], second: Callable[[dict], None]) -> DataFrame:
    """Each row through `first`, and through `second` on any error, in the executors; rows (id, via, fallback_reason).

    `via` is null where both fail. The reason is cut to 200 characters.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                reason = None
                try:
                    first(row)
                    via = "first"
                except Exception as e:  # noqa: BLE001 - any error means the other way
                    reason = str(e)[:200]
                    try:
                        second(row)
                        via = "second"
                    except Exception as again:  # noqa: BLE001
                        via, reason = None, f"{reason}; {again}"[:200]
                out.append((row["id"], via, reason))
            yield pd.DataFrame(out, columns=["id", "via", "fallback_reason"])

    return rows.mapInPandas(run, "id string, via string, fallback_reason string")
