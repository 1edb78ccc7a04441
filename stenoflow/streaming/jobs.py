"""Streams: a job queue worked in order, stage states kept across batches, windowed counts with late events, and turns that survive batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def queue(spark: SparkSession, folder: str, schema: str, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Files are worked first in, first out, one at a time. After a restart the batch that was under way is worked again, so `work`
    must give the same result for a batch it has seen."""
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)
    return files.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# fixed values: the order of a stage's states
STATES = ("pending", "running", "done", "error", "skipped")
STAGE_SCHEMA = "job string, stage string, status string, started double, seconds double"


def _stages(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, started = state.get if state.exists else ("pending", None)
    seconds = None
    for pdf in batches:
        for _, row in pdf.sort_values("at").iterrows():
            if row["status"] not in STATES or status in ("done", "skipped"):
                continue  # a stage that has ended does not begin again
            if row["status"] == "running":
                started = row["at"]
            elif row["status"] in ("done", "error") and started is not None:
                seconds = row["at"] - started
            status = row["status"]
    state.update((status, started))
    yield pd.DataFrame({"job": [key[0]], "stage": [key[1]], "status": [status], "started": [started], "seconds": [seconds]}).astype({"started": "float64", "seconds": "float64"})


def stage_states(events: DataFrame) -> DataFrame:
    """The state of each stage from a stream of (job, stage, status, at), kept from batch to batch."""
    return events.groupBy("job", "stage").applyInPandasWithState(_stages, STAGE_SCHEMA, "status string, started double", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """An extension of the inventory: counts by type and time window; events later than `late` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("from"), "event_type", "n")


def _sessions(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, gap: float) -> Iterator[pd.DataFrame]:
    begin, end, n = state.get if state.exists else (None, None, 0)
    out = []
    for pdf in batches:
        for t in sorted(pdf["t"]):
            if end is not None and t - end > gap:
                out.append((key[0], begin, end, n))
                begin, n = None, 0
            begin, end, n = (t if begin is None else begin), t, n + 1
    state.update((begin, end, n))
    yield pd.DataFrame(out, columns=["key", "begin", "end", "n"]).astype({"begin": "float64", "end": "float64", "n": "int64"})


def closed_sessions(events: DataFrame, gap: float) -> DataFrame:
    """Sessions of (key, t) that a pause of more than `gap` has closed; the open one of each key is kept for the next batch."""
    return events.groupBy("key").applyInPandasWithState(lambda k, b, s: _sessions(k, b, s, gap), "key string, begin double, end double, n long", "begin double, end double, n long", "append", GroupStateTimeout.NoTimeout)
