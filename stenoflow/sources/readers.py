"""Sources: uploads, JSON jobs, frequency lists, delimited and line formats, annotated sentences, configuration and model calls."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: media that may be uploaded
MEDIA = ("mp3", "wav", "m4a", "mp4", "mkv", "webm", "ogg", "flac", "aac", "mov", "avi", "wma", "opus", "3gp", "m4v", "mpg")


def uploads(spark: SparkSession, folder: str, most_bytes: int = 500 << 20) -> DataFrame:
    """Media files with a verdict; contents are not read, only names and sizes."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    verdict = F.when(~ext.isin(*MEDIA), "unsupported").when(F.col("length") > most_bytes, "too large").otherwise("accepted")
    return files.select("path", "length", ext.alias("extension"), verdict.alias("verdict"))


def jobs(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One JSON file per job, newest path first; files that are no JSON are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", True).json(folder).withColumn("path", F.col("_metadata.file_path")).orderBy(F.desc("path"))


def job(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """One job by id; an id that is not a plain name is refused before any path is built."""
    if not name.replace("-", "").replace("_", "").isalnum():
        raise ValueError("a job id has only letters, digits, '-' and '_'")
    return spark.read.schema(schema).option("multiLine", True).json(f"{folder}/{name}.json")


def config(defaults: dict, environ: dict[str, str] | None = None, parse: Callable[[str], object] = json.loads) -> dict:
    """Nested settings with overrides SECTION__KEY from the environment, values typed by `parse` or kept as text."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in defaults.items()}
    for name, value in (os.environ if environ is None else environ).items():
        section, _, key = name.lower().partition("__")
        if key and isinstance(out.get(section), dict):
            try:
                out[section][key] = parse(value)
            except ValueError:
                out[section][key] = value
    return out


def frequency_list(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Lines 'word count'; a missing or unreadable count is 1, blank lines are skipped."""
    lines = spark.read.option("header", False).text(path)
    if header:
        first = lines.limit(1).collect()
        lines = lines.where(F.col("value") != (first[0][0] if first else ""))
    parts = F.split(F.trim("value"), r"\s+")
    return lines.where(F.trim("value") != "").select(F.element_at(parts, 1).alias("word"), F.coalesce(F.expr("try_cast(try_element_at(split(trim(value), '\\\\s+'), 2) as bigint)"), F.lit(1)).alias("count"))


def csv_rows(spark: SparkSession, path: str, schema: str, most: int | None = None, order: str | None = None) -> DataFrame:
    """Delimited rows with a header; `most` rows in the order of a column, where a cap is asked for."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows if most is None else rows.orderBy(order).limit(most)


def json_lines(spark: SparkSession, path: str, schema: str, done: DataFrame | None = None, key: str = "id") -> DataFrame:
    """One record a line; records in `done` are left out, so that a job can be taken up again."""
    rows = spark.read.schema(schema).json(path)
    return rows if done is None else rows.join(done.select(key).distinct(), key, "left_anti")


def annotated_spans(lines: DataFrame) -> DataFrame:
    """Rows (doc, line_no, value) of token lines 'id<TAB>form<TAB>...<TAB>label' to spans (doc, span, text, category).

    Labels are B-x, I-x or anything else. A span begins with B, or with I where none is open; any other line ends it. The category is that of
    its first label.
    """
    label = F.element_at(F.split("value", "\t"), -1)
    token = F.col("value").rlike(r"^\d+\t") & label.rlike("^[BI]-")
    rows = lines.withColumn("token", token).withColumn("label", label).withColumn("form", F.get(F.split("value", "\t"), F.lit(1)))
    w = Window.partitionBy("doc").orderBy("line_no")
    begins = F.col("token") & (F.col("label").startswith("B-") | ~F.coalesce(F.lag("token").over(w), F.lit(False)))
    rows = rows.withColumn("begins", begins).withColumn("span", F.sum(F.col("begins").cast("int")).over(w)).where("token")
    part = F.array_sort(F.collect_list(F.struct("line_no", "form", "label")))
    return rows.groupBy("doc", "span").agg(part.alias("x")).select("doc", "span", F.array_join(F.transform("x", lambda t: t["form"]), " ").alias("text"), F.regexp_replace(F.element_at("x", 1)["label"], "^[BI]-", "").alias("category"))


def sentences(lines: DataFrame, least: int = 20, most: int = 200) -> DataFrame:
    """The sentences of '# text = ' lines, cleaned, of letters and common signs only and of a length in bounds."""
    text = F.trim(F.regexp_replace(F.regexp_replace("value", r"^# text = ", ""), r"\s+", " "))
    return lines.where(F.col("value").startswith("# text = ")).select(text.alias("sentence")).where(F.length("sentence").between(least, most) & F.col("sentence").rlike(r"^[\p{L}\p{N} ,.;:!?()'’\-–]+$"))


def model_rows(prompts: DataFrame, call: Callable[[str, float], str], schema: T.StructType, tries: int = 3) -> DataFrame:
    """Each (key, prompt) through a model that answers in JSON; typed rows (key, answer, attempts), answer null if all tries fail.

    The temperature is raised to 0.3 only after an answer that is no JSON. `call` runs on the executors.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, prompt in zip(pdf["key"], pdf["prompt"]):
                answer, used = None, 0
                for attempt in range(tries):
                    used = attempt + 1
                    got = call(prompt, 0.0 if attempt == 0 else 0.3)
                    try:
                        json.loads(got)
                    except (TypeError, ValueError):
                        continue
                    answer = got
                    break
                out.append((key, answer, used))
            yield pd.DataFrame(out, columns=["key", "raw", "attempts"])

    rows = prompts.mapInPandas(run, "key string, raw string, attempts int")
    return rows.select("key", F.from_json("raw", schema).alias("answer"), "attempts")
