"""Queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import chars, language, packing, personal, splitting, tokens, truncation, turns


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (tab, rec_key, lang, text, lang_probs) of segments and documents."""
    segments = table(spark, sf_dir, "segment").select(F.lit("segment").alias("tab"), F.concat_ws("/", "meeting_id", "seg_idx").alias("rec_key"), "lang", "text", "lang_probs")
    documents = table(spark, sf_dir, "documents").select(F.lit("documents").alias("tab"), F.col("doc_id").cast("string").alias("rec_key"), "lang", "text")
    return segments.unionByName(documents, allowMissingColumns=True)


def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    labelled, totals = language.sample_and_totals(rows)
    return language.identify(rows, language.train(labelled, totals=totals))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.cases(_identified(spark, sf_dir)).select("tab", "rec_key", "lang")


def p1_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's languages, stretch by stretch, with their confidence."""
    return _identified(spark, sf_dir).distinct()


def _private_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.concat_ws("/", "meeting_id", "part_idx", "item_idx")
    return (
        personal.keyed(table(spark, sf_dir, "segment"), "segment", F.concat_ws("/", "meeting_id", "seg_idx"), "text", "meeting_id")
        .unionByName(personal.keyed(table(spark, sf_dir, "decision"), "decision", item, "evidence_quote", "meeting_id"))
        .unionByName(personal.keyed(table(spark, sf_dir, "action_item"), "action_item", item, "owner", "meeting_id"))
    )


def _names(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    people = table(spark, sf_dir, "participant")
    common = table(spark, sf_dir, "lexicon").select(F.col("word").alias("word")).unionByName(people.where("role is not null").select(F.explode(F.split("role", " ")).alias("word")))
    return personal.names(rows.select("text"), people, common.where("word is not null").distinct())


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _private_texts(spark, sf_dir)
    found = personal.found_kinds(rows, _names(spark, sf_dir, rows))
    return found.select(F.substring_index("rec_key", "|", 1).alias("tab"), F.substring_index("rec_key", "|", -1).alias("rec_key"), "kind")


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with placeholders, one row for each distinct (record, text)."""
    rows = _private_texts(spark, sf_dir)
    done = personal.redacted(rows, _names(spark, sf_dir, rows))
    return done.select(F.substring_index("rec_key", "|", 1).alias("tab"), F.substring_index("rec_key", "|", -1).alias("rec_key"), "clean_text", "kinds")


def p3_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms next to protected entities, with how strongly they disclose one."""
    rows = _private_texts(spark, sf_dir)
    return personal.disclosing_terms(rows.select("text"), personal.seed_names(table(spark, sf_dir, "participant")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = turns.speaker_turns(table(spark, sf_dir, "segment"), table(spark, sf_dir, "participant"))
    return found.select("meeting_id", "first_seg", "last_seg", "speaker")


def p2_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns with their cleaned text, times and forward-filled speaker."""
    return turns.filled(turns.speaker_turns(table(spark, sf_dir, "segment"), table(spark, sf_dir, "participant")))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_long(table(spark, sf_dir, "segment"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pieces(spark, sf_dir).select("meeting_id", "seg_idx").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment, runs = table(spark, sf_dir, "segment"), table(spark, sf_dir, "exp_asr")
    key = F.concat_ws("/", "meeting_id", "seg_idx")
    return chars.changed_fields(segment, "segment", key, ["text", "raw_text"]).unionByName(chars.changed_fields(runs, "exp_asr", F.col("run_id").cast("string"), ["hyp"]))


def p6_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of equal-looking texts that occur in more than one spelling, case included."""
    segment = table(spark, sf_dir, "segment").select(F.explode(F.array("text", "raw_text")).alias("value"))
    return chars.equal_spellings(segment.unionByName(table(spark, sf_dir, "exp_asr").select(F.col("hyp").alias("value"))))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text encoded and decoded again: equal to the text, with '' for null."""
    return tokens.decode(tokens.encode(table(spark, sf_dir, "documents")))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = tokens.encode(table(spark, sf_dir, "documents"))
    return packing.pack(ids.select("doc_id", F.size("ids").alias("tokens")))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p8_containers(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents")).where("cut").select("doc_id").distinct()


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_rates(truncation.truncated(table(spark, sf_dir, "documents")))


def p9_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lengths at which sources cut texts."""
    return truncation.length_hazards(table(spark, sf_dir, "documents")).where("limit").select("source", "unit", "length", "n", "at_risk")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_languages, p2_found, p2_turns, p3_found, p3_redacted, p3_disclosure, p4_found, p4_pieces, p6_found, p6_spellings, p7_ids, p7_decoded, p8_containers, p8_fill, p9_found, p9_rates, p9_limits)
}

ORACLE: dict[str, str] = {
    "p4_found": "select distinct meeting_id, seg_idx from segment where length(text) > 600",
    "p7_decoded": "select distinct doc_id, coalesce(text, '') as text from documents",
}
