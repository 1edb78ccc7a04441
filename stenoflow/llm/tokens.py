"""Problem 7: encoding of whole texts with a public byte-level BPE tokenizer, and its inverse.

A byte-level BPE never merges across the words of its split pattern, so a text's ids are those of its words one after another. Words are
split in Spark, each distinct word is encoded once, and the ids are joined back by position. Words that make up at least 1/HOT_WORDS of all
words, of which there can be at most HOT_WORDS, are joined by broadcast; all others by a shuffle on the word, where none is frequent.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

TOKENIZER_DIR = "/opt/tokenizers"
HOT_WORDS = 10_000
# fixed value: the split pattern of the tokenizer's vocabulary, with Unicode white space in Java's dialect
SPLIT = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words are split by the tokenizer's own pattern, so only a tokenizer whose pattern is known can be used.
SPLITS = {"byte_bpe_50k": SPLIT}

_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _loaded[path] = t
    return _loaded[path]


def _encode_words(path: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _tokenizer(path)
        for pdf in parts:
            got = t.encode_batch(list(pdf["word"]), add_special_tokens=False)
            pdf["ids"] = [e.ids for e in got]
            yield pdf

    return run


def _words(docs: DataFrame) -> DataFrame:
    return docs.select("__d", "__h", F.posexplode(F.regexp_extract_all("text", F.lit(SPLIT), 0)).alias("pos", "word"))


def _gather(found: DataFrame, name: str) -> DataFrame:
    return found.groupBy("__d", "__h").agg(F.collect_list(F.struct("pos", "ids")).alias(name))


def encode(documents: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """Rows (doc_id, ids): the token ids of each distinct (doc_id, text), without special tokens.

    Null and empty texts give an empty list; a repeated row counts once; a doc_id with two texts gives a row for each. Other columns are
    ignored. Strings of special tokens inside a text are ordinary text. A tokenizer whose split pattern is not in SPLITS is refused. The files
    in tokenizer_dir must be there on every machine.

    The texts are partitioned by document once. Words in the frequent part of the table get their ids by broadcast and are gathered where
    they are; only words in the rare part are shuffled, to their entry and back to their document.
    """
    if tokenizer not in SPLITS:
        raise ValueError(f"no split pattern for tokenizer {tokenizer!r}; known: {', '.join(SPLITS)}")
    path = f"{tokenizer_dir}/{tokenizer}.json"
    docs = documents.select("doc_id", "text")
    empty = docs.where("text is null or text = ''").select("doc_id").distinct().select("doc_id", F.array().cast("array<int>").alias("ids"))
    full = docs.where("text is not null and text != ''")
    full = full.withColumn("__d", F.coalesce("doc_id", F.lit(0)))
    # the last bit of the hash tells a null doc_id from 0
    full = full.withColumn("__h", F.shiftleft(F.xxhash64("text"), 1).bitwiseOR(F.col("doc_id").isNull().cast("long")))
    counted = _words(full).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    vocabulary = cut(counted.mapInPandas(_encode_words(path), schema))
    total = vocabulary.agg(F.sum("n")).first()[0] or 0
    least = max(2, -(-total // HOT_WORDS))
    hot = vocabulary.where(F.col("n") >= least).select("word", "ids")
    once = full.dropDuplicates(["__d", "__h"])
    split = _words(once).join(F.broadcast(hot), "word", "left")
    frequent = _gather(split.where("ids is not null"), "__frequent")
    seldom = split.where("ids is null").drop("ids").join(vocabulary.where(F.col("n") < least).select("word", "ids"), "word")
    rare = _gather(seldom, "__rare")
    none = F.array().cast("array<struct<pos:int,ids:array<int>>>")
    gathered = frequent.join(rare, ["__d", "__h"], "full").select("__d", "__h", F.array_sort(F.concat(F.coalesce("__frequent", none), F.coalesce("__rare", none))).alias("x"))
    ids = gathered.select("__d", "__h", F.flatten(F.transform("x", lambda p: p["ids"])).alias("ids"))
    return ids.select(F.when(F.col("__h") % 2 == 0, F.col("__d")).alias("doc_id"), "ids").unionByName(empty)


def pieces(spark: SparkSession, tokenizer_dir: str = TOKENIZER_DIR, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """The vocabulary as rows (id, hex): the bytes of each id. Its size is that of the tokenizer, whatever the data."""
    rows = []
    with open(f"{tokenizer_dir}/{tokenizer}.tiktoken", "rb") as f:
        for line in f:
            piece, number = line.split()
            rows.append((int(number), base64.b64decode(piece).hex()))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "hex"]), "id int, hex string")


def decode(encoded: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """Rows (doc_id, text) from rows (doc_id, ids), by an id-to-piece join; an empty list gives an empty text, a null list null.

    Rows are told apart by doc_id and the list's hash. An id that the vocabulary lacks makes the text null.
    """
    rows = encoded.select("doc_id", "ids", F.xxhash64("ids").alias("__h"))
    parts = rows.where("size(ids) > 0").select("doc_id", "__h", F.posexplode("ids").alias("pos", "id"))
    spark = encoded.sparkSession
    joined = parts.join(F.broadcast(pieces(spark, tokenizer_dir, tokenizer)), "id", "left")
    text = F.when(
        F.count("hex") == F.count(F.lit(1)),
        F.decode(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("pos", "hex"))), lambda x: x["hex"]), "")), "UTF-8"),
    )
    out = joined.groupBy("doc_id", "__h").agg(text.alias("text")).select("doc_id", "text")
    rest = rows.where("ids is null or size(ids) = 0").select("doc_id", F.when(F.col("ids").isNotNull(), F.lit("")).alias("text")).distinct()
    return out.unionByName(rest)
