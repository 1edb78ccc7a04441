"""Problem 9: texts cut off by field limits or in transfer.

For each source the discrete hazard of every length (how many of the texts that reach a length end there) is tested against the hazard of
the lengths around it, in characters and in bytes, with false-discovery control per source: significant lengths are the source's field
limits. A text at such a length is cut if its ending is not clearly complete; a text of another length only if its ending is clearly
incomplete. How complete an ending is follows from structure (JSON, markup, marks left by the cut) and, for plain endings, from the whole
corpus: how often the last words are followed by the end of a sentence, an item or a line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from . import bits

#: Lengths on either side whose hazard a length is compared with.
NEAR = 25
#: False discovery rate of the length tests.
FDR = 0.01
#: A plain ending counts as complete from this share of sentence ends after its words on: at a field limit, and elsewhere.
AT_LIMIT, ELSEWHERE = 0.7, 0.25
#: Occurrences in the corpus that a word sequence needs to be judged by.
SUPPORT = 3
ORDERS = (4, 3, 2, 1)
#: The last words are looked for in so many characters first, and in the whole text where these do not hold five words.
TAIL = 400
_FIVE_WORDS = r"(?:[\p{L}\p{N}][\p{L}\p{N}'’\-]*[^\p{L}\p{N}'’\-]+){5}"
# fixed values: words that stand for a cut in brackets at the end of a text
_WORDS_OF_CUTS = r"(?:\.{2,}|…|more|cut|truncated|trunchiat|trunc|continued|cont|snip|обрезано|обрыв|далее|продолжение|suite|tronqué|gekürzt)\.{0,3}\s*[\])>]$"
_MARK = rf"(?iu)^\s*{_WORDS_OF_CUTS}"
_SPACES = "".join(map(chr, (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_FOLD = str.maketrans("ăâîșțşţё", "aaiststе")
_DIGITS = re.compile(r"\d+")
_LAST_MARK = re.compile(rf"(?i)[\[(<]\s*{_WORDS_OF_CUTS}")
#: Word sequences that end this share of a source's texts, at least CLOSINGS of them, are its closing words (signatures, version marks).
CLOSING_SHARE, CLOSINGS = 0.002, 3


def length_hazards(documents: DataFrame, near: int = NEAR, fdr: float = FDR) -> DataFrame:
    """Rows (source, unit, length, n, at_risk, hazard, expected, p, limit) for each length that occurs; unit is 'chars' or 'bytes'.
    A text that a source repeats counts once: its copies are no endings of their own.

    p bounds the chance of n or more endings if the hazard were that of the neighbouring lengths (Chernoff bound of the binomial tail);
    limit marks the lengths that pass Benjamini-Hochberg at `fdr` within their source and unit. Windows run over lengths, of which each
    counts once, not over documents. A null source is a source of its own.
    """
    texts = documents.where("text is not null and text != ''").select("source", F.xxhash64("text").alias("h"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes")).distinct()
    both = F.explode(F.array(*(F.struct(F.lit(unit).alias("unit"), F.col(unit).alias("length")) for unit in ("chars", "bytes"))))
    counts = texts.select("source", both.alias("x")).groupBy("source", "x.unit", "x.length").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("source", "unit")
    longer = group.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    around = group.orderBy("length").rangeBetween(-near, near)
    out = counts.withColumn("at_risk", F.sum("n").over(longer))
    out = out.withColumn("__n", F.sum("n").over(around) - F.col("n")).withColumn("__r", F.max("at_risk").over(around) * F.lit(2 * near))
    # lengths that do not occur have no row: each of the 2*near lengths around is at risk of at most the largest count at risk there
    out = out.withColumn("expected", (F.col("__n") + 0.5) / (F.col("__r") + 1))
    q, p0 = F.col("n") / F.col("at_risk"), F.col("expected")
    rest = F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p0))).otherwise(F.lit(0.0))
    kl = q * F.log(q / p0) + rest
    out = out.withColumn("hazard", q).withColumn("p", F.when(q > p0, F.exp(-F.col("at_risk") * kl)).otherwise(F.lit(1.0)))
    by_p = group.orderBy("p", "length")
    out = out.withColumn("__k", F.row_number().over(by_p)).withColumn("__m", F.count(F.lit(1)).over(group))
    passed = F.max(F.when(F.col("p") <= F.col("__k") * fdr / F.col("__m"), F.col("p"))).over(group)
    out = out.withColumn("limit", F.coalesce((F.col("p") <= passed) & (F.col("n") >= 3), F.lit(False)))
    return out.drop("__n", "__r", "__k", "__m")


_TOKEN = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*|[.!?;…]+(?=[\s\"<]|$)|\n|<[^<>]{1,40}>|\"")
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Stands after the last word of a text; hashes of words are odd.
TEXT_END = np.uint64(2)


def _tokens(text: str) -> list[str]:
    """Words, folded so that spellings of one sentence agree, and the ends between them: of sentences, items, lines and tags."""
    return _TOKEN.findall(_DIGITS.sub("0", text.lower().translate(_FOLD)))


def _without_mark(text: str) -> str:
    """A text without the spaces, and the dots or mark in brackets that a cut may have left, at its end: they are no end that vouches for it."""
    text = text.rstrip(_SPACES)
    if text.endswith(("]", ")", ">")) and (mark := _LAST_MARK.search(text, max(0, len(text) - 40))):
        return text[: mark.start()]
    bare = text.rstrip(_SPACES + ".…")
    tail = text[len(bare) :]
    return bare if ".." in tail or "…" in tail else text


class _Hashes(dict):
    """The hash of each word, 0 for an end, remembered; the memory is emptied when it is full."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        got = self[token] = (xxhash.xxh3_64_intdigest(token) | 1) if token[0].isalnum() else 0
        return got


def _runs(words: np.ndarray, k: int, before: np.ndarray | None) -> np.ndarray:
    """Hashes of the runs of k words that begin at each place, from those of k-1 words; 0 where an end is among them."""
    if before is None:
        return words
    out = np.zeros_like(words)
    n = len(words) - k + 1
    if n > 0:
        mixed = (before[:n] ^ (before[:n] >> np.uint64(29))) * _MIX + words[k - 1 :]
        out[:n] = np.where((before[:n] != 0) & (words[k - 1 :] != 0), mixed | np.uint64(1), np.uint64(0))
    return out


def _count(asked: np.ndarray):
    """Counts of the asked runs of a batch of texts; asked: a bit for each slot of a hash, so that only runs that may be asked for are kept.

    Copies of a text come to one task, which reads the first: repeats don't support each other.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, read = _Hashes(), set()
        for pdf in batches:
            flat: list[int] = []
            for text, h in zip(pdf["text"], pdf["h"]):
                if h in read:
                    continue
                read.add(h)
                flat += map(known.__getitem__, _tokens(_without_mark(text)))
                flat.append(TEXT_END)
            follows = np.array(flat, dtype=np.uint64)
            words = np.where(follows == TEXT_END, np.uint64(0), follows)
            before, seen = None, []
            for k in sorted(ORDERS):
                before = _runs(words, k, before)
                follower = np.concatenate((follows[k:], np.full(min(k, len(words)), TEXT_END)))
                hit = (before != 0) & (follower != TEXT_END) & bits.hits(asked, before)
                seen.append(pd.DataFrame({"h": before[hit].view(np.int64), "ends": (follower[hit] == 0).astype(np.int64)}))
            counts = pd.concat(seen).groupby("h")["ends"].agg(["size", "sum"])
            yield pd.DataFrame({"h": counts.index, "n": counts["size"].to_numpy(np.int64), "ends": counts["sum"].to_numpy(np.int64)})

    return run


def _followers(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows (h, n, ends) for runs of 1 to 4 words: how often each occurs in the corpus followed by something, and by an end. Each distinct text counts once.

    asked has the runs, in a column h, that must be among them; others may be. The end of a text is no follower, nor are the spaces, dots or
    mark there: a cut text would vouch for itself. Runs do not cross ends.
    """
    texts = documents.where("text is not null and text != ''").select("text", F.xxhash64("text").alias("h")).repartition("h")
    return texts.mapInPandas(_count(bits.slots(asked)), "h long, n long, ends long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))


_RUNS = T.ArrayType(T.StructType([T.StructField("k", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("letters", T.IntegerType())]))


@F.pandas_udf(_RUNS)
def _last_runs(texts: pd.Series) -> pd.Series:
    """The runs of 1 to 4 words that end each text; none where it ends with an end or a sign, or is null."""
    out, known = [], _Hashes()
    for text in texts:
        tokens = _tokens(text) if text else []
        n = 0
        while n < min(len(tokens), max(ORDERS)) and known[tokens[-1 - n]]:
            n += 1
        words, got, before = np.array([known[t] for t in tokens[len(tokens) - n :]], dtype=np.uint64), [], None
        hashes = []
        for k in range(1, n + 1):
            before = _runs(words, k, before)
            hashes.append(int(before[n - k : n - k + 1].view(np.int64)[0]))
        for k in sorted(range(1, n + 1), reverse=True):
            got.append({"k": k, "h": hashes[k - 1], "letters": len(tokens[-1])})
        out.append(got)
    return pd.Series(out)


def read_endings(documents: DataFrame) -> DataFrame:
    """Distinct rows (doc_id, source, text_hash, chars, bytes, kind, runs) of the non-blank texts: how each ends, read in one pass.

    kind: 'mark' (a mark left by a cut, or a broken character), 'structure' (JSON or markup that is not closed), 'closed' (structure that
    is), 'stop' (sentence or item end), 'open' (comma, colon, dash), 'plain' (ends in a word; runs are its last words, none if it has only
    signs). Dots that a cut may have left are taken off first.
    """
    # all of this looks at the very end of the whole text, however long what stands there is
    spaces, dots = F.lit(_SPACES), F.lit(_SPACES + ".…")
    text = F.rtrim("text", spaces)
    bare = F.rtrim(text, dots)
    tail = F.substring(text, F.length(bare) + 1, F.length(text))
    base = documents.where(F.length(F.trim("text", spaces)) > 0).select(
        "doc_id", "source", "text", F.xxhash64("text").alias("text_hash"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), text.alias("__s"), bare.alias("__bare"), (F.contains(tail, F.lit("..")) | F.contains(tail, F.lit("…"))).alias("__dots")
    )
    base = base.withColumn("__t", F.when(F.col("__dots"), F.col("__bare")).otherwise(F.col("__s")))
    last = F.right("__s", F.lit(1))
    inner = F.substring_index(F.translate("__s", "(<", "[["), "[", -1)
    mark = last.isin("]", ")", ">") & (F.length(inner) < F.length("__s")) & inner.rlike(_MARK)
    broken = F.contains("__t", F.lit("\ufffd")) & F.col("__t").rlike("\ufffd\\W*$")
    json_like = F.col("text").rlike(r"^\s*[{\[]\s*[\"{\[]")
    html_like = F.col("text").rlike(r"^\s*<[A-Za-z][A-Za-z0-9]*[\s>]")
    tag = F.lower(F.regexp_extract("text", r"^\s*<([A-Za-z][A-Za-z0-9]*)[\s>]", 1))
    closed = F.endswith(F.lower(F.regexp_replace(F.right("__t", F.length(tag) + 64), r"\s+>$", ">")), F.concat(F.lit("</"), tag, F.lit(">")))
    stop = F.right(F.rtrim("__t", F.lit("\"'»”)]*_")), F.lit(1)).isin(".", "!", "?", ";")
    kind = (
        F.when(mark | broken, "mark")
        .when(json_like, F.when(F.try_parse_json("text").isNotNull(), "closed").otherwise("structure"))
        .when(html_like, F.when(closed, "closed").otherwise("structure"))
        .when(~F.col("__dots") & stop, "stop")
        .when(F.right("__t", F.lit(1)).rlike(r"[,:\-–—/(«„\[]"), "open")
        .otherwise("plain")
    )
    base = base.withColumn("kind", kind)
    near = F.right("__t", F.lit(TAIL))
    enough = (F.length("__t") <= TAIL) | near.rlike(_FIVE_WORDS)
    runs = _last_runs(F.when(F.col("kind") == "plain", F.when(enough, near).otherwise(F.col("__t"))))
    return base.select("doc_id", "source", "text_hash", "chars", "bytes", "kind", runs.alias("runs")).distinct()


def endings(read: DataFrame, followers: DataFrame) -> DataFrame:
    """Rows (doc_id, source, at_limit, kind, score, order) from rows of read_endings with at_limit.

    kind 'closing' stands for plain endings in closing words of the source; score is the share of sentence ends after the last `order` words,
    -1 if the corpus does not even know the last one.
    """
    plain = read.where("kind = 'plain'")
    asked = plain.select("doc_id", "source", "at_limit", "text_hash", F.explode("runs").alias("x")).select("doc_id", "source", "at_limit", "text_hash", "x.k", "x.h", "x.letters")
    # closing words: one of four letters or more, or two, that end many distinct texts of a source at other lengths than its limits
    texts = read.select("source", "text_hash").distinct()
    per_source = texts.groupBy("source").agg(F.count(F.lit(1)).alias("of"))
    closed = asked.where("k <= 2 and not at_limit and (k = 2 or letters >= 4)").select("source", "h", "text_hash").distinct()
    closers = closed.groupBy("source", "h").agg(F.count(F.lit(1)).alias("times"))
    least = max(CLOSINGS, texts.select("text_hash").distinct().count() * CLOSING_SHARE)
    everywhere = closed.select("h", "text_hash").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("times_all")).where(F.col("times_all") >= least)
    closers = closers.alias("c").join(per_source.alias("p"), F.col("c.source").eqNullSafe(F.col("p.source"))).where((F.col("times") >= CLOSINGS) & (F.col("times") >= F.col("of") * CLOSING_SHARE)).select("c.source", "h", "times")
    known = asked.join(followers, "h", "left").alias("a")
    known = known.join(closers.alias("c"), F.col("a.h").eqNullSafe(F.col("c.h")) & F.col("a.source").eqNullSafe(F.col("c.source")), "left").select("a.*", "c.times")
    known = known.join(everywhere, "h", "left")
    supported = F.when(F.col("n") >= SUPPORT, F.col("k"))
    scored = known.groupBy("doc_id", "source", "at_limit", "text_hash").agg(
        F.max_by(F.col("ends") / F.col("n"), supported).alias("s"),
        F.max(supported).alias("order"),
        F.max(F.when(F.col("k") == 1, F.coalesce("n", F.lit(0)))).alias("last"),
        F.max(F.greatest("times", "times_all") >= F.coalesce("n", F.lit(0))).alias("closing"),
    )
    score = F.when(F.col("last") < SUPPORT, F.lit(-1.0)).otherwise(F.col("s"))
    scored = scored.select("doc_id", "source", "at_limit", F.when(F.col("closing"), "closing").otherwise("plain").alias("kind"), score.alias("score"), "order")
    void = (F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("order"))
    rest = read.where("kind != 'plain'").select("doc_id", "source", "at_limit", "kind", *void)
    # plain texts without a word (only signs) are complete
    none = plain.where(F.size("runs") == 0).select("doc_id", "source", "at_limit", F.lit("closed").alias("kind"), *void)
    return scored.unionByName(rest).unionByName(none)


def truncated(documents: DataFrame, near: int = NEAR, fdr: float = FDR) -> DataFrame:
    """Rows (doc_id, source, at_limit, kind, score, order, cut, found_by), one for each document with a text (null and blank texts are not cut and
    left out).

    at_limit: its length is a significant length of its source. found_by: 'length' for texts cut there, which is the method; 'transfer' for
    texts of other lengths whose ending alone shows the cut; null for whole ones. Repeated rows count once; columns other than doc_id, source and text are
    ignored. An empty table gives no rows.
    """
    docs = documents.select("doc_id", "source", "text")
    limits = cut(length_hazards(docs, near, fdr).where("limit").select("source", "unit", "length"))
    read = read_endings(docs)
    same = lambda unit, n: F.col("x.source").eqNullSafe(F.col("l.source")) & (F.col("l.unit") == unit) & (F.col(f"x.{n}") == F.col("l.length"))
    read = read.alias("x").join(limits.alias("l"), same("chars", "chars"), "left").select("x.*", F.col("l.length").isNotNull().alias("__at"))
    read = read.alias("x").join(limits.alias("l"), same("bytes", "bytes"), "left").select("x.*", (F.col("__at") | F.col("l.length").isNotNull()).alias("at_limit"))
    read = cut(read.drop("__at"))
    asked = read.where("kind = 'plain'").select(F.explode("runs.h").alias("h")).distinct()
    out = endings(read, _followers(docs, asked))
    least = F.when(F.col("at_limit"), F.lit(AT_LIMIT)).otherwise(F.lit(ELSEWHERE))
    # words known only one by one are weak evidence of an end
    score = F.when(F.col("order") == 1, F.col("score") / 2).otherwise(F.col("score"))
    open_end = F.col("kind").isin("mark", "structure", "open") | ((F.col("kind") == "plain") & F.coalesce(score < least, F.col("at_limit")))
    return out.withColumn("cut", open_end).withColumn("found_by", F.when(F.col("cut"), F.when(F.col("at_limit"), "length").otherwise("transfer")))


def truncation_rates(flagged: DataFrame) -> DataFrame:
    """Rows (source, documents, cut, share): of each source's documents that have a text, how many were cut."""
    return flagged.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("cut").alias("cut"), F.round(F.avg(F.col("cut").cast("int")), 4).alias("share"))
