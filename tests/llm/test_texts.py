"""Characters, pieces, turns and truncation."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stenoflow.llm import chars, splitting, truncation, turns


@pytest.mark.parametrize(
    "dirty, clean",
    [
        ("ｃｏｎｆｉｒｍａｒｅａ ２６", "confirmarea 26"), ("ă și Î", "ă și Î"), ("şi ţară", "și țară"), ("nu mai am o", "nu mai am o"), ("ur­olo​gie﻿", "urologie"),
        ("сorectează", "corectează"), ("пpocят", "просят"), ("jοi seara", "joi seara"), ("Până јоі seara", "Până joi seara"), ("Міе mi se pare", "Mie mi se pare"),
        ("3½ m² № 5 „da” ♪", "3½ m² № 5 „da” ♪"), ("[S7] Больной дышит", "[S7] Больной дышит"), ("и CT на койке", "и CT на койке"), ("Коллеги, а доза", "Коллеги, а доза"), ("пiд", "під"), ("", ""),
    ],
)
def test_consistent(dirty, clean):
    assert chars.consistent(dirty) == clean
    assert chars.consistent(clean) == clean


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAbсоеxуpіșşţ̦̆​ ｘ５½№ .жлăЖ", max_size=20))
def test_consistent_is_stable(text):
    once = chars.consistent(text)
    assert unicodedata.normalize("NFC", once) == once
    assert not set(once) & set("​ şţｘ５")
    assert chars.consistent(once) == once
    assert chars.comparison_key(text) == chars.comparison_key(once)


def test_changed_fields(spark):
    df = spark.createDataFrame([(1, "şi", None), (1, "şi", None), (2, "și", "a​b"), (3, "", ""), (None, "ｘ", "y")], "id long, text string, raw_text string").withColumn("value", F.lit("clash")).withColumn("text_clean", F.lit("old"))
    got = chars.changed_fields(df, "t", F.col("id").cast("string"), ["text", "raw_text"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("t", "1", "text"), ("t", "2", "raw_text"), ("t", None, "text")], key=str)
    assert chars.changed_fields(df.limit(0), "t", F.col("id").cast("string"), ["text"]).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .,\n-é́", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_pieces(text, limit, overlap):
    points = splitting.split_points(text, limit, overlap)
    assert all(0 < e - b <= limit for b, e in points)
    if text:
        assert points[0][0] == 0 and points[-1][1] == len(text)
    for (b, e), (b2, e2) in zip(points, points[1:]):
        assert b < b2 <= e < e2 and e - b2 <= overlap


def test_pieces_end_at_sentences():
    text = "Prima propoziție este aici. A doua vine acum, cu o pauză. " * 20
    points = splitting.split_points(text)
    assert all(text[:e].rstrip()[-1] == "." for _, e in points)
    with pytest.raises(ValueError):
        splitting.split_points(text, 10, 10)


def test_split_long(spark):
    long = "Cuvinte " * 200
    rows = [("m", 1, 10.0, 20.0, long), ("m", 1, 10.0, 20.0, long), ("m", 2, None, None, long), ("m", 3, 5.0, 1.0, "x" * 601), ("m", 4, 0.0, 1.0, None), ("m", 5, 0.0, 1.0, "x" * 600), (None, 6, 0.0, 9.0, "я" * 1300)]
    df = spark.createDataFrame(rows, "meeting_id string, seg_idx long, start double, end double, text string").withColumn("piece", F.lit("clash"))
    got = splitting.split_long(df).orderBy("seg_idx", "piece").collect()
    assert {r["seg_idx"] for r in got} == {1, 2, 3, 6}
    one = [r for r in got if r["seg_idx"] == 1]
    assert [r["piece"] for r in one] == list(range(one[0]["pieces"])) and all(len(r["piece_text"]) <= 600 for r in got)
    assert one[0]["start_estimate"] == 10.0 and all(a["start_estimate"] < b["start_estimate"] < 20 for a, b in zip(one, one[1:]))
    assert all(r["start_estimate"] is None for r in got if r["seg_idx"] == 2)
    assert splitting.split_long(df.limit(0)).collect() == []


PEOPLE = "meeting_id string, part_idx int, item_idx long, speaker string, name string, role string"
SEGMENTS = "meeting_id string, seg_idx long, start double, end double, speaker string, text string"


@pytest.mark.parametrize("hot", [10**9, 2])
def test_turns(spark, hot):
    rows = [
        ("m", 0, 0.0, 1.0, "S1", "[00:00:01] S1: Ăă, da"), ("m", 1, 1.0, 2.0, "s 1", "(tuse) [inaudible 00:03] îî..."), ("m", 2, 2.0, 1.0, "Vorb. 1", "Deci mergem"), ("m", 2, 2.0, 1.0, "Vorb. 1", "Deci mergem"),
        ("m", 3, 3.0, 4.0, None, "SPEAKER_02 : nu"), ("m", 4, 3.0, 4.0, None, "SPEAKER_02: nu"), ("m", 5, 9.0, 11.0, "?", "hmm, bine"), ("m", 6, 12.0, 13.0, "S1", None), ("m", 7, 13.0, 14.0, "unknown", "5"),
        ("m", 8, 14.0, 15.0, "S1", "*telefon* Um, gata"), (None, 9, 0.0, 1.0, "S3", "x"), ("m", 10, None, None, "S9", "da"),
    ]
    people = spark.createDataFrame([("m", 0, 0, "S1", "Ana", None)], PEOPLE)
    found = turns.speaker_turns(spark.createDataFrame(rows, SEGMENTS).withColumn("__island", F.lit("clash")), people, hot_rows=hot, piece_rows=2)
    got = {(r["meeting_id"], r["first_seg"], r["last_seg"], r["speaker"]) for r in found.collect()}
    assert got == {("m", 10, 10, "S9"), ("m", 0, 2, "S1"), ("m", 3, 3, "S2"), ("m", 4, 4, "S2"), ("m", 5, 7, "S?"), ("m", 8, 8, "S1"), (None, 9, 9, "S3")} - {("m", 3, 3, "S2"), ("m", 4, 4, "S2")} | {("m", 3, 4, "S2")}
    by = {r["first_seg"]: r for r in turns.filled(found).collect()}
    assert by[0]["text"] == "da Deci mergem" and by[5]["speaker_filled"] == "S2" and by[8]["text"] == "gata" and by[0]["end"] == 1.0
    assert turns.speaker_turns(spark.createDataFrame([], SEGMENTS), people).collect() == []


def test_truncation(spark):
    whole = ["Dacă potasiul nu se corectează, îl mutăm la chirurgie fără discuții.", "Pacientul de la patul opt respiră mai bine după ce am schimbat sonda.", "Graficul pentru luni nu este încă semnat de juristul."]
    rows = [(i, "a", " ".join(whole[(i + j) % 3] for j in range(2 + i % 4))) for i in range(60)]
    rows += [(100 + i, "a", (" ".join(whole[(i + j) % 3] for j in range(6)))[:200]) for i in range(12)]
    odd = [("{\"a\": \"x\"}", False), ("{\"a\": \"x", True), ("<div><p>da</p></div>", False), ("<div><p>da</p>", True), ("Graficul pentru luni nu este încă semnat de [...]", True), ("Graficul pentru lu�", True), ("Graficul pentru luni nu este încă semnat de juristul", False), ("Graficul pentru luni nu este încă semnat de juristul...", False), ("Dacă potasiul nu se cor...", True), ("", None), (None, None), ("  \n", None), ("Pacientul, ", True)]
    rows += [(200 + i, "b" if i % 2 else None, t) for i, (t, _) in enumerate(odd)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, source string, text string").withColumn("kind", F.lit("clash")).withColumn("n", F.lit(1))
    limits = truncation.length_hazards(df).where("limit").select("source", "length").distinct().collect()
    assert ("a", 200) in [tuple(r) for r in limits]
    got = {r["doc_id"]: r["cut"] for r in truncation.truncated(df).collect()}
    for i, (t, want) in enumerate(odd):
        assert got.get(200 + i) is want, t
    assert not any(got[i] for i in range(60))
    cut = {100 + i for i in range(12) if rows[60 + i][2].rstrip()[-1] != "."}
    assert cut and {i for i in range(100, 112) if got[i]} == cut
    rates = {r["source"]: (r["documents"], r["cut"]) for r in truncation.truncation_rates(truncation.truncated(df)).collect()}
    assert rates["a"] == (72, len(cut))
    assert truncation.truncated(df.limit(0)).collect() == []


def test_truncation_of_repeated_texts(spark):
    whole = ["Dacă potasiul nu se corectează, îl mutăm la chirurgie fără discuții.", "Pacientul de la patul opt respiră mai bine după ce am schimbat sonda.", "Graficul pentru luni nu este încă semnat de juristul."]
    rows = [(i, "a", " ".join(whole[(i + j) % 3] for j in range(2 + i % 4))) for i in range(60)]
    # what a cut leaves after the last word is no sentence end, however often it occurs
    ends = ["...", "…", " . . ..", "\n", "... \n", "[...]", "<...>"]
    for end in ends:
        assert truncation._without_mark("Dacă potasiul nu se cor" + end).rstrip() == "Dacă potasiul nu se cor", end
    assert truncation._without_mark("Da (bine). (nu)\n") == "Da (bine). (nu)"
    rows += [(100 + i, "b", f"{whole[i % 2]} Dacă potasiul nu se cor{'abcdefg'[i]}{end}") for i, end in enumerate(ends)]
    rows += [(200, "c", "Graficul pentru luni nu este încă semnat de juristul...")]
    once = {r["doc_id"]: tuple(r[1:]) for r in truncation.truncated(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert all(once[100 + i][5] for i in range(len(ends))) and not once[200][5]
    many = [(1000 * k + i, source, text) for k in range(9) for i, source, text in rows]
    again = {r["doc_id"]: tuple(r[1:]) for r in truncation.truncated(spark.createDataFrame(many, "doc_id long, source string, text string")).collect()}
    assert len(again) == len(many) and all(again[1000 * k + i] == x for i, x in once.items() for k in range(9))
