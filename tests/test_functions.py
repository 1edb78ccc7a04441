"""Scalar functions: golden examples, brute force and properties."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stenoflow.functions import fuzzy, numerals, speech
from stenoflow.functions import text as X
from stenoflow.functions.speakers import resolve_speakers

short = st.text(alphabet="abcd ", max_size=12)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(short, short)
def test_ratio(a, b):
    want = 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0
    assert abs(fuzzy.ratio(a, b) - want) < 1e-9
    assert fuzzy.ratio(a, b) == fuzzy.ratio(b, a)


@settings(max_examples=200, deadline=None)
@given(short, short)
def test_partial_ratio(a, b):
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    n, m = len(s), len(t)
    if n:
        windows = [t[:i] for i in range(1, n)] + [t[i : i + n] for i in range(m - n + 1)] + [t[i:] for i in range(m - n + 1, m)]
        assert abs(fuzzy.partial_ratio(a, b) - max(200 * lcs(s, w) / (n + len(w)) for w in windows)) < 1e-9
    assert 0 <= fuzzy.partial_ratio(a, b) <= 100


@settings(max_examples=100, deadline=None)
@given(short, short)
def test_token_set_ratio(a, b):
    score = fuzzy.token_set_ratio(a, b)
    assert 0 <= score <= 100 and score == fuzzy.token_set_ratio(b, a)
    if a.split() and set(a.split()) <= set(b.split()):
        assert score == 100


def test_numerals():
    for said, written in [
        ("zero virgulă zero opt", "0,08"), ("optzeci și șase", "86"), ("patruzeci", "40"), ("trei opt patruzeci", "38 40"), ("zero zero opt zero zero șapte", "0,08 0,07"),
        ("două mii douăzeci și cinci", "2025"), ("unu și opt", "1 și 8"), ("pacientul patru opt", "pacientul patul 8"), ("un pacient", "un pacient"), ("sută la sută", "sută la sută"),
        ("treizeci și șapte virgulă doi", "37,2"), ("o sută douăzeci pe optzeci", "120 pe 80"), ("", ""),
    ]:
        assert numerals.to_digits(said) == written
    assert numerals.to_digits(None) is None


def test_repeats_and_alignment():
    assert speech.collapse_repeats("a b c a b c a b c a b c x") == "a b c a b c x"
    assert speech.collapse_repeats("e-e-e-e-e-e da") == "e-e-e da"
    assert speech.collapse_repeats(None) is None and speech.collapse_repeats("") == ""
    assert speech.align_words([("patru", 0.9), ("opt", 0.4), ("da", 0.8)], "patul 8 da nou") == [("patul", 0.4), ("8", 0.4), ("da", 0.8), ("nou", None)]
    assert speech.align_words(None, "da") == [("da", None)]


def test_columns(spark):
    df = spark.createDataFrame([("Şedinţa Pacientului", "01:02:03", 3723.9), ("", "3:04", 59.0), (None, None, None)], "t string, s string, x double")
    got = df.select(X.comma_forms("t"), X.without_diacritics("t"), X.seconds_of(F.col("s")), X.clock(F.col("x")), X.html_escape(F.col("t"))).collect()
    assert tuple(got[0]) == ("ședința pacientului", "sedinta pacientului", 3723, "01:02:03", "Şedinţa Pacientului")
    assert tuple(got[1]) == ("", "", 184, "00:00:59", "—")
    assert tuple(got[2])[:3] == (None, None, None) and got[2][4] == "—"
    keys = spark.createDataFrame([("ghețar",), ("getzar",), ("casă",)], "w string").select(X.phonetic_key(F.col("w"))).collect()
    assert keys[2][0] == "casa" and keys[0][0] == "citar"


def test_speakers(spark):
    people = spark.createDataFrame([("m", "S1", "Ana Pop"), ("m", "spk_2", "Ion Pop"), ("m", "S3", None), ("n", "S7", "Ana Pop")], "meeting_id string, speaker string, name string")
    rows = [("S 1", ""), ("Vorb. 03", ""), ("SPEAKER_00", ""), ("[S2]", ""), ("dr. ANA POP", ""), ("Pop", ""), ("Ion", ""), (None, "[00:01] (tuse) Говорящий 4: да"), (None, "S5 - da"), (None, "da"), ("?", "S5: da"), ("", "S5: da"), (None, None)]
    df = spark.createDataFrame([("m", i, s, t) for i, (s, t) in enumerate(rows)], "meeting_id string, i long, speaker string, text string").withColumn("name", F.lit("clash")).withColumn("__key", F.lit(1))
    got = {r["i"]: r["speaker_id"] for r in resolve_speakers(df.drop("__key"), people).collect()}
    assert [got[i] for i in range(len(rows))] == ["S1", "S3", "S0", "S2", "S1", "S?", "S2", "S4", "S5", "S?", "S?", "S?", "S?"]


def test_checks(spark):
    from stenoflow.functions import checks

    df = spark.createDataFrame([("10.1.2.3",), ("11.0.0.1",), ("mail.local",), ("evil.example",), (None,), ("300.1.1.1",)], "h string")
    got = [r[0] for r in df.select(checks.allowed(F.col("h"), ["mail.local"], ["10.0.0.0/8", "192.168.0.0/16"])).collect()]
    assert got == [True, False, True, False, True, False]
    frames = spark.createDataFrame([([1.0, -1.0], [0.1, -0.1], 10.0), ([], [], 0.0)], "s array<double>, n array<double>, snr double")
    rows = frames.select(checks.level_db(F.col("s")), checks.noise_gain(F.col("s"), F.col("n"), F.col("snr"))).collect()
    assert abs(rows[0][0]) < 1e-6 and abs(rows[0][1] - 10**0.5) < 1e-6 and rows[1][0] == -99
    texts = spark.createDataFrame([("TA 185/95 apoi 120/80 și 80/50",), (None,)], "t string")
    assert [r[0] for r in texts.select(checks.pressure_alerts(F.col("t"))).collect()] == [["185/95", "80/50"], None]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=7), st.lists(st.sampled_from("abc"), max_size=7))
def test_word_edits(a, b):
    from functools import cache

    from stenoflow.plans.ranking import word_edits

    @cache
    def far(i, j):
        return max(i, j) if not i or not j else min(far(i - 1, j) + 1, far(i, j - 1) + 1, far(i - 1, j - 1) + (a[i - 1] != b[j - 1]))

    assert word_edits(a, b) == far(len(a), len(b))


def test_alert_spans_and_runs():
    from stenoflow.functions import clinic

    said = "TA 80/40 mmHg, Hb 75 g/L, puls 72 și NA 0,08 mcg/kg/min, K 4,0"
    assert [said[b:e] for b, e in clinic.alert_spans(said)] == ["TA 80/40 mmHg", "Hb 75 ", "NA 0,08 mcg/kg/min"]
    runs = clinic.text_runs(said)
    assert "".join(r for r, _ in runs) == said and ("Hb 75", True) in runs
    for text, n in (("INR 1,2; pH 7,2", 1), ("bloc AV 2, temperatura 37,9", 0), ("temperatura 38", 1), ("Hb 12, Hb 10, Hb 120, Hb 105", 2), ("glicemia 5, glicemia 45", 1), ("120/80 mmHg", 0), ("", 0), ("fără cifre", 0), ("5 mg 3 ml", 2)):
        assert len(clinic.alert_spans(text)) == n, text
    assert clinic.text_runs("") == []


def test_abbreviations_and_units(spark):
    from stenoflow.functions import clinic

    rows = spark.createDataFrame([("Tensiunea de 120 și hemoglobina",), ("infarctul miocardic acut",), (None,), ("preahemoglobina",)], "t string")
    assert [r[0] for r in rows.select(clinic.abbreviated(F.col("t"), "ro")).collect()] == ["TA de 120 și Hb", "infarctul miocardic acut".replace("infarctul miocardic acut", "IMA"), None, "preahemoglobina"]
    mg = spark.createDataFrame([("5 mg, 3 mg/dL",)], "t string")
    assert mg.select(F.regexp_replace("t", clinic.unit_pattern("mg"), "")).first()[0] == "5, 3 mg/dL"


def test_word_and_character_edits():
    import random

    from stenoflow.plans.ranking import char_edits, word_edits

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(5)
    for _ in range(500):
        a, b = (["".join(rng.choice("ab") for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(0, 9))] for _ in "xy")
        assert word_edits(a, b) == plain(a, b) and char_edits("".join(a), "".join(b)) == plain("".join(a), "".join(b))
