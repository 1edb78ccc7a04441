"""Queries over small tables of their own: what a bound on rows, lengths or languages would leave out."""

import pytest

from stenoflow.plans import registry

SEGMENT = "meeting_id string, seg_idx long, start double, end double, text string, raw_text string, lang string, corrections array<struct<from:string,to:string>>"


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables given as (schema, rows) and gives their folder."""

    def write(**named):
        for name, (schema, rows) in named.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def segment(i, start=0.0, end=1.0, text=None, raw=None, lang="ro", corrections=None, meeting="m"):
    return meeting, i, start, end, text, raw, lang, corrections


def rows(spark, name, folder):
    return sorted(map(tuple, registry.queries()[name](spark, folder).collect()))


def test_windows_reach_the_end_of_the_meeting(spark, tables):
    spans = [segment(0, 50.0, 70.0), segment(1, 2530.0, 2600.0), segment(2, 9990.0, 10_030.0), segment(3, 2461.0, 2519.0), segment(4, 5.0, 20.0, meeting="n")]
    folder = tables(segment=(SEGMENT, spans), job=("id string, status string", [("m", "done"), ("n", "done"), ("o", "new")]))
    got = rows(spark, "q_interval_overlap", folder)
    assert got == [("m", 0.0, 0, 50.0, 60.0), ("m", 2520.0, 1, 2530.0, 2580.0), ("m", 9960.0, 2, 9990.0, 10_020.0), ("n", 0.0, 4, 5.0, 20.0)]


def test_every_variant_is_applied(spark, tables):
    letters = "abcdefghij"
    rare = ["x" + letters[i // 10] + letters[i % 10] for i in range(60)]
    many = [segment(i, raw="", corrections=[(w, w.upper() + "1")]) for i, w in enumerate(rare)] + [segment(100 + i, raw="", corrections=[("pnetru", "pentru")]) for i in range(3)]
    texts = [segment(200 + i, raw=f"Nu {w.capitalize()}, a{w}b") for i, w in enumerate(rare)]
    got = rows(spark, "q_variants_applied", tables(segment=(SEGMENT, [*many, *texts, segment(300, raw="PNETRU xaa"), segment(301, raw=None), segment(302, raw="bine")])))
    assert got == [("m", 200 + i, f"Nu {w.upper()}1, a{w}b", [w]) for i, w in enumerate(rare)] + [("m", 300, "pentru XAA1", ["pnetru", "xaa"])]


def test_variants_as_one_by_one():
    import random
    import re

    from stenoflow.plans.corpus import Variants

    rng = random.Random(3)
    some = lambda k: "".join(rng.choice("aB -.ă1_") for _ in range(rng.randint(1, k)))
    for _ in range(1500):
        pairs = list({(some(4), some(4)) for _ in range(8)})
        text = want = some(14)
        applied = []
        for wrong, correct in sorted(pairs, key=lambda p: (-len(p[0]), p)):
            want, n = re.subn(rf"(?<![^\W_]){re.escape(wrong)}(?![^\W_])", lambda _, to=correct: to, want, flags=re.I)
            applied += [wrong] * bool(n)
        assert Variants(pairs).apply(text) == (want, applied), (pairs, text)


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, diagonal, row[0] = i, row[0], i
        for j, y in enumerate(b, 1):
            diagonal, left = row[j], min(row[j] + 1, left + 1, diagonal + (x != y))
            row[j] = left
    return row[-1]


def test_character_edits():
    import random

    from stenoflow.plans.ranking import char_edits

    rng = random.Random(5)
    some = lambda k: "".join(rng.choice("abcж ") for _ in range(rng.randint(0, k)))
    for k in (3, 12, 90):
        for _ in range(300):
            a, b = some(k), some(k)
            assert char_edits(a, b) == plain_edits(a, b), (a, b)


def test_character_edits_of_long_and_russian_texts(spark, tables):
    long, ru = "pacientul respiră greu " * 40, "больной дышит, ёлка"
    said = [segment(0, text=long, raw=long + "da da da "), segment(1, text="Șapte.", raw="sapta"), segment(2, text=ru, raw="больная дышит елка", lang="ru"), segment(3, text=None, raw="x"), segment(4, text="", raw="abc", lang="en")]
    got = rows(spark, "q_character_edits", tables(segment=(SEGMENT, said)))
    assert got == [("en", 3, 0), ("ro", 9 + 1, len(long) + 5), ("ru", 2, len(ru) - 1)]


def test_candidates_in_every_language(spark, tables):
    lexicon = ("lang string, word string, count long", [("ro", "respirație", 3), ("ro", "ședință", 2), ("ru", "давление", 5), ("ru", "кровотечение", 5), ("en", "pressure", 4), ("en", "breathing", 4)])
    said = [segment(0, text="respirrație resspirație sedimță"), segment(1, text="дваление кровотечениями крвоотечение", lang="ru"), segment(2, text="perssure breathings", lang="en"), segment(3, text="давлоние", lang="ro")]
    folder = tables(segment=(SEGMENT, said), lexicon=lexicon)
    found = {r[:2]: r[3] for r in rows(spark, "q_candidates", folder)}
    assert found[("ru", "дваление")] == "давление" and found[("en", "perssure")] == "pressure" and found[("ro", "respirrație")] == "respirație"
    assert all(lang != "ro" or word != "давлоние" for lang, word in found)  # the lexicon of another language
    near = {r[:2]: r[2] for r in rows(spark, "q_nearest_word", folder)}
    # кровотечениями, breathings and respirrație part from the lexicon's word in their last letters only
    assert near == {("ro", "resspirație"): "respirație", ("ru", "крвоотечение"): "кровотечение"}


def test_word_errors_by_script(spark, tables):
    said = [segment(0, text="bine doctor 7", raw="bine doctr"), segment(1, text="да bine", raw="да bun"), segment(2, text="хорошо сейчас", raw="хорошо ceva", lang="ru"), segment(3, text="", raw="x", lang="en")]
    got = {r[:2]: r[2:] for r in [(r["lang"], r["script"], r["edits"], r["words"]) for r in registry.queries()["q_word_error_rate"](spark, tables(segment=(SEGMENT, said))).collect()]}
    assert got == {
        ("ro", "all"): (1, 2), ("ro", "latin"): (1, 2), ("mixed", "all"): (1, 2), ("mixed", "latin"): (1, 1), ("mixed", "cyrillic"): (0, 1),
        ("ru", "all"): (1, 2), ("ru", "cyrillic"): (1, 2), ("en", "all"): (1, 0),
    }
