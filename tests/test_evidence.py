"""A quote's segment is the best of all segments of its meeting, by brute force."""

import random

from stenoflow.functions import fuzzy
from stenoflow.plans.joins import best_turns


def test_partial_ratio_from():
    rng = random.Random(1)
    some = lambda k: "".join(rng.choice("abcă ") for _ in range(rng.randint(0, k)))
    for _ in range(1500):
        a, b, least = some(9), some(25), rng.choice([0.0, 40.0, 72.0, 90.0, 100.0])
        whole = fuzzy.partial_ratio(a, b)
        assert fuzzy.partial_ratio_from(a, b, least) == (whole if whole >= least else 0.0), (a, b, least)


def test_best_turn():
    rng = random.Random(2)
    some = lambda lo, hi: "".join(rng.choice("abcd ") for _ in range(rng.randint(lo, hi)))
    for _ in range(150):
        turns = [{"seg_idx": i, "start": 50.0 * i, "text": some(1, 25)} for i in range(20)]
        quotes = [{"part_idx": 0, "item_idx": i, "quote": some(8, 15), "ts": rng.choice([None, 100.0, 700.0]), "least": 55.0} for i in range(3)]
        got = {x[1]: x[2:] for x in best_turns(quotes, turns)}
        for q in quotes:
            every = [(fuzzy.partial_ratio(q["quote"], t["text"]) + 3.0 * (q["ts"] is not None and abs(t["start"] - q["ts"]) < 120), -t["start"], t["seg_idx"]) for t in turns]
            score, start, seg = max(every)
            assert got.get(q["item_idx"]) == ((seg, -start, score) if score >= 55 else None)


def test_earlier_and_nearer_segments_win(spark, tmp_path):
    from stenoflow.plans import registry

    quote = "vom administra zece miligrame la ora opt"
    said = [("m", 0, 0.0, "ora opt"), ("m", 1, 500.0, quote), ("n", 0, 0.0, quote), ("n", 1, 900.0, "vom administra zece miligrame la ora op")]
    spark.createDataFrame(said, "meeting_id string, seg_idx long, start double, text string").write.parquet(f"{tmp_path}/segment.parquet")
    decisions = [("m", 0, 0, quote, None), ("n", 0, 0, quote, "00:15:00")]
    spark.createDataFrame(decisions, "meeting_id string, part_idx long, item_idx long, evidence_quote string, timestamp string").write.parquet(f"{tmp_path}/decision.parquet")
    got = registry.queries()["q_evidence"](spark, str(tmp_path)).select("meeting_id", "seg_idx", "evidence_score").collect()
    assert sorted(map(tuple, got)) == [("m", 0, 100.0), ("n", 1, 100.0)]


def test_likely_scores_are_reached():
    from stenoflow.plans.joins import likely_scores

    rng = random.Random(3)
    some = lambda lo, hi: " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(lo, hi)))
    for _ in range(100):
        turns = [{"seg_idx": i, "start": rng.choice([None, 50.0 * i]), "text": rng.choice([some(1, 9), "..."])} for i in range(rng.randint(1, 12))]
        quotes = [{"part_idx": 0, "item_idx": i, "quote": some(3, 6), "ts": rng.choice([None, 100.0])} for i in range(4)]
        for _, i, score in likely_scores(quotes, turns):
            q = quotes[i]
            every = [fuzzy.partial_ratio(q["quote"], t["text"]) + 3.0 * (q["ts"] is not None and t["start"] is not None and abs(t["start"] - q["ts"]) < 120) for t in turns]
            assert 55 <= score <= max(every) + 1e-9


def test_evidence_has_few_copies_of_a_meeting(spark):
    from stenoflow.plans.joins import _met

    quotes = spark.range(9000).selectExpr("'m' as meeting_id", "cast(0 as int) as part_idx", "id as item_idx", "'q' as quote", "null as ts", "55.0D as least")
    turns = spark.range(40_000).selectExpr("'m' as meeting_id", "id as seg_idx", "1.0D as start", "'t' as text")
    met = [(r["q"], r["t"]) for r in _met(quotes, turns).selectExpr("size(quotes) as q", "size(turns) as t").collect()]
    assert sum(q * t for q, t in met) == 9000 * 40_000 and sum(q for q, _ in met) <= 9000 * 32 and sum(t for _, t in met) <= 40_000 * 4


def test_uncertain_word_of_a_quote(spark, tmp_path):
    from stenoflow.plans import registry

    words = lambda *ps: [(w, p, True) for w, p in zip("vom administra zece miligrame de noradrenalină la ora opt".split(), ps)]
    said = [("m", 0, 0.0, "vom administra zece miligrame de noradrenalină la ora opt", words(0.9, 0.9, 0.9, 0.9, 0.9, 0.3, 0.9, 0.9, 0.2)), ("m", 1, 9.0, "cu totul altceva", None)]
    spark.createDataFrame(said, "meeting_id string, seg_idx long, start double, text string, word_conf array<struct<word:string,p:double,critical:boolean>>").write.parquet(f"{tmp_path}/segment.parquet")
    decisions = [("m", 0, 0, "administra zece miligrame de noradrenalină", None)]
    spark.createDataFrame(decisions, "meeting_id string, part_idx long, item_idx long, evidence_quote string, timestamp string").write.parquet(f"{tmp_path}/decision.parquet")
    assert [tuple(r) for r in registry.queries()["q_uncertain_in_quote"](spark, str(tmp_path)).collect()] == [("m", 0, 0, 5, "noradrenalină", 0.3)]


def test_repeated_segments_are_met_once(spark):
    from stenoflow.plans.joins import _met

    quotes = spark.range(50).selectExpr("'m' as meeting_id", "0 as part_idx", "id as item_idx", "'q' as quote", "null as ts", "55.0D as least")
    turns = spark.range(200).selectExpr("'m' as meeting_id", "id % 100 as seg_idx", "1.0D as start", "'t' as text")
    assert [(len(r["quotes"]), len(r["turns"])) for r in _met(quotes, turns).select("quotes", "turns").collect()] == [(50, 100)]


def test_equal_and_near_segments():
    from stenoflow.plans.joins import found_turns

    rng = random.Random(4)
    some = lambda a, lo, hi: "".join(rng.choice(a) for _ in range(rng.randint(lo, hi)))
    for _ in range(300):
        letters = rng.choice(["ab ", "abc. ", "abcdefgh  "])
        turns = [{"seg_idx": i, "start": rng.choice([None, 50.0 * rng.randint(0, 20)]), "text": some(letters, 1, rng.choice([6, 25, 60]))} for i in range(rng.randint(1, 15))]
        said = "".join(t["text"] for t in turns) + " " * 8
        for alone in (True, False):
            k = rng.randint(0, len(said) - 8)
            q = {"part_idx": 0, "item_idx": 0, "quote": rng.choice([said[k : k + rng.randint(8, 30)], some(letters, 8, 40)]), "ts": rng.choice([None, 100.0, 700.0]), "least": 55.0}
            near = lambda t: q["ts"] is not None and t["start"] is not None and abs(t["start"] - q["ts"]) < 120  # noqa: B023, E731
            score, start, seg = max((fuzzy.partial_ratio(q["quote"], t["text"]) + 3.0 * near(t), -(float("inf") if t["start"] is None else t["start"]), -t["seg_idx"]) for t in turns)
            got = [(x[2], x[4]) for x in found_turns([q], turns, alone)]
            assert got == ([(-seg, score)] if score >= (55 if alone else 100) else []), (q, turns)
