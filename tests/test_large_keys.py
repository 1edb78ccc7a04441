"""Keys beyond what an int holds when they are put into one number."""

import pytest

from stenoflow.plans import registry

DECISION = "meeting_id string, part_idx int, item_idx long, decision string, subject string, timestamp string, evidence_quote string"
ACTION = "meeting_id string, part_idx int, item_idx long, task string, subject string, timestamp string, evidence_quote string"


@pytest.fixture
def folder(spark, tmp_path):
    decisions = [("m", 5000, 1, "Rămâne așa.", "patul 3", "00:10", None), ("m", 3000, 2, "Da.", "Patul 3 ", "00:05", None)]
    tasks = [("m", 4000, 1, "Sună familia azi.", "patul 3", "00:20", "x"), ("m", 2_000_000_000, 7, "Sună familia azi", "patul 3", "00:20", "xyz"), ("m", 4000, 0, "Trimite raportul.", None, None, None)]
    for name, schema, rows in (("decision", DECISION, decisions), ("action_item", ACTION, tasks)):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def rows(spark, name, folder):
    return sorted(map(tuple, registry.queries()[name](spark, folder).collect()))


def test_subject_blocks(spark, folder):
    got = {r[1]: r[2:] for r in rows(spark, "q_subject_blocks", folder)}
    assert got == {"patul 3": (10, 1, 2, "Sună familia azi. | Sună familia azi", 1), "Patul 3 ": (5, 1, 0, "", 2), "general": (0, 0, 1, "Trimite raportul.", 3)}


def test_leader_dedup(spark, folder):
    assert rows(spark, "q_leader_dedup", folder) == [("m", 4_000_000_000, 0, True), ("m", 4_000_000_001, 1, True), ("m", 2_000_000_000_000_007, 1, True)]


def test_subject_clusters(spark, folder):
    got = rows(spark, "q_subject_clusters", folder)
    assert got == [("m", 3_000_000_002, 0, True), ("m", 5_000_000_001, 0, False), ("m", 1_004_000_000_001, 0, False), ("m", 2_001_000_000_000_007, 0, False)]


def test_leaders_with_an_index():
    import random

    from stenoflow.functions import fuzzy
    from stenoflow.operators import folds

    rng = random.Random(4)
    for least in (85.0, 60.0, 30.0):
        for _ in range(60):
            some = ["".join(rng.choice("abș  ") for _ in range(rng.randint(0, 12))) for _ in range(25)]
            said = [{"item": i, "text": rng.choice(some), "quote": "x" * rng.randint(0, 9)} for i in range(60)]
            plain, want = [], []
            for r in said:
                at = next((i for i, x in enumerate(plain) if fuzzy.token_set_ratio(r["text"], x[0]) >= least), None)
                took = at is None or len(r["quote"]) > len(plain[at][1])
                if at is None:
                    at = len(plain)
                    plain.append(None)
                if took:
                    plain[at] = (r["text"], r["quote"])
                want.append((r["item"], at, took))
            for index in (None, fuzzy.WordSets()):
                leaders = folds.Leaders(fuzzy.token_set_ratio, least, index=index)
                assert [x for r in said for x in leaders.feed(r)] == want, said
