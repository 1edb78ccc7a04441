"""Decisions that a task repeats, by brute force: also where the two have no word in common."""

import random

from stenoflow.functions import fuzzy
from stenoflow.plans import registry
from stenoflow.plans.joins import repeated


def test_repeated():
    rng = random.Random(6)
    some = lambda: "".join(rng.choice("abcș   ") for _ in range(rng.randint(0, 11)))
    for _ in range(200):
        tasks = [{"task": some(), "times": rng.sample(["", "1", "2"], rng.randint(0, 2))} for _ in range(8)]
        decisions = [{"decision": some(), "times": [*rng.sample(["", "1", "2"], 2), None]} for _ in range(6)]
        want = set()
        for d in decisions:
            for time in d["times"]:
                for t in tasks:
                    score = fuzzy.token_set_ratio(d["decision"], t["task"])
                    if score >= 80 or time in t["times"] and score >= 35:
                        want.add((d["decision"], time))
        assert set(repeated(decisions, tasks)) == want


def test_decisions_not_tasks(spark, tmp_path):
    decisions = [("m", 0, 0, "abcd efgh", None), ("m", 0, 1, "sună familia", "00:10"), ("m", 0, 2, "sună familia", None), ("n", 0, 0, "abcd efgh", ""), ("m", 0, 3, None, "00:10")]
    tasks = [("m", 0, 0, "abcde fgh", None), ("m", 0, 1, "sună mai târziu la familie", "00:10")]
    for name, text, rows in (("decision", "decision", decisions), ("action_item", "task", tasks)):
        spark.createDataFrame(rows, f"meeting_id string, part_idx int, item_idx long, {text} string, timestamp string").write.parquet(f"{tmp_path}/{name}.parquet")
    got = registry.queries()["q_decisions_not_tasks"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("m", 0, 2), ("m", 0, 3), ("n", 0, 0)]
