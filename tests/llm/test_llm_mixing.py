from __future__ import annotations

import math
import random

from orewright.llm import mixing as M


def test_plan():
    got = M.plan({"a": 100, "b": 1000}, {"a": (0.5, 2), "b": (0.5, 1), "c": (0.1, 3)})
    assert got == {"a": (2, 0), "b": (0, 200)}
    assert M.plan({}, {"a": (1.0, 1)}) == {} and M.plan({"a": 5}, {"a": (0.0, 1)}) == {}
    assert M.plan({"a": 100}, {"a": (1.0, 3)}, total=150) == {"a": (1, 50)}


def test_operator(spark, rows):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randint(5, 60))), ["Big", "big ", "BIG"][i % 3]) for i in range(3000)]
    docs += [(10_000 + i, "small words here " * 5, "small") for i in range(40)] + [(20_000, "x " * 50, "other"), (20_001, None, "small"), (None, "y", "small"), (20_002, "z", None), (10_000, "small words here " * 5, "small"), (20_003, "", "small")]
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id bigint, text string, source string, tokens string")
    goal = spark.createDataFrame([("big", 0.8, 2), (" Small", 0.2, 3), ("absent", 0.3, 1), ("nul", None, None)], "source string, target_share double, max_repeats int")
    mixed = M.mix(df, goal).persist()
    r = {x["source"]: x for x in M.share_report(mixed, goal).collect()}
    assert abs(r["big"]["actual_share"] - 0.8) < 0.01 and abs(r["small"]["actual_share"] - 0.2) < 0.01 and r["absent"]["actual_share"] == 0
    uses = mixed.groupBy("source", "doc_id").count().collect()
    assert max(x["count"] for x in uses if x["source"] == "small") == 3 and len({x["doc_id"] for x in uses if x["source"] == "small"}) == 41
    assert all(x["count"] <= 2 for x in uses if x["source"] == "big")
    counts = [x["count"] for x in uses if x["source"] == "big"]
    assert max(counts) - min(counts) <= 1
    assert rows(M.mix(df.limit(0), goal)) == [] and rows(M.mix(df, goal.limit(0))) == []
    assert rows(mixed) == rows(M.mix(df, goal))  # the same each time


def test_sampling_takes_the_least_keys(spark):
    df = spark.createDataFrame([(i, "alpha beta gamma " * 10, "a") for i in range(200)], "doc_id bigint, text string, source string")
    goal = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    size = M.measured(df, goal).first()["tokens"]
    taken = {r["doc_id"] for r in M.mix(df, goal, total=size * 50).collect()}
    keys = {r["doc_id"]: r["key"] for r in M.measured(df, goal).collect()}
    assert len(taken) == 50 and max(keys[i] for i in taken) <= min(k for i, k in keys.items() if i not in taken)


def test_quality():
    assert M.quality("", 0) == M.LEAST_QUALITY and M.quality("{}{}{}", 6) == M.LEAST_QUALITY
    assert M.quality("many plain words", 4) < M.quality("many plain words " * 40, 120) < 1
    assert math.isclose(M.quality("ab12", 32), 0.25)
