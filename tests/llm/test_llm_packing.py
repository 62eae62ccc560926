from __future__ import annotations

import random
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orewright.llm import packing as P
from orewright.llm import tokens as T


def best_possible(sizes, capacity):
    """The least number of containers, by trying all partitions of small inputs."""
    best = [len(sizes)]

    def go(i, room):
        if len(room) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(room)
            return
        seen = set()
        for k, r in enumerate(room):
            if r >= sizes[i] and r not in seen:
                seen.add(r)
                go(i + 1, [*room[:k], r - sizes[i], *room[k + 1 :]])
        go(i + 1, [*room, capacity - sizes[i]])

    go(0, [])
    return best[0]


@given(st.lists(st.integers(0, 20), max_size=9), st.just(20))
@settings(max_examples=200, deadline=None)
def test_bin_completion_is_optimal_on_small_inputs(sizes, capacity):
    bins = P.bin_completion(sizes, capacity)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= capacity for b in bins)
    assert len(bins) <= best_possible(sorted(sizes, reverse=True), capacity) + (sum(sizes) == 0)


def test_completions_are_the_fullest():
    sizes = [9, 7, 6, 4, 3, 1]
    fits = max(sum(c) for n in range(7) for c in combinations(sizes, n) if sum(c) <= 16)
    assert sum(sizes[i] for i in P.completions(sizes, 16, 16, 3)[0]) == fits


def test_group_keeps_whole_texts_and_fills_well():
    rng = random.Random(3)
    sizes = [min(8192, int(rng.lognormvariate(6, 0.8))) for _ in range(1500)]
    kinds = [("wide", 8192), ("short", 512), ("medium", 2048)]
    out = P.pack_group(sizes, kinds)
    assert sorted(i for _, _, m in out for i in m) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in m) <= c for _, c, m in out)
    assert sum(c for _, c, _ in out) / sum(sizes) < 1.02


def test_tokens_equal_the_encoding():
    texts = ["Hello world, it's  fine\n\n", "Граф ссылок\tпропускает 123", "", None, "x" * 5000]
    enc = T.encoding()
    assert T.count_tokens(texts) == [0 if t is None else len(enc.encode_ordinary(t)) for t in texts]


def test_operator(spark, rows):
    docs = spark.createDataFrame([(1, "word " * 30, "a"), (1, "word " * 30, "a"), (2, "", "b"), (3, None, "c"), (4, "word " * 120, "d"), (None, "word " * 7, "e"), (5, "word " * 10, "f"), (5, "other " * 10, "f")], "doc_id bigint, text string, tokens string")
    kinds = spark.createDataFrame([("small", 20), ("large", 50), ("bad", 0), ("none", None)], "container string, capacity_tokens int")
    got = P.pack(docs, kinds).collect()
    by = {}
    for r in got:
        by.setdefault(r["bin_id"], []).append(r)
    assert all(sum(r["tokens"] for r in b) <= b[0]["capacity_tokens"] and len({r["container"] for r in b}) == 1 for b in by.values())
    size = lambda i: sum(r["tokens"] for r in got if r["doc_id"] == i)
    assert size(1) == T.count_tokens(["word " * 30])[0] and size(4) == T.count_tokens(["word " * 120])[0]
    assert [r["piece_no"] for r in got if r["doc_id"] == 1] == [0] and sorted(r["piece_no"] for r in got if r["doc_id"] == 4) == [1, 2, 3]
    assert sum(r["doc_id"] == 5 for r in got) == 2 and not any(r["doc_id"] == 3 for r in got)
    assert rows(P.pack(docs.limit(0), kinds)) == [] and rows(P.pack(docs, kinds.limit(0))) == []
    assert P.fill_report(P.pack(docs, kinds)).count() >= 1


@given(st.lists(st.integers(1, 15), min_size=1, max_size=9), st.integers(1, 20), st.integers(0, 20))
@settings(max_examples=200, deadline=None)
def test_every_undominated_filling_is_enumerated(sizes, space, waste):
    sizes = sorted(sizes, reverse=True)
    got = [tuple(sizes[i] for i in taken) for taken in P.undominated(sizes, space, waste)]
    assert len(got) == len(set(got))
    want = set()
    for n in range(len(sizes) + 1):
        for taken in combinations(range(len(sizes)), n):
            own = [sizes[i] for i in taken]
            left = space - sum(own)
            out = {s for i, s in enumerate(sizes) if i not in taken} - set(own)
            sub = {sum(c) for k in range(n + 1) for c in combinations(own, k)}
            fits = any(i not in taken and s <= left for i, s in enumerate(sizes))
            if 0 <= left <= waste and not fits and not any(0 <= x - s <= left for x in out for s in sub):
                want.add(tuple(own))
    assert set(got) == want


def test_too_many_kinds_are_an_error(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    kinds = spark.range(P.MOST_KINDS + 1).selectExpr("cast(id as string) container", "cast(id + 1 as int) capacity_tokens")
    with pytest.raises(ValueError, match="kinds"):
        P.pack(docs, kinds)
