from __future__ import annotations

import random

import numpy as np
import pytest

from orewright.llm import spans as S

WORDS = "lattice kernel journal footer anchor shard panel window index batch".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(n))


def longest_common(a, b):
    best, prev = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else 0)
        best, prev = max(best, *row), row
    return best


def corpus(seed):
    rng = random.Random(seed)
    shared = prose(rng, 120)
    docs = []
    for i in range(14):
        a = rng.randint(0, 500)
        n = rng.choice([0, 295, 299, 300, 301, 340, 500])
        docs.append((i, prose(rng, rng.randint(0, 50)) + shared[a : a + n] + prose(rng, rng.randint(0, 50))))
    return [*docs, (20, docs[0][1]), (21, "short"), (22, ""), (23, None), (24, "x" * 450), (25, "y" + "x" * 300), (26, "z" * 299), (27, "z" * 299)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("cap", [128, 1])
def test_pairs_equal_brute_force(spark, rows, monkeypatch, seed, cap):
    monkeypatch.setattr(S, "SHARD", cap)
    docs = [d for d in corpus(seed) if d[0] in (20, 24, 25, 26, 27, 23) or d[0] < 9]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, place string")
    want = [(a, b) for a, x in docs for b, y in docs if a < b and x and y and (x == y and len(x) >= 300 or longest_common(x, y) >= 300)]
    assert rows(S.sharing_pairs(df)) == sorted(want, key=repr)


def test_maximal_spans_and_share(spark):
    rng = random.Random(9)
    shared = prose(rng, 260)[:1500]
    a, b = prose(rng, 40) + "A" + shared + "B" + prose(rng, 10), prose(rng, 10) + "C" + shared + "D" + prose(rng, 40)
    df = spark.createDataFrame([(1, a), (2, b), (3, prose(rng, 80)), (None, a)], "doc_id bigint, text string")
    (r,) = S.maximal_spans(df).collect()
    assert a[r["start_a"] : r["start_a"] + r["length"]] == shared == b[r["start_b"] : r["start_b"] + r["length"]]
    share = {x["doc_id"]: x["shared_chars"] for x in S.shared_share(df).collect()}
    assert share == {1: 1500, 2: 1500, 3: 0}


def test_long_texts_go_in_stretches(spark, rows, monkeypatch):
    monkeypatch.setattr(S, "STRETCH", 1000)
    docs = [d for d in corpus(7) if d[1]][:9]
    df = spark.createDataFrame([(i, prose(random.Random(1000 + i), 150) + t + prose(random.Random(2000 + i), 150)) for i, t in docs], "doc_id bigint, text string")
    texts = dict(rows(df))
    want = [(a, b) for a in texts for b in texts if a < b and longest_common(texts[a][1000:-1000], texts[b][1000:-1000]) >= 300]
    assert rows(S.sharing_pairs(df)) == sorted(want)
    assert [(i, at, len(x)) for i, at, x in S._stretches(["y" * 1702, "z" * 300], 300)] == [(0, 0, 1000), (0, 701, 1000), (0, 1402, 300), (1, 0, 300)]


def test_empty(spark, rows):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert rows(S.sharing_pairs(df)) == [] and rows(S.shared_share(df)) == []


def test_winnowing_guarantee():
    rng = random.Random(2)
    core = prose(rng, 60)[:300]
    texts = [prose(rng, 30) + core + prose(rng, 30), core, "q" + core + "q", core + prose(rng, 5)]
    own, _, h = S.anchors(texts, 300)
    assert len(set.intersection(*(set(h[own == i].tolist()) for i in range(4)))) >= 1


def test_automaton():
    rng = random.Random(5)
    texts = [[rng.randint(0, 3) for _ in range(rng.randint(1, 30))] for _ in range(6)]
    sam = S.Automaton()
    for t in texts:
        last = 0
        for w in t:
            last = sam.add(w, last)
    for i, t in enumerate(texts):
        sam.own(t, 1 << i)
    probe = [rng.randint(0, 3) for _ in range(40)]
    has = lambda t, p: any(t[k : k + len(p)] == p for k in range(len(t) - len(p) + 1))
    for j, (state, length) in enumerate(sam.statistics(probe)):
        match = probe[j + 1 - length : j + 1]
        assert length == max(n for n in range(j + 2) if n == 0 or any(has(t, probe[j + 1 - n : j + 1]) for t in texts))
        if length:
            assert sam.owners[state] == sum(1 << i for i, t in enumerate(texts) if has(t, match))


def test_window_minima():
    x = np.random.default_rng(1).integers(0, 99, 57).astype(np.uint64)
    for w in (1, 5, 57):
        assert S.window_minima(x, w).tolist() == [x[i : i + w].min() for i in range(len(x) - w + 1)]


def test_broadcast_automata_find_the_same_pairs(spark, rows):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(2, 40)))
    spans = [" ".join(word() for _ in range(30))[:330] for _ in range(4)] + ["x" * 320]
    texts = [" ".join([word(), *(rng.choice([s, s[5:310], word()]) for s in rng.sample(spans, 2)), word()]) for _ in range(40)]
    df = spark.createDataFrame([*enumerate(texts), (90, None), (None, texts[0]), (91, ""), (0, texts[0])], "doc_id bigint, text string")
    want = rows(S.sharing_pairs(df))
    assert len(want) > 20 and rows(S.pairs_by_broadcast(df)) == want
    assert rows(S.pairs_by_broadcast(df, shard_chars=2 * sum(map(len, texts)) // 3)) == want
    with pytest.raises(ValueError, match="shard"):
        S.pairs_by_broadcast(df, shard_chars=200)
    assert rows(S.pairs_by_broadcast(df.limit(0))) == []
