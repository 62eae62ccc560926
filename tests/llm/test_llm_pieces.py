from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from orewright.llm import pieces as P

TEXT = st.text(st.sampled_from("ab .\n#!?… \ŕ"), max_size=400)


@given(TEXT, st.integers(5, 60), st.integers(0, 80))
@settings(max_examples=300, deadline=None)
def test_pieces_keep_their_promises(text, limit, overlap):
    got = P.cut(text, limit, overlap)
    own = min(overlap, limit // 2)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(e - s <= limit for s, e, _ in got)
    for (s1, e1, _), (s2, e2, _) in zip(got, got[1:], strict=False):
        assert s1 <= s2 <= e1 < e2 and e1 - s2 <= own
    places = set(P.boundaries(text)[0])
    assert all(e in places for _, e, how in got if how == "natural")
    if len(text) > limit and P.longest_run(text) <= limit - own - 2:
        assert not any(how == "forced" for _, _, how in got)


def test_strong_boundaries_win():
    text = ("One two three. " * 20).strip() + "\n\n# Head\n" + ("Four five six. " * 20).strip()
    (s, e, how), *_ = P.cut(text, 400, 20)
    assert how == "natural" and text[e:].startswith("# Head")


def test_balanced():
    text = "Word word word. " * 300
    sizes = [e - s for s, e, _ in P.cut(text, 1000, 100)]
    assert max(sizes) - min(sizes) < 150


def test_operator(spark, rows):
    items = spark.createDataFrame(
        [("specs", 1, "a" * 25, 1), ("specs", 2, "ab. " * 6, 2), ("specs", 3, "short", 3), ("specs", 4, "", 4), ("specs", 5, None, 5), ("other", 6, "z" * 90, 6), ("specs", None, "b" * 25, 7)],
        "src string, item_id bigint, text string, max_chars int",
    )
    limits = spark.createDataFrame([("specs", 10, 2), ("none", None, 3)], "src string, max_chars int, overlap_chars int")
    assert rows(P.oversized(items, limits)) == sorted([("specs", 1, "forced"), ("specs", 2, "natural"), ("specs", None, "forced")], key=repr)
    p = P.split_texts(items, limits).collect()
    assert {r["item_id"] for r in p if r["cut"] == "whole"} == {3, 4, 6}
    assert all(len(r["piece"]) <= 10 for r in p if r["src"] == "specs")
    assert rows(P.oversized(items.limit(0), limits)) == []
    assert rows(P.oversized(items, limits.limit(0))) == []


@given(TEXT, st.integers(5, 60), st.integers(0, 80))
@settings(max_examples=300, deadline=None)
def test_overlap_is_kept_and_labels_follow_the_runs(text, limit, overlap):
    got = P.cut(text, limit, overlap)
    own = min(overlap, limit // 2)
    assert all(e1 - s2 == own for (_, e1, _), (s2, _, _) in zip(got, got[1:], strict=False))
    if len(text) > limit:
        assert any(how == "forced" for *_, how in got) == (P.longest_run(text) > limit)
        if P.longest_run(text) <= limit - own:
            assert all(how in ("natural", "end") for *_, how in got)


def test_five_long_sentences():
    text = " ".join(["x" * 90 + "."] * 5)
    got = P.cut(text, 100, 20)
    assert [s2 for s2, *_ in got[1:]] == [e - 20 for _, e, _ in got[:-1]] and all(e - s <= 100 for s, e, _ in got)
    assert {how for *_, how in got} <= {"natural", "tight", "end"}


def test_no_more_pieces_than_needed():
    text = "Word word word. " * 3000
    assert len(P.cut(text, 1000, 100)) == -(-(len(text) - 100) // 900)
