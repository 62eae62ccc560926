from __future__ import annotations

import random

import pytest

from orewright.llm import qapairs as Q
from tests.llm import refusal_cases as R

ASK = "How do we notice that the shell panel drops the daily journal?"


@pytest.mark.parametrize(
    ("question", "answer", "want"),
    [
        (ASK, None, "empty"), (ASK, " \n​", "empty"), (ASK, "<p> </p>", "empty"), (ASK, "```\n```", "empty"), (ASK, "N/A", "empty"), (ASK, "нет данных", "empty"), (ASK, "…", "empty"),
        (ASK, "42 ms", None), (ASK, "`push_hit`", None), (ASK, "T-23", None), (ASK, "= 1.75", None),
        (ASK, ASK, "echo"), (ASK, ASK.upper(), "echo"), (ASK, f"> {ASK}", "echo"), (ASK, f"Your question was: {ASK}", "echo"), (ASK, f"{ASK}\n{ASK}", "echo"),
        (ASK, f"{ASK}\n\nThe window scanner locks the footer in a single sweep.", None),
        (ASK, "I'm sorry, but I can't help with that.", "refusal"), (ASK, "The daily journal… I'd rather not discuss it, as it may be unsafe. Is there anything else?", "refusal"),
        ("Почему граф ссылок пропускает дневной журнал?", "Простите. Обсуждать это я не стану, так как это может быть небезопасно.", "refusal"),
        ("Чому граф посилань пропускає журнал?", "На жаль, я не можу з цим допомогти.", "refusal"), ("Warum faltet der Zeiger das Tagebuch?", "Leider gilt: diese Bitte muss ich ablehnen.", "refusal"), ("¿Por qué el índice guarda la copia?", "Disculpa. No puedo ayudarte con eso.", "refusal"),
        (ASK, "I can't stress enough that the order matters. The panel drops it on row 12.", None), (ASK, "A closed reader cannot be opened twice, sorry for the confusion.", None),
        (ASK, "The panel drops the journal before the lock is rel", "truncated"), (ASK, "It works.\n\n```rust\nlet a = 1;", "truncated"), (ASK, "It works.\n- one point.\n- During a", "truncated"),
        (ASK, "It works.\n\n| a | b |\n| --- | --- |\n| x | 0.", "truncated"), (ASK, "The panel drops it (with weight", "truncated"), (ASK, "It works.\n\n```rust\nlet a = 1;\n```", None), (ASK, "It works.\n\n| a | b |\n| --- | --- |\n| x | 0.5 |", None),
        (ASK, "Der Ranglauf prüft das seltenste Wort in der Zeile.", "other_lang"), ("Translate into Deutsch: the panel drops it.", "Der Ranglauf prüft das seltenste Wort in der Zeile.", None),
        ("Почему холодный сегмент держит журнал?", "Холодний сегмент тримає журнал позаду кешу, бо порядок важливий.", "other_lang"),
        (None, "The panel drops it.", None), ("", "The panel drops it.", None), ("", "", "empty"),
    ],
)
def test_defects(question, answer, want):
    assert Q.defect(question, answer) == want


def test_operator(spark, rows):
    long = "The panel drops it on the row. " * 20_000
    df = spark.createDataFrame([(1, ASK, None, "a"), (1, ASK, None, "a"), (2, ASK, long, "b"), (None, ASK, "n/a", "c"), (3, None, None, "d")], "id bigint, question string, answer string, defect string")
    assert rows(Q.defective(df)) == sorted([(1, "empty"), (None, "empty"), (3, "empty")], key=repr)
    assert rows(Q.defective(df.limit(0))) == []


def test_long_open_quotation():
    said = "The panel drops it on the row. " * 40
    assert Q.defect(ASK, f'The manual says: "{said}') == "truncated"
    assert Q.defect(ASK, f'The manual says: "{said.rstrip()}"') is None


def test_tiling():
    assert Q.tiled("a b c x a b c d".split(), "a b c d".split(), 3) == 7
    assert Q.tiled([], ["a"], 3) == 0


def _tiles_plainly(a, b, least):
    """Greedy string tiling word by word: the longest unmarked match, the first in `a` of several."""
    ua, ub, total = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in ua and j + n not in ub:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return total
        ua |= set(range(i, i + n))
        ub |= set(range(j, j + n))
        total.append(n)


def test_greedy_tiles_are_those_of_a_plain_search():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 18))] for _ in range(2))
        got = Q.greedy_tiles(a, b, 2)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in got)
        for k, side in ((0, a), (1, b)):
            marked = [p for t in got for p in range(t[k], t[k] + t[2])]
            assert len(marked) == len(set(marked)) and all(p < len(side) for p in marked)
        lengths = [n for *_, n in got]
        assert lengths == sorted(lengths, reverse=True)
        plain = _tiles_plainly(a, b, min(2, len(b)) or 1)
        assert lengths[:1] == plain[:1]
        left = [p for p in range(len(a)) if all(not i <= p < i + n for i, _, n in got)]
        assert len(left) <= len(a) - sum(plain) + 4  # ties between equal lengths may cost a word


def test_order_of_runs_counts():
    q = "one two three four five six seven eight nine ten eleven twelve".split()
    assert Q.tiled(q, q, 3) == 12
    assert [n for *_, n in Q.greedy_tiles(q[6:] + q[:6], q, 3)] == [6, 6]
    again = "one two three four two three four five three four five six".split()  # overlapping runs use words of the question twice
    assert sum(n for *_, n in Q.greedy_tiles(again, q, 3)) < 12


def test_tiling_of_long_periodic_texts_ends():
    assert Q.tiled(["x"] * 30_000, ["x"] * 20_000, 3) >= 29_998


@pytest.mark.parametrize(
    ("answer", "cut"),
    [
        ("<b>bold text that never closes.", True), ("<b>bold</b> text.", False), ("<ul><li>one thing.", True), ("<ul><li>one thing.</ul>", False), ("A line.<br>Another line.", False), ("<p>A line.", False),
        ("It holds (as said.\n\nThe next paragraph goes on.", True), ("It holds (as said.\n\nThe next paragraph goes on).", False), ("He said «this holds.\n\nIt goes on.", True),
        ('He said "this is a thing' + " and more words" * 40 + " It goes on.", True), ('"First paragraph of the words.\n\n"Second paragraph of the words."', False), ('A screen of 24" is enough.', False), ('It is "quoted" and (bracketed "inside") here.', False),
        ("It is **bold text.", True), ("It is **bold** text.", False), ("It is `code that stays open.", True), ("A stray ` mark.\n\nThe next paragraph is whole.", False),
        ("See:\n\n| a | b |\n| --- | --- |", True), ("See:\n\n| a | b |\n| --- | --- |\n| 1 | 2 |", False), ("See:\n\n| a | b |\n| --- | --- |\n| 1 |", True),
        ("Steps:\n- open it\n- close it", False), ("Steps:\n- open it.\n- close", True), ("Steps:\n- open it.\n-", True), ("~~~~\ncode\n~~~", True), ("~~~~\ncode ( [ \"\n~~~~", False),
        ("a) the first way. b) the second way.", False), ("It works :)", False), ("It works :).", False), ("It is <a href=", True), ("If x < y it stops.", False),
    ],
)
def test_parse(answer, cut):
    assert Q.is_truncated(answer) is cut


def test_refusals_written_by_hand():
    """The grammar was mended on the first set; the second shows what it finds of others."""
    for found, wanted in ((R.REFUSALS, 1.0), (R.LATER_REFUSALS, 0.85)):
        said = [Q.defect(R.QUESTIONS[k], a) == "refusal" for k, v in found.items() for a in v]
        assert sum(said) >= wanted * len(said)
    for k, v in [*R.ANSWERS.items(), *R.LATER_ANSWERS.items()]:
        for a in v:
            assert Q.defect(R.QUESTIONS[k], a) is None, a
