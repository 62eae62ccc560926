from __future__ import annotations

import pytest

from orewright.core import packed as P

WORDS = ["draft", "io/net", "deep work", "c++", "node.js", "utf-8", "rust:async", "Anker", "50%"]
# plain fields that give the values their code lengths
PLAIN = [", ".join(WORDS[i:] + WORDS[:i]) for i in range(len(WORDS))] + WORDS


@pytest.mark.parametrize(
    ("field", "want"),
    [
        ("draft, io/net,deep work", ["draft", "io/net", "deep work"]),
        ("draft;io/net | deep work", ["draft", "io/net", "deep work"]),
        ("#draft #c++ #50%", ["draft", "c++", "50%"]),
        ("#draft, #deep work", ["draft", "deep work"]),
        ("[draft, draft]", ["draft", "draft"]),
        ('["draft", "a, b", "the \\"outer\\" gate", "\\u0436"]', ["draft", "a, b", 'the "outer" gate', "ж"]),
        ('"a, b", "the ""outer"" gate"', ["a, b", 'the "outer" gate']),
        ("«x | y»; «draft»", ["x | y", "draft"]),
        ("“\"in\" side”, “draft”", ['"in" side', "draft"]),
        ("draft / io/net / utf-8", ["draft", "io/net", "utf-8"]),
        ("draft\r\nAnker\n\nc++", ["draft", "Anker", "c++"]),
        (",draft, ,;", ["draft"]),
        ("  deep work ", ["deep work"]),
        ("draft\tAnker", ["draft", "Anker"]),
        ("draft • Anker", ["draft", "Anker"]),
        ("draft、Anker", ["draft", "Anker"]),
    ],
)
def test_values(spark, field, want):
    df = spark.createDataFrame([(0, field, "x", 1)] + [(i + 1, p, None, 2) for i, p in enumerate(PLAIN)], "id bigint, tags string, key string, field int")
    got = sorted((r["pos"], r["value"]) for r in P.split_packed(df, "id", "tags").where("key = 0").collect())
    assert [v for _, v in got] == want
    assert [p for p, _ in got] == list(range(1, len(want) + 1))


def test_odd_input(spark, rows):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "[]"), (5, ","), (6, "a"), (6, "a"), (None, "b"), (7, ", ".join(f"v{i}" for i in range(3000)))], "id bigint, tags string")
    got = rows(P.split_packed(df, "id", "tags").select("key", "pos", "value"))
    assert (6, 1, "a") in got and (None, 1, "b") in got
    assert sum(r[0] == 7 for r in got) == 3000 and {r[0] for r in got} == {6, 7, None}


def test_empty_table(spark, rows):
    assert rows(P.split_packed(spark.createDataFrame([], "id bigint, tags string"), "id", "tags")) == []


def test_code_lengths_decide(spark, rows):
    # a comma within a value that is known, in a field of semicolons
    known = [(i, '"Lodge, part 2"') for i in range(40)] + [(50 + i, "draft") for i in range(20)] + [(80 + i, "Anker") for i in range(20)]
    df = spark.createDataFrame([*known, (200, "Lodge, part 2; draft; Anker")], "id bigint, tags string")
    assert [r[2] for r in sorted(rows(P.split_packed(df, "id", "tags").where("key = 200").select("key", "pos", "value")))] == ["Lodge, part 2", "draft", "Anker"]


def test_every_set_of_separators_is_tried():
    field = "a,b;c|d\te\nf"
    tried = {d for d, *_ in P.parses(field)}
    assert len(tried) == 2**5 and {"comma+semicolon+bar+tab", "comma+semicolon+bar+tab+line"} <= tried


def test_a_long_field_under_many_dialects(spark, rows):
    field = "; ".join(f"tag {i}, x | y / z" for i in range(3000))
    df = spark.createDataFrame([(1, field)], "id bigint, tags string")
    assert P.split_packed(df, "id", "tags").count() >= 3000
