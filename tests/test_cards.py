"""The card of a document against its SQL on odd texts; those of its scenes stay in the queries by scene."""

from __future__ import annotations

import pytest

from orewright.plans import registry
from tests.compare import compare, duck

TEXTS = {
    1: "# A\n**Metric: T-1**\n**Subjects: Ann, Bo**\n\n# B\n**Metric: Т-92**\n**Location: Pier**",
    2: "# A\n" + "text\n" * 58 + "**Metric: T-1**",
    3: "# A\n" + "text\n" * 59 + "**Metric: T-1**",
    4: "intro\r\n# A \r\nMetric: Т-9\r\nLocation: Pier\r\n",
    5: "**МЕТРИКА: Т-9**\nЛОКАЦИЯ: Пирс\nсубъекты:  , Ann,　",
    6: "METRİC: T-1\n#  \n# Late",
    7: "Metric\u000b: T-1",
    8: "x Metric: T-1\n# A\u0085b",
    9: "Metric:\n\n  \nMetric: T-1",
    10: "",
    11: None,
}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory) -> str:
    at = str(tmp_path_factory.mktemp("cards"))
    spark.createDataFrame(list(TEXTS.items()), "doc_id bigint, text string").write.parquet(f"{at}/documents.parquet")
    return at


def test_temporal_of_documents(spark, odd, rows):
    assert compare(spark, "scan_temporal", odd, duck(odd)).startswith("same")
    assert rows(registry.queries()["scan_temporal"](spark, odd)) == sorted([(3, None), (4, "Т-9\r"), (5, "Т-9"), (6, None), (7, None), (8, None), (9, None), (10, None)], key=repr)
    assert (1, "Т-92") in rows(registry.queries()["scan_temporal_by_scene"](spark, odd))


def test_cards_of_documents(spark, odd, rows):
    assert compare(spark, "scene_cards", odd, duck(odd)).startswith("same")
    got = rows(registry.queries()["scene_cards"](spark, odd))
    assert [r[0] for r in got].count(1) == 1 and len(got) == 10
    for row in [(1, "A", "T-1", "Pier", 2), (4, "A \r", "Т-9\r", "Pier\r", 0), (5, None, "Т-9", "Пирс", 1), (6, None, None, None, 0), (8, "A\u0085b", None, None, 0)]:
        assert row in got
    assert {(1, "A", "T-1", None, 2), (1, "B", "Т-92", "Pier", 0)} <= set(rows(registry.queries()["scene_cards_by_scene"](spark, odd)))
