"""Every query outside the llm subpackage against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from orewright.plans import registry
from tests.compare import compare, duck

NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con(data):
    return duck(data)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, con, name):
    said = compare(spark, name, data, con)
    assert said.startswith(("same", "rows")), said


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(NAMES)
