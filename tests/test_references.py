from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from orewright.core import references as R

T = lambda d: datetime(2024, 1, d)
CALLS = "call_id bigint, caller string, callee string, file string, line int, scanned_at timestamp_ntz, loaded_at timestamp_ntz, key string, periods int, state string"
DEFS = "def_id bigint, symbol string, kind string, file string, line int, byte bigint, scanned_at timestamp_ntz, e int, s int"
FILES = "path string, lang string, text string, bytes bigint, indexed_at timestamp_ntz, deleted_at timestamp_ntz, key string"
EXT = "symbol string, lang string"


def tables(spark, calls, defs, files, ext=(("println", "rust"),)):
    return (
        spark.createDataFrame([(*c, None, "x", 1, "y") for c in calls], CALLS), spark.createDataFrame([(*d, 7, 8) for d in defs], DEFS),
        spark.createDataFrame([(*f, "k") for f in files], FILES), spark.createDataFrame(list(ext), EXT),
    )


FILE = [("a/b.rs", "rust", "", 1, T(1), T(10)), ("a/c.rs", "rust", "", 1, T(5), None)]
DEF = [(1, "foo", "fn", "a/b.rs", 1, 0, T(2)), (2, "bar", "fn", "a/c.rs", 1, 0, T(6)), (3, "foo", "fn", "a/c.rs", 9, 0, T(20)), (4, None, "fn", "a/c.rs", 9, 0, T(2)), (5, "nowhen", "fn", "a/c.rs", 9, 0, None)]


@pytest.mark.parametrize(
    ("callee", "file", "at", "want"),
    [
        ("foo", "a/b.rs", T(3), []),
        ("foo", "a/b.rs", T(2), []),  # the start counts
        ("x::y.foo()", "./a//b.rs", T(3), []),
        ("  foo! ", "a\\.\\b.rs", T(3), []),
        ("foo", "a/c.rs", T(12), [("callee", "deleted")]),
        ("foo", "a/b.rs", T(10), [("callee", "deleted"), ("file", "deleted")]),  # the end doesn't
        ("foo", "a/c.rs", T(20), []),
        ("bar", "a/c.rs", T(4), [("callee", "late"), ("file", "late")]),
        ("Foo", "a/C.rs", T(3), [("callee", "missing"), ("file", "missing")]),
        ("println", None, T(3), []),
        ("std::println!", "", T(3), []),
        ("nowhen", None, T(3), [("callee", "missing")]),
        ("none", None, None, [("callee", "missing")]),
        ("foo", None, None, []),
        (None, None, T(3), []),
    ],
)
def test_states(spark, rows, callee, file, at, want):
    t = tables(spark, [(1, "m", callee, file, 1, at)] * 2, DEF, FILE)
    assert rows(R.call_orphans(*t).select("ref_field", "state")) == want


def test_hot_key_and_counts(spark, rows):
    calls = [(i, "m", "gone", "a/c.rs", 1, T(7)) for i in range(300)] + [(i, None, "bar", "a/c.rs", 1, T(7)) for i in range(300, 900)]
    o = R.call_orphans(*tables(spark, calls, DEF, FILE))
    assert rows(R.orphan_counts(o)) == [("defs", "2024-01", "missing", 300, 1)]


def test_empty_tables(spark, rows):
    none = tables(spark, [], [], [], ())
    assert rows(R.call_orphans(*none)) == []
    some = tables(spark, [(1, None, "f", "p", 1, T(1))], [], [], ())
    assert rows(R.call_orphans(*some).select("ref_field", "state")) == [("callee", "missing"), ("file", "missing")]


def test_periods_are_merged(spark):
    p = spark.createDataFrame([("k", 1, 3), ("k", 2, 5), ("k", 7, None), ("k", 8, 9), ("k", 1, 2), ("z", 4, 4)], "k string, s int, e int")
    day = lambda c: F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, {c} - 1)")
    got = {r["key"]: [(x["s"].day, x["e"].year if x["e"].year > 3000 else x["e"].day) for x in r["periods"]] for r in R.parent_periods(p, F.col("k"), day("s"), day("e")).collect()}
    assert got == {"k": [(1, 5), (7, 9999)], "z": [(4, 4)]}
