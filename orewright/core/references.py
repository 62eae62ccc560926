"""Dangling references: keys that name no record existing at the time of the reference.

A parent record exists during a period [start, end); an open end is null. A reference
(key, t) dangles if no period of its key holds t:

* ``missing``: the key has no period at all;
* ``late``: every period of the key starts after t;
* ``deleted``: any other case (some period is over, none holds t).

Defined results for odd input: a null or blank key is no reference. A period without a
start can't be placed in time and is left out; one that ends at or before its start is
empty and never holds a t, though its key counts as found. A reference without a time
can only be ``missing``. Double rows count once. Empty tables give an empty result.
Columns of the inputs beyond the named ones are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



BLANKS = " \t\n\x0b\f\r"


def last_segment(c: Column) -> Column:
    """The name a call refers to: outer blanks and one trailing ``()`` or ``!`` left aside,
    then what follows the last ``::`` or ``.``; null if nothing is left."""
    bare = F.btrim(c, F.lit(BLANKS))
    bare = F.when(F.endswith(bare, F.lit("()")), F.left(bare, F.length(bare) - 2)).when(F.endswith(bare, F.lit("!")), F.left(bare, F.length(bare) - 1)).otherwise(bare)
    name = F.btrim(F.substring_index(F.substring_index(bare, "::", -1), ".", -1), F.lit(BLANKS))
    return F.when(name != "", name)


def same_path(c: Column) -> Column:
    """One spelling for a path: forward slashes, none doubled, no ``.`` segments; null if empty."""
    plain = F.trim(F.translate(c, "\\", "/"))
    inner = F.regexp_replace(F.regexp_replace(plain, "/{2,}", "/"), r"(^|/)(\./)+", "$1")
    path = F.when(F.contains(plain, F.lit("//")) | F.contains(plain, F.lit("./")) | F.endswith(plain, F.lit("/.")), F.regexp_replace(inner, r"(?<=.)/\.$", "")).otherwise(plain)
    return F.when((path != "") & (path != "."), path)


FAR = "9999-12-31 00:00:00"


def _merged(p: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The periods (s, e) of each of `keys`, those that overlap or touch made one."""
    w = Window.partitionBy(*keys).orderBy("s")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("new", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0))
    p = p.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return p.groupBy(*keys, "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("run")


def parent_periods(parents: DataFrame, key: Column, start: Column, end: Column, *more: str) -> DataFrame:
    """(*more, key, periods): the disjoint periods of each key in order.

    Periods are reduced before they meet: of equal starts the latest end, nothing that
    starts after a period which never ends, and those of one month are merged first, so a
    hot key is spread over its months. What is left of one key is the number of times it
    went away, not the number of its records.
    """
    keys = [*more, "key"]
    p = parents.select(*more, key.alias("key"), start.cast("timestamp_ntz").alias("s"), end.cast("timestamp_ntz").alias("e")).where("key is not null and s is not null")
    p = p.groupBy(*keys, "s").agg(F.when(F.count("*") == F.count("e"), F.max("e")).alias("e"))
    opens = p.where("e is null").groupBy(*keys).agg(F.min("s").alias("open_s"))
    p = p.join(opens, keys, "left").where("open_s is null or s <= open_s")
    p = p.select(*keys, F.date_trunc("month", "s").alias("month"), "s", F.coalesce("e", F.lit(FAR).cast("timestamp_ntz")).alias("e"))
    p = _merged(_merged(p, [*keys, "month"]).drop("month"), keys)
    return p.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("periods"))


def dangling(refs: DataFrame, parents: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The dangling rows of `refs` (ref_field, ref_key, t and others) with their ``state``.

    `parents` has in (ref_field, ref_key, periods) what :func:`parent_periods` gives, `known` in
    (ref_field, ref_key) the keys that are no case. Only the distinct keys, with their first and
    last time, meet the parents: keys that one period holds at every time at which they are
    named fall out in an anti-join, so a hot sound key never takes part in the join back, and a
    hot broken one is split by the adaptive skew join.
    """
    on = ["ref_field", "ref_key"]
    r = refs.where("ref_key is not null")
    keys = r.groupBy(*on).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    if known is not None:
        keys = keys.join(known.select(*on).where("ref_key is not null").distinct(), on, "left_anti")
    held = parents.select(F.col("ref_field").alias("f"), F.col("ref_key").alias("k"), F.explode("periods").alias("p"))
    whole = F.col("t0").isNull() | ((F.col("p.s") <= F.col("t0")) & (F.col("t1") < F.col("p.e")))
    broken = keys.join(held, (F.col("ref_field") == F.col("f")) & (F.col("ref_key") == F.col("k")) & whole, "left_anti")
    broken = broken.select(*on).join(parents, on, "left")
    alive = F.exists("periods", lambda p: (p["s"] <= F.col("t")) & (F.col("t") < p["e"]))
    state = (
        F.when(F.col("periods").isNull(), "missing")
        .when(F.col("t").isNull() | alive, F.lit(None).cast("string"))
        .when(F.col("t") < F.element_at("periods", 1)["s"], "late")
        .otherwise("deleted")
    )
    return r.join(broken, on).withColumn("state", state).where("state is not null").drop("periods")


def call_orphans(calls: DataFrame, defs: DataFrame, files: DataFrame, externals: DataFrame, distinct: bool = True) -> DataFrame:
    """(call_id, ref_field, state, ref_key, t) of the dangling callees and files of `calls`; double rows of `calls` give theirs once, if `distinct`."""
    f = files.select("path", "indexed_at", "deleted_at")
    ends = f.select(F.col("path").alias("file"), "deleted_at").where("deleted_at is not null")
    named = defs.select("symbol", "file", "scanned_at").distinct().join(ends, "file", "left")
    both = named.select(F.lit("callee").alias("ref_field"), F.col("symbol").alias("name"), F.col("scanned_at").alias("start"), F.col("deleted_at").alias("end")).unionByName(
        f.select(F.lit("file").alias("ref_field"), same_path(F.col("path")).alias("name"), F.col("indexed_at").alias("start"), F.col("deleted_at").alias("end"))
    )
    parents = parent_periods(both, F.col("name"), F.col("start"), F.col("end"), "ref_field").withColumnRenamed("key", "ref_key")
    known = externals.select(F.lit("callee").alias("ref_field"), F.col("symbol").alias("ref_key"))
    named_by = F.array(
        F.struct(F.lit("callee").alias("ref_field"), last_segment(F.col("callee")).alias("ref_key")), F.struct(F.lit("file").alias("ref_field"), same_path(F.col("file")).alias("ref_key"))
    )
    refs = calls.select("call_id", F.col("scanned_at").cast("timestamp_ntz").alias("t"), F.inline(named_by))
    found = dangling(refs, parents, known).select("call_id", "ref_field", "state", "ref_key", "t")
    return found.distinct() if distinct else found


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per referenced table, month of the reference and state."""
    table = F.when(F.col("ref_field") == "callee", "defs").otherwise("source_files")
    return (
        orphans.select(table.alias("ref_table"), F.date_format("t", "yyyy-MM").alias("month"), "state", "call_id", "ref_key")
        .groupBy("ref_table", "month", "state")
        .agg(F.count("*").alias("orphans"), F.countDistinct("ref_key").alias("keys"))
    )
