"""Relational and temporal operators that Spark supplies, with the choices that matter at scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, t: str, rt: str, cols: list[str], bucket_days: int = 30) -> DataFrame:
    """Each left row with the columns of the last right row of its key at or before its time.

    Rows of both sides are laid in one order per key and carried forward; keys with very
    many rows are cut into stretches of `bucket_days`, the last state of each stretch being
    handed on to the next, so no task has to sort a whole hot key.
    """
    day = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / (86400 * bucket_days))
    l = left.withColumn("__t", F.col(t)).withColumn("__side", F.lit(1)).withColumn("__b", day(t))
    state = F.struct(F.col(rt).alias("at"), *[F.col(c) for c in cols])
    r = right.select(key, F.col(rt).alias("__t"), F.lit(0).alias("__side"), day(rt).alias("__b"), state.alias("__s"))
    last = r.groupBy(key, "__b").agg(F.max_by("__s", F.struct("__t", "__s")).alias("__last"))
    carry = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    spots = l.select(key, "__b").unionByName(r.select(key, "__b")).distinct().join(last, [key, "__b"], "left").withColumn("__in", F.last("__last", True).over(carry)).select(key, "__b", "__in")
    both = l.unionByName(r, allowMissingColumns=True).join(spots, [key, "__b"])
    w = Window.partitionBy(key, "__b").orderBy("__t", "__side", "__s").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__s", F.coalesce(F.last("__s", True).over(w), F.col("__in"))).where("__side = 1")
    return out.select(*left.columns, *[F.col("__s")[c].alias(c) for c in cols])


def range_join(left: DataFrame, right: DataFrame, x: Column, lo: Column, hi: Column, width: float) -> DataFrame:
    """Rows of `left` with the rows of `right` whose range holds x, by equality of buckets of `width`."""
    l = left.withColumn("__b", F.floor(x / width).cast("bigint"))
    r = right.withColumn("__b", F.explode(F.sequence(F.floor(lo / width).cast("bigint"), F.floor(hi / width).cast("bigint"))))
    return l.join(r, "__b").where((x >= lo) & (x <= hi)).drop("__b")


def salted_join(left: DataFrame, right: DataFrame, on: str, salts: int) -> DataFrame:
    """An inner join whose hot keys are spread over `salts` tasks: `right` is repeated once a salt."""
    l = left.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    r = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return l.join(r, [on, "__salt"]).drop("__salt")


def salted_sum(df: DataFrame, key: str, value: Column, salts: int = 16) -> DataFrame:
    """(key, total, n) in two steps, so that one key's rows meet in `salts` tasks first."""
    part = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts))).groupBy(key, "__salt").agg(F.sum(value).alias("s"), F.count("*").alias("c"))
    return part.groupBy(key).agg(F.sum("s").alias("total"), F.sum("c").alias("n"))


def sessions(events: DataFrame, key: str, t: str, gap: str) -> DataFrame:
    """(key, start, end, n) of stretches of events less than `gap` apart."""
    g = events.where(F.col(t).isNotNull()).groupBy(key, F.session_window(F.col(t).cast("timestamp"), gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def windows(events: DataFrame, t: str, size: str, slide: str | None, *aggs: Column, by: list[str] | None = None) -> DataFrame:
    w = F.window(F.col(t).cast("timestamp"), size, slide).alias("w") if slide else F.window(F.col(t).cast("timestamp"), size).alias("w")
    g = events.groupBy(w, *(by or [])).agg(*aggs)
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), *(by or []), *[c for c in g.columns if c not in ("w", *(by or []))])


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The latest row of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """`n` rows of `df`, each set of rows being as likely as any other: those of the least digests of key and
    seed. A partition sends on `n` rows at most; equal keys are taken together by their order."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def page_of(df: DataFrame, order: Sequence[Column | str], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of `size` rows in an order; no partition sends on more rows than the pages up to it hold."""
    if number < 1 or size < 1:
        raise ValueError("pages and their rows count from 1")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def bbox_join(left: DataFrame, right: DataFrame, width: float, height: float) -> DataFrame:
    """(l, r): the pairs of boxes (id, x0, y0, x1, y1) of two tables that touch or overlap.

    Boxes are laid on a grid of cells of `width` by `height` and meet where they share a cell; a pair
    is given in the cell of the lower left corner of what they share, so it comes once and needs no
    distinct. Cells of about the size of a usual box are best. Boxes with a null or reversed side
    touch nothing.
    """

    def cells(df: DataFrame, name: str) -> DataFrame:
        b = df.select(F.col("id").alias(name), *[F.col(c).cast("double").alias(f"{name}_{c}") for c in ("x0", "y0", "x1", "y1")])
        b = b.where((F.col(f"{name}_x0") <= F.col(f"{name}_x1")) & (F.col(f"{name}_y0") <= F.col(f"{name}_y1")))
        at = lambda c, size: F.floor(F.col(f"{name}_{c}") / size)
        return b.withColumn("cx", F.explode(F.sequence(at("x0", width), at("x1", width)))).withColumn("cy", F.explode(F.sequence(at("y0", height), at("y1", height))))

    j = cells(left, "l").join(cells(right, "r"), ["cx", "cy"])
    x, y = F.greatest("l_x0", "r_x0"), F.greatest("l_y0", "r_y0")
    touch = (x <= F.least("l_x1", "r_x1")) & (y <= F.least("l_y1", "r_y1"))
    return j.where(touch & (F.floor(x / width) == F.col("cx")) & (F.floor(y / height) == F.col("cy"))).select("l", "r")
