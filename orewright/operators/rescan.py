"""Incremental scans: a corpus is read again only where size or time of a file have changed.

The state of a scan is kept a file: its size and time, and the counts of its tokens. A
later scan compares listings, takes back what changed or vanished files had counted and
adds what they count now; the others are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orewright.operators import text as T
from orewright.session import materialize


def file_counts(files: DataFrame) -> DataFrame:
    """(path, tok, n) of `files` (path, text)."""
    return T.token_stream(files, "path", "text").groupBy("path", "tok").agg(F.count("*").alias("n"))


def scan_plan(known: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, act): ``add``, ``change``, ``remove`` or ``keep`` by comparing (path, size, mtime) of the last scan and now."""
    k = known.select("path", F.struct("size", "mtime").alias("was"))
    n = listing.select("path", F.struct("size", "mtime").alias("now"))
    act = F.when(F.col("was").isNull(), "add").when(F.col("now").isNull(), "remove").when(F.col("was").eqNullSafe(F.col("now")), "keep").otherwise("change")
    return k.join(n, "path", "full_outer").select("path", act.alias("act"))


def rescan(known: DataFrame, counts: DataFrame, vocabulary: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plan, counts, vocabulary) after a scan of `files` (path, size, mtime, text), given the listing, the counts a
    file and the vocabulary (tok, freq) of the last one. Only texts of new and changed files are read."""
    plan = materialize(scan_plan(known, files.select("path", "size", "mtime")), "plan")
    fresh = files.join(plan.where("act in ('add', 'change')").select("path"), "path", "left_semi")
    gone = counts.join(plan.where("act in ('change', 'remove')").select("path"), "path", "left_semi")
    new = materialize(file_counts(fresh), "counts")
    moved = new.select("tok", F.col("n").alias("d")).unionByName(gone.select("tok", (-F.col("n")).alias("d"))).groupBy("tok").agg(F.sum("d").alias("d"))
    freq = F.coalesce("freq", F.lit(0)) + F.coalesce("d", F.lit(0))
    vocab = vocabulary.join(moved, "tok", "full_outer").select("tok", freq.alias("freq")).where("freq > 0")
    return plan, counts.join(plan.where("act in ('change', 'remove')").select("path"), "path", "left_anti").unionByName(new), vocab
