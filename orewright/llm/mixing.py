"""Mixing sources to target shares of the tokens, with capped repetition.

The mix is as large as the targets allow: the source that is scarcest for its share gives
all its records the most often it may, and every other source its share of that total (a
smaller total can be asked for). Complete epochs come first: each record is used as often
as the whole source fits its budget. The rest is filled by Efraimidis-Spirakis sampling:
each record gets the key ``-ln(u) / w`` for a uniform u from its hash and its quality w,
and the records with the least keys are taken until the budget is reached; the one that
crosses it is taken if its half fits.

The order within a source is never made in one task: keys are binned by their logarithm,
the sums of the bins are added up, and only the bin that crosses the budget is sorted.

Quality is the share of letters and white space in the text times ``t / (t + 32)`` for t
tokens, at least 0.01.

Defined results for odd input: names of sources are compared without case and outer
blanks; records without id, text or source, and sources that no target names, are left
out; double rows of a record count once; a target without records gets share 0 and
doesn't bind the total; null or negative targets count as 0 and null repeats as 1; empty
tables give an empty mix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orewright.llm.tokens import count_tokens
from orewright.session import materialize

#: Bins of a doubling of the key, and the least quality.
BINS, LEAST_QUALITY = 4096, 0.01

_LETTER = np.fromiter((chr(c).isalpha() or chr(c).isspace() for c in range(0x3000)), bool, 0x3000)


def plain_source(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def quality(text: str, tokens: int) -> float:
    """The weight of a record in the sampling."""
    if not text:
        return LEAST_QUALITY
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _LETTER[np.minimum(codes, 0x2FFF)].sum() + (codes >= 0x3000).sum()
    return max(LEAST_QUALITY, float(letters) / len(codes) * tokens / (tokens + 32))


def _measure(vocabulary: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            tokens = count_tokens(texts, vocabulary)
            w = [quality(t, n) for t, n in zip(texts, tokens, strict=True)]
            yield pd.DataFrame({"src": pdf["src"], "doc_id": pdf["doc_id"], "h": pdf["h"], "tokens": np.array(tokens, np.int32), "w": w})

    return run


def measured(docs: DataFrame, targets: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(src, doc_id, tokens, key) of the records of `docs` (doc_id, text, source) that a target names."""
    named = targets.select(plain_source(F.col("source")).alias("src")).distinct()
    rows = docs.select(plain_source(F.col("source")).alias("src"), "doc_id", "text", F.xxhash64("text").alias("h")).where("doc_id is not null and text is not null")
    out = materialize(rows.join(named, "src", "left_semi").mapInPandas(_measure(vocabulary), "src string, doc_id bigint, h bigint, tokens int, w double"), "measured").distinct()
    u = (F.pmod(F.xxhash64("doc_id", "h", F.lit(20)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return out.select("src", "doc_id", "tokens", (-F.ln(u) / F.col("w")).alias("key"))


def plan(stock: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, tuple[int, int]]:
    """(complete epochs, tokens of the fractional rest) of each source, from the tokens in stock."""
    want = {s: (share, cap) for s, (share, cap) in targets.items() if share > 0 and stock.get(s, 0) > 0 and cap > 0}
    if not want:
        return {}
    most = min(stock[s] * cap / share for s, (share, cap) in want.items())
    size = most if total is None else total
    out = {}
    for s, (share, cap) in want.items():
        budget = min(size * share, stock[s] * cap)
        epochs = min(cap, math.floor(budget / stock[s] + 1e-9))
        out[s] = (epochs, max(0, round(budget - epochs * stock[s])))
    return out


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, vocabulary: str | None = None) -> DataFrame:
    """(source, doc_id, copy_no, tokens): the records of the mix, one row for each use."""
    spark = docs.sparkSession
    schema = "source string, doc_id bigint, copy_no int, tokens int"
    goal = {r["src"]: (max(0.0, r["share"] or 0.0), 1 if r["cap"] is None else r["cap"]) for r in targets.groupBy(plain_source(F.col("source")).alias("src")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).where("src is not null").collect()}
    rows = measured(docs, targets, vocabulary)
    stock = {r["src"]: r["t"] for r in rows.groupBy("src").agg(F.sum("tokens").alias("t")).collect()}
    todo = plan(stock, goal, total)
    if not todo:
        return spark.createDataFrame([], schema)
    budgets = spark.createDataFrame([(s, e, f) for s, (e, f) in sorted(todo.items())], "src string, epochs int, rest bigint")
    rows = rows.join(F.broadcast(budgets), "src")  # a row for each target
    rows = rows.withColumn("bin", F.floor(F.log2(F.greatest("key", F.lit(1e-300))) * BINS))
    whole = rows.where("epochs > 0").select("src", "doc_id", "tokens", F.explode(F.sequence(F.lit(1), F.col("epochs"))).alias("copy_no"))

    part = rows.where("rest > 0")
    bins = part.groupBy("src", "rest", "bin").agg(F.sum("tokens").cast("bigint").alias("t"))
    up = Window.partitionBy("src").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("t").over(up), F.lit(0))).where("before < rest").select("src", "bin", "before", (F.col("before") + F.col("t") <= F.col("rest")).alias("all"))
    part = part.join(bins, ["src", "bin"])
    one = Window.partitionBy("src", "bin").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = part.where(~F.col("all")).withColumn("at", F.col("before") + F.coalesce(F.sum("tokens").over(one), F.lit(0)))
    edge = edge.where(F.col("at") + F.col("tokens") / 2 <= F.col("rest"))
    taken = part.where("all").select("src", "doc_id", "tokens", "epochs").unionByName(edge.select("src", "doc_id", "tokens", "epochs"))
    taken = taken.select("src", "doc_id", "tokens", (F.col("epochs") + 1).alias("copy_no"))
    return whole.unionByName(taken).select(F.col("src").alias("source"), "doc_id", "copy_no", "tokens")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached share of each source, with its records, tokens and most uses of one record."""
    goal = targets.groupBy(plain_source(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("records"), F.max("copy_no").alias("most_uses"))
    all_tokens = got.agg(F.sum("tokens").alias("all_tokens"))
    out = goal.join(got, "source", "left").crossJoin(F.broadcast(all_tokens))
    none = F.lit(0).cast("bigint")
    return out.select(
        "source", "target_share", "max_repeats", F.coalesce("tokens", none).alias("tokens"), F.coalesce("records", none).alias("records"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"),
    )
