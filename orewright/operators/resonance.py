"""Information density and decaying resonance of token windows.

Density at a centre c with radius r: ``kappa * (1 + ln(1 + kw)) * sum of rarity^2`` over the
distinct tokens of [c - r, c + r] that aren't in the query, kw being the query tokens there
and ``rarity = max(0, ln N - ln freq)``; a bonus may be added. Resonance follows
``R_t = density_t + phi * R_{t-1}``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orewright.operators import text as T

RADIUS, PHI, KAPPA = 40, 0.85, 1.0


def rarities(docs: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """(tok, rarity) over all texts, or (key, tok, rarity) within each one if `key` is given."""
    if key:
        tf = T.token_stream(docs, key, text).groupBy(key, "tok").agg(F.count("*").alias("freq"))
        n = F.sum("freq").over(Window.partitionBy(key))
        return tf.select(key, "tok", F.greatest(F.lit(0.0), F.ln(n) - F.ln("freq")).alias("rarity"))
    vocab = T.vocabulary(docs, text)
    total = vocab.agg(F.sum("freq").alias("n"))
    return vocab.crossJoin(F.broadcast(total)).select("tok", F.greatest(F.lit(0.0), F.ln("n") - F.ln("freq")).alias("rarity"))


def density_at_hits(docs: DataFrame, query: str, radius: int = RADIUS, kappa: float = KAPPA, bonus: bool = False, key: str = "doc_id", text: str = "text", local: bool = False) -> DataFrame:
    """(key, pos, density) at every occurrence of the phrase. Only the windows of hits meet the vocabulary."""
    q = T.query_tokens(query)
    d = T.with_tokens(docs.select(key, text).where(T.has_literals(F.col(text), q)), text)
    d = d.select(key, "toks", F.explode(T.phrase_positions(F.col("toks"), q)).alias("pos"))
    lo = F.greatest(F.col("pos") - radius, F.lit(0))
    window = F.slice("toks", lo + 1, F.col("pos") + radius - lo + 1)
    qa = F.array(*[F.lit(x) for x in q])
    d = d.select(key, "pos", window.alias("win"))
    add = T.semantic_bonus(F.array_join("win", " ")) if bonus else F.lit(0.0)
    d = d.select(key, "pos", add.alias("bonus"), F.size(F.filter("win", lambda t: F.array_contains(qa, t))).alias("kw"), F.explode_outer(F.array_except(F.array_distinct("win"), qa)).alias("tok"))
    r = rarities(docs, key if local else None, text)
    j = d.join(r, [key, "tok"] if local else "tok", "left")
    return j.groupBy(key, "pos").agg((kappa * (1 + F.ln(F.max("kw") + 1.0)) * F.sum(F.coalesce("rarity", F.lit(0.0)) ** 2) + F.max("bonus")).alias("density"))


def fold(values: Column, phi: float = PHI) -> Column:
    """The last value of the recurrence over an array."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: x + phi * a)


def memory_of(phi: float) -> int:
    """Values back at which a value's weight falls below 1e-13 of its own."""
    phi = min(max(phi, 0.0), 0.999)
    return 1 if phi < 1e-13 else max(1, math.ceil(math.log(1e-13) / math.log(phi)))


def resonance_at_hits(hits: DataFrame, phi: float = PHI, key: str = "doc_id", value: str = "density") -> DataFrame:
    """`hits` with ``resonance``, folded over each document's hits in their order."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(1 - memory_of(phi), 0)
    return hits.withColumn("resonance", fold(F.collect_list(value).over(w), phi))


def density_field(docs: DataFrame, query: str, radius: int = RADIUS, kappa: float = KAPPA, key: str = "doc_id", text: str = "text", corpus: DataFrame | None = None) -> DataFrame:
    """(key, pos, density) at every token of `docs`, in linear work; rarities come from `corpus` or else `docs`.

    An occurrence is the first of its token in the windows whose centres lie in
    [max(p - r, previous + r + 1), p + r]; it adds its rarity^2 there. So each occurrence
    becomes two steps of a running sum, and no window is ever made.
    """
    q = T.query_tokens(query)
    ts = T.token_stream(docs, key, text)
    before = F.lag("pos").over(Window.partitionBy(key, "tok").orderBy("pos"))
    ts = ts.withColumn("lo", F.greatest(F.col("pos") - radius, F.coalesce(before + radius + 1, F.lit(0)), F.lit(0)))
    ts = ts.join(rarities(docs if corpus is None else corpus, None, text), "tok", "left").withColumn("own", F.col("tok").isin(q))
    gain = F.when(F.col("own"), 0.0).otherwise(F.coalesce("rarity", F.lit(0.0)) ** 2)
    kw = F.col("own").cast("int")
    steps = F.array(
        F.struct(F.col("lo").alias("at"), gain.alias("v"), F.lit(0).alias("k"), F.lit(0).alias("here")),
        F.struct((F.col("pos") + radius + 1).alias("at"), (-gain).alias("v"), (-kw).alias("k"), F.lit(0).alias("here")),
        F.struct(F.greatest(F.col("pos") - radius, F.lit(0)).alias("at"), F.lit(0.0).alias("v"), kw.alias("k"), F.lit(0).alias("here")),
        F.struct(F.col("pos").alias("at"), F.lit(0.0).alias("v"), F.lit(0).alias("k"), F.lit(1).alias("here")),
    )
    s = ts.select(key, F.inline(F.filter(steps, lambda x: (x["v"] != 0) | (x["k"] != 0) | (x["here"] != 0))))
    s = s.groupBy(key, "at").agg(F.sum("v").alias("v"), F.sum("k").alias("k"), F.sum("here").alias("here"))
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("sum", F.sum("v").over(w)).withColumn("kw", F.sum("k").over(w)).where("here > 0")
    return s.select(key, F.col("at").alias("pos"), (kappa * (1 + F.ln(F.col("kw") + 1.0)) * F.greatest("sum", F.lit(0.0))).alias("density"))


def field_resonance(docs: DataFrame, query: str, radius: int = RADIUS, phi: float = PHI, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, density, resonance) at the hits, the recurrence running over every token. The
    field is made only for texts that hold the literals; rarities come from all."""
    q = T.query_tokens(query)
    some = docs.where(T.has_literals(F.col(text), q))
    hits = T.phrase_hits(some, query, key, text)
    f = density_field(some, query, radius, KAPPA, key, text, corpus=docs)
    # a text's field as one array, out of which each hit folds what it still remembers
    field = f.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "density"))).alias("f"))
    at = hits.groupBy(key).agg(F.collect_list("pos").alias("at"))
    back = memory_of(phi)

    def heard(p: Column) -> Column:
        first = F.greatest(p + 1 - back, F.lit(0))
        near = F.slice(F.col("f"), first + 1, p - first + 1)
        said = F.aggregate(near, F.lit(0.0), lambda a, x: x["density"] + phi * a)
        return F.struct(p.alias("pos"), F.get(F.col("f"), p)["density"].alias("density"), said.alias("resonance"))

    return field.join(at, key).select(key, F.inline(F.transform("at", heard)))


def top_hits(hits: DataFrame, n: int, order: Sequence[str] = ("doc_id", "pos")) -> DataFrame:
    """The n hits of highest resonance, ties by place."""
    return hits.orderBy(F.desc(F.round("resonance", 2)), *order).limit(n)


def top_per_key(hits: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(F.round("resonance", 6)), "pos")
    return hits.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)

