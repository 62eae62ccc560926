"""Inverted index, BM25, phrases, link authority and hybrid retrieval."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orewright.operators import text as T
from orewright.session import materialize

K1, B, PHRASE_BONUS, STOP_SHARE = 1.2, 0.75, 0.5, 0.95
#: Weights of the joint score: BM25, link authority, title, density.
W_BM25, W_RANK, W_TITLE, W_DENSITY = 0.55, 0.15, 0.20, 0.10


def web_tokens(text: Column) -> Column:
    """Index terms: lower case, yo as ye, runs of letters and digits of 2 to 32 characters."""
    found = F.regexp_extract_all(F.translate(F.lower(text), "ё", "е"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= 2) & (F.length(t) <= 32))


def index_rows(docs: DataFrame, key: str = "doc_id", title: str = "title", text: str = "text") -> DataFrame:
    """(key, body, head, doclen): terms of text and title of each document."""
    d = docs.where(F.col(text).isNotNull()).select(key, web_tokens(F.col(text)).alias("body"), web_tokens(F.coalesce(F.col(title), F.lit(""))).alias("head"))
    return d.withColumn("doclen", F.size("body"))


def _count(arr: Column, term: str) -> Column:
    return F.size(F.filter(arr, lambda t: t == term))


def query_terms(query: str) -> list[str]:
    return [t for t in dict.fromkeys(re.findall(r"\w+", query.lower().replace("ё", "е"))) if 2 <= len(t) <= 32]


def bm25(docs: DataFrame, terms: dict[str, float], key: str = "doc_id", title: str = "title", text: str = "text") -> DataFrame:
    """(key, bm25, hits, title_hits, doclen) of documents with any term; `terms` are weighted.

    Documents are reduced to a row each before anything is aggregated; what is shuffled is
    a handful of sums. A term in more than 95 % of five or more documents is left out
    unless all are.
    """
    rows = index_rows(docs, key, title, text)
    names = list(terms)
    cols = [_count(F.col("body"), t).alias(f"b{i}") for i, t in enumerate(names)] + [_count(F.col("head"), t).alias(f"h{i}") for i, t in enumerate(names)]
    tf = rows.select(key, "doclen", *cols)
    has = lambda i: (F.col(f"b{i}") + F.col(f"h{i}")) > 0
    n = range(len(names))
    stats = tf.agg(F.count("*").alias("n"), F.avg(F.greatest("doclen", F.lit(1))).alias("avgdl"), *[F.sum(has(i).cast("int")).alias(f"df{i}") for i in n])
    stop = lambda i: (F.col("n") >= 5) & (F.col(f"df{i}") > STOP_SHARE * F.col("n"))
    all_stop = F.forall(F.array(*[stop(i) | (F.col(f"df{i}") == 0) for i in n]), lambda x: x)
    idf = lambda i: F.ln(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
    j = tf.crossJoin(F.broadcast(stats))
    score, hits, heads = F.lit(0.0), F.lit(0), F.lit(0)
    for i, t in enumerate(names):
        f = F.col(f"b{i}") + F.col(f"h{i}")
        use = ~stop(i) | all_stop
        part = terms[t] * idf(i) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.greatest("doclen", F.lit(1)) / F.col("avgdl")))
        score = score + F.when(use & (f > 0), part).otherwise(0.0)
        hits = hits + F.when(use, f).otherwise(0)
        heads = heads + F.when(use, F.least(F.col(f"h{i}"), F.lit(1))).otherwise(0)
    out = j.select(key, score.alias("bm25"), hits.alias("hits"), heads.alias("title_hits"), "doclen")
    return out.where("hits > 0")


def phrase_filter(docs: DataFrame, scored: DataFrame, phrase: Sequence[str], key: str = "doc_id", title: str = "title", text: str = "text") -> DataFrame:
    """`scored` reduced to documents with the phrase, with ``occ`` and a bonus of
    ``0.5 * sum of idf * min(occ, 8)``."""
    rows = index_rows(docs, key, title, text)
    n = rows.agg(F.count("*").alias("n"), *[F.sum((F.array_contains("body", t) | F.array_contains("head", t)).cast("int")).alias(f"df{i}") for i, t in enumerate(phrase)])
    occ = rows.select(key, F.size(T.phrase_positions(F.col("body"), phrase)).alias("occ")).where("occ > 0").crossJoin(F.broadcast(n))
    idf = sum((F.ln(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) for i in range(len(phrase))), F.lit(0.0))
    bonus = PHRASE_BONUS * idf * F.least("occ", F.lit(8))
    return scored.join(occ.select(key, "occ", bonus.alias("bonus")), key).withColumn("bm25", F.col("bm25") + F.col("bonus")).drop("bonus")


def page_rank(nodes: DataFrame, edges: DataFrame, iterations: int = 10, damping: float = 0.85) -> DataFrame:
    """(id, rank): start 1, base (1 - d) / n, links to oneself count in the out-degree alone,
    the mass of pages without links isn't spread. Lineage is cut every four rounds."""
    size = nodes.agg(F.count("*").alias("n"))
    node = materialize(nodes.crossJoin(F.broadcast(size)), "nodes")
    e = materialize(edges.select("src", "dst").join(node.select(F.col("id").alias("dst")), "dst", "left_semi"), "arcs")
    out = e.groupBy("src").agg(F.count("*").alias("out"))
    link = materialize(e.where("src != dst").join(out, "src").groupBy("src", "dst", "out").agg(F.count("*").alias("m")), "links")
    rank = node.select("id", F.lit(1.0).alias("rank"))
    for i in range(iterations):
        flow = link.join(rank, link["src"] == rank["id"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("m") / F.col("out")).alias("flow"))
        rank = node.join(flow, node["id"] == flow["dst"], "left").select("id", ((1 - damping) / F.col("n") + damping * F.coalesce("flow", F.lit(0.0))).alias("rank"))
        if i % 4 == 3 and i < iterations - 1:
            rank = materialize(rank, "rank")
    return rank


def web_rank(scored: DataFrame, ranks: DataFrame, n_terms: int, key: str = "doc_id") -> DataFrame:
    """`scored` with the joint score of BM25, link authority, title share and term density."""
    j = scored.join(ranks.select(F.col("id").alias(key), "rank"), key, "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))
    j = j.withColumn("density", F.when(F.col("doclen") > 0, F.col("hits") / F.col("doclen")).otherwise(0.0))
    top = j.agg(F.greatest(F.max("bm25"), F.lit(1e-9)).alias("mb"), F.greatest(F.max("rank"), F.lit(1e-9)).alias("mr"), F.greatest(F.max("density"), F.lit(1e-9)).alias("md"))
    title = F.least(F.col("title_hits") / max(n_terms, 1), F.lit(1.0))
    score = W_BM25 * F.col("bm25") / F.col("mb") + W_RANK * F.ln(1 + F.col("rank") * 1000) / F.greatest(F.ln(1 + F.col("mr") * 1000), F.lit(1e-9)) + W_TITLE * title + W_DENSITY * F.col("density") / F.col("md")
    return j.crossJoin(F.broadcast(top)).select(key, score.alias("score"), "bm25", "rank", "density")


def expand(terms: Sequence[str], lexicon: dict[str, list[tuple[str, float]]], weight: float = 0.85) -> dict[str, float]:
    """Query terms at weight 1 and their counterparts at confidence times `weight`, the first source winning."""
    out = {t: 1.0 for t in terms}
    for t in terms:
        for other, conf in lexicon.get(t, []):
            out.setdefault(other, conf * weight)
    return out


def unique_results(scored: DataFrame, digests: DataFrame, key: str = "doc_id", score: str = "bm25") -> DataFrame:
    """`scored` without documents that say the same as a better one: of those of one digest (key, digest) the
    first by score and key is kept."""
    w = Window.partitionBy("digest").orderBy(F.desc(F.round(score, 9)), key)
    return scored.join(digests.select(key, "digest"), key).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "digest")


#: Trust in a source of text: rank and coefficient. Fixed values.
PROVENANCE = {"narrative": (0, 0.7), "source_document": (1, 1.0), "mvr_verified": (2, 1.5)}


def provenance(source: Column, known: Mapping[str, str], other: str = "narrative") -> Column:
    """The provenance of a document by its source, in whatever case and between whatever blanks, from a
    table of source -> provenance; `other` for the rest."""
    wrong = set(known.values()) - set(PROVENANCE)
    if wrong:
        raise ValueError(f"unknown provenance: {sorted(wrong)}")
    name, out = F.lower(F.trim(source)), F.lit(other)
    for kind in sorted(set(known.values())):
        out = F.when(name.isin(*sorted(k for k, v in known.items() if v == kind)), kind).otherwise(out)
    return out


def provenance_weight(p: Column) -> Column:
    out = F.lit(PROVENANCE["narrative"][1])
    for k, (_, c) in PROVENANCE.items():
        out = F.when(p == k, c).otherwise(out)
    return out


def fuse(lexical: DataFrame, vector: DataFrame, provenances: DataFrame, w_lexical: float = 0.65, w_vector: float = 0.35) -> DataFrame:
    """(id, score): lexical (id, bm25) and vector (id, cos) candidates joined, each scaled and
    weighed, times the trust in their source."""
    top = lexical.agg(F.greatest(F.max("bm25"), F.lit(1e-12)).alias("top"))
    j = lexical.join(vector, "id", "full_outer").crossJoin(F.broadcast(top)).join(provenances, "id")
    base = w_lexical * F.coalesce(F.col("bm25") / F.col("top"), F.lit(0.0)) + w_vector * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("cos", F.lit(0.0))))
    return j.select("id", (base * provenance_weight(F.col("provenance"))).alias("score"))


def upsert(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): what a new snapshot does to the old one, by content digest."""
    o = old.select(F.col(key), F.col(digest).alias("was"))
    n = new.select(F.col(key), F.col(digest).alias("now"))
    j = o.join(n, key, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed").otherwise("same")
    return j.select(key, change.alias("change"))


def bigram_trits(sentences: DataFrame, key: str, text: str, high: float = 2.0, low: float = 0.5) -> DataFrame:
    """(prev, next, n, trit): pairs of neighbouring tokens within a sentence; +1 where
    P(next | prev) / P(next) is at least `high`, -1 where at most `low`, else 0."""
    parts = sentences.where(F.col(text).isNotNull()).select(F.explode(F.split(F.lower(text), r"[.!?…\n]+")).alias("s"))
    toks = parts.select(F.regexp_extract_all("s", F.lit(T.TOKEN), F.lit(0)).alias("t")).where(F.size("t") > 0)
    uni = toks.select(F.explode("t").alias("tok")).groupBy("tok").agg(F.count("*").alias("u"))
    total = uni.agg(F.sum("u").alias("total"))
    pairs = toks.select(F.explode(F.arrays_zip(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))).alias("prev"), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))).alias("next"))).alias("p")).select("p.prev", "p.next")
    bi = pairs.groupBy("prev", "next").agg(F.count("*").alias("n"))
    j = bi.join(uni.select(F.col("tok").alias("prev"), F.col("u").alias("up")), "prev").join(uni.select(F.col("tok").alias("next"), F.col("u").alias("un")), "next").crossJoin(F.broadcast(total))
    ratio = (F.col("n") / F.col("up")) / (F.col("un") / F.col("total"))
    return j.select("prev", "next", "n", F.when(ratio >= high, 1).when(ratio <= low, -1).otherwise(0).alias("trit"))
