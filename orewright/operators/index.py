"""An inverted index kept in a folder: postings by term, upserts by generation, BM25 and phrases from it.

Every upsert writes one generation: the postings and pages of what is new or changed, and
the pages of older generations that this makes dead. Postings lie in buckets by the hash
of their term, sorted by term, so a query reads the buckets of its terms alone and the
row groups within them that can hold the term. Counts of pages and lengths are kept a
generation, so no query reads the pages. A generation counts once its manifest is
written, which is last; what a lost upsert leaves behind is never read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orewright.operators.search import B, K1, PHRASE_BONUS, STOP_SHARE, web_tokens
from orewright.session import cores, materialize

#: Buckets of terms, and parts into which the postings of one bucket are dealt when written, so that a frequent term is no single task.
BUCKETS, PARTS = 64, 4
_MANIFEST = "gen int, pages bigint, length bigint, added bigint, changed bigint, same bigint, removed bigint"


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


class Index:
    """The index in the folder `at`, of documents known by `key`."""

    def __init__(self, spark: SparkSession, at: str, key: str = "doc_id", key_type: str = "bigint", buckets: int = BUCKETS):
        self.spark, self.at, self.key, self.buckets = spark, at.rstrip("/"), key, buckets
        self._schemas = {
            "postings": f"{key} {key_type}, doclen int, term string, tf int, title_tf int, positions array<int>, gen int, bucket int",
            "pages": f"{key} {key_type}, digest string, doclen int, gen int",
            "dead": f"{key} {key_type}, dead_gen int, gen int",
        }

    def _path(self, name: str) -> str:
        return f"{self.at}/{name}"

    def _exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(name))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def manifest(self) -> DataFrame:
        """What each generation held and did."""
        return self.spark.read.schema(_MANIFEST).parquet(self._path("manifest")) if self._exists("manifest") else self.spark.createDataFrame([], _MANIFEST)

    def _last(self) -> int:
        return self.manifest().agg(F.max("gen")).first()[0] or 0

    def _read(self, name: str, gen: int) -> DataFrame:
        return self.spark.read.schema(self._schemas[name]).parquet(self._path(name)).where(F.col("gen") <= gen)

    def pages(self) -> DataFrame:
        """(key, digest, doclen, gen) of the documents that are in the index."""
        gen = self._last()
        return self._read("pages", gen).join(self._read("dead", gen).select(self.key, F.col("dead_gen").alias("gen")), [self.key, "gen"], "left_anti")

    def upsert(self, docs: DataFrame, title: str = "title", text: str = "text", gone: DataFrame | None = None) -> dict[str, int]:
        """Takes in `docs` and leaves out those of `gone` (key): documents whose title and text are as
        they were are skipped. A null text takes a document out of the index. Rows of an equal key
        count once, the one of the greatest digest. Returns what was done."""
        key = self.key
        digest = F.md5(F.concat_ws("\x00", F.coalesce(title, F.lit("")), text))
        new = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(F.when(F.col(text).isNotNull(), digest).alias("digest"), F.col(title).alias("title"), F.col(text).alias("text"))).alias("d"))
        new = new.select(key, "d.digest", "d.title", "d.text")
        if gone is not None:
            away = gone.select(key).distinct()
            new = new.join(away, key, "left_anti").unionByName(away.select(key, *[F.lit(None).cast("string").alias(c) for c in ("digest", "title", "text")]))
        gen = self._last()
        old = self.pages().select(key, F.col("digest").alias("was"), F.col("gen").alias("dead_gen"), F.col("doclen").alias("old_length")) if gen else None
        if old is None:
            old = self.spark.createDataFrame([], f"{key} {dict(docs.dtypes)[key]}, was string, dead_gen int, old_length int")
        j = new.join(old, key, "left")
        act = F.when(F.col("digest").isNull(), F.when(F.col("was").isNotNull(), "removed")).when(F.col("was").isNull(), "added").when(F.col("was") != F.col("digest"), "changed").otherwise("same")
        j = materialize(j.withColumn("act", act).where("act is not null").withColumn("body", F.when(F.col("act").isin("added", "changed"), web_tokens(F.col("text")))), "upsert")
        put = j.where("body is not null").select(key, "digest", web_tokens(F.coalesce("title", F.lit(""))).alias("head"), "body", F.size("body").alias("doclen"))
        nxt = gen + 1
        self._postings_of(put).write.mode("overwrite").partitionBy("bucket").parquet(self._path(f"postings/gen={nxt}"))
        put.select(key, "digest", "doclen").write.mode("overwrite").parquet(self._path(f"pages/gen={nxt}"))
        j.where("act in ('changed', 'removed')").select(key, "dead_gen").write.mode("overwrite").parquet(self._path(f"dead/gen={nxt}"))
        counts = {r["act"]: r for r in j.groupBy("act").agg(F.count("*").alias("n"), F.sum(F.greatest(F.coalesce(F.size("body"), F.lit(0)), F.lit(1))).alias("length"), F.sum(F.greatest("old_length", F.lit(1))).alias("old")).collect()}
        n = lambda a: counts[a]["n"] if a in counts else 0
        part = lambda a, c: (counts[a][c] or 0) if a in counts else 0
        done = {a: n(a) for a in ("added", "changed", "same", "removed")}
        pages = done["added"] - done["removed"]
        length = part("added", "length") + part("changed", "length") - part("changed", "old") - part("removed", "old")
        row = (nxt, pages, length, *done.values())
        self.spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").parquet(self._path("manifest"))
        return done

    def _postings_of(self, put: DataFrame) -> DataFrame:
        """(bucket, term, key, tf, title_tf, positions, doclen), dealt and sorted for writing."""
        key = self.key
        rows = put.repartition(key)  # the terms of a document then meet where they are made
        body = rows.select(key, "doclen", F.posexplode("body").alias("pos", "term")).select(key, "doclen", "term", "pos", F.lit(0).alias("t"))
        head = rows.select(key, "doclen", F.explode("head").alias("term")).select(key, "doclen", "term", F.lit(None).cast("int").alias("pos"), F.lit(1).alias("t"))
        p = body.unionByName(head).groupBy(key, "term", "doclen").agg(F.count("pos").cast("int").alias("tf"), F.sum("t").cast("int").alias("title_tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
        p = p.withColumn("bucket", _bucket(F.col("term"), self.buckets))
        return p.repartition(max(cores(self.spark), self.buckets), "bucket", F.pmod(F.xxhash64(key), F.lit(PARTS))).sortWithinPartitions("bucket", "term", key)

    def postings(self, terms: Sequence[str]) -> DataFrame:
        """(term, key, tf, title_tf, positions, doclen) of `terms`, from their buckets alone."""
        gen, key = self._last(), self.key
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t"), self.buckets)).distinct().collect()]
        p = self._read("postings", gen).where(F.col("bucket").isin(buckets) & F.col("term").isin(list(terms)))
        dead = self._read("dead", gen).select(key, F.col("dead_gen").alias("gen"))
        return p.join(dead, [key, "gen"], "left_anti").select("term", key, "tf", "title_tf", "positions", "doclen")

    def totals(self) -> tuple[int, float]:
        """How many documents the index holds, and their mean length."""
        n, length = self.manifest().agg(F.sum("pages"), F.sum("length")).first()
        return n or 0, (length or 0) / max(n or 0, 1)

    def bm25(self, terms: dict[str, float], phrase: Sequence[str] = ()) -> DataFrame:
        """(key, bm25, hits, title_hits, doclen, occ) of the documents with any of the weighted `terms`; with a
        `phrase`, only those in whose text its terms follow each other ``occ`` times, with a bonus."""
        key = self.key
        n, mean = self.totals()
        names = list(dict.fromkeys([*terms, *phrase]))
        p = self.postings(names)
        df = p.groupBy("term").agg(F.count("*").alias("df"))
        weigh = self.spark.createDataFrame([(t, float(w)) for t, w in terms.items()], "term string, weight double")
        # one row a term of the query
        idf = df.withColumn("idf", F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))).withColumn("stop", F.lit(n >= 5) & (F.col("df") > STOP_SHARE * n))
        asked = idf.join(F.broadcast(weigh), "term", "left")
        asked = asked.crossJoin(F.broadcast(asked.agg(F.min(F.col("stop")).alias("all_stop"))))
        f = F.col("tf") + F.col("title_tf")
        use = F.col("weight").isNotNull() & (~F.col("stop") | F.col("all_stop"))
        part = F.col("weight") * F.col("idf") * f * (K1 + 1) / (f + K1 * (1 - B + B * F.greatest("doclen", F.lit(1)) / mean))
        j = p.join(F.broadcast(asked), "term")
        places = [F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{i}") for i, t in enumerate(phrase)]
        out = j.groupBy(key).agg(
            F.sum(F.when(use, part).otherwise(0.0)).alias("bm25"), F.sum(F.when(use, f).otherwise(0)).cast("int").alias("hits"), F.sum(F.when(use, F.least("title_tf", F.lit(1))).otherwise(0)).cast("int").alias("title_hits"),
            F.max("doclen").alias("doclen"), F.sum(F.when(F.col("term").isin(list(phrase)), F.col("idf")).otherwise(0.0)).alias("phrase_idf"), *places,
        ).where("hits > 0")
        if not phrase:
            return out.select(key, "bm25", "hits", "title_hits", "doclen", F.lit(0).alias("occ"))
        starts = F.col("p0")
        for i in range(1, len(phrase)):
            starts = F.array_intersect(starts, _shifted(F.col(f"p{i}"), i))
        out = out.withColumn("occ", F.coalesce(F.size(starts), F.lit(0))).where("occ > 0")
        return out.select(key, (F.col("bm25") + PHRASE_BONUS * F.col("phrase_idf") * F.least("occ", F.lit(8))).alias("bm25"), "hits", "title_hits", "doclen", "occ")


def why(index: Index, terms: dict[str, float]) -> DataFrame:
    """(key, term, tf, title_tf, idf, part): what each term adds to the BM25 score of each document it is in."""
    n, mean = index.totals()
    p = index.postings(list(terms))
    weigh = index.spark.createDataFrame([(t, float(w)) for t, w in terms.items()], "term string, weight double")
    df = p.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(weigh), "term")  # one row a term of the query
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    f = F.col("tf") + F.col("title_tf")
    part = F.col("weight") * F.col("idf") * f * (K1 + 1) / (f + K1 * (1 - B + B * F.greatest("doclen", F.lit(1)) / mean))
    return p.join(F.broadcast(df.select("term", "weight", idf.alias("idf"))), "term").select(index.key, "term", "tf", "title_tf", "idf", part.alias("part"))


def parse_query(query: str) -> tuple[list[str], list[list[str]]]:
    """The terms of a query, and the phrases that stand in it in double quotes or guillemets."""
    def terms(part: str) -> list[str]:
        return [t for t in re.findall(r"\w+", part.lower().replace("ё", "е")) if 2 <= len(t) <= 32]

    phrases = [terms(m.group(1) or m.group(2)) for m in re.finditer(r'"([^"]*)"|«([^»]*)»', query)]
    return list(dict.fromkeys(terms(query))), [p for p in phrases if len(p) > 1]


__all__ = ["BUCKETS", "Index", "parse_query", "why"]
