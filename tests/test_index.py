"""The persisted index: upserts, removal, phrases, pruning."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orewright.operators import search
from orewright.operators.index import Index, parse_query

SCHEMA = "doc_id bigint, title string, text string, tf int"
PAGES = [(1, "Rust", "rust async runtime and more rust", 0), (2, "async safety", "async is not next to the other word rust", 0), (3, None, "владения память и журнал", 0), (4, "", "", 0), (5, "x", None, 0), (None, "x", "rust", 0), (1, "Rust", "rust async runtime and more rust", 0)]


@pytest.fixture
def index(spark, tmp_path):
    return Index(spark, f"file://{tmp_path}/index", buckets=8)


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_upserts(spark, index):
    assert index.upsert(docs(spark, PAGES)) == {"added": 4, "changed": 0, "same": 0, "removed": 0}
    assert index.upsert(docs(spark, PAGES)) == {"added": 0, "changed": 0, "same": 4, "removed": 0}
    assert index.totals() == (4, pytest.approx((6 + 9 + 3 + 1) / 4))
    changed = [(1, "Rust", "nothing of it here", 0), (2, "async safety", None, 0), (9, "new", "rust again", 0)]
    assert index.upsert(docs(spark, changed)) == {"added": 1, "changed": 1, "same": 0, "removed": 1}
    assert ids(index.bm25({"rust": 1.0})) == [1, 9]  # the first by its title
    assert ids(index.bm25({"async": 1.0})) == []
    assert index.upsert(docs(spark, []), gone=spark.createDataFrame([(9,), (77,)], "doc_id bigint")) == {"added": 0, "changed": 0, "same": 0, "removed": 1}
    assert ids(index.bm25({"rust": 1.0})) == [1] and ids(index.pages()) == [1, 3, 4]
    assert index.upsert(docs(spark, PAGES)) == {"added": 1, "changed": 1, "same": 2, "removed": 0}


def test_scores_are_those_of_the_scan(spark, index, rows):
    d = docs(spark, PAGES[:4])
    index.upsert(d.where("doc_id <= 2").withColumn("text", F.lit("old words")))
    index.upsert(d)
    terms = {"rust": 1.0, "async": 0.5, "absent": 1.0}
    near = lambda df: sorted((r["doc_id"], round(r["bm25"], 9), r["hits"], r["title_hits"], r["doclen"]) for r in df.collect())
    assert near(index.bm25(terms)) == near(search.bm25(d, terms))


def test_phrases(spark, index):
    index.upsert(docs(spark, PAGES))
    assert ids(index.bm25({"rust": 1.0, "async": 1.0})) == [1, 2]
    assert ids(index.bm25({"rust": 1.0, "async": 1.0}, ["rust", "async"])) == [1]
    assert ids(index.bm25({"async": 1.0, "safety": 1.0}, ["async", "safety"])) == []  # not in a title
    assert ids(index.bm25({"владения": 1.0}, ["владения", "память"])) == [3]
    assert parse_query('"rust async" more «Ёлка и» x') == (["rust", "async", "more", "елка"], [["rust", "async"]])


def test_a_query_reads_the_buckets_of_its_terms(spark, index):
    index.upsert(docs(spark, PAGES))
    plan = index.postings(["rust"])._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x and "positions" in x)
    assert "bucket#" in scan.split("PartitionFilters: [")[1].split("]")[0] and "term" in scan.split("DataFilters: [")[1].split("]")[0]


def test_an_unfinished_upsert_is_never_read(spark, index):
    index.upsert(docs(spark, PAGES))
    index._postings_of(docs(spark, PAGES).where("doc_id = 1").select("doc_id", F.array(F.lit("ghost")).alias("head"), F.array(F.lit("ghost")).alias("body"), F.lit(1).alias("doclen"))).write.partitionBy("bucket").parquet(index._path("postings/gen=2"))
    assert ids(index.bm25({"ghost": 1.0})) == []


def test_empty(spark, index):
    assert index.upsert(docs(spark, [])) == {"added": 0, "changed": 0, "same": 0, "removed": 0}
    assert index.totals() == (0, 0.0)
