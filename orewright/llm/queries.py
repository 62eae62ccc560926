"""Queries of the llm operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orewright.llm import docpairs, langid, mixing, packing, pieces, qapairs, spans
from orewright.session import table


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    specs = table(spark, sf, "specs").select(F.lit("specs").alias("src"), F.col("id").alias("item_id"), F.col("full_text").alias("text"))
    notes = table(spark, sf, "poler_notes").select(F.lit("poler_notes").alias("src"), F.col("id").alias("item_id"), F.col("body").alias("text"))
    return specs.unionByName(notes)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.oversized(_texts(spark, sf), table(spark, sf, "piece_limits"))


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.split_texts(_texts(spark, sf).distinct(), table(spark, sf, "piece_limits"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return qapairs.defective(table(spark, sf, "poler_chat"))


def _languages(spark: SparkSession, sf: str) -> DataFrame:
    notes = table(spark, sf, "poler_notes").select(F.lit("poler_notes").alias("src"), F.col("id").alias("item_id"), F.col("body").alias("text"), F.col("lang").alias("label"))
    chat = table(spark, sf, "poler_chat").select(F.lit("poler_chat").alias("src"), F.col("id").alias("item_id"), F.col("answer").alias("text"), F.col("answer_lang").alias("label"))
    return langid.label_texts(notes.unionByName(chat))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return langid.mislabelled(_languages(spark, sf))


def p4_stretches(spark: SparkSession, sf: str) -> DataFrame:
    return _languages(spark, sf).distinct()


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return docpairs.documented_ids(table(spark, sf, "defs"), table(spark, sf, "source_files"))


def p6_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return docpairs.documented(table(spark, sf, "defs"), table(spark, sf, "source_files"))


def p7_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), table(spark, sf, "containers"))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(p7_packed(spark, sf))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.share_report(p8_mix(spark, sf), table(spark, sf, "mix_targets"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return spans.sharing_pairs(table(spark, sf, "documents"))


def p9_spans(spark: SparkSession, sf: str) -> DataFrame:
    return spans.maximal_spans(table(spark, sf, "documents"))


def p9_share(spark: SparkSession, sf: str) -> DataFrame:
    return spans.shared_share(table(spark, sf, "documents"))


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p3_found": p3_found, "p4_found": p4_found, "p4_stretches": p4_stretches, "p6_found": p6_found, "p6_pairs": p6_pairs, "p7_packed": p7_packed, "p7_fill": p7_fill, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_spans": p9_spans, "p9_share": p9_share}

SQL = {
    "p1_found": r"""
WITH item AS (
  SELECT DISTINCT 'specs' AS src, id AS item_id, full_text AS text FROM specs
  UNION SELECT DISTINCT 'poler_notes', id, body FROM poler_notes
)
SELECT src, item_id, CASE WHEN list_max(list_transform(string_split(regexp_replace(text, '([.!?…])(\s)', '\1' || chr(10) || '\2', 'g'), chr(10)), lambda x: length(x))) > max_chars
  THEN 'forced' ELSE 'natural' END AS cut
FROM item JOIN piece_limits USING (src) WHERE length(text) > max_chars""",
    "p9_found": """
WITH doc AS (SELECT doc_id, text FROM documents WHERE length(text) >= 300 AND doc_id IS NOT NULL),
gram AS (SELECT DISTINCT doc_id, hash(substring(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM doc)),
hit AS (SELECT h FROM gram GROUP BY h HAVING count(*) > 1)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM gram a JOIN hit USING (h) JOIN gram b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p9_spans": """
WITH doc AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 300 AND doc_id IS NOT NULL),
gram AS (SELECT doc_id, i, hash(substring(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM doc)),
hit AS (SELECT h FROM gram GROUP BY h HAVING count(DISTINCT doc_id) > 1),
meet AS (SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b, a.i, b.i - a.i AS shift FROM gram a JOIN hit USING (h) JOIN gram b ON a.h = b.h AND a.doc_id < b.doc_id),
run AS (SELECT *, i - row_number() OVER (PARTITION BY doc_a, doc_b, shift ORDER BY i) AS run FROM meet)
SELECT doc_a, doc_b, (min(i) - 1)::INT AS start_a, (min(i) - 1 + shift)::INT AS start_b, (count(*) + 299)::INT AS length FROM run GROUP BY doc_a, doc_b, shift, run""",
    "p9_share": """
WITH doc AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 300 AND doc_id IS NOT NULL),
gram AS (SELECT doc_id, i, hash(substring(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM doc)),
hit AS (SELECT h FROM gram GROUP BY h HAVING count(DISTINCT doc_id) > 1),
cov AS (SELECT doc_id, least(300, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 300)) AS fresh FROM (SELECT DISTINCT doc_id, i FROM gram JOIN hit USING (h))),
part AS (SELECT doc_id, sum(fresh)::BIGINT AS shared_chars FROM cov GROUP BY doc_id),
size AS (SELECT doc_id, coalesce(max(length(text)), 0)::INT AS n_chars FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)
SELECT doc_id, n_chars, coalesce(shared_chars, 0) AS shared_chars, CASE WHEN n_chars > 0 THEN round(coalesce(shared_chars, 0) / n_chars, 6) ELSE 0.0 END AS share FROM size LEFT JOIN part USING (doc_id)""",
}
