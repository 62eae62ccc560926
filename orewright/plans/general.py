"""Queries of the general operators for dirty data: dangling references and packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orewright.core import packed, references
from orewright.session import table


def _orphans(spark: SparkSession, sf: str, distinct: bool = True) -> DataFrame:
    return references.call_orphans(*(table(spark, sf, t) for t in ("calls", "defs", "source_files", "externals")), distinct=distinct)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf, distinct=False).select("call_id", "ref_field", "state").distinct()


def p2_counts(spark: SparkSession, sf: str) -> DataFrame:
    return references.orphan_counts(_orphans(spark, sf))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    out = packed.split_packed(table(spark, sf, "poler_notes"), "id", "tags")
    return out.select(F.col("key").alias("note_id"), "pos", F.col("value").alias("tag")).distinct()


QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts, "p5_found": p5_found}

_ORPHANS = r"""
WITH parent AS (
  SELECT 'callee' AS ref_field, d.symbol AS k, d.scanned_at AS s, f.deleted_at AS e
  FROM (SELECT DISTINCT symbol, file, scanned_at FROM defs) d LEFT JOIN source_files f ON f.path = d.file
  WHERE d.symbol IS NOT NULL AND d.scanned_at IS NOT NULL
  UNION ALL
  SELECT 'file', path, indexed_at, deleted_at FROM source_files WHERE path IS NOT NULL AND indexed_at IS NOT NULL
), ref AS (
  SELECT DISTINCT call_id, 'callee' AS ref_field, scanned_at AS t,
    nullif(trim(regexp_replace(trim(regexp_replace(trim(callee), '\s*(\(\)|!)$', '')), '^.*(::|\.)', '')), '') AS k
  FROM calls
  UNION
  SELECT DISTINCT call_id, 'file', scanned_at,
    nullif(regexp_replace(regexp_replace(regexp_replace(replace(trim(file), chr(92), '/'), '/{2,}', '/', 'g'), '^(\./)+', ''), '/(\./)+', '/', 'g'), '')
  FROM calls
), live AS (
  SELECT r.call_id, r.ref_field, r.t, r.k, count(p.k) AS n,
    count(*) FILTER (WHERE p.s <= r.t AND (p.e IS NULL OR r.t < p.e)) AS alive,
    count(*) FILTER (WHERE p.s > r.t) AS later
  FROM ref r LEFT JOIN parent p ON p.ref_field = r.ref_field AND p.k = r.k
  WHERE r.k IS NOT NULL AND NOT (r.ref_field = 'callee' AND r.k IN (SELECT symbol FROM externals WHERE symbol IS NOT NULL))
  GROUP BY ALL
), orphan AS (
  SELECT call_id, ref_field, t, k, CASE WHEN n = 0 THEN 'missing' WHEN later = n THEN 'late' ELSE 'deleted' END AS state
  FROM live WHERE alive = 0 AND (n = 0 OR t IS NOT NULL)
)
"""

SQL = {
    "p2_found": _ORPHANS + "SELECT DISTINCT call_id, ref_field, state FROM orphan",
    "p2_counts": _ORPHANS
    + """SELECT CASE WHEN ref_field = 'callee' THEN 'defs' ELSE 'source_files' END AS ref_table, strftime(t, '%Y-%m') AS month, state,
  count(*) AS orphans, count(DISTINCT k) AS keys FROM orphan GROUP BY ALL""",
}
