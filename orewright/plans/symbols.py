"""Queries over the symbols of source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from orewright.functions import chem
from orewright.operators import code as C
from orewright.operators import vectors as V
from orewright.session import table, texts


def _files(s, d):
    return texts(s, d, "source_files")


def scan_against_defs(s, d):
    """How the functions found in the sources compare with the table of definitions, by language."""
    ext = F.regexp_extract("path", r"\.([a-z]+)$", 1)
    found = C.definitions(_files(s, d)).select("path", "symbol", "byte", F.lit(1).alias("f"))
    known = table(s, d, "defs").where("kind in ('fn', 'def', 'func', 'function', 'method') and byte is not null").select(F.col("file").alias("path"), "symbol", "byte", F.lit(1).alias("k")).distinct()
    j = found.join(known, ["path", "symbol", "byte"], "full_outer")
    return j.groupBy(ext.alias("ext")).agg(F.count("f").alias("found"), F.count("k").alias("known"), F.sum((F.col("f").isNotNull() & F.col("k").isNotNull()).cast("bigint")).alias("both"))


def _phase(s, d):
    t = texts(s, d, "poler_notes").select("id", F.coalesce("title", F.lit("")).alias("title")).distinct()
    return t.select("id", C.phase_vector("title").alias("v")).select("id", F.round(V.norm(F.col("v")), 6).alias("norm"), F.round(F.get("v", 0), 6).alias("v0"))


def _elements(s, d):
    e = s.createDataFrame([(n, sym, m) for (sym, m), n in zip(chem.MASS.items(), range(1, 119), strict=True)], "number int, symbol string, mass double")
    return table(s, d, "part").select("p_partkey", (F.col("p_partkey") % 118 + 1).cast("int").alias("number")).join(F.broadcast(e), "number").groupBy("number", "symbol").agg(F.count("*").alias("parts"), F.round(F.sum("mass"), 3).alias("mass"))


QUERIES = {
    "code_definitions": lambda s, d: C.definitions(_files(s, d)),
    "code_call_sites": lambda s, d: C.call_sites(_files(s, d)),
    "code_scan_check": scan_against_defs,
    "code_by_suffix": lambda s, d: C.by_suffix(table(s, d, "defs").distinct(), "_window"),
    "text_phase_vectors": _phase,
    "chem_elements": _elements,
}

SQL = {
    "code_by_suffix": "SELECT symbol, count(*) AS places, count(*) OVER () = 1 AS sole FROM (SELECT DISTINCT * FROM defs) WHERE ends_with(symbol, '_window') GROUP BY symbol",
}
