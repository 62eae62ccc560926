"""The scan as a whole: ranked passages with their scene and line, changes between scans, samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orewright.operators import chunks as C
from orewright.operators import text as T
from orewright.plans.structural import SCENES_SQL
from orewright.session import table, texts

NEEDLE = "residual error"


def _docs(s, d):
    return texts(s, d, "documents")


def _specs(s, d):
    return texts(s, d, "specs").where("full_text is not null").select("id", F.col("full_text").alias("text")).distinct()


def matched_lines(s, d):
    """Matching lines of the specifications with the byte of the match."""
    g = T.grep(_specs(s, d), NEEDLE, key="id")
    at = F.col("byte_offset") + F.octet_length(F.substring_index("line", NEEDLE, 1))
    return g.select("id", "line_no", at.alias("byte"), F.substring("line", 1, 80).alias("preview"))


def line_of_byte(s, d):
    """The line of each match counted from the line feeds before its byte, against the line it was found on."""
    m = matched_lines(s, d).join(_specs(s, d), "id")
    head = F.substring(F.encode("text", "utf-8"), 1, F.col("byte").cast("int"))
    n = F.octet_length(head) - F.octet_length(F.replace(F.decode(head, "utf-8"), F.lit("\n"), F.lit("")))
    return m.select("id", "byte", "line_no", (n + 1).cast("int").alias("line"))


def scene_of_match(s, d):
    """The section each matching line lies in, by line ranges of the same text."""
    sec = C.sections_of(_specs(s, d), "id", "text").select("id", "section", "first_line", (F.col("first_line") + F.col("lines") - 1).alias("last_line"), "heading")
    m = matched_lines(s, d)
    return m.join(sec, "id").where(F.col("line_no").between(F.col("first_line"), F.col("last_line"))).select("id", "line_no", "section", "heading")


def context_json(s, d):
    """Each match as nested JSON: place, preview and scene."""
    m = matched_lines(s, d).join(scene_of_match(s, d).distinct(), ["id", "line_no"])
    return m.select("id", "byte", F.to_json(F.struct(F.struct("id", F.col("line_no").alias("line"), "byte").alias("at"), "preview", F.struct("section", "heading").alias("scene"))).alias("j"))


def _tagged(cards):
    return cards.where(F.col("metric").isNull() | F.col("metric").like("Т-9%")).select("doc_id", "metric")


def temporal(s, d):
    """Scenes whose tag is missing or the one asked for."""
    return _tagged(C.scene_cards(_docs(s, d), "doc_id", "text"))


def document_temporal(s, d):
    """Texts whose tag, the first in their head, is missing or the one asked for."""
    return _tagged(C.document_cards(_docs(s, d), "doc_id", "text"))


def scan_diff(s, d):
    """Places that the newer scan finds and the older one didn't."""
    old = T.phrase_hits(_docs(s, d).where("ingested_at < timestamp_ntz'2024-06-01 00:00:00'"), "lattice kernel")
    return T.phrase_hits(_docs(s, d), "lattice kernel").join(old, ["doc_id", "pos"], "left_anti")


def _subjects(s, d):
    names = F.array_distinct(C.card_subjects("head"))
    return C.scene_heads(_docs(s, d), "doc_id", "text").select("doc_id", "part", "scene", names.alias("names")).where("size(names) > 1").distinct()


def cooccurrence(s, d):
    """Pairs of subjects that share scenes, with the number of scenes."""
    n = _subjects(s, d).select("names", F.explode("names").alias("a")).select("a", F.explode("names").alias("b"))
    return n.where("a < b").groupBy("a", "b").agg(F.count("*").alias("scenes"))


def stride_sample(s, d):
    """Every seventh paragraph of each text, the first included."""
    p = C.paragraph_rows(_specs(s, d), "id", "text")
    w = Window.partitionBy("id").orderBy("no")
    return p.withColumn("rn", F.row_number().over(w)).where("rn % 7 = 1").select("id", "no")


def stop_terms(s, d):
    """Terms in so many documents that a ranking leaves them out."""
    t = T.with_tokens(_docs(s, d)).select("doc_id", F.explode(F.array_distinct("toks")).alias("tok"))
    n = _docs(s, d).where("text is not null").agg(F.count("*").alias("n"))
    return t.groupBy("tok").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).where("n >= 5 and df > 0.3 * n").select("tok", "df")


def digest_report(s, d):
    """Texts, lines, words and bytes by source, sources compared without case and blanks."""
    src = F.lower(F.trim(F.coalesce("source", F.lit("none"))))
    x = _docs(s, d).where("text is not null").select(src.alias("src"), F.size(F.split("text", "\n")).alias("l"), F.size(T.tokens_of(F.col("text"))).alias("w"), F.octet_length("text").alias("b"))
    return x.groupBy("src").agg(F.count("*").alias("texts"), F.sum("l").alias("lines"), F.sum("w").alias("words"), F.sum("b").alias("bytes"))


QUERIES = {
    "scan_matches": matched_lines, "scan_line_of_byte": line_of_byte, "scan_scene": scene_of_match, "scan_context_json": context_json, "scan_temporal": document_temporal, "scan_temporal_by_scene": temporal, "scan_cooccurrence_by_scene": cooccurrence, "scan_diff": scan_diff,
    "scan_cooccurrence": cooccurrence, "scan_stride_sample": stride_sample, "scan_stop_terms": stop_terms, "scan_digest": digest_report,
}

_LN = "SELECT id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT id, string_split(text, chr(10)) AS l FROM (SELECT DISTINCT id, full_text AS text FROM specs WHERE full_text IS NOT NULL))"
_M = f"""ln AS MATERIALIZED ({_LN}), o AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM ln),
m AS (SELECT id, line_no::INT AS line_no, (off + strlen(split_part(line, '{NEEDLE}', 1)))::BIGINT AS byte, substring(line, 1, 80) AS preview FROM o WHERE contains(line, '{NEEDLE}'))"""
_S = r"""h AS (SELECT id, line_no, CASE WHEN regexp_matches(line, '^[ \t]*#{1,6}[ \t]') THEN trim(regexp_replace(line, '^[ \t]*#{1,6}[ \t]+|\r$', '', 'g')) END AS head FROM ln),
s AS (SELECT id, line_no, count(head) OVER w AS section, last_value(head IGNORE NULLS) OVER w AS heading FROM h WINDOW w AS (PARTITION BY id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
x AS (SELECT m.*, section, heading FROM m JOIN s ON s.id = m.id AND s.line_no = m.line_no)"""
_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_CARD = r"(SELECT doc_id, array_to_string(string_split(text, chr(10))[1:60], chr(10)) AS head FROM documents WHERE text IS NOT NULL)"
_HITS = f"WITH a AS (SELECT doc_id, ingested_at, {_TOK} AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, unnest(list_filter(range(len(t) - 1), lambda i: t[i + 1] = 'lattice' AND t[i + 2] = 'kernel'))::INT AS pos FROM a WHERE true"

SQL = {
    "scan_matches": f"WITH {_M} SELECT * FROM m",
    "scan_line_of_byte": f"WITH {_M} SELECT id, byte, line_no, line_no AS line FROM m",
    "scan_scene": f"WITH {_M}, {_S} SELECT id, line_no, section, heading FROM x",
    "scan_temporal": rf"SELECT doc_id, metric FROM (SELECT doc_id, nullif(trim(regexp_extract(head, '(?im)^\*{{0,2}}(?:Metric|Метрика|Metrik|Métrica)\s*:\s*([^*\n]+)\*{{0,2}}\s*$', 1)), '') AS metric FROM {_CARD}) WHERE metric IS NULL OR metric LIKE 'Т-9%'",
    "scan_temporal_by_scene": SCENES_SQL + " SELECT doc_id, metric FROM m WHERE metric IS NULL OR metric LIKE 'Т-9%'",
    "scan_cooccurrence_by_scene": SCENES_SQL
    + """, n AS (SELECT DISTINCT doc_id, part, scene, unnest(list_distinct(list_filter(list_transform(string_split(sub, ','), lambda x: trim(x)), lambda x: x != ''))) AS name FROM m)
SELECT x.name AS a, y.name AS b, count(*) AS scenes FROM n x JOIN n y ON x.doc_id = y.doc_id AND x.part = y.part AND x.scene = y.scene AND x.name < y.name GROUP BY ALL""",
    "scan_diff": _HITS + " AND NOT (ingested_at < '2024-06-01')",
    "scan_cooccurrence": rf"""WITH n AS (SELECT DISTINCT doc_id, unnest(list_distinct(list_filter(list_transform(string_split(regexp_extract(head, '(?im)^\*{{0,2}}(?:Subjects|Субъекты|Суб''єкти|Subjekte|Sujetos)\s*:\s*([^*\n]+)\*{{0,2}}\s*$', 1), ','), lambda x: trim(x)), lambda x: x != ''))) AS name FROM {_CARD})
SELECT x.name AS a, y.name AS b, count(*) AS scenes FROM n x JOIN n y ON x.doc_id = y.doc_id AND x.name < y.name GROUP BY ALL""",
    "scan_stride_sample": r"WITH p AS (SELECT id, len(list_filter(regexp_split_to_array(full_text, '\n\s*\n'), lambda x: trim(x) != '')) AS k FROM (SELECT DISTINCT id, full_text FROM specs WHERE full_text IS NOT NULL)) SELECT id, unnest(range(0, k, 7))::INT AS no FROM p",
    "scan_stop_terms": f"WITH t AS (SELECT doc_id, unnest(list_distinct({_TOK})) AS tok FROM documents WHERE text IS NOT NULL) SELECT tok, count(*) AS df FROM t GROUP BY tok HAVING count(*) > 0.3 * (SELECT count(*) FROM documents WHERE text IS NOT NULL)",
    "scan_digest": f"SELECT lower(trim(coalesce(source, 'none'))) AS src, count(*) AS texts, sum(len(string_split(text, chr(10))))::BIGINT AS lines, sum(len({_TOK}))::BIGINT AS words, sum(strlen(text))::BIGINT AS bytes FROM documents WHERE text IS NOT NULL GROUP BY 1",
}
