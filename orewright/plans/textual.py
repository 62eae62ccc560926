"""Queries over tokens, phrases, exact search, projections and resonance."""

from __future__ import annotations

from pyspark.sql import functions as F

from orewright.operators import resonance as R
from orewright.operators import text as T
from orewright.session import table, texts

PHRASE, PAIR, PREFIX = "lattice kernel", "journal heartbeat", "bread"
LITERAL, PATTERN = "lattice", r"within \d+ ms"
TERMS = ("anchor", "сегмент", "Zeiger")


def _docs(spark, sf):
    return texts(spark, sf, "documents")


def _round(df, *cols, digits=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


def _hits(spark, sf):
    return R.resonance_at_hits(R.density_at_hits(_docs(spark, sf), PHRASE))


QUERIES = {
    "text_token_counts": lambda s, d: T.with_tokens(_docs(s, d)).select("doc_id", F.size("toks").alias("n_tokens"), F.size(F.array_distinct("toks")).alias("n_distinct")),
    "text_vocabulary": lambda s, d: T.vocabulary(_docs(s, d)),
    "text_term_frequency": lambda s, d: T.postings(_docs(s, d)).select("doc_id", "tok", "tf"),
    "text_postings": lambda s, d: T.postings(_docs(s, d)).select("tok", "doc_id", "tf", "first_pos", F.array_join("positions", " ").alias("positions")),
    "text_phrase": lambda s, d: T.phrase_hits(_docs(s, d), PHRASE),
    "text_proximity": lambda s, d: T.proximity_hits(_docs(s, d), PAIR),
    "text_prefix": lambda s, d: T.prefix_tokens(_docs(s, d), PREFIX),
    "text_literal_prefilter": lambda s, d: _docs(s, d).where(T.has_literals(F.col("text"), ["journal", "heartbeat"])).select("doc_id"),
    "text_corpus_stats": lambda s, d: T.with_tokens(_docs(s, d)).agg(F.count("*").alias("texts"), F.sum(F.size("toks")).alias("tokens"), F.sum(F.octet_length("text")).alias("bytes")),
    "grep_lines": lambda s, d: T.lines(texts(s, d, "specs").distinct().select("id", F.col("full_text").alias("text")), "id").select("id", "line_no", "byte_offset", F.length("line").alias("n")),
    "grep_literal": lambda s, d: T.grep(_docs(s, d), LITERAL),
    "grep_ignore_case": lambda s, d: T.grep(_docs(s, d), "ЯДРО", ignore_case=True).select("doc_id", "line_no"),
    "grep_regex": lambda s, d: T.grep(_docs(s, d), PATTERN, literal=False).select("doc_id", "line_no", "byte_offset"),
    "grep_max_count": lambda s, d: T.grep(_docs(s, d), LITERAL, max_count=2).select("doc_id", "line_no"),
    "grep_context": lambda s, d: T.grep_context(_docs(s, d), "heartbeat", 1, 2),
    "grep_counts": lambda s, d: T.grep_counts(_docs(s, d), LITERAL),
    "grep_stats": lambda s, d: T.grep_counts(_docs(s, d), LITERAL).agg(F.count("*").alias("files"), F.sum("matched_lines").alias("matched_lines"), F.sum("occurrences").alias("occurrences")),
    "grep_nonmatching": lambda s, d: _docs(s, d).where("text is not null").join(T.grep_counts(_docs(s, d), LITERAL), "doc_id", "left_anti").select("doc_id"),
    "grep_match_ranges": lambda s, d: T.lines(_docs(s, d)).select("doc_id", "line_no", F.size(F.regexp_extract_all("line", F.lit(PATTERN), F.lit(0))).alias("n")).where("n > 0"),
    "grep_multi_literal": lambda s, d: _docs(s, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("residual error|daily journal|merged breadcrumb|journal"), F.lit(0))).alias("hit")).groupBy("doc_id", "hit").agg(F.count("*").alias("n")),
    "grep_binary": lambda s, d: _docs(s, d).groupBy(F.contains("text", F.lit("\u0000")).alias("is_binary")).agg(F.count("*").alias("n")),
    "grep_exit_code": lambda s, d: _docs(s, d).agg(F.when(F.max(F.contains("text", F.lit(LITERAL)).cast("int")) == 1, 0).otherwise(1).alias("exit_code")),
    "harvest_rank": lambda s, d: T.harvest(_docs(s, d), TERMS, 2),
    "harvest_top": lambda s, d: T.harvest(_docs(s, d), TERMS, 1, 10),
    "text_mask": lambda s, d: _docs(s, d).select("doc_id", F.md5(T.mask_simple(F.concat(F.coalesce("text", F.lit("")), F.lit(" mail a.b@mail.example 10.0.12.7 sk-abcdefghijklmnop")))).alias("masked")),
    "text_script_language": lambda s, d: _docs(s, d).where("text is not null").select("doc_id", T.script_language(F.col("text")).alias("lang")),
    "text_clean": lambda s, d: texts(s, d, "specs").where("full_text is not null").distinct().select("id", F.md5(T.clean_text(F.col("full_text"))).alias("cleaned")),
    "text_title": lambda s, d: _docs(s, d).where("text is not null").select("doc_id", T.title_of(F.col("text")).alias("head")),
    "text_snippet": lambda s, d: _docs(s, d).where(F.contains(F.lower("text"), F.lit("heartbeat"))).select("doc_id", T.snippet(F.col("text"), "heartbeat", 80).alias("snip")),
    "text_bonus": lambda s, d: _docs(s, d).where("text is not null").select("doc_id", T.semantic_bonus(F.col("text")).alias("bonus")),
    "text_scripts": lambda s, d: _docs(s, d).where("text is not null").select("doc_id", *T.script_counts(F.col("text"))),
    "text_content_hash": lambda s, d: _docs(s, d).groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")),
    "path_classes": lambda s, d: texts(s, d, "source_files").select("path").unionByName(texts(s, d, "specs").select(F.col("filename").alias("path")).distinct()).select("path", T.path_class(F.col("path")).alias("class"), T.rank_tier("prose", False, F.lit(True), F.col("path")).alias("tier")),
    "corpus_class_stats": lambda s, d: texts(s, d, "source_files").groupBy(F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("ext")).agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes")),
    "signature_lines": lambda s, d: T.lines(texts(s, d, "source_files"), "path").withColumn("name", F.regexp_extract("line", r"^\s*(?:pub(?:\([a-z]+\))? )?(?:async )?(?:fn|def|func|function) ([A-Za-z_0-9]+)\(", 1)).where("name != ''").select("path", "line_no", "name"),
    "type_declarations": lambda s, d: T.lines(texts(s, d, "source_files"), "path").withColumn("name", F.regexp_extract("line", r"^\s*(?:pub |export )?(?:struct|class|type|interface|enum) ([A-Za-z_0-9]+)", 1)).where("name != ''").select("path", "line_no", "name"),
    "resonance_density": lambda s, d: _round(R.density_at_hits(_docs(s, d), PHRASE), "density", digits=4),
    "resonance_density_local": lambda s, d: _round(R.density_at_hits(_docs(s, d), PHRASE, local=True), "density", digits=4),
    "resonance_hits": lambda s, d: _round(_hits(s, d), "density", "resonance", digits=4),
    "resonance_top": lambda s, d: R.top_hits(_hits(s, d), 10).select("doc_id", "pos", F.round("resonance", 2).alias("resonance")),
    "resonance_top_per_doc": lambda s, d: R.top_per_key(_hits(s, d), 1).select("doc_id", "pos"),
    "resonance_field_density": lambda s, d: R.density_field(_docs(s, d), PHRASE).groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum("density"), 2).alias("total")),
    "resonance_field": lambda s, d: _round(R.field_resonance(_docs(s, d), PHRASE), "density", "resonance", digits=3),
    "resonance_total": lambda s, d: T.phrase_hits(_docs(s, d), PHRASE).agg(F.count("*").alias("total_hits"), F.countDistinct("doc_id").alias("texts")),
}

_TOK = r"[\p{L}\p{N}_]+"
_DT = f"SELECT doc_id, text, regexp_extract_all(lower(text), '{_TOK}') AS toks FROM documents WHERE text IS NOT NULL"
_TS = f"SELECT doc_id, unnest(range(len(toks))) AS pos, unnest(toks) AS tok FROM ({_DT})"
_LINES = "SELECT {k}, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT {k}, string_split({t}, chr(10)) AS l FROM {src} WHERE {t} IS NOT NULL)"
_DL = _LINES.format(k="doc_id", t="text", src="documents")
_OFF = "coalesce(sum(strlen(line) + 1) OVER (PARTITION BY {k} ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset"
_PHRASE = "SELECT a.doc_id, a.pos FROM ts a JOIN ts b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.tok = 'lattice' AND b.tok = 'kernel'"
_VOCAB = "vocab AS (SELECT tok, count(*) AS freq FROM ts GROUP BY tok), n AS (SELECT count(*) AS n FROM ts), rare AS (SELECT tok, greatest(0, ln(n) - ln(freq)) AS rarity FROM vocab, n)"
_DENS = f"""WITH ts AS MATERIALIZED ({_TS}), {_VOCAB}, hits AS ({_PHRASE}),
w AS (SELECT DISTINCT h.doc_id, h.pos, t.tok FROM hits h JOIN ts t ON t.doc_id = h.doc_id AND t.pos BETWEEN h.pos - 40 AND h.pos + 40),
kw AS (SELECT h.doc_id, h.pos, count(*) AS kw FROM hits h JOIN ts t ON t.doc_id = h.doc_id AND t.pos BETWEEN h.pos - 40 AND h.pos + 40 WHERE t.tok IN ('lattice', 'kernel') GROUP BY ALL),
dens AS (SELECT doc_id, pos, (1 + ln(1 + max(kw))) * sum(CASE WHEN tok IN ('lattice', 'kernel') THEN 0 ELSE rarity * rarity END) AS density FROM w JOIN rare USING (tok) JOIN kw USING (doc_id, pos) GROUP BY ALL)
"""
_RES = _DENS + """, num AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM dens),
res AS (SELECT a.doc_id, a.pos, a.density, sum(b.density * pow(0.85, a.i - b.i)) AS resonance FROM num a JOIN num b ON a.doc_id = b.doc_id AND b.i <= a.i GROUP BY ALL)
"""
_OCC = lambda t, x: f"((length({t}) - length(replace({t}, '{x}', ''))) // {len(x)})"
_TOTAL = " + ".join(_OCC("lower(text)", t.lower()) for t in TERMS)
_MARKERS = ", ".join(f"('{m.replace(chr(39), chr(39) * 2)}', {w})" for m, w in T.MARKERS.items())
_FIELD = f"""WITH ts AS MATERIALIZED ({_TS}), {_VOCAB}, occ AS (SELECT doc_id, pos, tok, lag(pos) OVER (PARTITION BY doc_id, tok ORDER BY pos) AS prev FROM ts),
ev AS (
  SELECT doc_id, greatest(pos - 40, coalesce(prev + 41, 0), 0) AS place, rarity * rarity AS v, 0 AS k FROM occ JOIN rare USING (tok) WHERE tok NOT IN ('lattice', 'kernel')
  UNION ALL SELECT doc_id, pos + 41, -rarity * rarity, 0 FROM occ JOIN rare USING (tok) WHERE tok NOT IN ('lattice', 'kernel')
  UNION ALL SELECT doc_id, greatest(pos - 40, 0), 0, 1 FROM occ WHERE tok IN ('lattice', 'kernel')
  UNION ALL SELECT doc_id, pos + 41, 0, -1 FROM occ WHERE tok IN ('lattice', 'kernel')
), st AS (SELECT doc_id, place, sum(v) AS v, sum(k) AS k FROM (SELECT * FROM ev UNION ALL SELECT doc_id, pos, 0, 0 FROM ts) GROUP BY ALL),
run AS (SELECT doc_id, place AS pos, sum(v) OVER w AS v, sum(k) OVER w AS k FROM st WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
field AS MATERIALIZED (SELECT r.doc_id, r.pos, (1 + ln(1 + k)) * greatest(v, 0) AS density FROM run r JOIN ts USING (doc_id, pos))
"""

SQL = {
    "text_token_counts": f"SELECT doc_id, len(toks)::INT AS n_tokens, len(list_distinct(toks))::INT AS n_distinct FROM ({_DT})",
    "text_vocabulary": f"SELECT tok, count(*) AS freq FROM ({_TS}) GROUP BY tok",
    "text_term_frequency": f"SELECT doc_id, tok, count(*) AS tf FROM ({_TS}) GROUP BY ALL",
    "text_postings": f"SELECT tok, doc_id, count(*) AS tf, min(pos)::INT AS first_pos, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM ({_TS}) GROUP BY tok, doc_id",
    "text_phrase": f"SELECT doc_id, unnest(list_filter(range(len(toks) - 1), lambda i: toks[i + 1] = 'lattice' AND toks[i + 2] = 'kernel'))::INT AS pos FROM ({_DT})",
    "text_proximity": f"""WITH ts AS MATERIALIZED ({_TS}), c AS (SELECT doc_id, count(*) FILTER (tok = 'journal') AS a, count(*) FILTER (tok = 'heartbeat') AS b FROM ts GROUP BY doc_id HAVING a > 0 AND b > 0),
ex AS (SELECT DISTINCT x.doc_id FROM ts x JOIN ts y ON x.doc_id = y.doc_id AND y.pos = x.pos + 1 WHERE x.tok = 'journal' AND y.tok = 'heartbeat')
SELECT DISTINCT t.doc_id, t.pos::INT AS pos FROM c JOIN ts t ON t.doc_id = c.doc_id AND t.tok = CASE WHEN a <= b THEN 'journal' ELSE 'heartbeat' END
JOIN ts o ON o.doc_id = c.doc_id AND o.tok = CASE WHEN a <= b THEN 'heartbeat' ELSE 'journal' END AND abs(o.pos - t.pos) <= 128 WHERE c.doc_id NOT IN (SELECT doc_id FROM ex)""",
    "text_prefix": f"SELECT doc_id, pos::INT AS pos, tok FROM ({_TS}) WHERE starts_with(tok, '{PREFIX}')",
    "text_literal_prefilter": "SELECT doc_id FROM documents WHERE contains(lower(text), 'journal') AND contains(lower(text), 'heartbeat')",
    "text_corpus_stats": f"SELECT count(*) AS texts, sum(len(toks))::BIGINT AS tokens, sum(strlen(text))::BIGINT AS bytes FROM ({_DT})",
    "grep_lines": f"SELECT id, line_no::INT AS line_no, {_OFF.format(k='id')}, length(line)::INT AS n FROM ({_LINES.format(k='id', t='full_text', src='(SELECT DISTINCT * FROM specs)')})",
    "grep_literal": f"SELECT * FROM (SELECT doc_id, line_no::INT AS line_no, {_OFF.format(k='doc_id')}, line FROM ({_DL})) WHERE contains(line, '{LITERAL}')",
    "grep_ignore_case": f"SELECT doc_id, line_no::INT AS line_no FROM ({_DL}) WHERE contains(lower(line), 'ядро')",
    "grep_regex": f"SELECT doc_id, line_no, byte_offset FROM (SELECT doc_id, line_no::INT AS line_no, {_OFF.format(k='doc_id')}, line FROM ({_DL})) WHERE regexp_matches(line, '{PATTERN}')",
    "grep_max_count": f"SELECT doc_id, line_no::INT AS line_no FROM ({_DL}) WHERE contains(line, '{LITERAL}') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) <= 2",
    "grep_context": f"""WITH l AS (SELECT doc_id, line_no, contains(line, 'heartbeat') AS m FROM ({_DL})),
n AS (SELECT *, max(m::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM l),
g AS (SELECT doc_id, line_no, m, (line_no - coalesce(lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no), -9) > 1)::INT AS gap FROM n WHERE near = 1)
SELECT doc_id, sum(gap) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS grp, line_no::INT AS line_no, m AS is_match FROM g""",
    "grep_counts": f"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '{LITERAL}')))::BIGINT AS matched_lines, {_OCC('text', LITERAL)} AS occurrences FROM documents WHERE contains(text, '{LITERAL}')",
    "grep_stats": f"SELECT count(*) AS files, sum(len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '{LITERAL}'))))::BIGINT AS matched_lines, sum({_OCC('text', LITERAL)})::BIGINT AS occurrences FROM documents WHERE contains(text, '{LITERAL}')",
    "grep_nonmatching": f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND NOT contains(text, '{LITERAL}')",
    "grep_match_ranges": f"SELECT doc_id, line_no::INT AS line_no, len(regexp_extract_all(line, '{PATTERN}'))::INT AS n FROM ({_DL}) WHERE regexp_matches(line, '{PATTERN}')",
    "grep_multi_literal": "SELECT doc_id, hit, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'residual error|daily journal|merged breadcrumb|journal')) AS hit FROM documents) GROUP BY ALL",
    "grep_binary": "SELECT contains(text, chr(0)) AS is_binary, count(*) AS n FROM documents GROUP BY ALL",
    "grep_exit_code": f"SELECT CASE WHEN bool_or(contains(text, '{LITERAL}')) THEN 0 ELSE 1 END AS exit_code FROM documents",
    "harvest_rank": f"SELECT doc_id, ({_TOTAL})::BIGINT AS matches FROM documents WHERE ({_TOTAL}) >= 2",
    "harvest_top": f"SELECT doc_id, ({_TOTAL})::BIGINT AS matches FROM documents WHERE ({_TOTAL}) >= 1 ORDER BY matches DESC, doc_id LIMIT 10",
    "text_mask": f"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(coalesce(text, '') || ' mail a.b@mail.example 10.0.12.7 sk-abcdefghijklmnop', '{T.SECRET}', '[SECRET]', 'g'), '{T.EMAIL}', '[EMAIL]', 'g'), '{T.IP}', '[IP]', 'g')) AS masked FROM documents",
    "text_script_language": """WITH c AS (SELECT doc_id, length(regexp_replace(substring(text, 1, 4000), '[^Ѐ-ӿ]', '', 'g')) AS cyr, length(regexp_replace(substring(text, 1, 4000), '[^A-Za-z]', '', 'g')) AS lat FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN cyr + lat = 0 THEN '' WHEN cyr / (cyr + lat) > 0.2 THEN 'ru' ELSE 'en' END AS lang FROM c""",
    "text_clean": r"""SELECT id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(full_text, '\r\n?', chr(10), 'g'), '[ \t\x0b\f\x{a0}]+(\n)', '\1', 'g'), '[ \t\x0b\f\x{a0}]+$', ''), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS cleaned
FROM (SELECT DISTINCT * FROM specs WHERE full_text IS NOT NULL)""",
    "text_title": r"SELECT doc_id, coalesce(substring(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: strlen(x) >= 3)[1], 1, 120), '') AS head FROM documents WHERE text IS NOT NULL",
    "text_snippet": r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents WHERE contains(lower(text), 'heartbeat'))
SELECT doc_id, substring(flat, greatest(greatest(instr(lower(flat), 'heartbeat') - 1, 0) - 40, 0) + 1, 80) AS snip FROM f""",
    "text_bonus": f"""WITH m(marker, w) AS (VALUES {_MARKERS}), f AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{T.MARKER_PATTERN.replace(chr(39), chr(39) * 2)}')) AS marker FROM documents WHERE text IS NOT NULL)
SELECT d.doc_id, round(coalesce(sum(w), 0), 6)::DOUBLE AS bonus FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) d LEFT JOIN f USING (doc_id) LEFT JOIN m USING (marker) GROUP BY d.doc_id""",
    "text_scripts": "SELECT doc_id, " + ", ".join(f"length(regexp_replace(text, '[^{c}]', '', 'g'))::INT AS {n}" for n, c in T.SCRIPTS) + " FROM documents WHERE text IS NOT NULL",
    "text_content_hash": "SELECT md5(text) AS h, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY ALL",
    "path_classes": f"""WITH p AS (SELECT path FROM source_files UNION ALL SELECT DISTINCT filename FROM specs), e AS (SELECT path, lower(regexp_extract(path, '[^/\\\\.]\\.([A-Za-z0-9]+)$', 1)) AS ext FROM p),
c AS (SELECT path, CASE WHEN ext IN ({', '.join(repr(x) for x in T.DOC_EXTENSIONS)}) THEN 'doc' WHEN ext IN ({', '.join(repr(x) for x in T.CODE_EXTENSIONS)}) THEN 'code' ELSE 'data' END AS class FROM e)
SELECT path, class, CASE WHEN class = 'code' THEN 1 ELSE 0 END AS tier FROM c""",
    "corpus_class_stats": r"SELECT regexp_extract(path, '\.([a-z]+)$', 1) AS ext, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM source_files GROUP BY ALL",
    "signature_lines": rf"SELECT path, line_no::INT AS line_no, name FROM (SELECT path, line_no, regexp_extract(line, '^\s*(?:pub(?:\([a-z]+\))? )?(?:async )?(?:fn|def|func|function) ([A-Za-z_0-9]+)\(', 1) AS name FROM ({_LINES.format(k='path', t='text', src='source_files')})) WHERE name != ''",
    "type_declarations": rf"SELECT path, line_no::INT AS line_no, name FROM (SELECT path, line_no, regexp_extract(line, '^\s*(?:pub |export )?(?:struct|class|type|interface|enum) ([A-Za-z_0-9]+)', 1) AS name FROM ({_LINES.format(k='path', t='text', src='source_files')})) WHERE name != ''",
    "resonance_density": _DENS + "SELECT doc_id, pos::INT AS pos, round(density, 4) AS density FROM dens",
    "resonance_density_local": f"""WITH ts AS MATERIALIZED ({_TS}), n AS (SELECT doc_id, count(*) AS n FROM ts GROUP BY doc_id), rare AS (SELECT doc_id, tok, greatest(0, ln(max(n)) - ln(count(*))) AS rarity FROM ts JOIN n USING (doc_id) GROUP BY doc_id, tok), hits AS ({_PHRASE}),
w AS (SELECT DISTINCT h.doc_id, h.pos, t.tok FROM hits h JOIN ts t ON t.doc_id = h.doc_id AND t.pos BETWEEN h.pos - 40 AND h.pos + 40),
kw AS (SELECT h.doc_id, h.pos, count(*) AS kw FROM hits h JOIN ts t ON t.doc_id = h.doc_id AND t.pos BETWEEN h.pos - 40 AND h.pos + 40 WHERE t.tok IN ('lattice', 'kernel') GROUP BY ALL)
SELECT doc_id, pos::INT AS pos, round((1 + ln(1 + max(kw))) * sum(CASE WHEN tok IN ('lattice', 'kernel') THEN 0 ELSE rarity * rarity END), 4) AS density FROM w JOIN rare USING (doc_id, tok) JOIN kw USING (doc_id, pos) GROUP BY doc_id, pos""",
    "resonance_hits": _RES + "SELECT doc_id, pos::INT AS pos, round(density, 4) AS density, round(resonance, 4) AS resonance FROM res",
    "resonance_top": _RES + "SELECT doc_id, pos::INT AS pos, round(resonance, 2) AS resonance FROM res ORDER BY round(resonance, 2) DESC, doc_id, pos LIMIT 10",
    "resonance_top_per_doc": _RES + "SELECT doc_id, pos::INT AS pos FROM res QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(resonance, 6) DESC, pos) <= 1",
    "resonance_field_density": _FIELD + "SELECT doc_id, count(*) AS n, round(sum(density), 2) AS total FROM field GROUP BY doc_id",
    "resonance_field": _FIELD + f""", hits AS ({_PHRASE}) SELECT h.doc_id, h.pos::INT AS pos, round(max(f.density) FILTER (f.pos = h.pos), 3) AS density, round(sum(f.density * pow(0.85, h.pos - f.pos)), 3) AS resonance
FROM hits h JOIN field f ON f.doc_id = h.doc_id AND f.pos BETWEEN h.pos - 159 AND h.pos GROUP BY h.doc_id, h.pos""",
    "resonance_total": f"WITH ts AS ({_TS}) SELECT count(*) AS total_hits, count(DISTINCT doc_id) AS texts FROM ({_PHRASE})",
}
