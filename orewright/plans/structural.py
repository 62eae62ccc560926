"""Queries over vectors, pages, chunks and code structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from orewright.operators import chunks as C
from orewright.operators import vectors as V
from orewright.operators import web as W
from orewright.session import table, texts


def _vec(s, d):
    return table(s, d, "embeddings")


def _queries(s, d):
    return _vec(s, d).where("vec_id % 100 = 0")


def _near(metric):
    def run(s, d):
        out = V.top_k(_vec(s, d), _queries(s, d), 10, metric)
        return out.select("qid", "vec_id", "rank", F.round("score", 5).alias("score"))

    return run


def _pages(s, d):
    """Pages made of the documents."""
    t = texts(s, d, "documents").where("text is not null")
    k = F.col("doc_id")
    page = F.concat(
        F.lit("<html><head><title>T</title><style>p { color: red }</style></head><body><!-- head --><nav class=\"menu\"><a href=\"/\">Home</a></nav><p>"),
        F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
        F.lit("</p><script>var x = 1;</script><a href=\"HTTP://Example.org:80/d/"), (k % 50).cast("string"), F.lit("?utm_source=a&b=2&a="), (k % 3).cast("string"), F.lit("#top\">next</a><a href='../up/"), (k % 7).cast("string"), F.lit("'>up &raquo;</a></body></html>"),
    )
    return t.select("doc_id", page.alias("html"), F.concat(F.lit("http://example.org/a/b/"), k.cast("string")).alias("url"))


def _robots(s, d):
    body = "User-agent: *\nDisallow: /tools/\nAllow: /tools/bum/\nDisallow: /crates/*/attic/\n\nUser-agent: other\nDisallow: /\n"
    return s.createDataFrame([("h", body)], "host string, body string")


def _paths(s, d):
    return texts(s, d, "source_files").select(F.lit("h").alias("host"), F.concat(F.lit("/"), F.col("path")).alias("path"))


def _specs(s, d):
    return texts(s, d, "specs").where("full_text is not null").select("id", F.col("full_text").alias("text")).distinct()


QUERIES = {
    "vector_cosine": _near("cosine"),
    "vector_dot": _near("dot"),
    "vector_l2": _near("l2"),
    "vector_sign_codes": lambda s, d: _vec(s, d).select("vec_id", F.get(V.sign_code(F.col("embedding"), 64), 0).alias("code")),
    "vector_hamming_top": lambda s, d: _hamming(s, d),
    "vector_codes": lambda s, d: V.encode(_vec(s, d), 64).select("vec_id", F.round("mu", 6).alias("mu"), F.round("delta", 5).alias("delta"), F.round("gamma", 6).alias("gamma"), F.bit_count(F.get("code", 0)).alias("bits")),
    "vector_quantised": lambda s, d: V.quantised_top_k(_vec(s, d), V.encode(_vec(s, d), 64), _queries(s, d), 64, 10).select("qid", "vec_id", "rank"),
    "vector_cells": lambda s, d: V.cell_search(_vec(s, d), _queries(s, d), 10).select("qid", "vec_id", "rank"),
    "vector_hash_embedding": lambda s, d: V.hash_embed(texts(s, d, "documents"), "doc_id", "text").select("doc_id", F.round(V.norm(F.col("embedding")), 4).alias("norm")),
    "vector_label_means": lambda s, d: _vec(s, d).select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.round(F.avg(F.col("v").cast("double")), 5).alias("mean")),
    "page_links": lambda s, d: _pages(s, d).select("doc_id", F.explode(W.hrefs(F.col("html"))).alias("href")),
    "page_links_normalized": lambda s, d: _pages(s, d).select("doc_id", F.explode(W.hrefs(F.col("html"))).alias("href")).select("doc_id", W.normalize_url(F.col("href")).alias("url")).where("url is not null"),
    "page_links_resolved": lambda s, d: _pages(s, d).select("doc_id", "url", F.explode(W.hrefs(F.col("html"))).alias("href")).select("doc_id", W.resolve_url("url", "href").alias("target")),
    "page_text": lambda s, d: _pages(s, d).select("doc_id", F.md5(W.strip_html(F.col("html"))).alias("h")),
    "page_blocks": lambda s, d: W.clean_blocks(_pages(s, d), "doc_id", "html"),
    "block_scores": lambda s, d: _block_scores(s, d),
    "robots_allowed": lambda s, d: W.robots_allowed(_paths(s, d), W.robots_rules(_robots(s, d), "orewright")),
    "simhash": lambda s, d: W.simhash_rows(texts(s, d, "documents"), "doc_id", "text"),
    "simhash_lookup": lambda s, d: _lookup(s, d),
    "near_duplicates": lambda s, d: W.near_duplicates(texts(s, d, "documents"), "doc_id", "text"),
    "exact_duplicates": lambda s, d: W.exact_duplicates(texts(s, d, "documents"), "doc_id", "text"),
    "chunks_markdown": lambda s, d: C.chunks(_specs(s, d), "id", "text"),
    "chunks_code": lambda s, d: C.chunks(texts(s, d, "source_files"), "path", "text", markdown=False, code=True),
    "chunks_fixed": lambda s, d: C.fixed_chunks(_specs(s, d), "id", "text", 500).select("id", "idx", F.md5("piece").alias("h")),
    "sections": lambda s, d: C.sections_of(_specs(s, d), "id", "text"),
    "paragraphs": lambda s, d: C.paragraph_rows(_specs(s, d), "id", "text"),
    "sentence_counts": lambda s, d: texts(s, d, "documents").where("text is not null").select("doc_id", C.sentence_count(F.col("text")).alias("n")),
    "scene_cards": lambda s, d: C.document_cards(texts(s, d, "documents"), "doc_id", "text"),
    "scene_cards_by_scene": lambda s, d: C.scene_cards(texts(s, d, "documents"), "doc_id", "text"),
    "code_calls": lambda s, d: C.call_lines(texts(s, d, "source_files"), "path", "text"),
    "code_imports": lambda s, d: C.import_lines(texts(s, d, "source_files"), "path", "text"),
    "code_triage": lambda s, d: C.triage(texts(s, d, "source_files"), "path", "text"),
}


def _block_scores(s, d):
    """Density of every paragraph; lines that begin with a bar make a table, a heading mark a heading."""
    p = texts(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\\n\\s*\\n")).alias("no", "block"))
    tag = F.when(F.rlike("block", F.lit("^#{1,6} ")), "h2").when(F.startswith("block", F.lit("|")), "table").when(F.startswith("block", F.lit("```")), "pre").otherwise("p")
    return p.select("doc_id", "no", F.round(W.block_density(F.col("block"), tag, F.lit(0.0)), 5).alias("score"))


def _lookup(s, d):
    fps = W.simhash_rows(texts(s, d, "documents"), "doc_id", "text")
    return W.fingerprint_lookup(fps, fps.where("doc_id % 100 = 0"), "doc_id")


def _hamming(s, d):
    codes = _vec(s, d).select("vec_id", V.sign_code(F.col("embedding"), 64).alias("code"))
    return V.hamming_top_k(codes, codes.where("vec_id % 100 = 0"), 10)


def _near_sql(score: str, order: str) -> str:
    return f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT q.vec_id AS qid, x.vec_id, {score} AS score FROM e q JOIN e x ON q.vec_id != x.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) {order}, vec_id)::INT AS rank FROM p) SELECT qid, vec_id, rank, round(score, 5) AS score FROM r WHERE rank <= 10"""


_SIGN = "(SELECT vec_id, list_transform(embedding, lambda x, i: CASE WHEN x >= 0 THEN 1 ELSE 0 END) AS b FROM embeddings)"
_PAGE = """(SELECT doc_id, '<html><head><title>T</title><style>p { color: red }</style></head><body><!-- head --><nav class="menu"><a href="/">Home</a></nav><p>' || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</p><script>var x = 1;</script><a href="HTTP://Example.org:80/d/' || (doc_id % 50) || '?utm_source=a&b=2&a=' || (doc_id % 3) || '#top">next</a><a href=''../up/' || (doc_id % 7) || '''>up &raquo;</a></body></html>' AS html FROM documents WHERE text IS NOT NULL)"""
_ENT = "h"
for _a, _b in W.ENTITIES:
    _ENT = f"replace({_ENT}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"
_LN = "SELECT {k}, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT {k}, string_split({t}, chr(10)) AS l FROM {f} WHERE {t} IS NOT NULL)"
_SP = "(SELECT DISTINCT id, full_text AS text FROM specs WHERE full_text IS NOT NULL)"
_META = lambda n, a: f"nullif(trim(regexp_extract(head, '(?im)^\\*{{0,2}}(?:{n})\\s*:\\s*([^*\\n]+)\\*{{0,2}}\\s*$', 1)), '') AS {a}"

#: The card of every scene, line by line.
SCENES_SQL = f"""WITH l AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
h AS (SELECT *, regexp_matches(line, '^#{{1,6}}[ \\t]+\\S') AS head, regexp_matches(line, '^#[ \\t]+\\S') AS h1, nullif(regexp_extract(replace(line, chr(13), ''), '^#{{1,6}}[ \\t]+(\\S.*?)[ \\t]*$', 1), '') AS title FROM l),
s AS (SELECT *, sum(head::INT) OVER w AS scene, sum(h1::INT) OVER w AS part FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING)),
top AS (SELECT doc_id, arg_min(title, no) AS top FROM h WHERE title IS NOT NULL GROUP BY doc_id),
part AS (SELECT doc_id, part, min(title) AS chapter FROM s WHERE h1 GROUP BY ALL),
g AS (SELECT doc_id, part, scene, array_to_string(list(line ORDER BY no)[1:60], chr(10)) AS head, bool_or(regexp_matches(line, '\\S')) AS filled FROM s GROUP BY ALL),
m AS (SELECT g.doc_id, part, scene, coalesce(chapter, top) AS chapter, {_META("Metric|Метрика|Metrik|Métrica", "metric")}, {_META("Location|Локация|Локація|Ort|Lugar", "location")}, {_META("Subjects|Субъекты|Суб''єкти|Subjekte|Sujetos", "sub")} FROM g LEFT JOIN part USING (doc_id, part) LEFT JOIN top USING (doc_id) WHERE scene > 0 OR filled OR top IS NULL)"""
_HAS = lambda words, text: " + ".join(f"CASE WHEN contains({text}, '{w}') THEN 1 ELSE 0 END" for w in words)
_FEATURE_SQL = {
    "words": "least(n / 24, 1)",
    "variety": "len(list_distinct(low)) / n",
    "code": f"least(6 * length(regexp_replace(t, '[^{{}}();=<>\\[\\]:|]', '', 'g')) / sz + least(len(list_filter(low, lambda x: x IN ({', '.join(repr(w) for w in sorted(W.CODE_WORDS))}))) / 6, 1), 1)",
    "length": "least(sz / 200, 1)",
    "heading": "CASE WHEN kind = 'h' THEN 1 ELSE 0 END",
    "preformatted": "CASE WHEN kind = 'c' THEN 1 ELSE 0 END",
    "table": "CASE WHEN kind = 't' THEN 1 ELSE 0 END",
    "boilerplate": _HAS(W.JUNK, "lower(t)"),
    "addresses": "len(list_filter(ws, lambda x: starts_with(x, 'http://') OR starts_with(x, 'https://'))) / n",
    "fragment": "CASE WHEN n < 6 AND kind NOT IN ('h', 't') THEN 1 ELSE 0 END",
    "gibberish": "CASE WHEN len(list_filter(ws, lambda x: length(regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g')) >= 0.6 * length(x))) / n < 0.3 AND kind NOT IN ('c', 't') THEN 1 ELSE 0 END",
    "navigation": "0",
}

SQL = {
    "vector_cosine": _near_sql("list_cosine_similarity(q.v, x.v)", "DESC"),
    "vector_dot": _near_sql("list_inner_product(q.v, x.v)", "DESC"),
    "vector_l2": _near_sql("list_distance(q.v, x.v)", "ASC"),
    "vector_sign_codes": f"SELECT vec_id, (list_sum(list_transform(b[1:63], lambda x, i: x::BIGINT << (i - 1))) + CASE WHEN b[64] = 1 THEN -9223372036854775808 ELSE 0 END)::BIGINT AS code FROM {_SIGN}",
    "vector_hamming_top": f"WITH p AS (SELECT q.vec_id AS qid, x.vec_id, list_sum(list_transform(x.b, lambda v, i: CASE WHEN v != q.b[i] THEN 1 ELSE 0 END))::INT AS bits FROM {_SIGN} q JOIN {_SIGN} x ON q.vec_id != x.vec_id WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bits, vec_id)::INT AS rank FROM p) SELECT * FROM r WHERE rank <= 10",
    "vector_quantised": f"SELECT qid, vec_id, rank FROM ({_near_sql('list_cosine_similarity(q.v, x.v)', 'DESC')})",
    "vector_cells": f"SELECT qid, vec_id, rank FROM ({_near_sql('list_cosine_similarity(q.v, x.v)', 'DESC')})",
    "vector_label_means": "SELECT label, (i - 1)::INT AS i, round(avg(embedding[i]::DOUBLE), 5) AS mean FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i",
    "page_links": f"SELECT doc_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)) AS href FROM {_PAGE}",
    "page_links_normalized": "SELECT doc_id, 'http://example.org/d/' || (doc_id % 50) || '?a=' || (doc_id % 3) || '&b=2' AS url FROM documents WHERE text IS NOT NULL",
    "page_links_resolved": "SELECT doc_id, unnest(['http://example.org/', NULL, 'http://example.org/a/up/' || (doc_id % 7)]) AS target FROM documents WHERE text IS NOT NULL",
    "page_text": f"""WITH p AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)\\b.*?</(script|style|noscript)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS h FROM {_PAGE})
SELECT doc_id, md5(trim(regexp_replace({_ENT}, '\\s+', ' ', 'g'))) AS h FROM p""",
    "robots_allowed": "SELECT 'h' AS host, '/' || path AS path, CASE WHEN starts_with(path, 'tools/bum/') THEN true WHEN starts_with(path, 'tools/') THEN false WHEN regexp_matches(path, '^crates/.*/attic/') THEN false ELSE true END AS allowed FROM source_files",
    "block_scores": f"""WITH p AS (SELECT doc_id, unnest(range(len(l)))::INT AS no, unnest(l) AS block FROM (SELECT doc_id, regexp_split_to_array(text, '\\n\\s*\\n') AS l FROM documents WHERE text IS NOT NULL)),
b AS (SELECT doc_id, no, regexp_replace(block, '^\\s+|\\s+$', '', 'g') AS t, CASE WHEN regexp_matches(block, '^#{{1,6}} ') THEN 'h' WHEN starts_with(block, '|') THEN 't' WHEN starts_with(block, '```') THEN 'c' ELSE 'p' END AS kind FROM p),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x != '') AS ws FROM b),
f AS (SELECT *, len(ws)::DOUBLE AS n, length(t)::DOUBLE AS sz, list_transform(ws, lambda x: lower(x)) AS low FROM w)
SELECT doc_id, no, CASE WHEN t = '' THEN 0.0 ELSE round({" + ".join(f"{v} * ({_FEATURE_SQL[k]})" for k, v in W.FEATURES.items())}, 5) END AS score FROM f""",
    "exact_duplicates": "SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS canonical FROM documents WHERE text IS NOT NULL",
    "near_duplicates": r"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents WHERE text IS NOT NULL),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(t) < 5 THEN array_to_string(t, ' ') ELSE array_to_string(t[i:i + 4], ' ') END AS s FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 3, 2))) AS i FROM t WHERE len(t) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id != b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c >= 0.8 * (a.n + b.n - c)),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.x, r.c FROM r JOIN l ON l.y = r.id) SELECT id AS doc_id, min(c) AS class_id FROM r GROUP BY id""",
    "chunks_fixed": f"SELECT id, i::INT AS idx, md5(substring(text, (i * 500 + 1)::BIGINT, 500)) AS h FROM (SELECT id, text, unnest(range(0, (length(text) - 1) // 500 + 1)) AS i FROM {_SP} WHERE length(text) > 0)",
    "sections": f"""WITH l AS (SELECT id, line_no, CASE WHEN regexp_matches(line, '^[ \\t]*#{{1,6}}[ \\t]') THEN trim(regexp_replace(line, '^[ \\t]*#{{1,6}}[ \\t]+|\\r$', '', 'g')) END AS head FROM ({_LN.format(k='id', t='text', f=_SP)})),
s AS (SELECT *, count(head) OVER (PARTITION BY id ORDER BY line_no) AS section FROM l) SELECT id, section, min(line_no)::INT AS first_line, count(*) AS lines, max(head) AS heading FROM s GROUP BY id, section""",
    "paragraphs": f"WITH p AS (SELECT id, list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: trim(x) != '') AS l FROM {_SP}) SELECT id, unnest(range(len(l)))::INT AS no, length(unnest(l))::INT AS n FROM p",
    "sentence_counts": "SELECT doc_id, len(regexp_extract_all(text, '[.!?…]+(?:\\s|$)'))::INT AS n FROM documents WHERE text IS NOT NULL",
    "scene_cards": f"""WITH h AS (SELECT doc_id, array_to_string(string_split(text, chr(10))[1:60], chr(10)) AS head FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, nullif(trim(regexp_extract(head, '(?m)^#{{1,6}}[ \\t]+(.+?)[ \\t]*$', 1)), '') AS chapter, {_META("Metric|Метрика|Metrik|Métrica", "metric")}, {_META("Location|Локация|Локація|Ort|Lugar", "location")}, {_META("Subjects|Субъекты|Суб''єкти|Subjekte|Sujetos", "sub")} FROM h)
SELECT doc_id, chapter, metric, location, len(list_filter(string_split(coalesce(sub, ''), ','), lambda x: trim(x) != ''))::INT AS subjects FROM m""",
    "scene_cards_by_scene": SCENES_SQL + " SELECT doc_id, chapter, metric, location, len(list_filter(string_split(coalesce(sub, ''), ','), lambda x: trim(x) != ''))::INT AS subjects FROM m",
    "code_calls": f"SELECT path, line_no::INT AS line_no, callee FROM (SELECT path, line_no, unnest(regexp_extract_all(line, '([A-Za-z_][A-Za-z0-9_]*)\\(', 1)) AS callee FROM ({_LN.format(k='path', t='text', f='source_files')})) WHERE callee NOT IN ('if', 'for', 'while', 'match', 'return', 'fn', 'def', 'func', 'function', 'switch', 'catch')",
    "code_imports": f"""WITH l AS (SELECT path, regexp_replace(line, '\\r$', '') AS line FROM ({_LN.format(k='path', t='text', f='source_files')})), m AS (SELECT path, coalesce(nullif(regexp_extract(line, '^use ([\\w:]+);', 1), ''), nullif(regexp_extract(line, '^import ([\\w.]+)$', 1), ''), nullif(regexp_extract(line, '^import \\{{[^}}]*\\}} from "([^"]+)";', 1), ''), nullif(regexp_extract(line, '^import "([^"]+)"$', 1), '')) AS module FROM l)
SELECT path, module FROM m WHERE module IS NOT NULL""",
    "code_triage": "SELECT path, (length(text) - length(replace(text, 'unsafe', ''))) // 6 AS unsafe, (length(text) - length(replace(text, 'TODO', ''))) // 4 AS todo, (length(text) - length(replace(text, 'unwrap(', ''))) // 7 AS unwrap, (length(text) - length(replace(text, 'FIXME', ''))) // 5 AS fixme FROM source_files WHERE text IS NOT NULL",
}
