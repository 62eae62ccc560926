"""Queries over the index, link and entity graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from orewright.core.references import last_segment
from orewright.operators import graph as G
from orewright.operators import search as S
from orewright.operators import web as W
from orewright.operators.chunks import split_giants
from orewright.operators.index import Index, parse_query, why
from orewright.operators.relational import page_of, sample_rows
from orewright.operators.rescan import file_counts, rescan
from orewright.operators.vectors import cosine
from orewright.session import materialize, scratch, table, texts

TERMS = {"lattice": 1.0, "heartbeat": 1.0, "journal": 1.0}
LEXICON = {"lattice": [("решётки", 0.90), ("gitterkern", 0.70)], "journal": [("журнал", 0.90), ("lattice", 0.70)]}
PHRASE = ["lattice", "kernel"]
SEED, PAIR = "push_hit", ["default", "new"]


#: What the sources of the given tables are worth.
SOURCES = {
    "proof-notes": "mvr_verified", "audit-files": "mvr_verified", "test-plans": "mvr_verified", "engine-docs": "source_document", "code-comments": "source_document",
    "pts-drafts": "source_document", "scan-reports": "source_document", "release-notes": "source_document", "lattice-wiki": "source_document",
}


def _docs(s, d):
    return texts(s, d, "documents")


def edges(s, d):
    """The call graph: distinct call sites as edges with their number as weight, and a class."""
    c = table(s, d, "calls").select("call_id", "caller", last_segment(F.col("callee")).alias("dst")).distinct().where("caller is not null and dst is not null")
    return c.groupBy(F.col("caller").alias("src"), "dst").agg(F.count("*").alias("weight")).withColumn("cls", F.length("dst") % 6)


def nodes(s, d):
    e = edges(s, d)
    return e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()


def _seed(s, *ids):
    return s.createDataFrame([(i,) for i in ids], "id string")


def _r(df, *cols, n=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, n))
    return df


def _bm25(s, d, terms=None):
    return S.bm25(_docs(s, d), terms or TERMS)


def _links(s, d):
    """Links between source files: a file links to those that define what it calls."""
    c = table(s, d, "calls").select("file", last_segment(F.col("callee")).alias("symbol")).distinct()
    f = table(s, d, "defs").select("symbol", F.col("file").alias("dst")).distinct()
    one = f.groupBy("symbol").agg(F.count("*").alias("n"), F.min("dst").alias("dst")).where("n = 1").select("symbol", "dst")
    return c.join(one, "symbol").select(F.col("file").alias("src"), "dst").distinct()


def _files(s, d):
    return texts(s, d, "source_files").select(F.col("path").alias("id")).distinct()


#: Words of a query, a phrase among them, and the vector that stands for it.
ASKED, ASKED_VECTOR = '"lattice kernel" journal', 7


def _index(s, d):
    """An index of the documents from two snapshots: the earlier ones without titles, then all as they are."""
    at = Index(s, scratch(s, "index"))
    docs = _docs(s, d)
    at.upsert(docs.where("ingested_at < timestamp_ntz'2024-06-01 00:00:00'").withColumn("title", F.lit(None).cast("string")))
    at.upsert(docs)
    return at


def _asked(s, d):
    terms, phrases = parse_query(ASKED)
    return _index(s, d).bm25(dict.fromkeys(terms, 1.0), phrases[0])


def _hybrid(s, d):
    """Documents by the index and by the cosine of their vectors to one of them."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    q = e.where(F.col("id") == ASKED_VECTOR).select(F.col("v").alias("q"))  # one row
    cos = e.crossJoin(F.broadcast(q)).select("id", cosine(F.col("v"), F.col("q")).alias("cos"))
    lex = _index(s, d).bm25(TERMS).select(F.col("doc_id").alias("id"), "bm25")
    return S.fuse(lex, cos, _docs(s, d).select(F.col("doc_id").alias("id"), S.provenance(F.col("source"), SOURCES).alias("provenance")))


def _web(s, d):
    """Source files by their words and by their rank among the files that link to each other."""
    files = texts(s, d, "source_files").withColumn("title", F.regexp_replace("path", r"[/._]", " "))
    scored = S.bm25(files, WEB_TERMS, key="path")
    return S.web_rank(scored, S.page_rank(_files(s, d), _links(s, d), 3), len(WEB_TERMS), key="path")


WEB_TERMS = {"window": 1.0, "cursor": 1.0, "trit": 1.0}


def _triples(s, d):
    t = table(s, d, "calls").select(F.col("caller").alias("s"), F.lit("calls").alias("p"), last_segment(F.col("callee")).alias("o")).where("s is not null and o is not null")
    i = table(s, d, "imports").where("file is not null").select(F.col("file").alias("s"), F.lit("imports").alias("p"), F.col("module").alias("o"))
    return t.unionByName(i)


def _defs(s, d):
    return table(s, d, "defs").distinct().withColumn("lang", F.regexp_extract("file", r"\.([a-z]+)$", 1))


def _name_words(symbol):
    """The longer words of a name in their order by letters, however they are joined."""
    apart = F.lower(F.regexp_replace(symbol, "([a-z0-9])([A-Z])", "$1_$2"))
    return F.array_join(F.array_sort(F.filter(F.split(apart, "_"), lambda w: F.length(w) > 3)), " ")


def _rescan(s, d):
    """A scan of the files known at a day, then one of all files, some of which were deleted after it."""
    f = texts(s, d, "source_files").select("path", F.col("bytes").alias("size"), F.col("indexed_at").alias("mtime"), "text", "deleted_at")
    day = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    first = f.where(F.col("mtime") < day)
    counts = materialize(file_counts(first), "counts")
    vocab = counts.groupBy("tok").agg(F.sum("n").alias("freq"))
    return rescan(first.select("path", "size", "mtime"), counts, vocab, f.where("deleted_at is null"))


def _calls(s, d):
    return table(s, d, "calls").select(F.col("caller").alias("src"), last_segment(F.col("callee")).alias("dst"), "file").where("dst is not null and file is not null")


QUERIES = {
    "index_rows": lambda s, d: S.index_rows(_docs(s, d)).select("doc_id", "doclen", F.size("head").alias("title_terms")),
    "index_bm25": lambda s, d: _r(_bm25(s, d), "bm25"),
    "index_bm25_expanded": lambda s, d: _r(_bm25(s, d, S.expand(list(TERMS), LEXICON)), "bm25").select("doc_id", "bm25"),
    "index_bm25_top": lambda s, d: _r(_bm25(s, d), "bm25", n=4).orderBy(F.desc("bm25"), "doc_id").limit(10).select("doc_id", "bm25"),
    "index_phrase_bonus": lambda s, d: _r(S.phrase_filter(_docs(s, d), _bm25(s, d, {"lattice": 1.0, "kernel": 1.0}), PHRASE), "bm25").select("doc_id", "bm25", "occ"),
    "link_edges": _links,
    "page_rank": lambda s, d: _r(S.page_rank(_files(s, d), _links(s, d), 5), "rank", n=9),
    "web_search": lambda s, d: _r(_web(s, d), "score", "bm25", "density").select("path", "score", "bm25", "density"),
    "hybrid_search": lambda s, d: _r(_hybrid(s, d), "score"),
    "index_persisted": lambda s, d: _r(_index(s, d).bm25(TERMS), "bm25").drop("occ"),
    "index_persisted_phrase": lambda s, d: _r(_asked(s, d), "bm25").select("doc_id", "bm25", "occ"),
    "index_why": lambda s, d: _r(why(_index(s, d), TERMS), "idf", "part"),
    "index_unique": lambda s, d: _r(S.unique_results(_bm25(s, d), _docs(s, d).where("text is not null").select("doc_id", F.md5("text").alias("digest"))), "bm25").select("doc_id", "bm25"),
    "index_page": lambda s, d: page_of(_r(_bm25(s, d), "bm25", n=4).select("doc_id", "bm25"), [F.desc("bm25"), "doc_id"], 3, 10),
    "document_sample": lambda s, d: sample_rows(_docs(s, d).select("doc_id", "n_chars"), "doc_id", 50, 7),
    "graph_sql_export": lambda s, d: G.sql_export(edges(s, d)),
    "url_slugs": lambda s, d: texts(s, d, "source_files").select("path", W.url_slug(F.concat(F.lit("http://example.org/"), F.col("path"))).alias("slug")),
    "giant_split": lambda s, d: split_giants(texts(s, d, "specs").distinct(), "id", "full_text", 8192, 2048).groupBy("id").agg(F.count("*").alias("parts"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part_no", "part"))), lambda p: p["part"]), "")).alias("h")).select("id", "h", (F.col("parts") > 1).alias("cut")),
    "index_upserts": lambda s, d: _index(s, d).manifest().select("gen", "pages", "added", "changed", "same", "removed"),
    "provenance_stats": lambda s, d: _docs(s, d).groupBy(S.provenance(F.col("source"), SOURCES).alias("provenance")).agg(F.count("*").alias("n"), F.countDistinct(F.lower(F.trim("source"))).alias("sources")),
    "min_provenance": lambda s, d: _docs(s, d).where(S.provenance(F.col("source"), SOURCES) == "mvr_verified").select("doc_id"),
    "snapshot_changes": lambda s, d: S.upsert(_docs(s, d).where("ingested_at < timestamp_ntz'2024-06-01 00:00:00'").select("doc_id", F.md5("text").alias("h")), _docs(s, d).where("ingested_at >= timestamp_ntz'2024-03-01 00:00:00'").select("doc_id", F.md5(F.concat("text", F.when(F.col("doc_id") % 10 == 0, "x").otherwise(""))).alias("h")), "doc_id", "h"),
    "bigram_trits": lambda s, d: S.bigram_trits(texts(s, d, "poler_notes").select("id", "title").distinct(), "id", "title"),
    "bigram_trits_corpus": lambda s, d: S.bigram_trits(_docs(s, d), "doc_id", "text").groupBy("trit").agg(F.count("*").alias("pairs"), F.sum("n").alias("n")),
    "graph_edges": edges,
    "graph_degrees": lambda s, d: G.degrees(edges(s, d)),
    "graph_degree_ranking": lambda s, d: G.degrees(edges(s, d)).orderBy(F.desc("in_degree"), "id").limit(20).select("id", "in_degree"),
    "graph_class_mass": lambda s, d: G.class_mass(edges(s, d)),
    "graph_signed": lambda s, d: G.signed(edges(s, d)).select("src", "dst", "signed_weight"),
    "graph_rotor": lambda s, d: G.rotor(edges(s, d)),
    "graph_rotor_top": lambda s, d: G.rotor_top(edges(s, d), 15),
    "graph_neighbours": lambda s, d: G.neighbours(edges(s, d), SEED, 12),
    "graph_k_hop": lambda s, d: G.k_hop(edges(s, d), _seed(s, SEED), 2),
    "graph_k_hop_both": lambda s, d: G.k_hop(edges(s, d), _seed(s, "default"), 1, both=True),
    "graph_frontier": lambda s, d: G.frontier_sizes(edges(s, d), _seed(s, SEED), 3, 1),
    "graph_weighted_k_hop": lambda s, d: _r(G.weighted_k_hop(edges(s, d), _seed(s, SEED), 2), "strength"),
    "graph_path_length": lambda s, d: G.shortest_path_length(edges(s, d), SEED, "is_empty_run", 4),
    "graph_common_partners": lambda s, d: G.common_partners(edges(s, d), PAIR),
    "graph_page_rank": lambda s, d: _r(G.weighted_page_rank(nodes(s, d), edges(s, d), 4), "rank", n=9),
    "graph_propagate": lambda s, d: _r(G.propagate(edges(s, d), _seed(s, SEED), 2), "x", n=4),
    "graph_motifs": lambda s, d: G.motifs(edges(s, d)),
    "graph_impact": lambda s, d: G.impact(_calls(s, d), _seed(s, SEED, "with_limit", "nov_walk_window_edge", "default"), 2),
    "graph_passport": lambda s, d: G.passport(_calls(s, d), _seed(s, SEED, "with_limit", "nov_walk_window_edge", "default", "no_such_symbol"), 2),
    "graph_path": lambda s, d: G.shortest_path(edges(s, d), SEED, "is_empty_run", 4),
    "rescan_vocabulary": lambda s, d: _rescan(s, d)[2],
    "rescan_plan": lambda s, d: _rescan(s, d)[0].groupBy("act").agg(F.count("*").alias("files")),
    "triples_dedup": lambda s, d: G.dedup_triples(_triples(s, d)),
    "triples_counts": lambda s, d: _triples(s, d).groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("s", "o").alias("pairs")),
    "causal_nexus_words": lambda s, d: G.nexus(_defs(s, d).withColumn("symbol", _name_words(F.col("symbol")))),
    "causal_nexus": lambda s, d: G.nexus(_defs(s, d)),
}

_SEG = r"nullif(trim(regexp_replace(trim(regexp_replace(trim(callee), '\s*(\(\)|!)$', '')), '^.*(::|\.)', '')), '')"
_E = f"edge AS MATERIALIZED (SELECT src, dst, count(*) AS weight, length(dst) % 6 AS cls FROM (SELECT DISTINCT call_id, caller AS src, {_SEG} AS dst FROM calls) WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY src, dst)"
_SGN = "CASE cls WHEN 0 THEN -1 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END"
_WT = r"list_filter(regexp_extract_all(translate(lower({c}), 'ё', 'е'), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) BETWEEN 2 AND 32)"
_IDX = f"idx AS MATERIALIZED (SELECT doc_id, {_WT.format(c='text')} AS body, {_WT.format(c='coalesce(title, chr(0))')} AS head FROM documents WHERE text IS NOT NULL)"
_FILE_IDX = f"idx AS MATERIALIZED (SELECT path AS doc_id, {_WT.format(c='text')} AS body, {_WT.format(c="regexp_replace(path, '[/._]', ' ', 'g')")} AS head FROM source_files WHERE text IS NOT NULL)"
_CNT = "len(list_filter({a}, lambda x: x = '{t}'))"


def _bm25_sql(terms: dict[str, float]) -> str:
    vals = ", ".join(f"('{t}', {w})" for t, w in terms.items())
    return f"""{_IDX}, q(term, weight) AS (VALUES {vals}), n AS (SELECT count(*) AS n, avg(greatest(len(body), 1)) AS avgdl FROM idx),
tf AS (SELECT doc_id, term, weight, len(body) AS doclen, len(list_filter(body, lambda x: x = term)) + len(list_filter(head, lambda x: x = term)) AS f, least(len(list_filter(head, lambda x: x = term)), 1) AS h FROM idx, q),
df AS (SELECT term, count(*) AS df FROM tf WHERE f > 0 GROUP BY term),
sc AS (SELECT doc_id, sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * greatest(doclen, 1) / avgdl))) AS bm25, sum(f)::INT AS hits, sum(h)::INT AS title_hits, max(doclen)::INT AS doclen FROM tf JOIN df USING (term), n WHERE f > 0 GROUP BY doc_id)
"""


_LINKS = f"""one AS (SELECT symbol, min(file) AS dst FROM (SELECT DISTINCT symbol, file FROM defs) GROUP BY symbol HAVING count(*) = 1),
link AS (SELECT DISTINCT file AS src, dst FROM (SELECT DISTINCT file, {_SEG} AS symbol FROM calls) JOIN one USING (symbol))"""
_PROV = "CASE WHEN lower(trim(source)) IN ('proof-notes', 'audit-files', 'test-plans') THEN 'mvr_verified' WHEN lower(trim(source)) IN ('engine-docs', 'code-comments', 'pts-drafts', 'scan-reports', 'release-notes', 'lattice-wiki') THEN 'source_document' ELSE 'narrative' END"


def _rank_sql(k: int) -> str:
    steps = ["r0 AS (SELECT id, 1.0::DOUBLE AS rank FROM page)"]
    for i in range(1, k + 1):
        steps.append(f"r{i} AS MATERIALIZED (SELECT p.id, 0.15 / (SELECT count(*) FROM page) + 0.85 * coalesce(sum(r.rank / o.n), 0) AS rank FROM page p LEFT JOIN l ON l.dst = p.id AND l.src != l.dst LEFT JOIN r{i - 1} r ON r.id = l.src LEFT JOIN o ON o.src = l.src GROUP BY p.id)")
    return f"WITH {_LINKS}, page AS (SELECT DISTINCT path AS id FROM source_files), l AS (SELECT src, dst FROM link WHERE dst IN (SELECT id FROM page)), o AS (SELECT src, count(*) AS n FROM l GROUP BY src), " + ", ".join(steps) + f" SELECT id, round(rank, 9) AS rank FROM r{k}"


def _wrank_sql(k: int) -> str:
    steps = ["r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM node) AS rank FROM node)"]
    for i in range(1, k + 1):
        steps.append(
            f"z{i} AS (SELECT coalesce(sum(rank), 0) AS loose FROM r{i - 1} WHERE id NOT IN (SELECT src FROM o)), r{i} AS MATERIALIZED (SELECT p.id, 0.15 / (SELECT count(*) FROM node) + 0.85 * coalesce(sum(r.rank * a.w / o.s), 0) + 0.85 * (SELECT loose FROM z{i}) / (SELECT count(*) FROM node) AS rank FROM node p LEFT JOIN a ON a.dst = p.id LEFT JOIN r{i - 1} r ON r.id = a.src LEFT JOIN o ON o.src = a.src GROUP BY p.id)"
        )
    return f"WITH {_E}, node AS (SELECT src AS id FROM edge UNION SELECT dst FROM edge), a AS (SELECT src, dst, sum(abs(weight * {_SGN})) AS w FROM edge WHERE {_SGN} != 0 GROUP BY src, dst), o AS (SELECT src, sum(w) AS s FROM a GROUP BY src), " + ", ".join(steps) + f" SELECT id, round(rank, 9) AS rank FROM r{k}"


_HOPS = """hop(id, depth) AS (SELECT '{s}', 0 UNION SELECT e.dst, h.depth + 1 FROM hop h JOIN e ON e.src = h.id WHERE h.depth < {k}), near AS (SELECT id, min(depth)::INT AS depth FROM hop GROUP BY id)"""

SQL = {
    "index_rows": f"WITH {_IDX} SELECT doc_id, len(body)::INT AS doclen, len(head)::INT AS title_terms FROM idx",
    "index_bm25": f"WITH {_bm25_sql(TERMS)} SELECT doc_id, round(bm25, 6) AS bm25, hits, title_hits, doclen FROM sc",
    "index_bm25_expanded": f"WITH {_bm25_sql(S.expand(list(TERMS), LEXICON))} SELECT doc_id, round(bm25, 6) AS bm25 FROM sc",
    "index_bm25_top": f"WITH {_bm25_sql(TERMS)} SELECT doc_id, round(bm25, 4) AS bm25 FROM sc ORDER BY round(bm25, 4) DESC, doc_id LIMIT 10",
    "index_phrase_bonus": f"""WITH {_bm25_sql({"lattice": 1.0, "kernel": 1.0})}, occ AS (SELECT doc_id, len(list_filter(range(1, len(body)), lambda i: body[i] = 'lattice' AND body[i + 1] = 'kernel')) AS occ FROM idx)
SELECT doc_id, round(bm25 + 0.5 * (SELECT sum(ln(1 + (n - df + 0.5) / (df + 0.5))) FROM df, n) * least(occ, 8), 6) AS bm25, occ::INT AS occ FROM sc JOIN occ USING (doc_id) WHERE occ > 0""",
    "link_edges": f"WITH {_LINKS} SELECT * FROM link",
    "page_rank": _rank_sql(5),
    "web_search": f"""WITH {_rank_sql(3).removeprefix("WITH ").rsplit(" SELECT id, round", 1)[0]}, {_bm25_sql(WEB_TERMS).replace(_IDX, _FILE_IDX)},
c AS (SELECT sc.*, coalesce(r.rank, 0) AS rank, CASE WHEN doclen > 0 THEN hits / doclen ELSE 0 END AS density FROM sc LEFT JOIN r3 r ON r.id = sc.doc_id), t AS (SELECT max(bm25) AS mb, max(rank) AS mr, max(density) AS md FROM c)
SELECT doc_id AS path, round(0.55 * bm25 / mb + 0.15 * ln(1 + 1000 * rank) / ln(1 + 1000 * mr) + 0.2 * least(title_hits / 3, 1) + 0.1 * density / md, 6) AS score, round(bm25, 6) AS bm25, round(density, 6) AS density FROM c, t""",
    "hybrid_search": f"""WITH {_bm25_sql(TERMS)}, e AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings), v AS (SELECT e.doc_id, list_cosine_similarity(e.v, q.v) AS cos FROM e, e q WHERE q.doc_id = {ASKED_VECTOR})
SELECT doc_id AS id, round((0.65 * coalesce(bm25 / (SELECT max(bm25) FROM sc), 0) + 0.35 * greatest(0, least(1, coalesce(cos, 0)))) * CASE {_PROV} WHEN 'mvr_verified' THEN 1.5 WHEN 'source_document' THEN 1.0 ELSE 0.7 END, 6) AS score FROM sc FULL JOIN v USING (doc_id) JOIN documents USING (doc_id)""",
    "index_persisted": f"WITH {_bm25_sql(TERMS)} SELECT doc_id, round(bm25, 6) AS bm25, hits, title_hits, doclen FROM sc",
    "index_persisted_phrase": f"""WITH {_bm25_sql({"lattice": 1.0, "kernel": 1.0, "journal": 1.0})}, occ AS (SELECT doc_id, len(list_filter(range(1, len(body)), lambda i: body[i] = 'lattice' AND body[i + 1] = 'kernel')) AS occ FROM idx)
SELECT doc_id, round(bm25 + 0.5 * (SELECT sum(ln(1 + (n - df + 0.5) / (df + 0.5))) FROM df, n WHERE term != 'journal') * least(occ, 8), 6) AS bm25, occ::INT AS occ FROM sc JOIN occ USING (doc_id) WHERE occ > 0""",
    "index_why": f"WITH {_bm25_sql(TERMS)} SELECT doc_id, term, (f - t)::INT AS tf, t::INT AS title_tf, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * greatest(doclen, 1) / avgdl)), 6) AS part FROM (SELECT tf.*, len(list_filter(head, lambda x: x = term)) AS t FROM tf JOIN idx USING (doc_id)) JOIN df USING (term), n WHERE f > 0",
    "index_unique": f"WITH {_bm25_sql(TERMS)}, r AS (SELECT doc_id, bm25, row_number() OVER (PARTITION BY md5(text) ORDER BY round(bm25, 9) DESC, doc_id) AS rn FROM sc JOIN documents USING (doc_id)) SELECT doc_id, round(bm25, 6) AS bm25 FROM r WHERE rn = 1",
    "index_page": f"WITH {_bm25_sql(TERMS)} SELECT doc_id, round(bm25, 4) AS bm25 FROM sc ORDER BY round(bm25, 4) DESC, doc_id LIMIT 10 OFFSET 20",
    "document_sample": "SELECT doc_id, n_chars FROM documents ORDER BY md5(doc_id || '|7'), doc_id LIMIT 50",
    "graph_sql_export": f"WITH {_E} SELECT 'INSERT INTO edge (src, dst, weight) VALUES (' || chr(39) || replace(src, chr(39), chr(39) || chr(39)) || chr(39) || ', ' || chr(39) || replace(dst, chr(39), chr(39) || chr(39)) || chr(39) || ', ' || weight || ');' AS line FROM edge",
    "url_slugs": r"""WITH u AS (SELECT path, 'http://example.org/' || path AS url FROM source_files)
SELECT path, format('{:016x}', list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(url, ''), lambda c: ord(c)::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT) || '_' || regexp_replace(reverse(right(url, 24)), '[^\p{L}\p{N}.-]', '', 'g') AS slug FROM u""",
    "giant_split": "SELECT id, md5(full_text) AS h, length(full_text) >= 8192 AS cut FROM (SELECT DISTINCT * FROM specs) WHERE full_text IS NOT NULL",
    "index_upserts": """WITH d AS (SELECT *, ingested_at < '2024-06-01' AS early FROM documents WHERE text IS NOT NULL)
SELECT 1 AS gen, count(*) FILTER (early) AS pages, count(*) FILTER (early) AS added, 0::BIGINT AS changed, 0::BIGINT AS same, 0::BIGINT AS removed FROM d
UNION ALL SELECT 2, count(*) FILTER (early IS NOT TRUE), count(*) FILTER (early IS NOT TRUE), count(*) FILTER (early AND coalesce(title, '') != ''), count(*) FILTER (early AND coalesce(title, '') = ''), 0 FROM d""",
    "provenance_stats": f"SELECT {_PROV} AS provenance, count(*) AS n, count(DISTINCT lower(trim(source))) AS sources FROM documents GROUP BY 1",
    "min_provenance": f"SELECT doc_id FROM documents WHERE {_PROV} = 'mvr_verified'",
    "snapshot_changes": """WITH o AS (SELECT doc_id, md5(text) AS was FROM documents WHERE ingested_at < '2024-06-01'), n AS (SELECT doc_id, md5(text || CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE '' END) AS now FROM documents WHERE ingested_at >= '2024-03-01')
SELECT doc_id, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' WHEN was != now THEN 'changed' ELSE 'same' END AS change FROM o FULL JOIN n USING (doc_id)""",
    "graph_edges": f"WITH {_E} SELECT src, dst, weight, cls::INT AS cls FROM edge",
    "graph_degrees": f"WITH {_E} SELECT coalesce(o.src, i.dst) AS id, coalesce(od, 0) AS out_degree, coalesce(idg, 0) AS in_degree, coalesce(om, 0)::BIGINT AS out_mass, coalesce(im, 0)::BIGINT AS in_mass FROM (SELECT src, count(*) AS od, sum(weight) AS om FROM edge GROUP BY src) o FULL JOIN (SELECT dst, count(*) AS idg, sum(weight) AS im FROM edge GROUP BY dst) i ON o.src = i.dst",
    "graph_degree_ranking": f"WITH {_E} SELECT dst AS id, count(*) AS in_degree FROM edge GROUP BY dst ORDER BY in_degree DESC, id LIMIT 20",
    "graph_class_mass": f"WITH {_E} SELECT cls::INT AS cls, count(*) AS edges, sum(weight)::BIGINT AS mass, sum(weight * {_SGN})::BIGINT AS signed_mass FROM edge GROUP BY cls",
    "graph_signed": f"WITH {_E} SELECT src, dst, weight * {_SGN} AS signed_weight FROM edge",
    "graph_rotor": f"WITH {_E}, s AS (SELECT src, dst, weight * {_SGN} AS w FROM edge WHERE src != dst) SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(CASE WHEN src < dst THEN w ELSE -w END)::BIGINT AS j FROM s GROUP BY ALL HAVING j != 0",
    "graph_rotor_top": f"WITH {_E}, s AS (SELECT src, dst, weight * {_SGN} AS w FROM edge WHERE src != dst), r AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(CASE WHEN src < dst THEN w ELSE -w END)::BIGINT AS j FROM s GROUP BY ALL HAVING j != 0), t AS (SELECT CASE WHEN j > 0 THEN a ELSE b END AS src, CASE WHEN j > 0 THEN b ELSE a END AS dst, abs(j) AS j FROM r) SELECT * FROM t ORDER BY j DESC, src, dst LIMIT 15",
    "graph_neighbours": f"WITH {_E} SELECT dst AS id, weight FROM edge WHERE src = '{SEED}' ORDER BY weight DESC, dst LIMIT 12",
    "graph_k_hop": f"WITH RECURSIVE {_E}, e AS (SELECT DISTINCT src, dst FROM edge), {_HOPS.format(s=SEED, k=2)} SELECT * FROM near",
    "graph_k_hop_both": f"WITH RECURSIVE {_E}, e AS (SELECT src, dst FROM edge UNION SELECT dst, src FROM edge), {_HOPS.format(s='default', k=1)} SELECT * FROM near",
    "graph_frontier": f"WITH RECURSIVE {_E}, e AS (SELECT DISTINCT src, dst FROM edge WHERE {_SGN} = 1), {_HOPS.format(s=SEED, k=3)} SELECT depth, count(*) AS nodes FROM near WHERE depth > 0 GROUP BY depth",
    "graph_weighted_k_hop": f"WITH RECURSIVE {_E}, e AS (SELECT DISTINCT src, dst FROM edge), {_HOPS.format(s=SEED, k=1)} SELECT src, dst, depth, round(weight * pow(0.5, depth), 6) AS strength FROM edge JOIN near ON near.id = edge.src",
    "graph_path_length": f"WITH RECURSIVE {_E}, e AS (SELECT DISTINCT src, dst FROM edge), {_HOPS.format(s=SEED, k=4)} SELECT '{SEED}' AS src, id AS dst, depth AS hops FROM near WHERE id = 'is_empty_run'",
    "graph_common_partners": f"WITH {_E} SELECT dst AS id, sum(weight)::BIGINT AS mass FROM edge WHERE src IN ('{PAIR[0]}', '{PAIR[1]}') GROUP BY dst HAVING count(DISTINCT src) = 2",
    "graph_page_rank": _wrank_sql(4),
    "graph_propagate": f"""WITH {_E}, a AS (SELECT src, dst, sum(weight * {_SGN}) AS w FROM edge WHERE {_SGN} != 0 GROUP BY ALL), x0 AS (SELECT '{SEED}' AS id, 1.0::DOUBLE AS x),
x1 AS (SELECT id, sum(x) AS x FROM (SELECT id, 0.9 * x AS x FROM x0 UNION ALL SELECT dst, 0.5 * x * w FROM x0 JOIN a ON a.src = x0.id) GROUP BY id),
x2 AS (SELECT id, sum(x) AS x FROM (SELECT id, 0.9 * x AS x FROM x1 UNION ALL SELECT dst, 0.5 * x * w FROM x1 JOIN a ON a.src = x1.id) GROUP BY id) SELECT id, round(x, 4) AS x FROM x2""",
    "graph_motifs": f"""WITH {_E}, e AS MATERIALIZED (SELECT DISTINCT src, dst FROM edge WHERE src != dst), two AS (SELECT a.src AS u, a.dst AS v, b.dst AS w FROM e a JOIN e b ON b.src = a.dst WHERE b.dst != a.src)
SELECT n.src AS id, coalesce(r.n, 0) AS reciprocal, coalesce(f.n, 0) AS feedforward, coalesce(g.n, 0) AS feedback3 FROM (SELECT DISTINCT src FROM e) n
LEFT JOIN (SELECT a.src AS u, count(*) AS n FROM e a JOIN e b ON b.src = a.dst AND b.dst = a.src GROUP BY ALL) r ON r.u = n.src
LEFT JOIN (SELECT t.u, count(*) AS n FROM two t JOIN e c ON c.src = t.u AND c.dst = t.w GROUP BY ALL) f ON f.u = n.src
LEFT JOIN (SELECT t.u, count(*) AS n FROM two t JOIN e c ON c.src = t.w AND c.dst = t.u GROUP BY ALL) g ON g.u = n.src""",
    "graph_impact": f"""WITH RECURSIVE c AS MATERIALIZED (SELECT caller AS src, {_SEG} AS dst, file FROM calls WHERE file IS NOT NULL), e AS (SELECT DISTINCT src, dst FROM c WHERE dst IS NOT NULL AND src IS NOT NULL), root(root) AS (VALUES ('{SEED}'), ('with_limit'), ('nov_walk_window_edge'), ('default')),
hop(root, id, depth) AS (SELECT root, root, 0 FROM root UNION SELECT h.root, e.src, h.depth + 1 FROM hop h JOIN e ON e.dst = h.id WHERE h.depth < 2), near AS (SELECT root, id, min(depth) AS depth FROM hop GROUP BY ALL),
k AS (SELECT root, count(*) FILTER (depth > 0) AS callers FROM near GROUP BY root), f AS (SELECT root, count(DISTINCT file) AS files FROM near JOIN c ON c.dst = near.id GROUP BY root)
SELECT root AS symbol, coalesce(callers, 0) AS callers, coalesce(files, 0) AS files, CASE WHEN coalesce(files, 0) = 0 THEN 'LOW' WHEN files <= 3 THEN 'MEDIUM' WHEN files <= 10 THEN 'HIGH' ELSE 'CRITICAL' END AS danger FROM root LEFT JOIN k USING (root) LEFT JOIN f USING (root)""",
    "graph_passport": f"""WITH RECURSIVE c AS MATERIALIZED (SELECT DISTINCT caller AS src, {_SEG} AS dst, file FROM calls WHERE file IS NOT NULL AND caller IS NOT NULL AND {_SEG} IS NOT NULL), e AS MATERIALIZED (SELECT DISTINCT src, dst FROM c),
root(root) AS (VALUES ('{SEED}'), ('with_limit'), ('nov_walk_window_edge'), ('default'), ('no_such_symbol')),
u(root, id, depth) AS (SELECT root, root, 0 FROM root UNION SELECT u.root, e.src, u.depth + 1 FROM u JOIN e ON e.dst = u.id WHERE u.depth < 2), up AS (SELECT root, id, min(depth) AS depth FROM u GROUP BY ALL),
w(root, id, depth) AS (SELECT root, root, 0 FROM root UNION SELECT w.root, e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.id WHERE w.depth < 2), down AS (SELECT root, id, min(depth) AS depth FROM w GROUP BY ALL),
fa AS (SELECT DISTINCT root, file FROM up JOIN c ON c.dst = up.id WHERE depth < 2), fb AS (SELECT DISTINCT root, file FROM down JOIN c ON c.src = down.id WHERE depth < 2)
SELECT root AS symbol, (SELECT count(*) FROM up WHERE up.root = r.root AND depth > 0) AS upstream, (SELECT count(*) FROM down WHERE down.root = r.root AND depth > 0) AS downstream,
(SELECT count(*) FROM fa WHERE fa.root = r.root) AS files, (SELECT count(*) FROM fb WHERE fb.root = r.root) AS files_below,
(SELECT CASE WHEN count(*) = 0 THEN 'LOW' WHEN count(*) <= 3 THEN 'MEDIUM' WHEN count(*) <= 10 THEN 'HIGH' ELSE 'CRITICAL' END FROM (SELECT * FROM fa UNION SELECT * FROM fb) x WHERE x.root = r.root) AS danger FROM root r""",
    "graph_path": f"""WITH RECURSIVE {_E}, e AS (SELECT DISTINCT src, dst FROM edge), {_HOPS.format(s=SEED, k=4)},
back(hop, id) AS (SELECT depth, id FROM near WHERE id = 'is_empty_run' UNION ALL SELECT b.hop - 1, (SELECT min(e.src) FROM e JOIN near n ON n.id = e.src WHERE e.dst = b.id AND n.depth = b.hop - 1) FROM back b WHERE b.hop > 0) SELECT hop::INT AS hop, id FROM back""",
    "rescan_vocabulary": r"SELECT tok, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS tok FROM source_files WHERE deleted_at IS NULL) GROUP BY tok",
    "rescan_plan": """SELECT act, count(*) AS files FROM (SELECT CASE WHEN indexed_at < '2024-06-01' AND deleted_at IS NULL THEN 'keep' WHEN indexed_at < '2024-06-01' THEN 'remove' WHEN deleted_at IS NULL THEN 'add' END AS act FROM source_files) WHERE act IS NOT NULL GROUP BY act""",
    "triples_dedup": f"""WITH t AS (SELECT caller AS s, 'calls' AS p, {_SEG} AS o FROM calls WHERE caller IS NOT NULL UNION ALL SELECT file, 'imports', module FROM imports WHERE file IS NOT NULL), u AS (SELECT * FROM t WHERE o IS NOT NULL),
n AS (SELECT s AS name FROM u UNION ALL SELECT o FROM u), m AS (SELECT DISTINCT ON (lower(name)) lower(name) AS k, name FROM n ORDER BY lower(name), length(regexp_replace(name, '[^\\p{{Lu}}]', '', 'g')) DESC, name DESC)
SELECT a.name AS s, p, b.name AS o FROM (SELECT DISTINCT lower(s) AS s, p, lower(o) AS o FROM u) JOIN m a ON a.k = s JOIN m b ON b.k = o""",
    "triples_counts": f"SELECT p, count(*) AS n, count(DISTINCT (s, o)) AS pairs FROM (SELECT caller AS s, 'calls' AS p, {_SEG} AS o FROM calls WHERE caller IS NOT NULL UNION ALL SELECT file, 'imports', module FROM imports WHERE file IS NOT NULL) WHERE o IS NOT NULL GROUP BY p",
    "causal_nexus_words": r"""SELECT symbol, count(DISTINCT lang) AS langs, count(DISTINCT file) AS files, count(*) AS places, string_agg(DISTINCT lang, ',' ORDER BY lang) AS lang_list FROM (SELECT * REPLACE (array_to_string(list_sort(list_filter(string_split(lower(regexp_replace(symbol, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '_'), lambda x: length(x) > 3)), ' ') AS symbol), regexp_extract(file, '\.([a-z]+)$', 1) AS lang FROM (SELECT DISTINCT * FROM defs))
GROUP BY symbol HAVING langs > 1 OR files > 1""",
    "causal_nexus": r"SELECT symbol, count(DISTINCT lang) AS langs, count(DISTINCT file) AS files, count(*) AS places, string_agg(DISTINCT lang, ',' ORDER BY lang) AS lang_list FROM (SELECT DISTINCT *, regexp_extract(file, '\.([a-z]+)$', 1) AS lang FROM defs) GROUP BY symbol HAVING langs > 1 OR files > 1",
}
_PARTS = r"SELECT list_filter(regexp_extract_all(s, '[\p{{L}}\p{{N}}_]+'), lambda x: true) AS t FROM (SELECT unnest(regexp_split_to_array(lower({c}), '[.!?…\n]+')) AS s FROM {f})"
_TRITS = """WITH p AS (SELECT * FROM ({parts}) WHERE len(t) > 0), u AS (SELECT tok, count(*) AS u FROM (SELECT unnest(t) AS tok FROM p) GROUP BY tok), total AS (SELECT sum(u) AS total FROM u),
b AS (SELECT prev, next, count(*) AS n FROM (SELECT unnest(t[:-2]) AS prev, unnest(t[2:]) AS next FROM p WHERE len(t) > 1) GROUP BY ALL),
r AS (SELECT prev, next, n, (n / a.u) / (c.u / total) AS ratio FROM b JOIN u a ON a.tok = prev JOIN u c ON c.tok = next, total), z AS (SELECT prev, next, n, CASE WHEN ratio >= 2 THEN 1 WHEN ratio <= 0.5 THEN -1 ELSE 0 END AS trit FROM r)
"""
SQL["bigram_trits"] = _TRITS.format(parts=_PARTS.format(c="title", f="(SELECT DISTINCT id, title FROM poler_notes WHERE title IS NOT NULL)")) + "SELECT * FROM z"
SQL["bigram_trits_corpus"] = _TRITS.format(parts=_PARTS.format(c="text", f="documents")) + "SELECT trit, count(*) AS pairs, sum(n)::BIGINT AS n FROM z GROUP BY trit"
