"""Queries of stems, masking, dynamics, chemistry, shapes and content-defined chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from orewright.functions import chem as CH
from orewright.operators import dynamics as D
from orewright.operators import language as L
from orewright.operators import resonance as R
from orewright.operators import text as T
from orewright.plans.textual import PHRASE
from orewright.session import table, texts


def _docs(s, d):
    return texts(s, d, "documents")


def _dens(s, d):
    return R.density_at_hits(_docs(s, d), PHRASE).select("doc_id", "pos", (F.col("density") / 1000).alias("x"))


def _fold(rule, barred=False):
    def run(s, d):
        out = D.fold(_dens(s, d), "doc_id", ["pos"], "x", "y", lambda o, no: rule(o, no), F.col("pos") % 5 == 0 if barred else None)
        return out.select("doc_id", "pos", F.round("y", 6).alias("y"))

    return run


def _formulas(s, d):
    """Formulas made of the part numbers."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("C"), (k % 9 + 2).cast("string"), F.lit("H"), (k % 13 + 3).cast("string"), F.lit("(OH)"), (k % 3 + 2).cast("string"), F.lit("N"), (k % 4 + 2).cast("string"))
    return table(s, d, "part").select("p_partkey", text.alias("f"))


def _smiles(s, d):
    k = F.col("p_partkey")
    text = F.concat(F.repeat(F.lit("C"), (k % 6 + 1).cast("int")), F.lit("(=O)N"), F.when(k % 2 == 0, "c1ccccc1").otherwise("C1CCCCC1"), F.when(k % 3 == 0, "O").otherwise("[N+](=O)[O-]"))
    return table(s, d, "part").select("p_partkey", text.alias("smiles"))


def _squares(s, d):
    """Pairs of squares on a small lattice from the part numbers."""
    k = F.col("p_partkey")
    return table(s, d, "part").select("p_partkey", *[v.cast("int").alias(n) for n, v in (("ax", k % 7), ("ay", k % 5), ("an", k % 4 + 1), ("bx", k % 6), ("by", k % 8), ("bn", k % 3 + 1))])


def _relation(s, d):
    def run(batches):
        import pandas as pd

        from orewright.functions.spatial import Polygon, holds, relate

        square = lambda x, y, n: Polygon([(x, y), (x + n, y), (x + n, y + n), (x, y + n)])
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                code = relate(square(r.ax, r.ay, r.an), square(r.bx, r.by, r.bn))
                rows.append((r.p_partkey, holds(code, "intersects"), holds(code, "contains"), holds(code, "within"), holds(code, "touches"), holds(code, "overlaps"), holds(code, "equals"), holds(code, "disjoint")))
            yield pd.DataFrame(rows, columns=["p_partkey", "intersects", "contains", "within", "touches", "overlaps", "equal", "disjoint"])

    return _squares(s, d).mapInPandas(run, "p_partkey bigint, intersects boolean, contains boolean, within boolean, touches boolean, overlaps boolean, equal boolean, disjoint boolean")


def _addresses(s, d):
    def run(batches):
        import pandas as pd

        from orewright.functions.spatial import address_cell, world_address

        for pdf in batches:
            rows = []
            for k in pdf["p_partkey"].tolist():
                a = world_address(k % 20, k % 9 - 4, k % 7 - 3, k % 3)
                f, q, r, res = address_cell(a)
                rows.append((k, a, f, q, r, res))
            yield pd.DataFrame(rows, columns=["p_partkey", "address", "face", "q", "r", "res"])

    return table(s, d, "part").select("p_partkey").mapInPandas(run, "p_partkey bigint, address string, face int, q int, r int, res int")


QUERIES = {
    "text_stems": lambda s, d: L.stemmed_vocabulary(T.vocabulary(_docs(s, d))),
    "text_mask_all": lambda s, d: _docs(s, d).where("text is not null").select("doc_id", F.md5(L.mask_column(F.concat("text", F.lit(" call +1 (555) 010-99-88 or a@b.example, card 4111111111111111111")))).alias("h")),
    "query_intent": lambda s, d: texts(s, d, "poler_chat").select("id", "question").distinct().select("id", L.intent_column("question").alias("intent")),
    "text_quote": lambda s, d: _docs(s, d).where("text is not null").select("doc_id", L.quote_window(F.col("text"), "the pending anchors", 90).alias("quote")),
    "text_pieces": lambda s, d: L.corpus_pieces(_docs(s, d), "doc_id", "text").select("doc_id", "paragraph", "part", F.md5("piece").alias("h")),
    "script_affinity": lambda s, d: _docs(s, d).where("length(text) > 40").select("doc_id", L.script_of(F.substring("text", 30, 1)).alias("a"), L.script_of(F.substring("text", 40, 1)).alias("b")).select("doc_id", "a", "b", L.affinity(F.col("a"), F.col("b")).alias("affinity")),
    "resonance_psi": _fold(lambda o, no: D.psi(o, no)),
    "resonance_psi_barred": _fold(lambda o, no: D.psi(o, no), True),
    "resonance_cycle": _fold(lambda o, no: D.cycle(o, no)),
    "resonance_echo": _fold(lambda o, no: D.echo(o)),
    "chem_masses": lambda s, d: _formulas(s, d).select("p_partkey", F.round(CH.mass_column("f"), 3).alias("mass"), CH.hill_column("f").alias("hill")),
    "chem_descriptors": lambda s, d: _smiles(s, d).select("p_partkey", CH.descriptors_column("smiles").alias("x")).select("p_partkey", "x.atoms", F.round("x.mass", 3).alias("mass"), "x.rings", "x.donors", "x.acceptors", "x.rotatable", "x.charge", "x.five"),
    "shape_relations": _relation,
    "cell_addresses": _addresses,
    "content_chunks": lambda s, d: D.content_chunks(texts(s, d, "source_files"), "path", "text", 1024, 4096, 16384),
    "content_stored": lambda s, d: D.stored(D.content_chunks(texts(s, d, "source_files"), "path", "text", 1024, 4096, 16384)),
}

_DOC = "(SELECT * FROM documents WHERE text IS NOT NULL)"
SQL = {
    "text_quote": f"SELECT doc_id, substring(text, greatest(CASE WHEN contains(lower(text), 'pending') THEN instr(lower(text), 'pending') - 1 WHEN contains(lower(text), 'anchors') THEN instr(lower(text), 'anchors') - 1 ELSE 0 END - 30, 0) + 1, 90) AS quote FROM {_DOC}",
    "text_pieces": rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 40) AS l FROM {_DOC}),
q AS (SELECT doc_id, unnest(range(len(l))) AS paragraph, unnest(l) AS p FROM p), r AS (SELECT doc_id, paragraph, p, unnest(range(CASE WHEN length(p) > 380 THEN (length(p) - 1) // 340 + 1 ELSE 1 END)) AS part FROM q)
SELECT doc_id, paragraph::INT AS paragraph, part::INT AS part, md5(CASE WHEN length(p) > 380 THEN substring(p, (part * 340 + 1)::BIGINT, 340) ELSE p END) AS h FROM r""",
    "chem_masses": """WITH f AS (SELECT p_partkey, p_partkey % 9 + 2 AS c, p_partkey % 13 + 3 AS h, p_partkey % 3 + 2 AS o, p_partkey % 4 + 2 AS n FROM part)
SELECT p_partkey, round(12.011 * c + 1.008 * (h + o) + 15.999 * o + 14.007 * n, 3)::DOUBLE AS mass, 'C' || c || 'H' || (h + o) || 'N' || n || 'O' || o AS hill FROM f""",
    "shape_relations": """WITH q AS (SELECT p_partkey, p_partkey % 7 AS ax, p_partkey % 5 AS ay, p_partkey % 4 + 1 AS an, p_partkey % 6 AS bx, p_partkey % 8 AS b_y, p_partkey % 3 + 1 AS bn FROM part),
o AS (SELECT *, least(ax + an, bx + bn) - greatest(ax, bx) AS w, least(ay + an, b_y + bn) - greatest(ay, b_y) AS h, ax <= bx AND bx + bn <= ax + an AND ay <= b_y AND b_y + bn <= ay + an AS c, bx <= ax AND ax + an <= bx + bn AND b_y <= ay AND ay + an <= b_y + bn AS i FROM q)
SELECT p_partkey, w >= 0 AND h >= 0 AS intersects, c AS contains, i AS within, w >= 0 AND h >= 0 AND (w = 0 OR h = 0) AS touches, w > 0 AND h > 0 AND NOT c AND NOT i AS overlaps, c AND i AS equal, w < 0 OR h < 0 AS disjoint FROM o""",
}
