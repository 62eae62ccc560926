"""Retrieval chunks, sections, paragraphs, scenes and code structure."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orewright.operators import text as T
from orewright.session import cores

TARGET, OVERLAP, LEAST = 384, 48, 32
WORD, LINE, SENTENCE, PARAGRAPH, SECTION = range(5)
_term = re.compile(r"[^\W_]\w*|_+\w*")
_head = re.compile(r"[ \t]*(#{1,6})(?:[ \t]+(.*?))?[ \t#]*$")
_end = re.compile(r"[.!?。！？…]+[\"'»«)\]”’]*\s+(?=\S)")


def _size(text: str) -> int:
    return sum(2 <= len(t) <= 32 for t in _term.findall(text))


def sections(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, headings above) of the parts that headings begin."""
    out, crumbs, start, at = [], [], 0, 0
    for line in text.splitlines(keepends=True) if "\r" not in text else re.findall(r"[^\n]*\n|[^\n]+$", text):
        m = _head.match(line.rstrip("\r\n"))
        if m:
            if at > start:
                out.append((start, at, list(crumbs)))
            level = len(m.group(1))
            crumbs = [*crumbs[: level - 1], (m.group(2) or "").strip() or f"H{level}"]
            start = at
        at += len(line)
    if at > start:
        out.append((start, at, list(crumbs)))
    return out


def paragraphs(text: str, lo: int, hi: int) -> list[tuple[int, int, bool]]:
    """(start, end, fenced) of the paragraphs of a part; empty lines within a code fence don't part."""
    out, start, end, fenced, inside, at = [], None, lo, False, False, lo
    for line in re.findall(r"[^\n]*\n|[^\n]+$", text[lo:hi]):
        bare = line.strip()
        mark = bare.startswith(("```", "~~~"))
        if not bare and not inside:
            if start is not None:
                out.append((start, end, fenced))
            start = None
        else:
            if start is None:
                start, fenced = at, False
            if mark:
                inside = not inside
            fenced = fenced or inside
            end = at + len(line)
        at += len(line)
    if start is not None:
        out.append((start, end, fenced))
    return out


def chunk(text: str, markdown: bool = True, code: bool = False, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int, list[str], int]]:
    """(start, end, headings, tokens) of the chunks: each ends at the best boundary (section,
    paragraph, sentence, line, word) within the target, the next begins up to `overlap`
    tokens earlier; small tails join the piece before, small pieces the one behind."""
    overlap, least = min(overlap, target // 4), min(least, target // 2)
    parts = sections(text) if markdown else [(0, len(text), [])]
    out: list[tuple[int, int, list[str], int]] = []
    for lo, hi, crumbs in parts:
        level: dict[int, int] = {}
        for s, e, fenced in paragraphs(text, lo, hi):
            for p in (s, e):
                if lo < p < hi:
                    level[p] = PARAGRAPH
            if code or fenced:
                for m in re.finditer("\n", text[s:e]):
                    if s + m.end() < e:
                        level.setdefault(s + m.end(), LINE)
            else:
                for m in _end.finditer(text, s, e):
                    if m.end() < e:
                        level.setdefault(m.end(), SENTENCE)
                for m in _term.finditer(text, s, e):
                    if m.start() > s:
                        level.setdefault(m.start(), WORD)
        at = [lo, *sorted(level), hi]
        rank = [SECTION, *(level[p] for p in at[1:-1]), SECTION]
        before = [0, *accumulate(_size(text[a:b]) for a, b in zip(at, at[1:], strict=False))]
        cuts, i = [], 0
        while i + 1 < len(at):
            last = bisect.bisect_right(before, before[i] + target, i + 1) - 1
            end = max(range(i + 1, last + 1), key=lambda j: (rank[j], j)) if last > i else i + 1
            if end >= len(at) - 1:
                cuts.append((i, len(at) - 1))
                break
            cuts.append((i, end))
            back = [k for k in range(end - 1, i, -1) if before[end] - before[k] <= overlap] if overlap else []
            i = max(back, key=lambda k: (rank[k], k)) if back else end
        if len(cuts) > 1 and before[-1] - before[cuts[-1][0]] < least:
            cuts.pop()
            cuts[-1] = (cuts[-1][0], len(at) - 1)
        out += [(at[a], at[b], crumbs, _size(text[at[a] : at[b]])) for a, b in cuts if at[b] > at[a]]
    merged: list[tuple[int, int, list[str], int]] = []
    for s, e, crumbs, n in out:
        if not n and not text[s:e].strip():
            continue
        if merged and merged[-1][3] < least and merged[-1][2] == crumbs:
            a = merged.pop()[0]
            s, e = min(a, s), e
            n = _size(text[s:e])
        merged.append((s, e, crumbs, n))
    return merged


_CHUNKS = "idx int, byte_start int, byte_end int, line_start int, line_end int, breadcrumb array<string>, tokens int, chunk string"


def chunks(docs: DataFrame, key: str, text: str, markdown: bool = True, code: bool = False, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(key, idx, byte_start, byte_end, line_start, line_end, breadcrumb, tokens, chunk) of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["key"], pdf["text"], strict=True):
                for i, (s, e, crumbs, n) in enumerate(chunk(t, markdown, code, target, overlap, least)):
                    b = len(t[:s].encode("utf-8", "replace"))
                    rows.append((k, i, b, b + len(t[s:e].encode("utf-8", "replace")), t.count("\n", 0, s) + 1, t.count("\n", 0, max(s, e - 1)) + 1, crumbs, n, t[s:e]))
            yield pd.DataFrame(rows, columns=["key", "idx", "byte_start", "byte_end", "line_start", "line_end", "breadcrumb", "tokens", "chunk"])

    kind = dict(docs.dtypes)[key]
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    return d.mapInPandas(run, f"key {kind}, {_CHUNKS}").withColumnRenamed("key", key)


def fixed_chunks(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, idx, n): pieces of a fixed number of characters."""
    d = docs.select(key, text).where(F.length(text) > 0)
    at = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))
    return d.select(key, text, F.explode(at).alias("idx")).select(key, "idx", F.substring(text, F.col("idx") * size + 1, F.lit(size)).alias("piece"))


def section_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, line_no, heading): each heading opens a section; lines before the first have 0."""
    ln = T.lines(docs.select(key, text), key, text)
    ln = ln.withColumn("head", F.when(F.rlike("line", F.lit(r"^[ \t]*#{1,6}[ \t]")), F.trim(F.regexp_replace("line", r"^[ \t]*#{1,6}[ \t]+|\r$", ""))))
    w = Window.partitionBy(key).orderBy("line_no")
    return ln.select(key, F.count("head").over(w).alias("section"), "line_no", F.last("head", True).over(w).alias("heading"))


def sections_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    s = section_lines(docs, key, text)
    return s.groupBy(key, "section").agg(F.min("line_no").alias("first_line"), F.count("*").alias("lines"), F.max("heading").alias("heading"))


def paragraph_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, no, n): paragraphs parted by empty lines, with their length."""
    d = docs.select(key, text).where(F.col(text).isNotNull())
    parts = F.filter(F.split(F.col(text), r"\n\s*\n"), lambda p: F.trim(p) != "")
    return d.select(key, F.posexplode(parts).alias("no", "p")).select(key, "no", F.length("p").alias("n"))


def sentence_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[.!?…]+(?:\s|$)"), F.lit(0)))


#: Lines from its heading on in which a scene has its card.
CARD_LINES = 60
SUBJECTS = "Subjects|Субъекты|Суб'єкти|Subjekte|Sujetos"


def scene_heads(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, part, scene, chapter, head): the first lines of each scene, numbered within its part.

    Every heading opens a scene that ends at the next one; text before the first heading is a scene
    too, and so is a text without headings. Level-1 headings open parts and give the chapter; before the first
    of them it is the first heading of the text.
    """
    title = r"[ \t]+(\S.*?)[ \t]*$"
    d = docs.where(F.col(text).isNotNull()).select(key, F.nullif(F.regexp_extract(text, rf"(?m)^#{{1,6}}{title}", 1), F.lit("")).alias("top"), F.posexplode(F.split(text, r"\n(?=#[ \t]+\S)")).alias("part", "body"))
    d = d.select(key, "part", F.coalesce(F.nullif(F.regexp_extract("body", rf"(?m)\A#{title}", 1), F.lit("")), "top").alias("chapter"), "top", F.posexplode(F.split("body", r"\n(?=#{1,6}[ \t]+\S)")).alias("scene", "body"))
    lead = (F.col("part") == 0) & (F.col("scene") == 0) & F.col("top").isNotNull() & ~F.rlike("body", F.lit(r"\S"))
    return d.where(~lead).select(key, "part", "scene", "chapter", F.substring_index("body", "\n", CARD_LINES).alias("head"))


#: Blanks that are trimmed off the values of cards: spaces of every width, no tabs or line ends.
_SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def _trimmed(value: Column) -> Column:
    return F.btrim(value, F.lit(_SPACES))


def card_field(head: str, names: str) -> Column:
    """The value after one of the names, in any case, in the head of a scene. Only line feeds end lines."""
    plain = names.replace("i", "(?-i:[iI])")  # the i of Turkish is another letter
    s = r"[\t\n\f\r ]*"
    return F.nullif(_trimmed(F.regexp_extract(head, rf"(?imud)^\*{{0,2}}(?:{plain}){s}:{s}([^*\n]+)\*{{0,2}}{s}$", 1)), F.lit(""))


def card_subjects(head: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(card_field(head, SUBJECTS), F.lit("")), ","), _trimmed), lambda x: x != "")


def _cards(heads: DataFrame, key: str) -> DataFrame:
    return heads.select(
        key,
        "chapter",
        card_field("head", "Metric|Метрика|Metrik|Métrica").alias("metric"),
        card_field("head", "Location|Локация|Локація|Ort|Lugar").alias("location"),
        F.size(card_subjects("head")).alias("subjects"),
    )


def scene_cards(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chapter, metric, location, subjects) from the head of each scene."""
    return _cards(scene_heads(docs, key, text), key)


def document_cards(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chapter, metric, location, subjects) of each text as a whole: the first heading and the first card in
    its first lines, one row a text. The cards of its later scenes are in :func:`scene_cards`."""
    d = docs.where(F.col(text).isNotNull()).select(key, F.substring_index(text, "\n", CARD_LINES).alias("head"))
    return _cards(d.withColumn("chapter", F.nullif(_trimmed(F.regexp_extract("head", r"(?md)^#{1,6}[ \t]+(.+?)[ \t]*$", 1)), F.lit(""))), key)


def call_lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, callee): names followed by an opening bracket, keywords left out."""
    ln = T.lines(files.select(key, text), key, text)
    named = F.regexp_extract_all("line", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), F.lit(1))
    words = "if for while match return fn def func function switch catch".split()
    return ln.select(key, "line_no", F.explode(F.filter(named, lambda n: ~n.isin(words))).alias("callee"))


def import_lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, module) of import statements of the four languages."""
    ln = T.lines(files.select(key, text), key, text)
    line = F.regexp_replace("line", r"\r$", "")
    mod = F.coalesce(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in (r"^use ([\w:]+);", r"^import ([\w.]+)$", r'^import \{[^}]*\} from "([^"]+)";', r'^import "([^"]+)"$')])
    return ln.select(key, mod.alias("module")).where("module is not null")


def triage(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, unsafe, todo, unwrap, panic): markers that call for a look, by their number."""
    return files.where(F.col(text).isNotNull()).select(key, *[T.occurrences(F.col(text), m).alias(n) for n, m in (("unsafe", "unsafe"), ("todo", "TODO"), ("unwrap", "unwrap("), ("fixme", "FIXME"))])


#: Bytes from which a text counts as a giant, and of its parts.
GIANT, PART = 8 << 20, 2 << 20


def _parts_of(text: str, size: int) -> Iterator[str]:
    """Stretches of about `size` characters that end behind an empty line, or a line feed, or where they must."""
    at = 0
    while len(text) - at > size:
        end = text.rfind("\n\n", at + 1, at + size - 1)
        end = end + 2 if end >= 0 else text.rfind("\n", at + 1, at + size) + 1 or at + size
        yield text[at:end]
        at = end
    yield text[at:]


def split_giants(docs: DataFrame, key: str, text: str, giant: int = GIANT, part: int = PART) -> DataFrame:
    """(key, part_no, part): texts of `giant` characters or more in parts of at most `part`, dealt to all cores so that
    no task holds a giant; others as one part. The parts of a text make the text again. Null texts give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, t in zip(pdf["k"], pdf["t"], strict=True):
                parts = list(_parts_of(t, part)) if len(t) >= giant else [t]
                yield pd.DataFrame({"k": [k] * len(parts), "part_no": range(len(parts)), "part": parts})

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null")
    small = rows.where(F.length("t") < giant).select("k", F.lit(0).alias("part_no"), F.col("t").alias("part"))
    large = rows.where(F.length("t") >= giant).mapInPandas(run, f"k {kind}, part_no int, part string").repartition(cores(docs.sparkSession))
    return small.unionByName(large).withColumnRenamed("k", key)
