"""Functions paired with their documentation, by island grammars.

Each of the four languages has a small grammar of islands: comments, strings, attributes
or decorators, signatures and balanced bodies. All other code is water and skipped; what
looks like an island inside a string or comment is none. Documentation belongs to the
function it stands at:

* Rust: ``///``, ``/** */`` and ``#[doc = "..."]`` before the item; attributes, plain
  comments and blank lines may stand between.
* TypeScript: the last ``/** */`` before the item; decorators and plain comments may
  stand between.
* Go: the comment that ends on the line above, ``//go:`` directives aside.
* Python: the string that is the first statement of the body (not bytes, not formatted).

Documentation is trivial if nothing is left of it but rules and marks, placeholders for
text still to be written, or words of the function's own name and articles.

Defined results for odd input: a null or empty text has no functions; unknown languages go
by the path's ending, and without a known one give no row; unbalanced bodies reach to the
end of the text; LF, CR LF and CR end lines. A row of ``defs`` meets the function at its
``byte``; failing that, the one at its ``line`` if the name agrees; failing that, the only
one of its name left in the file, several being taken in order. Double rows count once,
rows without symbol or file and rows that meet no function give no pair.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orewright.operators.codelib import Source, islands, language_of, line_start
from orewright.session import materialize

#: Kinds of definitions that are functions or methods. Fixed values.
FUNCTION_KINDS = ("fn", "function", "method", "def", "func")

def _clean(raw: str) -> str:
    """The words of a documentation comment without its markers."""
    if raw.startswith("/*"):
        raw = re.sub(r"^/\*+|\*+/$", "", raw)
        lines = [re.sub(r"^\s*\*+ ?", "", x) for x in re.split(r"\r\n|\r|\n", raw)]
    else:
        lines = [re.sub(r"^\s*//+!? ?", "", x) for x in re.split(r"\r\n|\r|\n", raw)]
    return "\n".join(x.strip() for x in lines).strip()


def _before(text: str, start: int, lang: str, found: list[tuple[str, int, int]], begins: list[int]) -> tuple[str, int]:
    """The documentation that stands before the item at `start`, and where it begins. `found` are the islands in order."""
    docs: list[str] = []
    cur = first = start
    k = bisect_left(begins, start) - 1
    while k >= 0:
        kind, s, e = found[k]
        gap = text[e:cur]
        if gap and not gap.isspace():
            break
        k -= 1
        raw = text[s:e].rstrip()
        if lang == "go":
            if kind not in ("line", "block") or len(_line_end.findall(gap)) > 1:
                break
            if text[line_start(text, s) : s].strip():
                break
            if kind == "block" and docs:
                break
            if not _directive.match(raw) or raw.startswith("// "):
                docs.append(_clean(raw))
                first = s
            cur = s
            if kind == "block":
                break
            continue
        if kind == "str":
            break
        if lang == "rust":
            if kind == "line" and raw.startswith("///") and not raw.startswith("////"):
                docs.append(_clean(raw))
                first = s
            elif kind == "block" and raw.startswith("/**") and not raw.startswith("/***") and raw != "/**/":
                docs.append(_clean(raw))
                first = s
            elif kind == "attr" and (m := _doc_attribute.match(raw)):
                docs.append(m.group(2) if m.group(2) is not None else _escape.sub(lambda x: {"n": "\n", "t": "\t"}.get(x.group(1), x.group(1)), m.group(3)))
                first = s
            elif raw.startswith(("//!", "/*!", "#![")):
                break
        elif kind == "block" and raw.startswith("/**") and raw != "/**/":
            docs.append(_clean(raw))
            first = s
            break
        cur = s
    return "\n".join(reversed(docs)).strip(), first


_line_end, _escape = re.compile(r"\r\n|\r|\n"), re.compile(r"\\(.)")
_directive = re.compile(r"//(go|lint|nolint|line|export):?\S")
_doc_attribute = re.compile(r'#\[\s*doc\s*=\s*(?:r(#*)"(.*)"\1|"(.*)")\s*\]$', re.S)


def functions(text: str, lang: str) -> Iterator[tuple[str, int, int, str, int]]:
    """(name, start of the name's line, end, documentation, begin) of each function, in order."""
    source = Source(text, lang)
    begins = [s for _, s, _ in source.islands]
    for f in source.functions():
        line = line_start(text, f.at)
        if lang == "python":
            yield f.name, line, f.end, _first_string(text, source.islands, begins, f.inside), line
        else:
            doc, begin = _before(text, f.start, lang, source.islands, begins)
            yield f.name, line, f.end, doc, begin


_gap, _statement_end = re.compile(r"\s*"), re.compile(r"[ \t]*(?:[\r\n;#]|\Z)")


def _first_string(text: str, found: list[tuple[str, int, int]], begins: list[int], inside: int) -> str:
    """The string that is the first statement behind a signature, comments left aside."""
    p, k = inside, bisect_left(begins, inside)
    while k < len(found):
        p = _gap.match(text, p).end()
        kind, s, e = found[k]
        if s != p or kind not in ("line", "str"):
            break
        if kind == "str":
            return _docstring(text[s:e]) if _statement_end.match(text, e) else ""
        p, k = e, k + 1
    return ""


def _docstring(raw: str) -> str:
    prefix = re.match(r"[A-Za-z]*", raw).group().lower()
    if "b" in prefix or "f" in prefix:
        return ""
    body = raw[len(prefix) :]
    q = 3 if body[:3] in ('"""', "'''") else 1
    body = body[q:-q]
    if "r" not in prefix:
        body = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "\n": ""}.get(m.group(1), m.group(1)), body, flags=re.S)
    return "\n".join(x.strip() for x in re.split(r"\r\n|\r|\n", body)).strip()


#: What stands where documentation is still to be written, marks of work to do, words of writing, and articles. Fixed values.
PLACEHOLDER = re.compile(
    r"(?:stub|placeholder|n/?a|none|undocumented|no doc(?:s|umentation)?|missing doc(?:s|umentation)?|doc(?:s|umentation)?(?: (?:is )?(?:here|missing|pending|needed|to come|to be (?:written|done|added)))?|description(?: here)?|(?:add|write|insert) (?:a )?(?:docs?|documentation|descriptions?|text|me|something)(?: here| later| me)?|document(?: me| this)?|to be (?:written|documented|done|added)|coming soon|lorem ipsum|summary|\?+"
    r"|(?:no|missing|without) (?:description|comments?|text)(?: yet| available)?|(?:description|comments?|text) (?:later|follows|pending|missing|to follow|tbd)|to follow|later"
    r"|(?:нет|без) (?:описания|документации|комментария)|(?:описание|документация|текст) (?:позже|потом|будет позже|отсутствует|следует)|дописать|описать|заглушка|позже"
    r"|(?:немає|без) (?:опису|документації|коментаря)|(?:опис|документація|текст) (?:пізніше|згодом|буде пізніше|відсутній|відсутня)|дописати|описати|заглушка|пізніше"
    r"|keine (?:beschreibung|dokumentation)|ohne (?:beschreibung|dokumentation)|(?:beschreibung|dokumentation|text) (?:folgt|fehlt|später|kommt noch|kommt später)|folgt(?: noch| später)?|später"
    r"|sin (?:descripción|documentación|documentar)|(?:descripción|documentación|texto) (?:pendiente|más tarde|luego|después)|pendiente|por (?:documentar|escribir|hacer)|más tarde"
    r")(?![\w-])", re.I)
TASK = re.compile(r"(?:to-?do|fix-?me|xxx+|tb[dcaw]|wip|hack)(?![\w-])\s*(?:\([^()]*\))?[\s:.,!…–—-]*", re.I)
WRITING = re.compile(
    r"(?:(?:please |must |should )?(?:write|add|insert|fill(?: in)?|provide|update|improve|expand|finish|complete) (?:up )?(?:the |a |an |some |proper |better |more |missing )*(?:docs?|docstring|documentation|descriptions?|comments?|text|summary|explanation|me|this|it|something)"
    r"|(?:please |must |should )?(?:document|describe|explain|comment)(?: (?:it|me|this|that|here|later|function|method|the (?:function|method|behaviou?r|parameters?|arguments?|result)))*"
    r"|docs?|documentation|docstring|descriptions?|comments?|text|summary"
    r"|(?:до)?(?:писать|описать|документировать|задокументировать)(?: (?:это|функцию|метод|описание|документацию|текст|комментарий))?|(?:добавить|заполнить) (?:описание|документацию|комментарий|текст)|описание|документация"
    r"|(?:до)?(?:писати|описати|документувати|задокументувати)(?: (?:це|функцію|метод|опис|документацію|текст|коментар))?|(?:додати|заповнити) (?:опис|документацію|коментар|текст)|опис|документація"
    r"|(?:dokumentieren|beschreiben|erklären)|(?:beschreibung|dokumentation|text|kommentar)(?: (?:schreiben|ergänzen|einfügen|hinzufügen))?"
    r"|(?:documentar|describir|explicar)(?: (?:esto|la función|el método))?|(?:escribir|añadir|agregar) (?:la |una |el )?(?:descripción|documentación|texto|comentario)|descripción|documentación"
    r")[\s.!…:;)\]*_-]*", re.I)
ARTICLES = {"the", "a", "an", "der", "die", "das", "ein", "eine", "el", "la", "los", "las", "un", "una"}
_word = re.compile(r"[^\W\d_]+|\d+")


def name_words(name: str) -> set[str]:
    parts = re.sub(r"([a-z0-9])([A-Z])|([A-Z])(?=[A-Z][a-z])", r"\1\3 \2", name)
    return {w.lower() for w in _word.findall(parts)} | {w.lower() for w in re.split(r"_+", name) if w} | {name.lower()}


def _unwritten(line: str) -> bool:
    """Whether a line only holds the place of text still to be written. A mark of work to do with
    a task of its own (``TODO: cover by a test``) says something and is none."""
    if task := TASK.match(line):
        rest = line[task.end() :].strip()
        return not _word.search(rest) or bool(WRITING.fullmatch(rest)) or _unwritten(rest)
    m = PLACEHOLDER.match(line)
    return bool(m) and m.end() == len(line.rstrip(" .!…:;)]*-_"))


def telling(doc: str, name: str) -> bool:
    """Whether documentation says anything."""
    rest = []
    for line in re.split(r"[\r\n]+", doc):
        bare = _marks.sub("", line)
        if _word.search(bare) and not _unwritten(bare):
            rest.append(bare)
    words = [w.lower() for w in re.findall(r"[^\W_]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", " ".join(rest)))]
    own = name_words(name)
    return any(w not in own and w not in ARTICLES for w in words)


_marks = re.compile(r"^[\W_]+")
_FOUND = "path string, symbol string, line int, byte bigint, nth int, doc string, code string, told boolean"


#: Rows that an extractor gathers before it sends them on.
ROWS_OUT = 2_000


def _extractor(with_code: bool):
    names = ["path", "symbol", "line", "byte", "nth", "doc", "code", "told"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for path, lang, text in zip(pdf["path"], pdf["lang"], pdf["text"], strict=True):
                kind = language_of(lang, path)
                if not kind or not text:
                    continue
                seen: dict[str, int] = {}
                last, nbyte, nline = 0, 0, 1
                for name, line, end, doc, begin in functions(text, kind):
                    nbyte += len(text[last:line].encode("utf-8", "surrogatepass"))
                    nline += len(_line_end.findall(text, last, line))
                    last = line
                    seen[name] = seen.get(name, 0) + 1
                    rows.append((path, name, nline, nbyte, seen[name], doc if with_code else None, text[begin:end] if with_code else None, telling(doc, name)))
                if len(rows) >= ROWS_OUT:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return run


def extract(files: DataFrame, with_code: bool = True) -> DataFrame:
    """Every function of `files` (path, lang, text) with its documentation and code."""
    return files.select("path", "lang", "text").where("path is not null and text is not null").mapInPandas(_extractor(with_code), _FOUND)


def pair(defs: DataFrame, found: DataFrame) -> DataFrame:
    """(def_id, path, symbol, nth, told): the rows of `defs` that meet a function of `found`.

    Both sides come together once, by path and symbol; a row carries the places of the
    functions of its name in its file, and the windows keep that partitioning.
    """
    d = defs.select("def_id", "symbol", F.col("file").alias("path"), F.col("line").alias("d_line"), F.col("byte").alias("d_byte")).where("symbol is not null and path is not null")
    d = d.repartition("path", "symbol").distinct()
    at = found.groupBy("path", "symbol").agg(F.sort_array(F.collect_list(F.struct("nth", "line", "byte", "told"))).alias("places"))
    j = d.join(at, ["path", "symbol"])
    byte = F.filter("places", lambda p: p["byte"] == F.col("d_byte"))
    line = F.filter("places", lambda p: p["line"] == F.col("d_line"))
    j = j.withColumn("sure", F.when(F.size(byte) > 0, byte[0]["nth"]).when(F.size(line) > 0, line[0]["nth"]))
    # the others in their order to the functions of that name which nobody has claimed
    own = Window.partitionBy("path", "symbol")
    turn = F.row_number().over(Window.partitionBy("path", "symbol", F.col("sure").isNull()).orderBy("def_id", "d_line", "d_byte"))
    j = j.withColumn("claimed", F.collect_set("sure").over(own)).withColumn("turn", turn)
    free = F.filter(F.transform("places", lambda p: p["nth"]), lambda n: ~F.array_contains("claimed", n))
    j = j.withColumn("nth", F.coalesce("sure", F.when(F.col("turn") <= F.size(free), F.get(free, F.col("turn") - 1)))).where("nth is not null")
    return j.select("def_id", "path", "symbol", "nth", F.filter("places", lambda p: p["nth"] == F.col("nth"))[0]["told"].alias("told"))


def documented(defs: DataFrame, files: DataFrame) -> DataFrame:
    """(def_id, symbol, path, line, doc, code) of the functions whose documentation tells something."""
    found = materialize(extract(files), "functions")
    told = pair(_functions(defs), found).where("told").drop("told")
    return told.join(found, ["path", "symbol", "nth"]).select("def_id", "symbol", "path", "line", "doc", "code")


def documented_ids(defs: DataFrame, files: DataFrame) -> DataFrame:
    """(def_id) of the functions whose documentation tells something."""
    return pair(_functions(defs), extract(files, with_code=False)).where("told").select("def_id").distinct()


def _functions(defs: DataFrame) -> DataFrame:
    return defs.where(F.lower("kind").isin(*FUNCTION_KINDS))


__all__ = ["documented", "documented_ids", "extract", "functions", "islands", "pair", "telling"]
