"""Several values packed in one field: dialects chosen by minimum description length.

A dialect is any set of the separators that occur in a field, and a quoting. Every distinct
field is parsed under each dialect its characters allow; equal parses count as one. A parse costs the bits of its
dialect plus, for each value, the cheaper of the value's code (``-log2`` of its share in
the values of the whole table) and its spelling, where a separator or quote left inside
a bare value is dear. Code lengths come from all fields: first every parse counts with
an equal part of its field, then the cheapest parses alone count (`rounds` times).

Defined results for odd input: null, blank and value-less fields give no row; a repeated
value is kept at each of its places; places count from 1 over the values that aren't
empty; of equally cheap parses the first in the order of :func:`parses` is taken; double
rows of the table give their values once; other columns are ignored. A very long field is
parsed whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orewright.session import cores, materialize

#: Separators by name: the pattern that ends a value. Fixed values.
SEPARATORS = {
    "comma": ",",
    "semicolon": ";",
    "bar": r"\|",
    "tab": r"\t",
    "line": r"\r\n|\r|\n",
    "ideographic": "[、，；]",
    "bullet": "[•‣]",
    "dot": r"\s·\s",
    "slash": r"\s/\s",
    "dash": r"\s[-–—]\s",
    "hash": r"\s+(?=#)",
}
#: Quotings: opening and closing mark. Fixed values.
QUOTES = ('""', "''", "“”", "«»", "„“", "‘’", "``")
BRACKETS = {"[": "]", "(": ")", "{": "}"}
#: Bits of a character of a bare value, and of one that looks like structure.
CHAR_BITS, MARK_BITS, NEW_BITS = 5.0, 24.0, 10.0
MARKS = r"[,;|\t\r\n、，；•‣\"“”«»„‘`\[\]{}]|\s[·/–—-]\s|\s#|^'|'$"

_found = {k: re.compile(v) for k, v in SEPARATORS.items()}
_marks = re.compile(MARKS)


def _inside(field: str) -> str:
    """The field without the brackets that enclose all of it."""
    s = field.strip()
    while len(s) > 1 and BRACKETS.get(s[0]) == s[-1]:
        depth, quoted = 0, False
        for i, c in enumerate(s):
            if c == '"' and s[i - 1] != "\\":
                quoted = not quoted
            elif not quoted:
                depth += (c == s[0]) - (c == BRACKETS[s[0]])
                if depth == 0 and i < len(s) - 1:
                    return s
        s = s[1:-1].strip()
    return s


def _plain(raw: str, mark: str) -> str:
    """The text of a quoted value without the escapes of its quoting."""
    if "\\" in raw:
        try:
            return json.loads('"' + raw.replace('""', '\\"') + '"') if mark == '"' else re.sub(r"\\(.)", r"\1", raw)
        except ValueError:
            return re.sub(r"\\(.)", r"\1", raw)
    return raw.replace(mark * 2, mark)


def parse(body: str, seps: tuple[str, ...], quote: str) -> list[tuple[str, bool]]:
    """The values of `body` under one dialect, and whether each stood in quotes."""
    sep = re.compile("|".join(SEPARATORS[s] for s in seps)) if seps else None
    end = re.compile(r"\s*(?:$|" + "|".join(SEPARATORS[s] for s in seps) + ")") if seps else re.compile(r"\s*$")
    out, i, n = [], 0, len(body)
    while i <= n:
        start = i
        while start < n and (body[start].isspace() or body[start] == "#") and not (sep and body[start] in "\t\r\n" and sep.match(body, start)):
            start += 1
        value = None
        if quote and start < n and body[start] == quote[0]:
            k = start + 1
            while k < n:
                if body[k] == "\\" and quote[0] in "\"'":
                    k += 2
                elif body[k] != quote[1]:
                    k += 1
                elif quote[0] == quote[1] and body[k + 1 : k + 2] == quote[1]:
                    k += 2
                elif end.match(body, k + 1):
                    value, i = _plain(body[start + 1 : k], quote[1]), k + 1
                    break
                else:
                    k += 1
        m = sep.search(body, i) if sep else None
        quoted = value is not None
        if not quoted:
            value = body[i : m.start() if m else n]
        value = value.strip().lstrip("#").strip()
        if value:
            out.append((value, quoted))
        if not m:
            break
        i = max(m.end(), i + 1)
    return out


def parses(field: str) -> list[tuple[str, float, list[tuple[str, bool]]]]:
    """(dialect, its bits, values) of every different parse, simple dialects first."""
    body = _inside(field)
    seps = [k for k, p in _found.items() if p.search(body)]
    sets = [c for r in range(len(seps) + 1) for c in combinations(seps, r)]
    marks = [q for q in QUOTES if re.search(re.escape(q[0]) + ".*" + re.escape(q[1]), body, re.S)]
    seen, out = set(), []
    for s in sets:
        for q in ["", *marks]:
            values = parse(body, s, q)
            if (t := tuple(v for v, _ in values)) not in seen:
                seen.add(t)
                out.append(("+".join(s) + ("" if not q else " " + q), 1.0 + 3.0 * len(s) + 2.0 * bool(q), values))
    return out if any(v for _, _, v in out) else []


_seam = re.compile(r"[\"'”»’`]\s*(?:[,;|\t\r\n、，；•‣]|[·/–—-]\s)\s*[\"'“«„‘`]")


def spelling_bits(value: str, quoted: bool) -> float:
    """Bits of a value that has no code: quotes make separators cheap, but not a seam of two quoted values."""
    plain = NEW_BITS + CHAR_BITS * len(value)
    if quoted:
        return plain + 6.0 + 2 * MARK_BITS * len(_seam.findall(value))
    return plain + (MARK_BITS - CHAR_BITS) * len(_marks.findall(value))


_PARSES = "fid binary, n bigint, k int, no int, dialect string, bits double, vals array<string>, spelled array<double>"


#: Characters of parses that are gathered before they are sent on.
CHARS_OUT = 4_000_000


def _parse_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["fid", "n", "k", "no", "dialect", "bits", "vals", "spelled"]
    for pdf in batches:
        rows, chars = [], 0
        for fid, field, n in zip(pdf["fid"], pdf["field"], pdf["n"], strict=True):
            found = parses(field)
            for no, (dialect, bits, values) in enumerate(found):
                rows.append((fid, n, len(found), no, dialect, bits, [v for v, _ in values], [spelling_bits(*v) for v in values]))
                chars += 2 * len(field)
                if chars > CHARS_OUT:
                    yield pd.DataFrame(rows, columns=names)
                    rows, chars = [], 0
        yield pd.DataFrame(rows, columns=names)


def _codes(values: DataFrame) -> DataFrame:
    """(value, code): code length of each value by its weight among all."""
    w = values.groupBy("value").agg(F.sum("w").alias("w"))
    total = w.agg(F.sum("w").alias("total"))
    return w.crossJoin(F.broadcast(total)).select("value", (-F.log2(F.col("w") / F.col("total"))).alias("code"), "w")


def _cheapest(parsed: DataFrame, codes: DataFrame) -> DataFrame:
    """For each ambiguous field the number of its cheapest parse."""
    v = parsed.where("k > 1").select("fid", "no", "bits", F.explode_outer(F.arrays_zip("vals", "spelled")).alias("v"))
    v = v.select("fid", "no", "bits", F.col("v.vals").alias("value"), F.col("v.spelled").alias("spelled"))
    v = v.join(codes, "value", "left")
    # a value that stands in few fields pays its spelling as well, shared by those fields
    known = F.col("code") + F.col("spelled") / F.greatest(F.col("w"), F.lit(1.0))
    cost = F.when(F.col("value").isNull(), 0.0).otherwise(F.least(F.coalesce(known, F.col("spelled")), F.col("spelled") + 4))
    c = v.groupBy("fid", "no").agg((F.first("bits") + F.sum(cost)).alias("cost"))
    return c.groupBy("fid").agg(F.min(F.struct("cost", "no")).alias("best")).select("fid", F.col("best.no").alias("no"))


def split_packed(df: DataFrame, key: str, field: str, rounds: int = 2) -> DataFrame:
    """(key, pos, value, dialect): the values of `field`, one a row, in their order."""
    rows = df.select(F.col(key).alias("key"), F.col(field).alias("field")).where(r"field is not null and field rlike '\\S'")
    # a field is known by its digest, so that a long one isn't carried along with each of its values
    rows = rows.withColumn("fid", F.unhex(F.md5("field")))
    fields = rows.groupBy("fid").agg(F.first("field").alias("field"), F.countDistinct(F.struct("key")).alias("n"))
    # small rows, dear to parse: spread over all cores whatever their bytes
    fields = fields.repartition(3 * cores(df.sparkSession), "fid")
    parsed = materialize(fields.mapInPandas(_parse_all, _PARSES), "packed")
    single = parsed.where("k = 1")
    pick = parsed.select("fid", "no", "vals", (F.col("n") / F.col("k")).alias("w"))
    best = None
    for _ in range(rounds):
        values = pick.select(F.explode("vals").alias("value"), "w")
        best = _cheapest(parsed, _codes(values))
        taken = parsed.join(best, ["fid", "no"])
        pick = single.unionByName(taken).select("fid", "no", "vals", F.col("n").cast("double").alias("w"))
    chosen = single.unionByName(taken).select("fid", "vals", "dialect")
    out = rows.select("key", "fid").distinct().join(chosen, "fid").select("key", "dialect", F.posexplode("vals").alias("pos", "value"))
    return out.select("key", (F.col("pos") + 1).cast("int").alias("pos"), "value", "dialect")
