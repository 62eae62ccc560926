"""Symbols of source files: definitions, calls within their functions, enclosing scopes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orewright.operators import codelib


def _rows(what, columns: list[str], schema: str):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, label, text in zip(pdf["path"], pdf["lang"], pdf["text"], strict=True):
                lang = codelib.language_of(label, path)
                if lang and text:
                    rows += [(path, *r) for r in what(text, lang)]
            yield pd.DataFrame(rows, columns=columns)

    return lambda files: files.select("path", "lang", "text").where("path is not null and text is not null").mapInPandas(run, schema)


def _defs(text: str, lang: str) -> Iterator[tuple]:
    line = nbyte = last = 0
    for name, start, end in codelib.scopes(text, lang):
        line += len(re.findall(r"\r\n|\r|\n", text[last:start]))
        nbyte += len(text[last:start].encode("utf-8", "replace"))
        last = start
        yield name, line + 1, nbyte, len(re.findall(r"\r\n|\r|\n", text[start:end])) + 1


def definitions(files: DataFrame) -> DataFrame:
    """(path, symbol, line, byte, lines) of the functions of `files` (path, lang, text)."""
    return _rows(_defs, ["path", "symbol", "line", "byte", "lines"], "path string, symbol string, line int, byte bigint, lines int")(files)


def call_sites(files: DataFrame) -> DataFrame:
    """(path, caller, callee, line) of the calls within functions."""
    return _rows(codelib.calls, ["path", "caller", "callee", "line"], "path string, caller string, callee string, line int")(files)


def by_suffix(defs: DataFrame, suffix: str) -> DataFrame:
    """(symbol, places, sole): the symbols that end with a suffix, and whether it names one alone."""
    s = defs.where(F.endswith("symbol", F.lit(suffix))).groupBy("symbol").agg(F.count("*").alias("places"))
    n = s.agg(F.count("*").alias("n"))
    return s.crossJoin(F.broadcast(n)).select("symbol", "places", (F.col("n") == 1).alias("sole"))


def phase_vector(text: Column | str, dim: int = 64) -> Column:
    """A text as a unit vector: waves of its first characters' code bits, fading with their place."""

    def run(t: pd.Series) -> pd.Series:
        from orewright.operators.phaselib import encode

        return t.map(lambda v: None if v is None else encode(v, dim).tolist())

    return F.pandas_udf(run, "array<double>")(text)
