"""Stems, query intent, scripts and their affinity, masking, quotes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orewright.operators.langlib import intent, mask, stem


def stem_column(token: Column | str) -> Column:
    """Stems of tokens; each distinct token of a batch is stemmed once."""

    def run(t: pd.Series) -> pd.Series:
        return t.map({w: stem(w) for w in t.dropna().unique()})

    return F.pandas_udf(run, "string")(token)


def stemmed_vocabulary(vocab: DataFrame) -> DataFrame:
    """(stem, freq, forms) of a vocabulary (tok, freq): only the distinct tokens go through Python."""
    s = vocab.select(stem_column("tok").alias("stem"), "freq")
    return s.groupBy("stem").agg(F.sum("freq").alias("freq"), F.count("*").alias("forms"))


def intent_column(query: Column | str) -> Column:
    return F.pandas_udf(lambda q: q.map(intent), "string")(query)


def mask_column(text: Column | str) -> Column:
    """All classes of personal data masked, overlaps going to the span that starts first."""
    return F.pandas_udf(lambda t: t.map(lambda v: None if v is None else mask(v)), "string")(text)


#: Code point ranges of the scripts. Fixed values.
SCRIPT_RANGES = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)), "cyrillic": ((0x400, 0x52F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)), "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)), "hebrew": ((0x590, 0x5FF),), "devanagari": ((0x900, 0x97F),), "bengali": ((0x980, 0x9FF),), "gujarati": ((0xA80, 0xAFF),), "tamil": ((0xB80, 0xBFF),), "telugu": ((0xC00, 0xC7F),),
    "thai": ((0xE00, 0xE7F),), "georgian": ((0x10A0, 0x10FF), (0x2D00, 0x2D2F)), "armenian": ((0x530, 0x58F),), "coptic": ((0x2C80, 0x2CFF),), "glagolitic": ((0x2C00, 0x2C5F),), "syriac": ((0x700, 0x74F),),
    "hangul": ((0xAC00, 0xD7AF), (0x1100, 0x11FF), (0x3130, 0x318F)), "hiragana": ((0x3040, 0x309F),), "katakana": ((0x30A0, 0x30FF),), "cjk": ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF)),
}
#: Affinity of two different scripts; 0.1 for all others. Fixed values.
AFFINITY = {
    ("latin", "cyrillic"): 0.75, ("greek", "latin"): 0.80, ("greek", "cyrillic"): 0.85, ("greek", "coptic"): 0.90, ("cyrillic", "glagolitic"): 0.95, ("hebrew", "arabic"): 0.80, ("arabic", "syriac"): 0.85,
    ("devanagari", "bengali"): 0.85, ("devanagari", "gujarati"): 0.90, ("tamil", "telugu"): 0.75, ("hiragana", "katakana"): 0.95, ("hiragana", "cjk"): 0.70, ("hangul", "cjk"): 0.60,
}


def script_of(char: Column) -> Column:
    """The script of the first character of a string."""
    cp = F.ascii(char)
    out = F.lit("unknown")
    for name, ranges in SCRIPT_RANGES.items():
        for lo, hi in ranges:
            out = F.when(cp.between(lo, hi), name).otherwise(out)
    return out


def affinity(a: Column, b: Column) -> Column:
    out = F.lit(0.1)
    for (x, y), v in AFFINITY.items():
        out = F.when(((a == x) & (b == y)) | ((a == y) & (b == x)), v).otherwise(out)
    return F.when(a == b, 1.0).otherwise(out)


def quote_window(text: Column, query: str, width: int) -> Column:
    """A window around the longest query word of four letters or more, a third of it before the word."""
    words = sorted((w for w in re.findall(r"\w+", query.lower()) if len(w) >= 4), key=lambda w: (-len(w), query.lower().index(w)))
    at = F.lit(0)
    for w in reversed(words):
        at = F.when(F.contains(F.lower(text), F.lit(w)), F.instr(F.lower(text), w) - 1).otherwise(at)
    start = F.greatest(at - width // 3, F.lit(0))
    return F.substr(text, (start + 1).cast("int"), F.lit(width))


def corpus_pieces(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, paragraph, part, piece): paragraphs of 40 characters or more, those over 380 cut at 340."""
    paras = F.filter(F.transform(F.split(F.col(text), "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: F.length(p) >= 40)
    d = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(paras).alias("paragraph", "p"))
    last = F.when(F.length("p") > 380, F.floor((F.length("p") - 1) / 340).cast("int")).otherwise(0)
    d = d.select(key, "paragraph", "p", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    return d.select(key, "paragraph", "part", F.when(F.length("p") > 380, F.substring("p", F.col("part") * 340 + 1, F.lit(340))).otherwise(F.col("p")).alias("piece"))
