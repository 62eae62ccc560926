"""Splitting oversized texts at natural boundaries, with an overlap between pieces.

Boundaries are places between two characters, by strength: before a heading, after an
empty line (paragraph), after a line feed, after a sentence end (``. ! ? …`` followed by
white space), after other white space, anywhere. The first four are natural. A text of
L > `max_chars` characters needs at least ``ceil((L - o) / (max - o))`` pieces for an
overlap o. What is left of a text is always aimed to be cut into equal pieces of the least
number, and the next end is moved to the strongest boundary near its target. Where no
boundary is left from which so few pieces could reach the end, one more piece is planned.

Every piece has at most `max_chars` characters and begins exactly `overlap` characters
before the end of the piece before it. A cut is ``forced`` where more than `max_chars`
characters in a row hold no natural boundary, and ``tight`` where fewer do but more than
``max - overlap``, so that the overlap leaves no natural end in reach. Both fall behind
white space, if there is any, and never between CR and LF or before a combining mark.

Defined results for odd input: a null text gives no row; an empty text or one within the
limit gives one piece; an overlap of half the limit or more is lowered to half of it; a
limit that is null or below 1 leaves texts whole; double rows count once; equal ids with
different texts are cut each on its own. Other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADING, PARAGRAPH, LINE, SENTENCE = 4, 3, 2, 1
_breaks = re.compile(r"\n[ \t\r]*\n[ \t\r\n]*|\n|[.!?…](?=\s)")
_heading = re.compile(r"#{1,6}[ \t]\S")


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Places of the natural boundaries in order, and their strengths."""
    at: dict[int, int] = {}
    for m in _breaks.finditer(text):
        g = m.group()
        strength = SENTENCE if g[0] != "\n" else LINE if g == "\n" else PARAGRAPH
        if strength >= LINE and _heading.match(text, m.end()):
            strength = HEADING
        at[m.end()] = max(strength, at.get(m.end(), 0))
        if strength >= PARAGRAPH:  # the line feed that begins the break is a boundary as well
            at.setdefault(m.start() + 1, LINE)
    at.pop(len(text), None)
    places = sorted(at)
    return places, [at[p] for p in places]


def _forced(text: str, lo: int, hi: int) -> int:
    """A place in (lo, hi] for a cut without a natural boundary."""
    for p in range(hi, max(lo, hi - (hi - lo) // 4), -1):
        if text[p - 1].isspace() and not (text[p - 1] == "\r" and text[p : p + 1] == "\n"):
            return p
    for p in range(hi, lo, -1):
        nxt = text[p : p + 1]
        if not (nxt and unicodedata.combining(nxt)) and not (nxt == "\n" and text[p - 1] == "\r"):
            return p
    return hi


def _snapped(places: list[int], strength: list[int], lo: int, hi: int, target: float, aim: float) -> int | None:
    """The strongest of the boundaries in [lo, hi] near `target`, else the nearest, or None."""
    a, b = bisect_left(places, lo), bisect_right(places, hi)
    if a >= b:
        return None
    near = max(16.0, aim * 0.2)
    c, d = bisect_left(places, target - near, a, b), bisect_right(places, target + near, a, b)
    if c < d:
        return places[max(range(c, d), key=lambda k: (strength[k], -abs(places[k] - target)))]
    return min(places[max(a, min(c, b) - 1)], places[min(c, b - 1)], key=lambda p: abs(p - target))


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, how) of the pieces; how is ``whole``, ``natural``, ``tight``, ``forced`` or ``end``."""
    length = len(text)
    if length <= limit:
        return [(0, length, "whole")]
    overlap = max(0, min(overlap, limit // 2))
    step = limit - overlap
    places, strength = boundaries(text)
    out: list[tuple[int, int, str]] = []
    start, last = 0, overlap  # the first piece has no overlap before it
    while length - start > limit:
        left = length - last
        n = -(-left // step)
        aim = left / n
        end, how = _snapped(places, strength, max(last + 1, length - (n - 1) * step), last + step, last + aim, aim), "natural"
        if end is None:  # one more piece
            aim = left / (n + 1)
            end = _snapped(places, strength, last + 1, last + step, last + aim, aim)
        if end is None:  # equal parts of the run without a boundary
            k = bisect_right(places, last)
            before, ahead = places[k - 1] if k else 0, places[k] if k < len(places) else length
            end = _forced(text, last, last + min(step, -(-(ahead - last) // -(-(ahead - last) // step))))
            how = "forced" if ahead - before > limit else "tight"
        out.append((start, end, how))
        last, start = end, end - overlap
    out.append((start, length, "end"))
    return out


def longest_run(text: str) -> int:
    """The most characters in a row without a natural boundary among them."""
    if not text:
        return 0
    feeds = re.split(r"\n|(?<=[.!?…])(?=\s)", text)
    return max(map(len, feeds))


_SCHEMA = "src string, item_id bigint, piece_no int, start_char int, end_char int, cut string, overlap_chars int, piece string"


def _cutter(with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for src, item, text, limit, overlap in zip(pdf["src"], pdf["item_id"], pdf["text"], pdf["max_chars"], pdf["overlap_chars"], strict=True):
                pieces = cut(text, int(limit) if limit == limit and limit is not None and limit >= 1 else max(1, len(text)), int(overlap) if overlap == overlap and overlap is not None else 0)
                before = 0
                for no, (s, e, how) in enumerate(pieces):
                    rows.append((src, item, no + 1, s, e, how, before - s if no else 0, text[s:e] if with_text else None))
                    before = e
            yield pd.DataFrame(rows, columns=["src", "item_id", "piece_no", "start_char", "end_char", "cut", "overlap_chars", "piece"])

    return run


def split_texts(items: DataFrame, limits: DataFrame, with_text: bool = True) -> DataFrame:
    """Pieces of `items` (src, item_id, text) by `limits` (src, max_chars, overlap_chars).

    `limits` is the fixed table of a few rows, one for each source; texts meet it by broadcast
    only if it is that small, which the session's broadcast threshold checks.
    """
    lim = limits.groupBy("src").agg(F.min("max_chars").alias("max_chars"), F.max("overlap_chars").alias("overlap_chars"))
    rows = items.select("src", "item_id", "text").where("text is not null").join(lim, "src", "left")
    return rows.mapInPandas(_cutter(with_text), _SCHEMA)


def oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """(src, item_id, cut): how each text beyond its limit had to be cut."""
    p = split_texts(items, limits, with_text=False).where("cut != 'whole'")
    return p.groupBy("src", "item_id").agg(F.when(F.max(F.col("cut") == "forced"), "forced").otherwise("natural").alias("cut"))


__all__ = ["boundaries", "cut", "longest_run", "oversized", "split_texts"]
