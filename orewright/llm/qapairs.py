"""Broken pairs of question and answer, each with its defect.

The checks, in this order; the first that holds is the defect:

* ``empty``: the answer is null or nothing is left of it without blanks, invisible and
  punctuation characters and markup, or it is a stand-in for a missing value.
* ``echo``: greedy string tiling, longest tiles first, with tiles of three words or more,
  covers the answer by the question, bar a short lead-in; an answer longer than the
  question is tiled by as many copies of it as its length takes.
* ``refusal``: the grammar of :mod:`orewright.llm.refusals` derives the whole answer.
* ``truncated``: a pushdown parser over fences, inline code, brackets, quotations,
  emphasis, tags, list items and table rows ends with something open, or the last sentence
  has no end.
* ``other_lang``: script, letters and small words put no sentence of the answer in the
  question's language, and the question asks for no other one.

Defined results for odd input: a null or blank question can't be echoed and has no
language, its answer is still checked for the other defects; a null id is kept as null;
double rows count once; texts of any length are read whole. Other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orewright.llm.refusals import is_refusal
from orewright.llm.sentences import each_sentence, language, sentences

#: Stand-ins for a missing answer. Fixed values.
STAND_INS = frozenset(
    "n/a na n.a. n.a none null nil nan undefined empty void blank missing tbd todo unknown no-answer "
    "нет пусто отсутствует неизвестно немає порожньо відсутнє невідомо leer keine unbekannt fehlt k.a. vacío vacio nada ninguno ninguna desconocido".split()
) | {"no data", "no answer", "not available", "not applicable", "no response", "нет данных", "нет ответа", "немає даних", "немає відповіді", "без відповіді", "без ответа", "keine angabe", "keine angaben", "keine daten", "keine antwort", "k. a.", "sin datos", "sin respuesta", "no disponible", "no hay datos"}

_tags = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>|&nbsp;|```[\w+-]*|~~~", re.S)


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    left = _tags.sub(" ", answer) if "<" in answer or "&" in answer or "`" in answer or "~" in answer else answer
    if all(unicodedata.category(c)[0] in "ZCP" or c in "`^~|=+<>$*_#" for c in left):
        return True
    bare = left.strip(" \t\r\n.!?()[]{}<>\"'`*_-–—:")
    if len(bare) > 80:
        return False
    bare = " ".join(bare.split()).lower()
    return bare in STAND_INS or bare.rstrip(".") in STAND_INS


_word = re.compile(r"\w+")
_joint = re.compile(r"(?<=\w)[.,'’](?=\w)")
PRIME, BASE = (1 << 61) - 1, 1_000_003


def _words(text: str) -> list[str]:
    return _word.findall(_joint.sub("", text).lower())


def _prefix_hashes(codes: list[int]) -> list[int]:
    out = [0]
    for c in codes:
        out.append((out[-1] * BASE + c) % PRIME)
    return out


def _free(used: bytearray) -> list[int]:
    """For each place the number of unmarked words from there on."""
    out, run = [0] * len(used), 0
    for i in range(len(used) - 1, -1, -1):
        run = 0 if used[i] else run + 1
        out[i] = run
    return out


def greedy_tiles(a: list[str], b: list[str], least: int, copies: int = 1) -> list[tuple[int, int, int]]:
    """(place in `a`, place in `b`, words) of the tiles of greedy string tiling, the longest first.

    A word of `a` belongs to one tile at most, a word of `b` to one in each of its `copies`.
    Karp-Rabin hashes of all unmarked runs of one length find the matches, whose words are
    then compared. The longest length with a match is searched by bisection, as a match
    holds shorter ones, and all matches of that length are marked before the next is
    searched. Tiles of k different lengths have k * k / 2 words at least, so this takes
    no more than about n * sqrt(n) * log(n) steps.
    """
    least = min(least, len(b))
    if least < 1 or len(a) < least:
        return []
    ids: dict[str, int] = {}
    x = [ids.setdefault(w, len(ids) + 1) for w in a]
    y = ([*(ids.setdefault(w, len(ids) + 1) for w in b), 0] * copies)[:-1]
    used_x, used_y = bytearray(len(x)), bytearray(c == 0 for c in y)
    hx, hy = _prefix_hashes(x), _prefix_hashes(y)
    tiles: list[tuple[int, int, int]] = []
    top = min(len(a), len(b))
    while top >= least:
        free_x, free_y = _free(used_x), _free(used_y)

        def starts(h: list[int], free: list[int], n: int) -> Iterator[tuple[int, int]]:
            power = pow(BASE, n, PRIME)
            return (((h[i + n] - h[i] * power) % PRIME, i) for i in range(len(free)) if free[i] >= n)

        def common(n: int) -> bool:
            have = {k for k, _ in starts(hy, free_y, n)}  # noqa: B023
            return any(k in have for k, _ in starts(hx, free_x, n))  # noqa: B023

        # the longest length with a match: lengths fall in `range`, so the first that matches
        lengths = range(top, least - 1, -1)
        at = bisect_left(lengths, True, key=common)
        if at == len(lengths):
            break
        n = lengths[at]
        places: dict[int, list[int]] = {}
        for k, j in starts(hy, free_y, n):
            places.setdefault(k, []).append(j)
        for left in places.values():
            left.reverse()
        end = 0
        for k, i in starts(hx, free_x, n):
            if i < end or k not in places:
                continue
            left = places[k]
            while left and (used_y[left[-1]] or used_y[left[-1] + n - 1]):
                left.pop()
            if left and x[i : i + n] == y[left[-1] : left[-1] + n]:
                j = left.pop()
                used_x[i : i + n] = used_y[j : j + n] = b"\x01" * n
                tiles.append((i, j % (len(b) + 1), n))
                end = i + n
        top = n - 1
    return tiles


def tiled(a: list[str], b: list[str], least: int) -> int:
    """Words of `a` that tiles of `least` words or more from copies of `b` cover."""
    return sum(n for _, _, n in greedy_tiles(a, b, least, max(1, -(-len(a) // max(1, len(b))))))


_lead = re.compile(r"[^\n:]{0,60}:\s")


def is_echo(question: str | None, answer: str) -> bool:
    q, a = _words(question or ""), _words(answer)
    if len(q) < 2 or not a:
        return False
    have = set(q)
    if sum([w not in have for w in a]) > max(1, 0.1 * len(a)) + 7:
        return False  # a word that the question lacks is in no tile, and a lead-in has seven words at most
    lead = _lead.match(answer)
    if lead and (n := len(_words(lead.group()))) <= 7 and len(a) > n and not greedy_tiles(a[:n], q, 3):
        a = a[n:]
    if len(a) < min(len(q), 4) or len(a) < 0.5 * _question_size(question or "", len(q)):
        return False
    return len(a) - tiled(a, q, 3) <= max(1, 0.1 * len(a))


def _question_size(question: str, n: int) -> int:
    """Words of the last sentence of the question, which an echo gives back at least."""
    parts = sentences(question)
    return len(_words(question[parts[-1][0] : parts[-1][1]])) if parts else n


#: Elements of markup whose end must be written, and closing marks by opening ones. Fixed values.
ELEMENTS = frozenset(
    "a abbr article aside b big blockquote body button center cite code dd del details div dl em fieldset figure footer form h1 h2 h3 h4 h5 h6 head header html i ins kbd label main mark "
    "nav ol pre q s samp section small span strike strong sub summary sup table tbody textarea thead tt u ul var".split()
) - {"dd", "body", "head", "html", "tbody", "thead"}
CLOSES = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“„"}

_special = re.compile("[\n`<*:;()\\[\\]{}«»„“”\"]")
_lexer = re.compile(
    r"(?P<blank>\n(?:[ \t\r]*\n)+)"
    r"|\n[ \t]*(?P<fence>```+|~~~+)(?P<info>[^\n]*)"
    r"|\n[ \t]*(?P<row>\|[^\n]*)"
    r"|\n(?P<indent>[ \t]*)(?P<item>[-*•+]|\d{1,3}[.)])(?=[ \t\n]|\Z)"
    r"|(?P<code>(?P<ticks>`+)(?!`)[^\n]*?(?<!`)(?P=ticks)(?!`))|(?P<tick>`+)"
    r"|<!--(?P<comment>.*?)-->|<(?P<slash>/?)(?P<tag>[A-Za-z][A-Za-z0-9-]*)(?P<attrs>\s[^<>]*|/)?>|(?P<cut><(?:[A-Za-z/][^<>\n]*)?\Z)"
    r"|(?P<bold>\*\*)|[:;]-?[()]|(?P<close>[)\]}»”])|(?P<open>[(\[{«„])|(?P<quote>[\"“])",
    re.S,
)
_bars = re.compile(r"(?<!\\)\|")


class Parse:
    """A pushdown parse of one text: `stack` holds (symbol, mark, place) of what is open at its end."""

    def __init__(self, text: str):
        self.stack: list[tuple[str, str, int]] = []
        self.items: list[tuple[int, int]] = []  # place and indent of the list items
        self.rows: list[str] = []  # rows of the table that the text ends in
        text = "\n" + text  # every line begins behind a line feed
        at = 0
        while here := _special.search(text, at):
            m = _lexer.match(text, here.start())
            at = self._step(text, m) if m else here.end()
        self.text = text

    def _pop(self, symbol: str, marks: str) -> bool:
        """Closes the innermost such symbol and what is still open inside it."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == symbol and self.stack[k][1] in marks:
                del self.stack[k:]
                return True
        return False

    def _step(self, text: str, m: re.Match) -> int:
        s, e = m.start(), m.end()
        if m["fence"] and m["fence"][0] not in m["info"]:
            close = re.compile(rf"^[ \t]*{m['fence'][0]}{{{len(m['fence'])},}}[ \t\r]*$", re.M).search(text, min(e + 1, len(text)))
            if not close:
                self.stack.append(("fence", m["fence"], s))
                return len(text)
            return max(close.end(), e)
        if m["row"]:
            if not self.rows or text[self._row_end : s].strip():
                self.rows = []
            self.rows.append(m["row"].strip())
            self._row_end = e
            return e
        if m["item"]:
            self.items.append((e, len(m["indent"].expandtabs(4))))
        elif m["blank"]:  # emphasis and inline code end with their paragraph, whether closed or not
            self.stack = [x for x in self.stack if x[0] not in ("emphasis", "inline")]
            return e - 1  # the last line feed begins the next line
        elif m["tick"]:
            if not self._pop("inline", m["tick"]):
                self.stack.append(("inline", m["tick"], s))
        elif m["tag"]:
            name = m["tag"].lower()
            if name in ELEMENTS and m["slash"]:
                self._pop("tag", name) if any(x[:2] == ("tag", name) for x in self.stack) else None
            elif name in ELEMENTS and not (m["attrs"] or "").endswith("/"):
                self.stack.append(("tag", name, s))
        elif m["cut"]:
            self.stack.append(("tag", "<", s))
        elif m["bold"]:
            if not self._pop("emphasis", "**"):
                self.stack.append(("emphasis", "**", s))
        elif m["close"]:
            self._pop("quote" if m["close"] in "»”" else "bracket", CLOSES[m["close"]])
        elif m["open"]:
            self.stack.append(("quote" if m["open"] in "«„" else "bracket", m["open"], s))
        elif m["quote"] == "“":  # closes a low quotation mark, opens else
            if not self._pop("quote", "„"):
                self.stack.append(("quote", "“", s))
        elif m["quote"]:
            opens = (s == 0 or text[s - 1].isspace() or text[s - 1] in "([{<>*_-–—«/=:'") and s + 1 < len(text) and not text[s + 1].isspace()
            again = opens and any(x[:2] == ("quote", '"') for x in self.stack)
            if again and not text[:s].rstrip(" \t").endswith("\n"):  # no opening inside an open one: it closes
                self._pop("quote", '"')
            elif opens and not again:
                self.stack.append(("quote", '"', s))
            elif not opens:  # a mark of inches or seconds closes nothing where nothing is open
                self._pop("quote", '"')
        return e


def is_truncated(answer: str) -> bool:
    text = answer.rstrip().rstrip("​﻿­").rstrip()
    parse = Parse(text)
    if parse.stack:
        return True
    last = text.rsplit("\n", 1)[-1].strip()
    if _closed.search(last):
        return False
    if last.startswith("|") and parse.rows:
        head = len(_bars.findall(parse.rows[0]))
        return not last.endswith("|") or last.endswith(r"\|") or len(_bars.findall(last)) != head or set(last) <= set("|-: ")
    if _begun.match(last):
        return True
    if _END.search(last):
        return last.endswith("0.") and bool(re.search(r"(?<![\w.])0\.$", last))
    if re.search(r"[,:;(–—-]$", last):
        return True
    words = _word.findall(text)
    if "\n" not in text and (len(words) <= 2 or len(words) <= 4 and re.search(r"\d", text)):
        return False
    if re.fullmatch(r"`[^`]+`", text):
        return False
    body = parse.text
    if parse.items and "\n" not in body[parse.items[-1][0] :]:  # items without stops are finished without one
        ends = [body[p : body.find("\n", p)].strip() for p, _ in parse.items[:-1]]
        return not ends or 2 * sum(bool(_END.search(x)) for x in ends) >= len(ends)
    return True


_END = re.compile(r"[.!?…。！？][\"'”»“)\]}*_`>]*$")
_closed = re.compile(r"^(?:```+|~~~+)$|</\w+>$|/>$|-->$")
_begun = re.compile(r"(?:[-*•+]|\d{1,3}[.)]|#{1,6}|>)$|#{1,6}\s")


#: How languages are called, and words that ask for one. Fixed values.
LANGUAGE_NAMES = {
    "en": r"english|englisch\w*|ingl[eé]s|английск\w+|англійськ\w+",
    "de": r"deutsch\w*|german|alem[aá]n|немецк\w+|німецьк\w+",
    "es": r"español|espanol|spanish|spanisch\w*|castellano|испанск\w+|іспанськ\w+",
    "ru": r"русск\w+|russian|russisch\w*|ruso|російськ\w+",
    "uk": r"українськ\w+|украинск\w+|ukrainian|ukrainisch\w*|ucraniano",
    "": r"french|französisch|franc[eé]s|французск\w+|французьк\w+|italian\w*|polish|polnisch|польск\w+|польськ\w+",
}
_names = {k: re.compile(rf"(?<!\w)(?:{v})(?!\w)", re.I) for k, v in LANGUAGE_NAMES.items()}
_any_name = re.compile(rf"(?<!\w)(?:{'|'.join(LANGUAGE_NAMES.values())})(?!\w)", re.I)
_asks = re.compile(r"translat|answer|reply|respond|write|say|übersetz|antwort|schreib|sprache|переве|перевод|ответ|напиши|язык|переклад|відпов|напиши|мов[аиоуі]|traduc|respond|contest|escrib|idioma", re.I)


def asked_language(question: str) -> str | None:
    """The language a question asks its answer to be in: a code, "" for one outside the five, or None."""
    if not _any_name.search(question) or not _asks.search(question):
        return None
    return next((k for k, p in _names.items() if p.search(question)), None)


def other_language(question: str | None, answer: str) -> bool:
    if not question:
        return False
    asks = [x for s, e in sentences(question) if (x := language(question[s:e]))]
    if not asks:
        return False
    own = max(set(asks), key=lambda k: (asks.count(k), -asks.index(k)))
    said = False
    for s, e in each_sentence(answer):
        found = language(answer[s:e])
        if found == own:
            return False
        said = said or found is not None
    return said and asked_language(question) in (None, own)


def defect(question: str | None, answer: str | None) -> str | None:
    """The defect of a pair, or None."""
    if is_empty(answer):
        return "empty"
    if is_echo(question, answer):
        return "echo"
    if is_refusal(question, answer):
        return "refusal"
    if is_truncated(answer):
        return "truncated"
    return "other_lang" if other_language(question, answer) else None


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [defect(q, a) for q, a in zip(pdf["question"], pdf["answer"], strict=True)]
        yield pd.DataFrame({"chat_id": pdf["chat_id"].astype("Int64"), "defect": found})


def defective(pairs: DataFrame, key: str = "id") -> DataFrame:
    """(chat_id, defect) of the defective rows of `pairs` (key, question, answer)."""
    rows = pairs.select(F.col(key).alias("chat_id"), "question", "answer")
    return rows.mapInPandas(_find, "chat_id bigint, defect string").where("defect is not null").distinct()
