"""Island grammars of four programming languages: comments, strings, attributes, signatures, bodies.

What isn't an island is water and skipped; what looks like one inside a string or comment
is none. Line ends are LF, CR LF or CR.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from typing import NamedTuple

#: Languages by label and by ending. Fixed values.
LANGS = {"rust": "rust", "rs": "rust", "typescript": "ts", "ts": "ts", "tsx": "ts", "javascript": "ts", "js": "ts", "go": "go", "golang": "go", "python": "python", "py": "python"}

_S = r'"(?:[^"\\]|\\.)*"'
_LEX = {
    "rust": re.compile(rf'(?P<line>//[^\r\n]*)|(?P<block>/\*)|(?P<str>b?r(?P<h>#*)".*?"(?P=h)|b?{_S}|b?\'(?:[^\'\\\r\n]|\\[^\r\n]{{1,10}}?)\')|(?P<attr>#!?\[)', re.S),
    "ts": re.compile(rf"(?P<line>//[^\r\n]*)|(?P<block>/\*)|(?P<str>`(?:[^`\\]|\\.)*`|{_S}|'(?:[^'\\\r\n]|\\.)*')|(?P<attr>@[A-Za-z_][\w.]*)", re.S),
    "go": re.compile(rf"(?P<line>//[^\r\n]*)|(?P<block>/\*)|(?P<str>`[^`]*`|{_S}|'(?:[^'\\\r\n]|\\[^\r\n]{{1,10}}?)')", re.S),
    "python": re.compile(r"(?P<line>\#[^\r\n]*)|(?P<str>(?<![A-Za-z0-9_])(?P<p>[rRuUbBfF]{0,2})(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\.)*'))", re.S),
}
#: Words that begin a function. Each pattern begins with literals, so texts are skipped quickly up to them.
_HEAD = {
    "rust": re.compile(r"fn\s+(?:r#)?(?P<name>\w+)\s*(?=[<(])"),
    "ts": re.compile(r"function\s*\*?\s*(?P<name>[\w$]+)\s*(?=[<(])|const\s+(?P<bound>[\w$]+)\s*(?=[:=])|let\s+(?P<bound2>[\w$]+)\s*(?=[:=])|var\s+(?P<bound3>[\w$]+)\s*(?=[:=])"),
    "go": re.compile(r"func\s*(?=[\w(])"),
    "python": re.compile(r"def[ \t]+(?P<name>\w+)\s*(?=[\[(])"),
}
#: Possessive, as comments leave long runs of blanks.
_METHOD = re.compile(r"[\r\n{};][ \t]*+(?:(?:async|public|private|protected|static|abstract|override|readonly|get|set)\s++)*(?:\*\s*+)?(?P<method>#?[\w$]++)\s*+(?=[<(])")
_BEFORE = {
    "rust": re.compile(r"(?<![\w#])(?:(?:pub(?:\s*\([^()]*\))?|default|async|const|unsafe|extern)\s+)+\Z"),
    "ts": re.compile(r"(?<![\w.$])(?:(?:export|default|declare|async|public|private|protected|static|abstract|override|readonly)\s+)+\Z"),
}
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "function", "return", "with", "do", "else", "try", "new", "typeof", "await", "super"}
_space, _ident, _bracket = re.compile(r"\s*"), re.compile(r"[\w$]+"), re.compile(r"[()\[\]{}]")
_angle = re.compile(r"=>|->|[<>(\[{;]")
_PARTNER = {")": "(", "]": "[", "}": "{"}


def _block_end(text: str, at: int, nested: bool) -> int:
    """The end of the comment that begins with ``/*`` at `at`."""
    depth, i = 1, at + 2
    while depth:
        close = text.find("*/", i)
        if close < 0:
            return len(text)
        inner = text.find("/*", i, close) if nested else -1
        if inner >= 0:
            depth, i = depth + 1, inner + 2
        else:
            depth, i = depth - 1, close + 2
    return i


def bracket_end(mask: str, at: int, opening: str, closing: str) -> int:
    """The place behind the bracket that closes the one at `at`."""
    depth = 0
    for m in re.compile(f"[{re.escape(opening + closing)}]").finditer(mask, at):
        depth += 1 if m.group() == opening else -1
        if not depth:
            return m.end()
    return len(mask)


_unseen = re.compile(r"[^\r\n]")


def islands(text: str, lang: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with comments and strings blanked, and (kind, start, end) of the islands."""
    out, parts, i, done = [], [], 0, 0
    lex = _LEX[lang]
    while m := lex.search(text, i):
        kind, s, e = m.lastgroup if m.lastgroup not in ("h", "p") else "str", m.start(), m.end()
        if kind == "block":
            e = _block_end(text, s, lang == "rust")
        elif kind == "attr" and lang == "rust":
            e = s + 1
            depth = 0
            for t in re.compile(rf"{_S}|[\[\]]", re.S).finditer(text, s):
                depth += (t.group() == "[") - (t.group() == "]")
                if t.group() == "]" and not depth:
                    e = t.end()
                    break
        elif kind == "attr":
            after = re.compile(r"[ \t]*\(").match(text, e)
            if after:
                e = bracket_end(text, after.end() - 1, "(", ")")
        out.append((kind, s, e))
        parts += [text[done:s], " " * (e - s) if kind == "line" else _unseen.sub(" ", text[s:e])]
        done = i = max(e, s + 1)
    return "".join(parts) + text[done:], out


def language_of(label: str | None, path: str | None) -> str | None:
    """The grammar for a file by its label, else by its ending."""
    return LANGS.get((label or "").strip().lower()) or LANGS.get((path or "").rpartition(".")[2].lower())


def line_start(text: str, at: int) -> int:
    return max(text.rfind("\n", 0, at), text.rfind("\r", 0, at)) + 1


class Function(NamedTuple):
    """A function in a text: where its item begins (modifiers included), its name, and its body ends;
    `inside` is the place behind the mark that opens the body."""

    name: str
    start: int
    at: int
    inside: int
    end: int


class Source:
    """A text read by its language's island grammar: `mask` is the text with comments and strings
    blanked, `islands` are (kind, start, end), `closes` pairs the brackets of the mask."""

    def __init__(self, text: str, lang: str):
        self.text, self.lang = text, lang
        self.mask, self.islands = islands(text, lang)
        self.closes: dict[int, int] = {}
        open_: list[tuple[str, int]] = []
        for m in _bracket.finditer(self.mask):
            c = m.group()
            if c in "([{":
                open_.append((c, m.start()))
                continue
            # a bracket left open inside is taken as closed by its surroundings
            k = len(open_) - 1
            while k >= 0 and open_[k][0] != _PARTNER[c]:
                k -= 1
            if k >= 0:
                self.closes[open_[k][1]] = m.end()
                del open_[k:]

    def behind(self, at: int) -> int:
        """The place behind the bracket that opens at `at`."""
        return self.closes.get(at, len(self.mask))

    def _skip(self, at: int) -> int:
        return _space.match(self.mask, at).end()

    def _generics(self, at: int) -> int:
        """The place behind the type parameters that begin at `at`, if any do."""
        if self.mask[at : at + 1] == "[" and self.lang in ("go", "python"):
            return self._skip(self.behind(at))
        if self.mask[at : at + 1] != "<":
            return at
        depth, i = 0, at
        while m := _angle.search(self.mask, i):
            c, i = m.group(), m.end()
            if c == ";":
                break
            if c in "([{":
                i = self.behind(m.start())
            elif c in "<>":
                depth += 1 if c == "<" else -1
                if not depth:
                    return self._skip(i)
        return -1

    def _params(self, at: int) -> int:
        """The place behind type parameters and the parameters in brackets, or -1."""
        at = self._generics(at)
        return self._skip(self.behind(at)) if at >= 0 and self.mask[at : at + 1] == "(" and at in self.closes else -1

    def _type(self, at: int, stop: str) -> int:
        """The place of the mark `stop` that ends a type, or -1; what stands in brackets belongs to the type."""
        i, last = at, ":"
        while i < len(self.mask):
            c = self.mask[i]
            if c in "\r\n" and last not in ":|&<,=>" and self.mask[self._skip(i) : self._skip(i) + 1] not in ("|", "&", "=", "{"):
                return -1
            if c.isspace():
                i += 1
            elif self.mask.startswith("=>", i):
                if stop == "=>":
                    return i
                i, last = i + 2, ">"
            elif c == stop and not (c == "{" and last in ":|&<,(=>"):
                return i
            elif c == ";":
                return -1
            elif c in "([{":
                i, last = self.behind(i), ")"
            else:
                i, last = i + 1, c
        return -1

    def _block(self, at: int) -> int:
        """The place of the brace that opens the body, or of the semicolon or end where there is none."""
        for m in _body.finditer(self.mask, at):
            if m.start() < at:
                continue
            c = m.group()
            if c in "([" or c == "{" and self.lang == "go" and _typed.search(self.mask, max(0, m.start() - 12), m.start()):
                at = self.behind(m.start())
            else:
                return m.start()
        return len(self.mask)

    def _braced(self, name: str, start: int, at: int, behind: int) -> Function:
        body = self._block(behind)
        if self.mask[body : body + 1] == "{":
            return Function(name, start, at, body + 1, self.behind(body))
        return Function(name, start, at, min(body + 1, len(self.mask)), min(body + 1, len(self.mask)))

    def _rust(self, m: re.Match) -> Function | None:
        behind = self._params(self._skip(m.end("name")))
        return self._braced(m["name"], self._first(m.start()), m.start("name"), behind) if behind >= 0 else None

    def _go(self, m: re.Match) -> Function | None:
        at = m.end()
        if self.mask[at] == "(":
            at = self._skip(self.behind(at))
        name = _ident.match(self.mask, at)
        behind = self._params(self._skip(name.end())) if name else -1
        return self._braced(name.group(), m.start(), at, behind) if behind >= 0 else None

    def _ts(self, m: re.Match) -> Function | None:
        if m.re is _METHOD:
            start = self._skip(m.start() + 1)
            behind = self._params(m.end()) if m["method"] not in _NOT_METHODS else -1
            if behind < 0 or self.mask[behind : behind + 1] not in ("{", ":"):
                return None
            found = self._after_type(m["method"], start, m.start("method"), behind)
            return found if self.mask[found.inside - 1] == "{" else None
        start = self._first(m.start())
        if m["name"]:
            behind = self._params(m.end())
            return self._after_type(m["name"], start, m.start("name"), behind) if behind >= 0 else None
        bound, named, at = m[m.lastgroup], m.start(m.lastgroup), m.end()
        if self.mask[at] == ":":
            at = self._type(at + 1, "=")
        if at < 0 or self.mask[at : at + 1] != "=":
            return None
        at = self._skip(at + 1)
        word = _ident.match(self.mask, at)
        if word and word.group() == "async":
            at = self._skip(word.end())
            word = _ident.match(self.mask, at)
        if word and word.group() == "function":
            return self._braced(bound, start, named, word.end())
        at = self._skip(word.end()) if word else self._params(at)
        if at >= 0 and not word and self.mask[at : at + 1] == ":":
            at = self._type(at + 1, "=>")
        if at < 0 or not self.mask.startswith("=>", at):
            return None
        return self._braced(bound, start, named, at + 2)

    def _after_type(self, name: str, start: int, at: int, behind: int) -> Function:
        """A function whose result's type, if written, stands before its body."""
        if self.mask[behind : behind + 1] == ":":
            body = self._type(behind + 1, "{")
            if body < 0:
                return Function(name, start, at, behind, behind)
            return Function(name, start, at, body + 1, self.behind(body))
        return self._braced(name, start, at, behind)

    def _python(self, m: re.Match) -> Function | None:
        line = line_start(self.mask, m.start())
        before = self.mask[line : m.start()]
        behind = self._params(m.end()) if before.strip() in ("", "async") else -1
        if behind < 0:
            return None
        colon = next((k for k in self._outside(behind) if self.mask[k] == ":"), len(self.mask))
        indent = len(before) - len(before.lstrip(" \t"))
        end = len(self.mask)
        for nxt in _indented.finditer(self.mask, min(colon, end)):
            if len(nxt.group(1)) <= indent:
                end = nxt.start()
                break
        return Function(m["name"], line, m.start("name"), min(colon + 1, len(self.mask)), end)

    def _outside(self, at: int) -> Iterator[int]:
        """Places from `at` on that no bracket encloses."""
        while at < len(self.mask):
            if self.mask[at] in "([{":
                at = self.behind(at)
            else:
                yield at
                at += 1

    def _heads(self) -> Iterator[re.Match]:
        """Matches of what may begin a function, in order."""
        words = (m for m in _HEAD[self.lang].finditer(self.mask) if not m.start() or not (self.mask[m.start() - 1].isalnum() or self.mask[m.start() - 1] in "_.$#"))
        return heapq.merge(words, _METHOD.finditer(self.mask), key=lambda m: m.end()) if self.lang == "ts" else words

    def _first(self, at: int) -> int:
        """Where the modifiers before the word at `at` begin."""
        edge = max(self.mask.rfind(c, 0, at) for c in ";{}")
        m = _BEFORE[self.lang].search(self.mask, edge + 1, at)
        return m.start() if m else at

    def functions(self) -> Iterator[Function]:
        """The functions with their signatures, in order."""
        read, last = getattr(self, "_" + self.lang), -1
        for m in self._heads():
            found = read(m)
            if found and found.at > last:
                last = found.at
                yield found


_body, _typed = re.compile(r"[{;(\[]"), re.compile(r"\b(?:interface|struct)\s*$")
_indented = re.compile(r"(?:\r\n|\r|\n)([ \t]*)(?=[^\s#])")


def scopes(text: str, lang: str) -> list[tuple[str, int, int]]:
    """(name, start of the name's line, end) of the functions, in order."""
    return [(f.name, line_start(text, f.at), f.end) for f in Source(text, lang).functions()]


_call = re.compile(r"([A-Za-z_$][\w$]*(?:(?:::|\.)[A-Za-z_$][\w$]*)*)\s*!?\(")
_not_called = frozenset("if for while match return fn def func function switch catch with await in not and or elif lambda print_ self super".split())


def calls(text: str, lang: str) -> Iterator[tuple[str, str, int]]:
    """(enclosing function, callee, line) of every call outside strings and comments; the name in a signature is none."""
    source = Source(text, lang)
    mask = source.mask
    sigs = [(f.at, f.name, f.end) for f in source.functions()]
    named = {s for s, *_ in sigs}
    stack: list[tuple[str, int]] = []
    k = line = 0
    last = 0
    for c in _call.finditer(mask):
        while k < len(sigs) and sigs[k][0] <= c.start():
            stack.append((sigs[k][1], sigs[k][2]))
            k += 1
        while stack and stack[-1][1] <= c.start():
            stack.pop()
        name = c.group(1)
        if c.start() in named or name in _not_called or not stack:
            continue
        line += len(re.findall(r"\r\n|\r|\n", mask[last : c.start()]))
        last = c.start()
        yield stack[-1][0], name, line + 1
