"""Stemming, intent and masking of single strings, for the Arrow functions of :mod:`language`."""

from __future__ import annotations

import re

from orewright.operators.text import CARD, EMAIL, IP, PHONE, SECRET

#: Endings of Cyrillic word forms. Fixed values.
CYRILLIC_ENDINGS = (
    "уватися уються уватиму увалися уватиме иться еться утися атся ували увала увало уємо еннями еннях аннях ового енями ення ання ень нями "
    "ими ыми ейший ого ому ові еві ами ями ої ою ею ію ія ії ією ів ов ей ой ом ем ам ям ах ях ую ий ый ая яя ое ти ся сь ші ше и і а я у ю е о ь є"
).split()
_by_length = sorted(set(CYRILLIC_ENDINGS), key=lambda e: -len(e))
_cyr = re.compile("[Ѐ-ӿ]")


def stem(token: str) -> str:
    """Cyrillic words lose up to two endings, the stem keeping three letters; ASCII words are stemmed as English."""
    if not _cyr.search(token):
        return english(token) if token.isascii() and token.isalpha() else token
    for _ in range(2):
        if len(token) < 5:
            break
        end = next((e for e in _by_length if token.endswith(e) and len(token) - len(e) >= 3), None)
        if end is None:
            break
        token = token[: -len(end)]
    return token


_V = "aeiouy"
#: Words with stems of their own. Fixed values.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic".split()


def _regions(w: str) -> tuple[int, int]:
    m = re.match("gener|commun|arsen", w)
    if m:
        r1 = m.end()
    else:
        m = re.search(f"[{_V}][^{_V}]", w)
        r1 = m.end() if m else len(w)
    m = re.search(f"[{_V}][^{_V}]", w[r1:])
    return r1, r1 + m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return re.search(f"(^[{_V}][^{_V}]|[^{_V}][{_V}][^{_V}wxY])$", w) is not None


def english(word: str) -> str:
    """The stem of an English word by the second Porter algorithm."""
    w = word.lower()
    if len(w) <= 2:
        return w
    if w in SPECIAL:
        return SPECIAL[w]
    w = re.sub(f"(^|[{_V}])y", lambda m: m.group(1) + "Y", w)
    r1, r2 = _regions(w)
    # plural and past
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}].", w[:-1]):
        w = w[:-1]
    if w.lower() in KEPT:
        return w.lower()
    if w.endswith(("eedly", "eed")):
        end = 5 if w.endswith("eedly") else 3
        if len(w) - end >= r1:
            w = w[: len(w) - end] + "ee"
    else:
        m = re.search("(ingly|edly|ing|ed)$", w)
        if m and re.search(f"[{_V}]", w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                w = w[:-1]
            elif _short_end(w) and r1 >= len(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for s, by in STEP2.items():
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + by
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for s, by in STEP3.items():
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + by
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for s in STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2:
                w = w[: -len(s)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


#: Words that tell a query for code from one for prose. Fixed values.
CODE_WORDS = frozenset("func fn def class struct enum impl trait interface type pub priv private protected static const let var return async await package import module void typedef inline extern override virtual template namespace using new delete self this super constructor destructor".split())
QUESTIONS = frozenset("how what why where who when which как что где почему кто когда сколько зачем чем чему".split())
DOC_WORDS = frozenset("readme changelog install uninstall guide tutorial manual documentation license architecture introduction overview example описание установка инструкция документация справка руководство".split())


def intent(query: str | None) -> str | None:
    """``prose``, ``code`` or ``neutral`` by the shape and words of a query."""
    if query is None:
        return None
    if _cyr.search(query):
        return "prose"
    if re.search(r"[A-Za-z_]\w*\(", query):
        return "code"
    words = [x for w in query.split() if (x := re.sub(r"[^A-Za-z0-9_]", "", w).lower())]
    if any(w in CODE_WORDS for w in words):
        return "code"
    if any(w in QUESTIONS or w in DOC_WORDS for w in words):
        return "prose"
    return "prose" if len(words) >= 3 and not any("_" in w for w in words) else "neutral"


_classes = [(re.compile(p, re.ASCII), label) for p, label in ((SECRET, "[SECRET]"), (EMAIL, "[EMAIL]"), (IP, "[IP]"), (PHONE, "[PHONE]"), (CARD, "[CARD]"))]


def mask(text: str) -> str:
    spans = []
    for rx, label in _classes:
        for m in rx.finditer(text):
            if label != "[PHONE]" or sum(c.isdigit() for c in m.group()) >= 9:
                spans.append((m.start(), -m.end(), label))
    out, last = [], 0
    for s, e, label in sorted(spans, key=lambda x: x[:2]):
        if s >= last:
            out += [text[last:s], label]
            last = -e
    return "".join(out) + text[last:]
