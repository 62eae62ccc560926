"""Whole sentences of a text and quick evidence for their language by script and small words."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Frequent small words of each language. Fixed values.
SMALL_WORDS = {
    "en": "the of and to in is are was were that it its for on with as at by from this which not be has have had or an if when into than then so what how why who can do does we you your there where they them their our only every after before while until but because since my me i could would should without inside behind under",
    "de": "der die das den dem des und in im zu ist sind war mit von für auf nicht ein eine einen einem einer es sich als auch an am bei aus nach vor wie was warum wozu wenn dass daß oder aber so wird werden kann ich du wir sie er zum zur noch nur bis ohne unter hinter jede jeder jedes obwohl weil sobald während",
    "es": "el la los las de del que y en un una unos unas es son con por para no se su sus al lo como más pero si ya o este esta cuando donde qué cómo dónde puedes cuál hay muy sin sobre entre hasta desde tras solo cada detrás aunque porque",
    "ru": "и в во не на что как с со по к из за для от это при до или если чтобы когда где почему так же уже был была его её их то но только после без под ли мы вы он она они можешь каждый каждую хотя потому пока лишь может можно свой",
    "uk": "і й в у не на що як з зі із по до за для від це при або якщо щоб коли де чому так вже був була його її їх то але тільки після без під чи ми ви він вона вони можеш кожен кожну хоча бо адже поки лише та тож може можна доки його свій",
}
_words = {k: frozenset(v.split()) for k, v in SMALL_WORDS.items()}
#: Letters that tell close languages apart. Fixed values.
_LETTERS = {"uk": re.compile("[іїєґ]"), "ru": re.compile("[ыэёъ]"), "de": re.compile("[äöüß]"), "es": re.compile("[ñáíóú¿¡]")}
_cyr, _lat = re.compile("[а-яёіїєґ]+"), re.compile("[a-zäöüßñáéíóú]+")
_head = re.compile(r"#{1,6}\s")
_token = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_fence = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)", re.S | re.M)
_noise = re.compile(r"[\[{][^\n]*\":[^\n]*[\]}]|`[^`\n]*`|\$[^$\n]*\$|https?://\S+|data:\S+|(?<![A-Za-z0-9+/=])[A-Za-z0-9+/=]{40,}|<[^<>\n]{1,80}>|\b[^\W\d_]*+[_\d]\w*+(?:[.:/\\]\w+)*")
_bullet = re.compile(r"^[ \t>]*(?:[-*•+]|\d{1,3}[.)])?[ \t]+", re.M)
_stop = re.compile(r"[.!?…][\"'»”)\]*]*\s+|[\r\n]+")
#: What any noise holds, but for long runs of letters.
_sign = re.compile(r"[\[{`$<_\d/:=+]")


def prose(text: str) -> str:
    """The text without code, formulas, addresses, tags and names with digits or underscores."""
    if not _sign.search(text) and (len(text) < 40 or max(map(len, text.split()), default=0) < 40):
        return _fence.sub("\n", text) if "~~~" in text else text
    return _noise.sub(" ", _fence.sub("\n", text) if "```" in text or "~~~" in text else text)


def each_sentence(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches of `text` that line ends and sentence ends part,
    code blocks and headings left out."""
    blank = _fence.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text) if "```" in text or "~~~" in text else text
    at = 0
    for m in _stop.finditer(blank):
        e = m.start()
        if found := _trimmed(blank, at, e if blank[e] in "\r\n" else e + 1):
            yield found
        at = m.end()
    if found := _trimmed(blank, at, len(blank)):
        yield found


def _trimmed(text: str, s: int, e: int) -> tuple[int, int] | None:
    part = text[s:e]
    bare = part.lstrip()
    if not bare or bare[0] == "#" and _head.match(bare):
        return None
    return s + len(part) - len(bare), s + len(part.rstrip())


def sentences(text: str) -> list[tuple[int, int]]:
    """The stretches of :func:`each_sentence` as a list."""
    return list(each_sentence(text))


def language(sentence: str) -> str | None:
    """The language of a sentence by its script, its letters and its small words, or None."""
    low = (_noise.sub(" ", sentence) if _sign.search(sentence) or len(sentence) >= 40 and max(map(len, sentence.split()), default=0) >= 40 else sentence).lower()
    cyr, lat = sum(map(len, _cyr.findall(low))), sum(map(len, _lat.findall(low)))
    if cyr + lat < 4:
        return None
    score = {}
    tokens = _token.findall(low)
    for k in ("ru", "uk") if cyr > lat else ("en", "de", "es"):
        own = _words[k]
        score[k] = sum([t in own for t in tokens]) + (1.5 * len(_LETTERS[k].findall(low)) if k in _LETTERS else 0)
    best = max(score, key=lambda k: score[k])
    rest = max(v for k, v in score.items() if k != best)
    if score[best] == rest and cyr >= 30 and not _LETTERS["uk"].search(low):
        return "ru"  # so long a stretch of Ukrainian has one of its letters
    return best if score[best] > rest else None
