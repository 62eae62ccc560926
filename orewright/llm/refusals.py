"""A grammar of refusals over lemmas, in five languages.

Words are read as terminals (`LEXICON`): who speaks, negation, ability, what is asked to be
done, declining, rules, limits. A sentence refuses if one of the productions holds:

* agent + negated ability + act (``I am unable to answer``), the three near each other in any order;
* agent + negation + permission + act (``they don't let me answer``), or a short agent + negation + act + request (``I don't discuss this``);
* impossibility + act + (agent or request) (``it is not possible to fulfil this request``);
* agent + declining (``this is something I must decline``), not negated;
* agent + preference + negation (``I would rather not discuss it``);
* rule + (negation + permission, or prohibition) + (agent or act);
* (request or act) + beyond + agent (``this falls outside my remit``);
* agent + leaving + unanswered;
* a bare no (``My apologies, but no.``), or a no said to the request.

The grammar derives a whole answer if each of its sentences refuses, apologises, thanks,
gives a reason, offers other help or names the topic, one refuses, and none brings more
than `NEW_WORDS` words that belong neither to the grammar nor to the question.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from orewright.llm.sentences import SMALL_WORDS

#: Terminals: stems by kind, all languages together; a star stands for any ending. Fixed values.
LEXICON = {
    "agent": "i i'm im we i'd i'll i've we're me my mine our us myself я мне мной меня мы нам нас мой моя моё мои моих моей моего ми мені мене мною нам нас мій моя моє мої моїх моєї мого ich mir mich mein meine meiner meinem meinen meines wir uns unser* yo mi mis me mí nosotros nos nuestr*",
    "first": "могу смогу можем сможем буду будем стану станем вынужден* должен должна обязан* отказываюсь отказываемся отклоняю оставлю оставляю предпочту предпочитаю предпочёл предпочла сумею умею вправе берусь возьмусь хочу желаю готов готова намерен* "
    "можу зможу можемо зможемо змушен* мушу мусимо повинен повинна відмовляюся відмовляюсь відмовляємось відхиляю залишу залишаю волію волів воліла зумію вмію беруся візьмусь хочу бажаю готовий готова маю "
    "puedo podré podremos podemos podría prefiero preferiría debo debemos tengo tenemos dejaré dejo estoy estamos niego rechazo declino quiero quisiera voy vamos lamento siento sé",
    "neg": "not don't doesn't didn't isn't aren't no nor never nothing neither without не нет ни нечего ничего никак никогда ані ні немає нічого ніяк ніколи nicht nichts kein keine keinen keinem keiner keinerlei nie niemals no ni nunca nada tampoco sin",
    "able": "can could able will would shall may might allowed permitted authorised authorized position possible going willing free equipped supposed designed entitled capable ready comfortable inclined prepared way "
    "могу смогу можем сможем мочь буду будем стану станем состоянии вправе возможно можно получится получается выйдет удастся сумею умею готов готова готовы уполномочен* разрешено позволено намерен* берусь возьмусь хочу желаю "
    "можу зможу можемо зможемо буду будемо стану станемо змозі стані вправі можливо можна вийде вдасться зумію вмію готовий готова дозволено уповноважен* маю беруся візьмусь хочу бажаю "
    "kann können könnte könnten darf dürfen dürfte werde werden lage imstande möglich befugt berechtigt erlaubt gestattet möchte möchten will wollen bereit autorisiert vermag mag "
    "puedo podré podremos podemos podría podríamos posible posibilidad condiciones autorizad* capaz permitid* voy vamos dispuest* facultad* habilitad* quiero sé",
    "unable": "cannot can't won't couldn't wouldn't shan't mustn't unable incapable impossible forbidden prohibited нельзя невозможно запрещено неможливо заборонено unmöglich außerstande ausserstande untersagt verboten imposible incapaz impide* prohibido prohibida",
    "impossible": "получится получается выйдет удастся возможно невозможно нельзя можно вийде вдасться можливо неможливо можна possible impossible möglich unmöglich posible imposible",
    "act": "help helping assist assisting assistance answer answering comply complying provide providing discuss discussing share sharing say saying tell telling give giving talk talking speak respond responding reply fulfil fulfill fulfilling support continue offer offering do doing serve oblige engage advise comment commenting disclose reveal explain handle process proceed address accommodate satisfy grant deal into "
    "помо* ответ* отвеча* выполн* предостав* обсужд* обсуд* сдела* дела* дать давать говор* сказ* сообщ* рассказ* поясн* объясн* предлож* раскры* комментир* консультир* исполн* поддерж* подсказ* удовлетвор* "
    "допом* відпов* викон* нада* обговор* зроб* роби* дати давати говор* сказ* повідом* розпов* поясн* запропон* розкри* коментув* підтрим* підказ* задовольн* "
    "helfen hilfe weiterhelfen behilflich antworten beantwort* nachkommen erfüllen liefern sagen bereitstellen anbieten dienen tun geben besprechen sprechen reden erörtern erklären mitteilen teilen preisgeben äußern auskunft erzähl* unterstütz* entsprechen bearbeiten beraten eingehen nennen verraten "
    "ayud* responder* responde* contest* cumpl* ofrec* habl* dar darte darle proporcion* atend* facilit* decir decirte contar contarte coment* trat* entrar explic* compart* revel* apoy* hacer hacerlo satisfac* opinar brindar complacer",
    "decline": "decline declining declined refuse refusing refused reject pass abstain refrain deny withhold отказ* отклон* откаж* воздерж* відмов* відхил* утрима* ablehn* zurückweis* verweiger* weigere passen absag* enthalten declin* rechaz* negarme negar niego rehús* rehus* abstener* abstengo",
    "split_decline": "lehne lehnen weise weisen",
    "particle": "ab zurück",
    "prefer": "rather prefer sooner предпоч* лучше волі* краще радше lieber bevorzug* prefiero preferir* preferimos",
    "request": "request question query this that it one topic subject matter ask anything such something these those просьб* запрос* вопрос* это этого этому этим этом такое такого таком тему тема теме прохан* запит* питан* це цього цьому цим таке такого тему anfrage bitte frage das dies diese dieses diesem dazu dabei damit darauf darüber daran hierzu hierbei thema solches derartiges ello eso esto esta esa petición solicitud pregunta consulta tema tal cosa asunto",
    "noun": "request question query topic subject просьб* запрос* вопрос* тем* прохан* запит* питан* anfrage bitte frage thema petición solicitud pregunta consulta tema",
    "beyond": "beyond outside exceeds exceed exceeding за вне пределами выходит поза межами виходить außerhalb übersteigt überschreitet jenseits fuera excede sobrepasa supera",
    "scope": "scope remit ability abilities capabilities capability competence limits limit authority expertise purview range power powers allowed permitted рамк* компетенц* предел* полномочи* возможност* дозволен* межі меж компетенц* повноважен* можливост* дозволен* rahmen befugnis* kompetenz* möglichkeiten zuständigkeit* fähigkeiten grenzen bereich* alcance competencia* límites facultades capacidad* permitido ámbito",
    "rule": "guidelines guideline rules rule policy policies instructions principles правил* политик* инструкци* принцип* указани* правил* політик* інструкці* настанов* richtlinien regeln vorgaben vorschriften grundsätze anweisungen normas reglas políticas política pautas directrices instrucciones principios",
    "permit": "permit permits allow allows let lets допуск* позвол* разреш* дозвол* допуска* lassen lässt erlauben erlaubt gestatten gestattet zulassen zu admiten admite permiten permite dejan deja autorizan",
    "forbid": "forbid forbids prohibit prohibits prevent prevents bar bars запреща* заборон* verbieten verbietet untersagen untersagt hindern prohíben prohíbe impiden impide",
    "leave": "leave leaving оставл* остав* залиш* lasse lassen bleibt dejaré dejar dejo queda",
    "unanswered": "unanswered unaddressed ответа відповіді unbeantwortet respuesta contestar responder",
    "no": "no nope nah nein нет ні nein",
}
#: Words of apologies, thanks, reasons, offers and advice. Fixed values.
ASIDE = (
    "sorry apolog* unfortunately regret* afraid thank thanks understand see appreciate assistant ai model helper lack access unsafe safe risk* harm* sensitive internal confidential private please contact consult try colleague* else happy glad let know time moment now instead expert specialist support team forgive pardon excuse interest curiosity option choice "
    "боюсь сожален* жал* прост* извин* прощен* спасибо благодар* понима* помощник ассистент небезопасн* опасн* доступ* обрат* обращ* коллег* еще ещё момент* чем-то другим иным пожалуйста специалист* интерес* внутренн* конфиденциальн* выбор* "
    "боюся боюсь жаль вибач* пробач* перепрош* дяку* розумі* помічник асистент небезпечн* доступ* зверн* колег* ще іще мить момент* чимось іншим ласка фахівц* інтерес* внутрішн* конфіденційн* вибор* "
    "leider leid verzeih* entschuldig* nachsicht danke dank verstehe verständnis assistent helfer unsicher gefährlich zugriff zugang wende wenden kollegen team sonst moment zeitpunkt bedau* interesse fachleute gerne intern* vertraulich* wahl "
    "lo siento disculp* perdón perdon* desgracia lament* gracias entiendo comprendo asistente insegur* peligros* acceso consult* equipo algo momento ahora interés compañer* especialista gusto intern* confidencial* remedio opción"
)
#: Words of a sentence that neither the grammar nor the question knows, at most.
NEW_WORDS = 4
_BITS = {k: 1 << i for i, k in enumerate([*LEXICON, "aside", "small"])}
_exact: dict[str, int] = {}
_stems: dict[str, int] = {}
for _kind, _text in [*LEXICON.items(), ("aside", ASIDE), ("small", " ".join(SMALL_WORDS.values()))]:
    for _w in _text.split():
        _into = _stems if _w.endswith("*") else _exact
        _into[_w.rstrip("*")] = _into.get(_w.rstrip("*"), 0) | _BITS[_kind]
_longest = max(map(len, _stems))
_memo: dict[str, int] = {}


def kinds(word: str) -> int:
    """The terminals a lower-case word can be, as bits."""
    found = _memo.get(word)
    if found is None:
        found = _exact.get(word, 0)
        for n in range(3, min(len(word), _longest) + 1):
            found |= _stems.get(word[:n], 0)
        if len(_memo) > 200_000:
            _memo.clear()
        _memo[word] = found
    return found


_b = _BITS
_HARD = _b["neg"] | _b["unable"] | _b["decline"] | _b["split_decline"] | _b["beyond"] | _b["forbid"] | _b["unanswered"] | _b["no"]
_token = re.compile(r"\w+(?:['’\-]\w+)*")
_parts = re.compile(r"(?<=[.!?…])[\"'»”)\]*_]*\s+|\n+|(?<=\w[:;])\s+|\s+[–—-]\s+")


def _at(word_kinds: list[int], kind: str) -> list[int]:
    bit = _b[kind]
    return [i for i, k in enumerate(word_kinds) if k & bit]


def _near(one: list[int], two: list[int], reach: int) -> bool:
    return any(abs(i - j) <= reach for i in one for j in two)


def refuses(words: list[str]) -> bool:
    """Whether a production of refusals derives a sentence of these lower-case words."""
    ks = [kinds(w) for w in words]
    every = 0
    for k in ks:
        every |= k
    if not every & _HARD:
        return False
    has = {k: bool(every & bit) for k, bit in _b.items()}
    agent = sorted({*_at(ks, "agent"), *_at(ks, "first"), *([0] if ks[0] & _b["unable"] else [])})
    neg, act, request = _at(ks, "neg"), _at(ks, "act"), _at(ks, "request")
    blocked = [*_at(ks, "unable"), *(i for i in _at(ks, "able") if any(-2 <= i - j <= 6 or 0 <= j - i <= 6 for j in neg))]
    if any(_near([p], agent, 6) and any(-7 <= q - p <= 9 and q != p for q in act) for p in blocked):
        return True
    if _near(neg, [*_at(ks, "permit")], 3) and agent and act and not has["rule"]:
        return True
    if agent and any(_near([p], agent, 5) and any(0 < q - p <= 2 for q in act) for p in neg) and any(k & (_b["noun"] | _b["request"]) for k in ks[len(ks) // 2 :]) and len(words) <= 9:
        return True
    closed = [i for i in _at(ks, "impossible") if ks[i] & _b["unable"] or any(abs(i - j) <= 2 for j in neg)]
    if closed and any(abs(q - p) <= 8 and q != p for p in closed for q in act) and (agent or _at(ks, "noun")):
        return True
    declined = [*_at(ks, "decline"), *(i for i in _at(ks, "split_decline") if any(ks[j] & _b["particle"] for j in range(i + 1, len(ks))))]
    if declined and _near(declined, agent, 7) and not any(0 < p - j <= 2 for p in declined for j in neg):
        return True
    if has["prefer"] and neg and agent and (act or request) and _near(_at(ks, "prefer"), neg, 5):
        return True
    if has["rule"] and (agent or any(words[i] != "do" for i in act)) and (has["forbid"] or has["permit"] and neg and _near(_at(ks, "permit"), neg, 4)):
        return True
    if has["beyond"] and (act or request) and _near(_at(ks, "beyond"), agent, 6):
        return True
    if has["leave"] and has["unanswered"] and agent and (has["neg"] or "unanswered" in words or "unbeantwortet" in words or "без" in words):
        return True
    refusing = [i for i, k in enumerate(ks) if k & _b["no"] and words[i] not in ("нет", "no") or words[i] in ("no", "нет") and (i + 1 == len(words) or i == 0 or words[i - 1] in ("say", "decir", "but", "pero", "но", "say"))]
    if refusing:
        others = [k for i, k in enumerate(ks) if i not in refusing]
        if all(k & (_b["aside"] | _b["small"] | _b["agent"]) for k in others) and len(words) <= 8:
            return True
        if _near(refusing, act, 8) and (agent or neg and request):
            return True
    return False


def _each_part(answer: str) -> Iterator[str]:
    at = 0
    for m in _parts.finditer(answer):
        yield answer[at : m.start()]
        at = m.end()
    yield answer[at:]


def is_refusal(question: str | None, answer: str) -> bool:
    """Whether the grammar derives the whole answer."""
    own: set[str] | None = None
    refused = False
    topics = 0
    for part in _each_part(answer):
        words = _token.findall(part.lower().replace("’", "'"))
        if not words:
            continue
        ks = [kinds(w) for w in words]
        if own is None and not all(ks):
            own = {w[:5] for w in _token.findall((question or "").lower())}
        new = [w for w, k in zip(words, ks, strict=True) if not k and w[:5] not in own] if not all(ks) else []
        if len(new) <= NEW_WORDS and refuses(words):
            refused = True
        elif len(new) <= NEW_WORDS and any(k & _b["aside"] for k in ks) and len(words) <= 18:
            continue
        elif not refused and not topics and len(words) <= 8 and (not new or answer.startswith(part) and part != answer and part.rstrip()[-1:] not in ".!?"):
            topics += 1
        elif refused and all(k & (_b["small"] | _b["aside"] | _b["agent"] | _b["request"] | _b["act"]) for k in ks) and len(words) <= 6:
            continue
        else:
            return False
    return refused


__all__ = ["LEXICON", "is_refusal", "kinds", "refuses"]
