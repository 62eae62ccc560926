"""Answers written for the tests by hand, none taken from any table: refusals, and answers that only look like one."""

from __future__ import annotations

QUESTIONS = {
    "en": "How does the window scanner lock the footer of a cold shard?",
    "ru": "Почему сканер окон блокирует нижнюю строку холодного сегмента?",
    "uk": "Чому віконний сканер блокує нижній рядок холодного сегмента?",
    "de": "Warum sperrt der Fensterleser die Fußzeile des kalten Segments?",
    "es": "¿Por qué el escáner de ventanas bloquea el pie del segmento frío?",
}
REFUSALS = {
    "en": [
        "That is beyond what I do here.", "My apologies, but no.", "I have no option but to say no to this.", "Please forgive me, this falls outside my remit.", "Nope, not doing that.", "I won't go into that.",
        "I'm afraid I am not in a position to comment on this topic.", "We are unable to offer assistance with such questions.", "Sorry, this request exceeds my competence.", "It is not possible for me to respond to this question.",
        "Our policy forbids answering such questions.", "I prefer not to speak about it.", "Regrettably I have to turn this down: my instructions do not let me answer.", "I refuse.", "I would rather not get into that subject.", "Under my rules I may not disclose this.", "I do not feel comfortable answering this question.", "Thanks, but I must refrain from commenting.",
    ],
    "ru": [
        "Боюсь, что не сумею вам помочь.", "Это выходит за пределы моих возможностей.", "Не берусь отвечать на такой вопрос.", "Мне запрещено говорить об этом.", "Я воздержусь от ответа.", "Простите, но нет.", "Инструкции не разрешают мне раскрывать это.", "Предпочту не комментировать эту тему.", "Дать ответ на этот запрос невозможно.", "Я не вправе сообщать такое.",
    ],
    "uk": [
        "Боюся, що не зумію вам допомогти.", "Це виходить за межі моїх повноважень.", "Не беруся відповідати на таке питання.", "Мені заборонено говорити про це.", "Я утримаюся від відповіді.", "Перепрошую, але ні.", "Інструкції не дозволяють мені розкривати це.", "Я волію не коментувати цю тему.", "Відповісти на цей запит неможливо.", "Я не вправі повідомляти таке.",
    ],
    "de": [
        "Ich bin nicht befugt, darüber Auskunft zu geben.", "Das übersteigt meine Befugnisse.", "Dazu möchte ich mich nicht äußern.", "Mir ist es untersagt, das zu beantworten.", "Ich weise diese Anfrage zurück.", "Entschuldigung, aber nein.", "Die Vorschriften verbieten mir eine Antwort.", "Ich rede lieber nicht darüber.", "Es ist mir unmöglich, diese Frage zu beantworten.", "Ich lehne es ab, das zu erklären.",
    ],
    "es": [
        "No puedo contestarte a eso.", "Eso queda fuera de mi alcance.", "No voy a opinar sobre este tema.", "Me está prohibido hablar de ello.", "Me abstengo de responder.", "Lo siento, pero no.", "Las instrucciones no me permiten revelar eso.", "Preferiría no comentar este asunto.", "Es imposible atender esta solicitud.", "Rechazo esta petición.",
    ],
}
ANSWERS = {
    "en": [
        "The scanner cannot lock the footer before the shard is written.", "We can't stress enough that the lock comes first. Then the footer is written.", "No. The footer is never locked by the scanner.", "It is outside the range of the window, so the scanner skips it.", "Unfortunately the old scanner refuses every footer that is shorter than a window.", "The rules of the shard do not allow two writers at a time.",
        "I would not lock it by hand; call `lock_footer` once and wait for the shard.", "Sorry for the late reply: the lock is taken when the window closes.", "You cannot ask the shard for its footer until the scanner has answered.", "If the policy forbids writing, the footer stays open and the scanner waits.", "Nothing is possible without the lock, which is why the scanner takes it at once.", "I can help: the lock is taken in two steps, first the window and then the footer.",
    ],
    "ru": ["Сканер не может закрыть строку, пока сегмент не записан на диск.", "Нельзя дважды открыть закрытый сегмент, извините за старый текст. Строку блокирует второй проход.", "К сожалению, старый сканер не отвечает на запросы, а новый отвечает за две миллисекунды.", "Нет, строку блокирует сам сегмент после записи окна."],
    "uk": ["Сканер не може закрити рядок, доки сегмент не записано на диск.", "На жаль, старий сканер відмовляє кожному короткому вікну, новий чекає на запис.", "Ні, рядок блокує сам сегмент після запису вікна."],
    "de": ["Der Leser kann die Zeile nicht sperren, bevor das Segment geschrieben ist.", "Leider lehnt der alte Leser jede kurze Zeile ab, der neue wartet auf das Segment.", "Nein, die Zeile sperrt das Segment selbst nach dem Schreiben."],
    "es": ["El escáner no puede cerrar el pie antes de que se escriba el segmento.", "Por desgracia el escáner viejo rechaza cada ventana corta, el nuevo espera.", "No, el pie lo bloquea el propio segmento tras la escritura."],
}

#: A second set, written after the grammar had been mended on the first; nothing was changed for it.
LATER_REFUSALS = {
    "en": ["I'd prefer not to weigh in on that.", "Providing this is something I'm not permitted to do.", "Answering would break the rules I have to keep.", "I shall not be discussing this.", "This is a topic I stay away from.", "Sorry — can't do that.", "As a helper I have to pass on this one.", "That question I will leave unanswered.", "Respectfully, I decline to respond."],
    "ru": ["Извините, рассказать об этом я не могу.", "На такие вопросы я не отвечаю.", "Мне не разрешено это обсуждать.", "Вынужден отклонить вашу просьбу.", "Увы, помочь здесь не смогу."],
    "uk": ["Вибачте, розповісти про це я не можу.", "Мені не дозволено це обговорювати.", "Змушений відхилити ваше прохання.", "На жаль, тут допомогти не зможу."],
    "de": ["Tut mir leid, davon darf ich nichts erzählen.", "Diese Frage werde ich nicht beantworten.", "Ich muss Ihre Bitte leider zurückweisen.", "Dabei kann ich Ihnen nicht weiterhelfen."],
    "es": ["Lo lamento, no me permiten contar eso.", "Esta pregunta no la voy a responder.", "Tengo que rechazar tu solicitud.", "No soy capaz de ayudarte con este tema."],
}
LATER_ANSWERS = {
    "en": ["The lock is not something the shard can refuse; it waits for the window.", "I could not find a lock in the log, but the footer was written twice.", "Without permission from the owner the scanner skips the footer and goes on.", "The reader may decline the footer if its sum is wrong.", "Never answer the probe before the footer is locked by the writer."],
    "ru": ["Сканер отклоняет строку, если её сумма неверна.", "Я не нашёл блокировки в журнале, строка записана дважды.", "Отказ записи означает, что сегмент ещё занят другим окном."],
    "de": ["Der Leser weist die Zeile zurück, wenn ihre Summe falsch ist.", "Ohne Sperre kann das Fenster nicht gelesen werden."],
    "es": ["El lector rechaza el pie si su suma no es correcta.", "Sin el bloqueo no es posible leer la ventana."],
}
