from __future__ import annotations

import random

import numpy as np
import pytest

from orewright.llm import langid as L

BANK = {
    "en": ["The shell panel drops the daily journal before the lock is released.", "A cold shard folds every open bracket with a fixed seed.", "In quiet hours, the reader loop measures the residual error again."],
    "de": ["Der Gitterkern faltet das beschädigte Dateiende hinter dem Zwischenspeicher.", "Ein veralteter Zeiger sperrt die wartenden Anker mit festem Startwert.", "In ruhigen Stunden prüft der Ranglauf das seltenste Wort im Stapel."],
    "es": ["El filtro de resonancia retiene la copia en sombra detrás de la caché.", "Un segmento frío pliega cada paréntesis abierto con una semilla fija.", "En horas tranquilas, el bucle de lectura mide el error residual otra vez."],
    "ru": ["Граф ссылок пропускает дневной журнал до снятия блокировки сегодня.", "Холодный сегмент сворачивает каждую открытую скобку при неизменном зерне.", "В тихие часы, цикл чтения измеряет остаточную ошибку ещё раз."],
    "uk": ["Граф посилань пропускає денний журнал до зняття блокування сьогодні.", "Холодний сегмент згортає кожну відкриту дужку за незмінного зерна.", "У тихі години, цикл читання вимірює залишкову похибку ще раз."],
}


def text(lang, rng, n):
    return " ".join(rng.choice(BANK[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows = [("n", i, text(lang, rng, 3), lang) for i, lang in enumerate(list(BANK) * 30)]
    extra = [
        ("n", 900, text("ru", rng, 3), "uk"), ("n", 901, text("en", rng, 2) + "\n\n" + text("uk", rng, 2), "en"), ("n", 902, text("de", rng, 3), None), ("n", 903, text("es", rng, 3), "??"),
        ("n", 904, "Ok.", "de"), ("n", 905, None, "de"), ("n", 906, "", "de"), ("n", 907, "```\nlet the_value = compute(a, b);\nreturn the_value;\n```", "de"), ("n", 908, text("de", rng, 3), "German"), ("n", 908, text("de", random.Random(4), 3), "Deutsch"),
        ("n", 909, text("uk", rng, 4000), "uk-UA"), ("n", None, text("ru", rng, 3), "en_GB"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows + extra], "src string, item_id bigint, text string, label string, lang string")
    return L.label_texts(df).persist()


def test_cases(labelled, rows):
    want = [("n", 900, "ru"), ("n", 901, "en"), ("n", 901, "uk"), ("n", 902, "de"), ("n", 903, "es"), ("n", None, "ru")]
    assert rows(L.mislabelled(labelled)) == sorted(want, key=repr)


def test_stretches(labelled):
    r = labelled.where("item_id = 901").orderBy("start_char").collect()
    assert [x["lang"] for x in r] == ["en", "uk"] and all(0.5 < x["confidence"] <= 1 for x in r) and r[0]["end_char"] <= r[1]["start_char"]


def test_labels(spark):
    names = {"en": "EN en-US en_GB eng English английский", "uk": "uk UA ukr українська Ukrainian", "de": "Deutsch ger de-AT", "es": "español spa es-MX", "ru": "русский rus"}
    for code, words in names.items():
        df = spark.createDataFrame([(w,) for w in words.split()], "l string")
        assert {r[0] for r in df.select(L.label_language(df["l"])).collect()} == {code}
    df = spark.createDataFrame([(None,), ("",), ("und",), ("??",), ("auto",), ("fr",)], "l string")
    assert {r[0] for r in df.select(L.label_language(df["l"])).collect()} == {None}


def test_held_out_accuracy():
    rng = random.Random(2)
    rows = [(w, k) for k, lang in enumerate(L.LANGUAGES) for s in BANK[lang] for w in (s, s.replace(",", ""), " ".join(s.split()[1:]))]
    rng.shuffle(rows)
    idf = np.ones(1 << L.BITS)
    train, test = rows[:33], rows[33:]
    model = L.Model(idf, *L.ftrl([t for t, _ in train], np.array([k for _, k in train]), idf, epochs=30))
    assert (model.scores([t for t, _ in test]).argmax(1) == [k for _, k in test]).mean() >= 0.9


def test_without_labels(spark, rows):
    df = spark.createDataFrame([("n", 1, "some words that have no label at all", None)], "src string, item_id bigint, text string, label string")
    assert rows(L.label_texts(df)) == [] and rows(L.label_texts(df.limit(0))) == []
