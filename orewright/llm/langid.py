"""Languages of texts and of their stretches, with calibrated confidence.

The model is a sparse multinomial logistic regression on TF-IDF of hashed character
n-grams (1 to 4). Document frequencies are counted over all texts. The weights are learnt
by follow-the-regularised-leader with elastic-net penalties on whole sentences of a
bounded sample of labelled rows (`ROWS_PER_LANGUAGE`, chosen by hash); sentences that a
first model puts clearly elsewhere are left out of the second, as labels are noisy. A
temperature is then fitted on sentences held out. The model's size is fixed, so it is
sent to the executors whatever the size of the data.

Every sentence of every text is classified; neighbours of one language make a stretch.
Code, formulas, addresses, headings and stretches of fewer than four words have no
language of their own; where a text has no other, it is classified as one stretch.

Defined results for odd input: null texts and texts with fewer than `LEAST_LETTERS`
letters give no row; a label is compared by language, whatever its spelling, and one that
names none of the five known languages counts as missing; without labelled rows all five
languages are equally likely and nothing is reported; double rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orewright.llm.sentences import each_sentence, prose
from orewright.session import materialize

LANGUAGES = ("de", "en", "es", "ru", "uk")
#: Hashed features, n-gram lengths, letters a text needs, rows of each language to learn from.
BITS, LENGTHS, LEAST_LETTERS, ROWS_PER_LANGUAGE = 16, (1, 2, 3, 4), 20, 500
#: Texts that are scored in one go.
AT_ONCE = 256
#: Names and codes of the languages. Fixed values.
LABELS = {
    "de": "de deu ger german deutsch alemán aleman немецкий німецька germanisch",
    "en": "en eng english englisch inglés ingles английский англійська",
    "es": "es spa spanish español espanol castellano castilian spanisch испанский іспанська cast",
    "ru": "ru rus russian русский russisch ruso російська русская русск",
    "uk": "uk ukr ua ukrainian українська украинский ukrainisch ucraniano українська_мова укр",
}
_label = {w: k for k, v in LABELS.items() for w in v.split()}


def label_language(label: Column) -> Column:
    """The language code a label stands for in any usual spelling, or null."""
    plain = F.lower(F.regexp_replace(F.trim(label), r"\s*\(.*\)$|\s+(language|язык|мова|sprache)$", ""))
    known = F.create_map(*[F.lit(x) for kv in _label.items() for x in kv])
    return F.coalesce(known[plain], known[F.regexp_extract(plain, r"^([^\W_]+)[-_]", 1)])


_words = re.compile(r"[^\W\d_]{2,}")
_letter = re.compile(r"[^\W\d_]|['’]")


@cache
def _letter_codes() -> np.ndarray:
    """Which code points of the basic plane belong to words; those beyond it don't."""
    return np.array([bool(_letter.match(chr(c))) for c in range(0xFFFF)] + [False])


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length the hashed n-grams of all texts in order, and how many each text has.
    Words count in small letters, whatever stands between them as one blank."""
    joined = "".join(f" {t.lower()} \x00" for t in (t.replace("\x00", " ") for t in texts))
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = ~_letter_codes()[np.minimum(codes, 0xFFFF)] & (codes != 0)
    codes = np.where(blank, np.uint32(32), codes)
    codes = codes[~(blank & np.roll(blank, 1))].astype(np.uint64)
    ends = np.flatnonzero(codes == 0)
    size = np.diff(ends, prepend=-1) - 1
    h = np.zeros(len(codes), np.uint64)
    alive = np.ones(len(codes), bool)
    for n in range(1, max(LENGTHS) + 1):
        h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
        alive = alive[: len(h)] & (codes[n - 1 :] != 0)
        if n in LENGTHS:
            x = h[alive]
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            yield (x >> np.uint64(64 - BITS)).astype(np.int32), np.maximum(size - n + 1, 0)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all lengths, text by text, and the number of each text's."""
    parts = list(grams(texts))
    own = np.concatenate([np.repeat(np.arange(len(texts)), c) for _, c in parts])
    return np.concatenate([x for x, _ in parts])[np.argsort(own, kind="stable")], sum(c for _, c in parts)


_COUNTED = "bucket int, df bigint, lang string, h bigint, text string"


def _counter(per_language: int):
    """One pass over a partition: in how many texts each hashed n-gram stands (bucket -1: the texts),
    and of every language the rows of the least hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        kept = pd.DataFrame({"lang": [], "h": [], "text": []})
        for pdf in batches:
            texts = pdf["text"].tolist()
            for at in range(0, len(texts), 100):
                part = texts[at : at + 100]
                seen = np.zeros((len(part), 1 << BITS), bool)
                for idx, count in grams(part):
                    seen[np.repeat(np.arange(len(part)), count), idx] = True
                total += seen.sum(0)
                n += len(part)
            labelled = pdf.loc[pdf["lang"].notna(), ["lang", "h", "text"]]
            kept = labelled if kept.empty else pd.concat([kept, labelled])
            kept = kept.sort_values("h", kind="stable").groupby("lang").head(per_language)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": np.append(at, -1), "df": np.append(total[at], n), "lang": None, "h": 0, "text": None})
        if len(kept):
            yield kept.assign(bucket=-2, df=0)[["bucket", "df", "lang", "h", "text"]]

    return run


def counts_and_sample(rows: DataFrame, per_language: int) -> tuple[np.ndarray, list[tuple[str, str]]]:
    """IDF of every hashed n-gram over all `rows` (text, lang), and (text, lang) of the `per_language` rows of
    the least hashes of each language, from one pass."""
    counted = materialize(rows.select("text", "lang", F.xxhash64("text").alias("h")).mapInPandas(_counter(per_language), _COUNTED), "language-counts")
    df = counted.where("bucket >= -1").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    idf = np.zeros(1 << BITS)
    n = df.loc[df["bucket"] == -1, "df"].sum()
    df = df[df["bucket"] >= 0]
    idf[:] = np.log(1.0 + n)
    idf[df["bucket"].to_numpy(int)] = np.log((1.0 + n) / (1.0 + df["df"].to_numpy(float))) + 0.1
    least = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = counted.where("bucket = -2").withColumn("rn", least).where(F.col("rn") <= per_language).select("lang", "rn", "text").collect()
    return idf, [(r["text"], r["lang"]) for r in sorted(picked, key=lambda r: (r["lang"], r["rn"]))]


class Model:
    """Weights (already times IDF), bias and temperature."""

    def __init__(self, idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.idf2 = (idf**2).astype(np.float32)
        self.weights = (idf[:, None] * weights).astype(np.float32)
        self.bias, self.temperature = bias, temperature

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.scores_and_sizes(texts)[0]

    def scores_and_sizes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the languages, and the characters that were read; `AT_ONCE` texts at a time stay in the caches."""
        parts = [self._scored(texts[at : at + AT_ONCE]) for at in range(0, len(texts), AT_ONCE)]
        if not parts:
            return np.zeros((0, len(LANGUAGES))), np.ones(0)
        return np.concatenate([s for s, _ in parts]), np.concatenate([n for _, n in parts])

    def _scored(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        size = np.ones(len(texts))
        total, norm = np.zeros((len(texts), len(LANGUAGES))), np.full(len(texts), 1e-9)
        for n, (idx, count) in zip(LENGTHS, grams(texts), strict=True):
            if n == 1:
                size = np.maximum(count, 1)
            has = np.flatnonzero(count)
            if len(has):
                at = np.concatenate([[0], np.cumsum(count[has])[:-1]])
                total[has] += np.add.reduceat(self.weights[idx], at, axis=0)
                norm[has] += np.add.reduceat(self.idf2[idx], at)
        return total / np.sqrt(norm)[:, None] + self.bias, size

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return softmax(self.scores(texts) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def ftrl(texts: list[str], y: np.ndarray, idf: np.ndarray, epochs: int = 4, batch: int = 32, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.0005, l2: float = 0.0005) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal with elastic-net penalties."""
    k, rng = len(LANGUAGES), np.random.default_rng(7)
    z, n, w = (np.zeros((1 << BITS, k)) for _ in range(3))
    bias, nb = np.zeros(k), np.full(k, 1e-6)
    idx, count = features(texts)
    at = np.concatenate([[0], np.cumsum(count)])
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for b in range(0, len(order), batch):
            rows = order[b : b + batch]
            f = np.concatenate([idx[at[r] : at[r + 1]] for r in rows])
            own = np.repeat(np.arange(len(rows)), count[rows])
            uniq, inv = np.unique(f, return_inverse=True)
            weight = idf[f]
            x = np.bincount(own * len(uniq) + inv, weights=weight, minlength=len(rows) * len(uniq)).reshape(len(rows), -1)
            x /= np.sqrt(np.bincount(own, weights=weight**2, minlength=len(rows)))[:, None] + 1e-9
            p = softmax(x @ w[uniq] + bias)
            p[np.arange(len(rows)), y[rows]] -= 1.0
            g = x.T @ p
            sigma = (np.sqrt(n[uniq] + g**2) - np.sqrt(n[uniq])) / alpha
            z[uniq] += g - sigma * w[uniq]
            n[uniq] += g**2
            zu = z[uniq]
            w[uniq] = np.where(np.abs(zu) <= l1, 0.0, -(zu - np.sign(zu) * l1) / ((beta + np.sqrt(n[uniq])) / alpha + l2))
            gb = p.sum(0)
            nb += gb**2
            bias -= alpha * gb / (beta + np.sqrt(nb))
    return w, bias


def calibrate(model: Model, texts: list[str], y: np.ndarray) -> float:
    """The temperature with the least log loss on held-out sentences, 0.25 at least: where
    the model separates them all, a lower one would only claim certainty."""
    s = model.scores(texts)

    def loss(t: float) -> float:
        p = softmax(s / t)[np.arange(len(y)), y]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    grid = np.exp(np.linspace(np.log(0.25), np.log(5.0), 60))
    return float(min(grid, key=loss)) if len(y) else 1.0


_enough = re.compile(rf"(?:[\W\d_]*+[^\W\d_]){{{LEAST_LETTERS}}}")


def whole_sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, prose) of the stretches of `text` that can show a language: four words or more."""
    return [(s, e, p) for s, e in each_sentence(text) if len(_words.findall(p := prose(text[s:e]))) >= 4]


def train(rows: DataFrame, per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """A model from `rows` (text, lang), IDF counted over all of them; None without labelled rows."""
    idf, picked = counts_and_sample(rows, per_language)
    sents, y = [], []
    for text, lang in picked:
        for _, _, p in whole_sentences(text):
            sents.append(p)
            y.append(LANGUAGES.index(lang))
    if not sents:
        return None
    label = np.array(y)
    order = np.random.default_rng(3).permutation(len(sents))
    sents, label = [sents[i] for i in order], label[order]
    first = Model(idf, *ftrl(sents, label, idf, epochs=2))
    fits = first.probabilities(sents)[np.arange(len(sents)), label] >= 0.5
    sents, label = [s for s, ok in zip(sents, fits, strict=True) if ok], label[fits]
    held = max(1, len(sents) // 5)
    model = Model(idf, *ftrl(sents[held:], label[held:], idf))
    model.temperature = calibrate(model, sents[:held], label[:held])
    return model


#: Log-odds that a change of language between neighbouring sentences must outweigh.
CHANGE = 2.5


def smooth(p: np.ndarray) -> np.ndarray:
    """The likeliest languages of successive sentences, changes being rare (Viterbi)."""
    best = p.argmax(1)
    if (best == best[0]).all():
        return best
    logp = np.log(np.maximum(p, 1e-9))
    score, back = logp[0], []
    for row in logp[1:]:
        best = int(score.argmax())
        stay = score >= score[best] - CHANGE
        back.append(np.where(stay, np.arange(len(score)), best))
        score = np.where(stay, score, score[best] - CHANGE) + row
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def stretches(spans: list[tuple[int, int, str]], p: np.ndarray, size: np.ndarray) -> list[tuple[int, int, str, float]]:
    """(start, end, language, confidence) of the stretches, from the sentences' probabilities."""
    out: list[list] = []
    if not spans:
        return []
    for (s, e, _), q, k, n in zip(spans, p, smooth(p), size, strict=True):
        if out and out[-1][2] == k:
            out[-1][1] = e
            out[-1][3] += float(q[k]) * n
            out[-1][4] += n
        else:
            out.append([s, e, k, float(q[k]) * n, n])
    return [(s, e, LANGUAGES[k], c / n) for s, e, k, c, n in out]


_STRETCHES = "src string, item_id bigint, label string, start_char int, end_char int, lang string, confidence double, langs array<string>"


def _classifier(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            texts = pdf["text"].tolist()
            spans = []
            for t in texts:
                own = whole_sentences(t) if _enough.match(t) else None
                if own == [] and len(_words.findall(p := prose(t))) >= 2:
                    own = [(0, len(t), p)]
                spans.append(own or [])
            score, size = model.scores_and_sizes([p for own in spans for *_, p in own])
            prob = softmax(score / model.temperature) if len(score) else score
            rows, at = [], 0
            for src, item, label, own in zip(pdf["src"], pdf["item_id"], pdf["label"], spans, strict=True):
                found = stretches(own, prob[at : at + len(own)], size[at : at + len(own)])
                at += len(own)
                langs = sorted({x[2] for x in found})
                rows += [(src, item, label, *x, langs) for x in found]
            yield pd.DataFrame(rows, columns=["src", "item_id", "label", "start_char", "end_char", "lang", "confidence", "langs"])

    return run


def label_texts(items: DataFrame) -> DataFrame:
    """Stretches of `items` (src, item_id, text, label) with languages and confidence; ``label``
    comes back as the code of the language it names, or null, and ``langs`` has all of the item."""
    rows = items.select("src", "item_id", "text", label_language(F.col("label")).alias("label")).where(r"text rlike '\\p{L}'")
    model = train(rows.select("text", F.col("label").alias("lang")))
    if model is None:
        return rows.sparkSession.createDataFrame([], _STRETCHES)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return rows.mapInPandas(_classifier(shared), _STRETCHES)


def mislabelled(found: DataFrame) -> DataFrame:
    """(src, item_id, lang) of the items with a missing or wrong label or several languages."""
    case = F.col("label").isNull() | ~F.array_contains("langs", F.col("label")) | (F.size("langs") > 1)
    return found.where(case).select("src", "item_id", "lang").distinct()
