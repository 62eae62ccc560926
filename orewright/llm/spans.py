"""Long spans that stand word for word in more than one text.

Two texts share a span of `least` characters only if they share an anchor in it: anchors
are K-grams (K a power of two up to half of `least`) chosen by winnowing, the least hash
of every window of ``least - K + 1`` K-grams, so every stretch of `least` characters
holds one and equal stretches hold the same. What has no shared anchor can't be shared
and is left aside without loss.

Around each shared anchor lies the context in which a shared span with it must be. The
contexts of one anchor are a reference shard. A suffix automaton over their words is
built for it, each context is streamed through the automaton, and its matching statistics
name the other contexts with a long match; spans end exactly where the characters differ.
An automaton is thus only sent where its texts occur. (One broadcast automaton for every
shard of all texts would need each text to pass every shard: quadratic work, and
broadcasts that grow with the data.) Equal contexts of a shard go through it once. A
shard of more than `SHARD` contexts, such as a short phrase that a third of all texts
have, is resolved by equality instead: all stretches of `least` characters around the
anchor are hashed, and contexts with equal ones, compared by their characters, are linked.
:func:`pairs_by_broadcast` is the method without anchors, for bounded tables.

Defined results for odd input: null texts, null ids and texts shorter than `least` share
nothing; equal texts of that length share all; what a text shares with itself doesn't
count; double rows count once; a null or empty table gives no row. Places and lengths are
in code points of the text as stored.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orewright.session import materialize

LEAST, SHARD = 300, 128
#: Words longer than this are streamed character by character.
LONG_WORD = 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_size(least: int) -> int:
    k = 1
    while k * 4 <= least:
        k *= 2
    return k


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams, for k a power of two, by doubling."""
    h, n, base = codes.astype(np.uint64) + np.uint64(1), 1, _BASE
    with np.errstate(over="ignore"):
        while n < k:
            h = h[:-n] * base + h[n:]
            base = base * base
            n *= 2
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w successive values, by prefix and suffix minima of blocks."""
    n = len(x)
    pad = -n % w
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(y, axis=1).ravel()
    return np.minimum(left[: n - w + 1], right[w - 1 : n])


def anchors(texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, place, hash) of the anchors of `texts`, all at least `least` long."""
    k = gram_size(least)
    w = least - k + 1
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    codes = _codes("".join(texts))
    h = gram_hashes(codes, k)
    bits = np.uint64(max(8, int(len(codes)).bit_length()))
    key = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    least_key = window_minima(key, w)
    text_end = np.repeat(ends, sizes)[: len(least_key)]
    inside = np.arange(len(least_key)) + least <= text_end
    at = np.unique((least_key[inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64))
    own = np.searchsorted(ends, at, side="right")
    return own, at - (ends - sizes)[own], h[at].view(np.int64)


#: Characters that are hashed at once; a longer text goes in stretches that overlap by a span.
STRETCH = 1 << 20


def _stretches(texts: list[str], least: int) -> Iterator[tuple[int, int, str]]:
    """(number of the text, offset, stretch) of all texts."""
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - least + 1), STRETCH - least + 1):
            yield i, at, t[at : at + STRETCH]


def _anchor_rows(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["doc_id"].to_numpy()
            held: list[tuple[int, int, str]] = []
            size = 0
            for part in [*_stretches(pdf["text"].tolist(), least), None]:
                if held and (part is None or size + len(part[2]) > STRETCH):
                    own, place, h = anchors([x for *_, x in held], least)
                    number, offset = np.array([x[0] for x in held]), np.array([x[1] for x in held])
                    yield pd.DataFrame({"doc_id": ids[number[own]], "place": (place + offset[own]).astype(np.int32), "h": h})
                    held, size = [], 0
                if part:
                    held.append(part)
                    size += len(part[2])

    return run


class Automaton:
    """A suffix automaton over words (as numbers) of several texts, with the set of texts
    each state stands in as the bits of an integer."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.owners = [-1], [0], [0]

    def add(self, word: int, last: int) -> int:
        """Appends a word behind state `last`; the state of the text so far."""
        nxt, link, size = self.next, self.link, self.size
        if word in nxt[last]:
            q = nxt[last][word]
            if size[q] == size[last] + 1:
                return q
            return self._split(last, q, word)
        cur = len(nxt)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        self.owners.append(0)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[cur] = q if size[q] == size[p] + 1 else self._split(p, q, word)
        return cur

    def _split(self, p: int, q: int, word: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        self.owners.append(self.owners[q])
        link[q] = c
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = c
            p = link[p]
        return c

    def own(self, text: list[int], bit: int) -> None:
        """Marks all states of the text's substrings."""
        owners, link, state = self.owners, self.link, 0
        for word in text:
            state = self.next[state][word]
            s = state
            while s > 0 and not owners[s] & bit:
                owners[s] |= bit
                s = link[s]

    def statistics(self, text: list[int]) -> Iterator[tuple[int, int]]:
        """(state, matched words) at each word: the longest end of the text so far that occurs."""
        nxt, link, size = self.next, self.link, self.size
        state = length = 0
        for word in text:
            while state and word not in nxt[state]:
                state = link[state]
                length = size[state]
            if word in nxt[state]:
                state, length = nxt[state][word], length + 1
            yield state, length


_word = re.compile(r"\w+|\W")


def _words(text: str) -> list[str]:
    out = []
    for w in _word.findall(text):
        out.extend(w if len(w) > LONG_WORD else (w,))
    return out


def long_matches(texts: list[str], least: int) -> set[tuple[int, int]]:
    """Pairs of `texts` whose common words in a row, with the parts of words at both ends,
    may reach `least` characters; by an automaton of all and the statistics of each."""
    core = max(1, least - 2 * LONG_WORD)
    number: dict[str, int] = {}
    coded, places = [], []
    for t in texts:
        ws = _words(t)
        coded.append([number.setdefault(w, len(number)) for w in ws])
        places.append(np.cumsum([0, *map(len, ws)]).tolist())
    sam = Automaton()
    for c in coded:
        last = 0
        for word in c:
            last = sam.add(word, last)
    for i, c in enumerate(coded):
        sam.own(c, 1 << i)
    found = set()
    for i, c in enumerate(coded):
        at, partners = places[i], 0
        for j, (state, _) in enumerate(sam.statistics(c)):
            # the shortest suffix here that has the core's characters, and who has it
            end = at[j + 1]
            if end < core:
                continue
            s = state
            while (p := sam.link[s]) > 0 and end - at[j + 1 - sam.size[p]] >= core:
                s = p
            if sam.size[s] and end - at[j + 1 - sam.size[s]] >= core:
                partners |= sam.owners[s]
        partners &= ~((2 << i) - 1)
        while partners:
            low = partners & -partners
            found.add((i, low.bit_length() - 1))
            partners ^= low
    return found


def shared_around(a: np.ndarray, pa: int, b: np.ndarray, pb: int, k: int) -> tuple[int, int]:
    """Characters that two texts with an equal K-gram at `pa` and `pb` share before it and from it on."""
    n = min(pa, pb)
    diff = np.flatnonzero(a[pa - n : pa][::-1] != b[pb - n : pb][::-1])
    left = int(diff[0]) if len(diff) else n
    m = min(len(a) - pa, len(b) - pb)
    diff = np.flatnonzero(a[pa : pa + m] != b[pb : pb + m])
    right = int(diff[0]) if len(diff) else m
    return left, right if right >= k else 0


def shard_spans(rows: Iterable[tuple[int, int, int, str]], least: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(doc_a, doc_b, start_a, start_b, length) of the spans that the contexts of one anchor
    share; rows are (doc, place of the anchor in it, place in the context, context)."""
    k = gram_size(least)
    members: dict[tuple[str, int], list[tuple[int, int]]] = defaultdict(list)
    for doc, place, at, ctx in rows:
        members[(ctx, at)].append((doc, place))
    classes = list(members)
    codes = [_codes(c) for c, _ in classes]
    for i, (ctx, at) in enumerate(classes):
        own = sorted(members[classes[i]])
        for x, (da, pa) in enumerate(own):
            for db, pb in own[x + 1 :]:
                if da != db and len(ctx) >= least:
                    yield da, db, pa - at, pb - at, len(ctx)
    if len(classes) < 2:
        return
    for i, j in long_matches([c for c, _ in classes], least):
        ai, aj = classes[i][1], classes[j][1]
        left, right = shared_around(codes[i], ai, codes[j], aj, k)
        if left + right < least or not right:
            continue
        for da, pa in members[classes[i]]:
            for db, pb in members[classes[j]]:
                if da < db:
                    yield da, db, pa - left, pb - left, left + right
                elif db < da:
                    yield db, da, pb - left, pa - left, left + right


_SPANS = "doc_a bigint, doc_b bigint, start_a int, start_b int, length int"


def _shards(least: int):
    """Resolves the shards of a partition whose rows come sorted by anchor, one after another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchor, rows, out = None, [], []
        for pdf in batches:
            for h, *row in zip(pdf["h"].tolist(), pdf["doc_id"].tolist(), pdf["place"].tolist(), pdf["at"].tolist(), pdf["ctx"].tolist(), strict=True):
                if h != anchor:
                    out += shard_spans(rows, least)
                    anchor, rows = h, []
                rows.append(row)
            yield pd.DataFrame(out, columns=["doc_a", "doc_b", "start_a", "start_b", "length"])
            out = []
        yield pd.DataFrame(list(shard_spans(rows, least)), columns=["doc_a", "doc_b", "start_a", "start_b", "length"])

    return run


def _contexts(least: int):
    k = gram_size(least)
    before, after = least - k, least

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (doc, a["h"], a["n"], a["place"], min(a["place"], before), text[max(0, a["place"] - before) : a["place"] + after])
                for doc, text, own in zip(pdf["doc_id"], pdf["text"], pdf["own"], strict=True)
                for a in own
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "h", "n", "place", "at", "ctx"])

    return run


def _stretch_keys(least: int):
    """All stretches of `least` characters of a context that hold its anchor, hashed."""
    k = gram_size(least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h, cls, key, off = [], [], [], []
            for hh, c, at, ctx in zip(pdf["h"], pdf["cls"], pdf["at"], pdf["ctx"], strict=True):
                codes = _codes(ctx)
                if len(codes) < least:
                    continue
                g = gram_hashes(codes, k)
                # a stretch is covered by overlapping K-grams; two sums of their hashes name it
                n = len(codes) - least + 1
                with np.errstate(over="ignore"):
                    total = np.zeros(n, np.uint64)
                    for step in [*range(0, least - k, k), least - k]:
                        total = (total ^ g[step : step + n]) * _BASE
                        total ^= total >> np.uint64(32)
                start = np.arange(n)
                ok = (start <= at) & (start + least >= at + k)
                key.append(total[ok].view(np.int64))
                off.append((start[ok] - at).astype(np.int32))
                h.append(np.full(int(ok.sum()), hh, np.int64))
                cls += [c] * int(ok.sum())
            cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
            yield pd.DataFrame({"h": cat(h, np.int64), "cls": cls, "key": cat(key, np.int64), "off": cat(off, np.int32)})

    return run


def _large_shards(ctx: DataFrame, least: int) -> DataFrame:
    """Spans of the shards too large for an automaton, by equality of stretches."""
    named = ctx.withColumn("cls", F.md5(F.concat_ws(":", "at", "ctx")))
    members = named.select("h", "cls", "doc_id", "place", "at", F.length("ctx").alias("len"))
    classes = named.groupBy("h", "cls").agg(F.first("at").alias("at"), F.first("ctx").alias("ctx"))
    keys = classes.mapInPandas(_stretch_keys(least), "h bigint, cls string, key bigint, off int")
    a = keys.select("h", "key", "off", F.col("cls").alias("cls_a"))
    b = keys.select("h", "key", "off", F.col("cls").alias("cls_b"))
    links = a.join(b, ["h", "key", "off"]).where("cls_a <= cls_b")
    links = links.groupBy("h", "cls_a", "cls_b").agg(F.min("off").alias("lo"), (F.max("off") + least).alias("hi"))
    # equal sums only propose: the characters decide
    said = lambda x: classes.select("h", F.col("cls").alias(f"cls_{x}"), F.col("at").alias(f"at_{x}"), F.col("ctx").alias(f"ctx_{x}"))
    part = lambda x: F.expr(f"substring(ctx_{x}, at_{x} + lo + 1, hi - lo)")
    links = links.join(said("a"), ["h", "cls_a"]).join(said("b"), ["h", "cls_b"]).where(part("a") == part("b")).select("h", "cls_a", "cls_b", "lo", "hi")
    ma = members.select("h", F.col("cls").alias("cls_a"), F.col("doc_id").alias("x"), F.col("place").alias("px"))
    mb = members.select("h", F.col("cls").alias("cls_b"), F.col("doc_id").alias("y"), F.col("place").alias("py"))
    j = links.join(ma, ["h", "cls_a"]).join(mb, ["h", "cls_b"]).where("x != y and (cls_a != cls_b or x < y)")
    first = F.col("x") < F.col("y")
    return j.select(
        F.least("x", "y").alias("doc_a"),
        F.greatest("x", "y").alias("doc_b"),
        (F.when(first, F.col("px")).otherwise(F.col("py")) + F.col("lo")).cast("int").alias("start_a"),
        (F.when(first, F.col("py")).otherwise(F.col("px")) + F.col("lo")).cast("int").alias("start_b"),
        (F.col("hi") - F.col("lo")).cast("int").alias("length"),
    )


#: Characters of reference texts that one broadcast automaton may hold; a shard beyond it is an error.
BROADCAST_CHARS = 4_000_000

_automata: dict[str, tuple] = {}


def _automaton_of(name: str, texts: list[tuple[int, str]]) -> tuple:
    """The automaton of a broadcast shard, built once a worker, and the numbers of its words."""
    if name not in _automata:
        _automata.clear()
        number: dict[str, int] = {}
        coded = [[number.setdefault(w, len(number)) for w in _words(t)] for _, t in texts]
        sam = Automaton()
        for c in coded:
            last = 0
            for word in c:
                last = sam.add(word, last)
        for i, c in enumerate(coded):
            sam.own(c, 1 << i)
        _automata[name] = sam, number
    return _automata[name]


def _share(one: str, two: str, least: int) -> bool:
    """Whether two texts share `least` characters in a row, by all their stretches."""
    have = {one[i : i + least] for i in range(len(one) - least + 1)}
    return any(two[i : i + least] in have for i in range(len(two) - least + 1))


def _streamer(shared, name: str, least: int):
    core = max(1, least - 2 * LONG_WORD)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sam, number = _automaton_of(name, shared.value)
        for pdf in batches:
            found = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ws = _words(text)
                at = [0, *accumulate(map(len, ws))]
                partners = 0
                for j, (state, _) in enumerate(sam.statistics([number.get(w, -1) for w in ws])):
                    s, end = state, at[j + 1]
                    while (p := sam.link[s]) > 0 and end - at[j + 1 - sam.size[p]] >= core:
                        s = p
                    if sam.size[s] and end - at[j + 1 - min(sam.size[s], j + 1)] >= core:
                        partners |= sam.owners[s]
                while partners:
                    low = partners & -partners
                    partners ^= low
                    other, theirs = shared.value[low.bit_length() - 1]
                    if other < doc and _share(theirs, text, least):
                        found.append((other, doc))
            yield pd.DataFrame(found, columns=["doc_a", "doc_b"])

    return run


def pairs_by_broadcast(docs: DataFrame, least: int = LEAST, shard_chars: int = BROADCAST_CHARS) -> DataFrame:
    """(doc_a, doc_b) of all pairs with `least` characters in common, by one broadcast automaton for each reference shard.

    Every text passes every shard, so the work grows with the square of the texts: for bounded
    tables only. It is the plain form of the method that :func:`shared_spans` applies to the
    contexts of anchors, and its results are the same.
    """
    spark = docs.sparkSession
    texts = materialize(docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= least)).distinct(), "texts")
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-2 * total // shard_chars))
    named = texts.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    out = spark.createDataFrame([], "doc_a bigint, doc_b bigint")
    for n in range(shards):
        part = named.where(F.col("shard") == n)
        if (part.agg(F.sum(F.length("text"))).first()[0] or 0) > shard_chars:
            raise ValueError("a reference shard is larger than a broadcast may be")
        shared = spark.sparkContext.broadcast([(r["doc_id"], r["text"]) for r in part.select("doc_id", "text").collect()])
        out = out.unionByName(texts.mapInPandas(_streamer(shared, uuid.uuid4().hex, least), "doc_a bigint, doc_b bigint"))
    return out.distinct()


def shared_spans(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_a, doc_b, start_a, start_b, length): pieces of the spans that two of `docs`
    (doc_id, text) share, doc_a < doc_b, each around an anchor; see :func:`maximal_spans`."""
    texts = docs.select("doc_id", "text").where((F.col("doc_id").isNotNull()) & (F.length("text") >= least))
    rows = materialize(texts.mapInPandas(_anchor_rows(least), "doc_id bigint, place int, h bigint"), "anchors")
    shared = rows.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("h", "n")
    own = rows.join(shared, "h").distinct().groupBy("doc_id").agg(F.collect_list(F.struct("h", "n", "place")).alias("own"))
    ctx = texts.join(own, "doc_id").mapInPandas(_contexts(least), "doc_id bigint, h bigint, n bigint, place int, at int, ctx string")
    ctx = materialize(ctx.distinct(), "contexts")
    small = ctx.where(F.col("n") <= SHARD).repartition("h").sortWithinPartitions("h").mapInPandas(_shards(least), _SPANS)
    return small.unionByName(_large_shards(ctx.where(F.col("n") > SHARD), least))


def sharing_pairs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_a, doc_b) of all pairs with a span of `least` characters in common."""
    return shared_spans(docs, least).select("doc_a", "doc_b").distinct()


def maximal_spans(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_a, doc_b, start_a, start_b, length): the pieces joined to spans as long as they go."""
    s = shared_spans(docs, least).withColumn("shift", F.col("start_b") - F.col("start_a"))
    w = Window.partitionBy("doc_a", "doc_b", "shift").orderBy("start_a")
    s = s.withColumn("reach", F.max(F.col("start_a") + F.col("length")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("run", F.sum(F.when(F.col("start_a") <= F.col("reach"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = s.groupBy("doc_a", "doc_b", "shift", "run").agg(F.min("start_a").alias("start_a"), F.max(F.col("start_a") + F.col("length")).alias("end_a"))
    return out.select("doc_a", "doc_b", "start_a", (F.col("start_a") + F.col("shift")).alias("start_b"), (F.col("end_a") - F.col("start_a")).alias("length"))


def shared_share(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_chars, shared_chars, share): how much of each text stands in another one."""
    s = shared_spans(docs, least)
    one = s.select(F.col("doc_a").alias("doc_id"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("length")).alias("e"))
    two = s.select(F.col("doc_b").alias("doc_id"), F.col("start_b").alias("s"), (F.col("start_b") + F.col("length")).alias("e"))
    spans = one.unionByName(two).groupBy("doc_id", "s").agg(F.max("e").alias("e"))
    w = Window.partitionBy("doc_id").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    cut = spans.withColumn("reach", F.coalesce(F.max("e").over(w), F.lit(0)))
    part = cut.groupBy("doc_id").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "reach"))).alias("shared_chars"))
    size = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.length("text")).alias("n_chars"))
    out = size.join(part, "doc_id", "left").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.coalesce("shared_chars", F.lit(0)).cast("bigint").alias("shared_chars"))
    return out.withColumn("share", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(0.0))
