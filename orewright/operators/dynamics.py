"""States that a sequence of observations drives, folded over each key's rows in their order."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def psi(obs: np.ndarray, barred: np.ndarray, eta: float = 0.05, gamma: float = 0.5, rho: float = 0.9, memory: int = 8) -> np.ndarray:
    """Attention p after each observation o: with s = tanh o, ``dp = -2 (p - s) + gamma * sum of
    rho^k (p - s_{t-k})`` over the last `memory` ones, p kept within [-1, 1]. A barred one is
    remembered but moves nothing."""
    p, past, out = 0.0, [], []
    for o, no in zip(np.tanh(obs), barred, strict=True):
        if not no:
            pull = sum(rho**k * (p - s) for k, s in enumerate(reversed(past), 1))
            p = min(1.0, max(-1.0, p + eta * (-2.0 * (p - o) + gamma * pull)))
        past = [*past, o][-memory:]
        out.append(p)
    return np.array(out)


def cycle(obs: np.ndarray, barred: np.ndarray, eta: float = 0.01, gamma: float = 0.1, mix: float = 0.1, delta: float = 1e-10, loss: float = 0.02, start: tuple[float, float] = (0.0, 0.0)) -> np.ndarray:
    """Length of a state in the plane after each observation: it is damped, turned by the
    smoothed change of the observations, drawn to (tanh o, 0) and pulled towards length 1.
    For a barred observation the force along itself is projected away."""
    x, y = start
    turn = before = 0.0
    out = []
    for o, no in zip(np.tanh(obs), barred, strict=True):
        turn = 0.9 * turn + 0.1 * min(1.0, max(-1.0, 10.0 * (o - before)))
        before = o
        fx = loss**2 * x + gamma * (-2.0 * turn) * y + 2.0 * (x - o)
        fy = loss**2 * y + gamma * (2.0 * turn) * x + 2.0 * y
        if no:
            n = fx * fx + fy * fy
            left = delta / (n / max(n, 1e-24) + delta)
            fx, fy = fx * left, fy * left
        x, y = x - eta * fx, y - eta * fy
        n = x * x + y * y
        scale = (1.0 - mix) + mix * (1.0 / np.sqrt(n) if n > 0 else 1.0)
        x, y = x * scale, y * scale
        out.append(float(np.hypot(x, y)))
    return np.array(out)


def echo(obs: np.ndarray, rho: float = 0.8, horizon: int = 16, normed: bool = True) -> np.ndarray:
    """Weighted mean (or sum) of the last `horizon` observations, the freshest at weight 1."""
    w = (1.0 - rho) * rho ** np.arange(horizon)
    out = []
    for i in range(len(obs)):
        past = obs[max(0, i - horizon + 1) : i + 1][::-1]
        s = float((past * w[: len(past)]).sum())
        out.append(s / float(w[: len(past)].sum()) if normed else s)
    return np.array(out)


def fold(df: DataFrame, key: str, order: list[str], value: str, name: str, rule: Callable[..., np.ndarray], barred: Column | None = None) -> DataFrame:
    """`df` with the column `name`: the rule folded over each key's values in order.

    Rows come sorted by key from a range of keys each, and the rule runs on one key's values
    at a time, so no group is gathered beyond the values of one key.
    """
    no = F.coalesce(barred, F.lit(False)) if barred is not None else F.lit(False)
    src = df.withColumn("__no", no).repartition(key).sortWithinPartitions(key, *order)
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in df.columns) + f", {name} double"
    cols = df.columns

    def run(batches):  # noqa: ANN001, ANN202
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if held and len(pdf) and pdf[key].iloc[0] != held[-1][key].iloc[-1]:
                yield from done(held)
                held = []
            if len(pdf):
                last = pdf[key] == pdf[key].iloc[-1]
                cut = pdf[~last]
                if len(cut):
                    yield from done([*held, cut])
                    held = []
                held.append(pdf[last])
        if held:
            yield from done(held)

    def done(parts: list[pd.DataFrame]):  # noqa: ANN202
        pdf = pd.concat(parts, ignore_index=True)
        for _, g in pdf.groupby(key, sort=False, dropna=False):
            out = g[cols].copy()
            out[name] = rule(g[value].to_numpy(float), g["__no"].to_numpy(bool))
            yield out

    return src.mapInPandas(run, schema)


#: Sizes of content-defined chunks: least, aimed at, most.
CHUNK = (64 * 1024, 256 * 1024, 1024 * 1024)


def content_chunks(docs: DataFrame, key: str, text: str, least: int = CHUNK[0], aim: int = CHUNK[1], most: int = CHUNK[2]) -> DataFrame:
    """(key, idx, start, bytes, hash): pieces of a text's bytes cut where a rolling hash of the
    content says so, so that equal stretches are cut alike wherever they stand.

    The hash of a place is the sum of its bytes' random numbers, each shifted one bit further
    up: it depends on the last 64 bytes and is made for all places at once.
    """
    rng = np.random.Generator(np.random.PCG64(0x434443))
    gear = rng.integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    bits = max(8, min(40, round(np.log2(aim))))
    strict = np.uint64(((1 << bits) - 1) << (64 - bits))
    loose = np.uint64(((1 << max(6, bits - 2)) - 1) << (64 - max(6, bits - 2)))

    def cuts(data: bytes) -> list[int]:
        b = gear[np.frombuffer(data, np.uint8)]
        h, n = b.copy(), 1
        with np.errstate(over="ignore"):
            while n < 64:
                h[n:] = h[n:] + (h[:-n] << np.uint64(n)) if len(h) > n else h[n:]
                n *= 2
        hard, soft = np.flatnonzero((h & strict) == 0), np.flatnonzero((h & loose) == 0)
        out, start = [], 0
        while len(data) - start > least:
            a = hard[np.searchsorted(hard, start + least) :][:1]
            if len(a) and a[0] < start + aim:
                end = int(a[0]) + 1
            else:
                c = soft[np.searchsorted(soft, start + aim) :][:1]
                end = int(c[0]) + 1 if len(c) and c[0] < start + most else start + most
            if end >= len(data):
                break
            out.append(end)
            start = end
        return [*out, len(data)]

    def run(batches):  # noqa: ANN001, ANN202
        import hashlib

        for pdf in batches:
            rows = []
            for k, t in zip(pdf["key"], pdf["text"], strict=True):
                data = t.encode("utf-8", "replace")
                s = 0
                for i, e in enumerate(cuts(data) if data else []):
                    rows.append((k, i, s, e - s, hashlib.blake2b(data[s:e], digest_size=16).hexdigest()))
                    s = e
            yield pd.DataFrame(rows, columns=["key", "idx", "start", "bytes", "hash"])

    kind = dict(docs.dtypes)[key]
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    return d.mapInPandas(run, f"key {kind}, idx int, start bigint, bytes bigint, hash string").withColumnRenamed("key", key)


def stored(chunks: DataFrame) -> DataFrame:
    """(chunks, bytes, distinct_chunks, distinct_bytes) after equal chunks are kept once."""
    one = chunks.groupBy("hash").agg(F.max("bytes").alias("b"), F.count("*").alias("n"), F.sum("bytes").alias("s"))
    return one.agg(F.sum("n").alias("chunks"), F.sum("s").alias("bytes"), F.count("*").alias("distinct_chunks"), F.sum("b").alias("distinct_bytes"))
