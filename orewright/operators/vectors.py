"""Vector search: exact, quantised to a bit a dimension, and by inverted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orewright.session import materialize


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    d = norm(a) * norm(b)
    return F.when(d > 0, dot(a, b) / d)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


_BEST = "qid bigint, vec_id bigint, score double"


#: Bytes of query vectors that go out in one broadcast, and queries multiplied with a batch at once.
QUERY_BYTES, TILE = 64 << 20, 512


def _scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    s = q @ x.T
    if metric == "cosine":
        return s / np.maximum(np.linalg.norm(q, axis=1, keepdims=True) * np.linalg.norm(x, axis=1), 1e-300)
    if metric == "l2":
        return -np.sqrt(np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1) - 2 * s, 0.0))
    return s


def _bits_apart(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    apart = [np.bitwise_count((q[:, w : w + 1] ^ x[:, w]).view(np.uint64)) for w in range(x.shape[1])]
    return -np.sum(apart, axis=0, dtype=np.float64)


def _scan(shared, k: int, metric: str, column: str = "embedding"):
    """A pass over the rows keeping for each query of the broadcast the k best of the partition; a tile of
    queries meets a batch at once, so memory doesn't grow with the queries beyond k rows each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, qids = shared.value
        score = _bits_apart if metric == "hamming" else _scores
        tiles = [slice(at, at + TILE) for at in range(0, len(qids), TILE)]
        held = [(np.zeros((len(qids[t]), 0), np.int64), np.zeros((len(qids[t]), 0))) for t in tiles]
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf[column].to_numpy()).astype(queries.dtype)
            own = pdf["vec_id"].to_numpy(np.int64)
            for i, t in enumerate(tiles):
                s = np.where(own[None, :] == qids[t][:, None], -np.inf, score(queries[t], x, metric))
                ids, top = held[i]
                ids, top = np.concatenate([ids, np.broadcast_to(own, s.shape)], axis=1), np.concatenate([top, s], axis=1)
                order = np.lexsort((ids, -np.round(top, 12)), axis=1)[:, :k]
                held[i] = np.take_along_axis(ids, order, 1), np.take_along_axis(top, order, 1)
        for t, (ids, top) in zip(tiles, held, strict=True):
            yield _best_rows(qids[t], ids, top)

    return run


def _scanned(rows: DataFrame, queries: DataFrame, k: int, metric: str, column: str, width: int) -> DataFrame:
    """(qid, vec_id, rank, score): every broadcast of queries of at most :data:`QUERY_BYTES` meets all rows in one
    scan, and what it finds is written before the next is fetched."""
    spark = rows.sparkSession
    numbered = materialize(queries.select("vec_id", column).distinct(), "queries")
    blocks = -(-numbered.count() * 8 * width // QUERY_BYTES)
    found = None
    for b in range(blocks):
        part = numbered.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect()
        if not part:
            continue
        q = np.stack([np.asarray(r[column], np.int64 if metric == "hamming" else np.float64) for r in part])
        shared = spark.sparkContext.broadcast((q, np.array([r["vec_id"] for r in part], np.int64)))
        best = rows.select("vec_id", column).mapInPandas(_scan(shared, k, metric, column), _BEST)
        w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "vec_id")
        one = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "vec_id", "rank", "score")
        one = materialize(one, "nearest") if blocks > 1 else one
        found = one if found is None else found.unionByName(one)
    return spark.createDataFrame([], "qid bigint, vec_id bigint, rank int, score double") if found is None else found


def top_k(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(qid, vec_id, rank, score): the k nearest other vectors of each query row (vec_id, embedding).

    Queries go out in broadcasts of a bounded size; each is multiplied with every vector in
    tiles, and a partition sends on k rows a query. Rows without a vector are left out.
    """
    usable = "vec_id is not null and embedding is not null and size(embedding) > 0"
    v, q = vectors.select("vec_id", "embedding").where(usable), queries.select("vec_id", "embedding").where(usable)
    one = v.select(F.size("embedding")).limit(1).first()
    out = _scanned(v, q, k, metric, "embedding", one[0] if one else 1)
    return out.withColumn("score", -F.col("score")) if metric == "l2" else out


def hamming_top_k(codes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, vec_id, rank, bits): for each query row (vec_id, code) the k other codes (words of 64 bits) with the fewest bits apart."""
    usable = "vec_id is not null and code is not null and size(code) > 0"
    one = codes.where(usable).select(F.size("code")).limit(1).first()
    out = _scanned(codes.select("vec_id", "code").where(usable), queries.select("vec_id", "code").where(usable), k, "hamming", "code", one[0] if one else 1)
    return out.select("qid", "vec_id", "rank", (-F.col("score")).cast("int").alias("bits"))


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "vec_id", "rank", "score")


def _kth(ranked: DataFrame, qids: np.ndarray, k: int) -> np.ndarray:
    """The k-th score of each query, minus infinity where fewer are known."""
    known = {r["qid"]: r["score"] for r in ranked.where(F.col("rank") == k).collect()}
    return np.array([known.get(i, -np.inf) for i in qids.tolist()])


def _query_blocks(queries: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vectors, ids) of the queries, a fixed number at a time."""
    numbered = materialize(queries.select("vec_id", "embedding").where("vec_id is not null and embedding is not null").distinct(), "queries")
    blocks = max(1, -(-numbered.count() // block))
    for b in range(blocks):
        rows = numbered.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect()
        if rows:
            yield np.stack([np.asarray(r["embedding"], np.float64) for r in rows]), np.array([r["vec_id"] for r in rows], np.int64)


def _kept(ids: np.ndarray, top: np.ndarray, own: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of those kept so far and of further scores."""
    ids, top = np.concatenate([ids, np.broadcast_to(own, s.shape)], axis=1), np.concatenate([top, s], axis=1)
    order = np.lexsort((ids, -np.round(top, 9)), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(top, order, 1)


def _best_rows(qids: np.ndarray, ids: np.ndarray, top: np.ndarray) -> pd.DataFrame:
    ok = np.isfinite(top)
    return pd.DataFrame({"qid": np.repeat(qids, top.shape[1])[ok.ravel()], "vec_id": ids[ok], "score": top[ok]})


#: Angle and score by which bounds are wider than computed, for what rounding takes.
SLACK = 1e-7


# ---- one bit a dimension ------------------------------------------------------------------


def padded(d: int) -> int:
    n = 64
    while n < d:
        n *= 2
    return n


def rotation_signs(seed: int, n: int) -> np.ndarray:
    """n signs from the SplitMix64 stream of a seed."""
    mask, out, state = (1 << 64) - 1, [], (seed ^ 0xADA1B1DA0000000) & ((1 << 64) - 1)
    while len(out) < n:
        state = (state + 0x9E3779B97F4A7C15) & mask
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        z ^= z >> 31
        out += [1.0 if (z >> b) & 1 else -1.0 for b in range(64)]
    return np.array(out[:n])


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows padded, multiplied by signs and transformed by Walsh and Hadamard, keeping lengths."""
    y = np.zeros((len(x), len(signs)))
    y[:, : x.shape[1]] = x * signs[: x.shape[1]]
    h, n = 1, len(signs)
    while h < n:
        y = y.reshape(len(x), -1, 2, h)
        y = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return y / np.sqrt(n)


def encode_rows(x: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes as 64-bit words, mean, spread, mean deviation) of each row."""
    y = rotate(x, signs)
    mu = y.mean(1)
    c = y - mu[:, None]
    bits = (c >= 0).reshape(len(x), -1, 64)
    words = (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(2, dtype=np.uint64).view(np.int64)
    return words, mu, np.sqrt((c**2).sum(1)), np.abs(c).mean(1)


def encode(vectors: DataFrame, dim: int, seed: int = 42) -> DataFrame:
    """(vec_id, code ARRAY<BIGINT>, mu, delta, gamma) of every vector."""
    signs = rotation_signs(seed, padded(dim))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                w, mu, delta, gamma = encode_rows(np.stack(pdf["embedding"].to_numpy()).astype(np.float64), signs)
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "code": list(w), "mu": mu, "delta": delta, "gamma": gamma})

    return vectors.select("vec_id", "embedding").where(F.size("embedding") == dim).mapInPandas(run, "vec_id bigint, code array<bigint>, mu double, delta double, gamma double")


def sign_code(v: Column, dim: int) -> Column:
    """The sign bits of a vector without rotation, 64 to a word."""
    words = []
    for w in range(-(-dim // 64)):
        bits = [F.when(F.get(v, i) >= 0, F.shiftleft(F.lit(1).cast("bigint"), i - 64 * w)).otherwise(F.lit(0).cast("bigint")) for i in range(64 * w, min(dim, 64 * w + 64))]
        words.append(_or(bits))
    return F.array(*words)


def _or(bits: list[Column]) -> Column:
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=False)] + ([bits[-1]] if len(bits) % 2 else [])
    return bits[0]


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def symmetric_ip(h: Column, d: int, mu_a: Column, delta_a: Column, mu_b: Column, delta_b: Column) -> Column:
    """Inner product by the Hamming distance of two codes."""
    return d * mu_a * mu_b + delta_a * delta_b * F.sin(np.pi / 2 * (d - 2 * h) / d)


def _adc(queries: np.ndarray, qids: np.ndarray, signs: np.ndarray, keep: int):
    y = rotate(queries, signs)
    mu_q = y.mean(1)
    centred, s_q = y - mu_q[:, None], y.sum(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            words = np.stack(pdf["code"].to_numpy()).view(np.uint64)
            bits = ((words[:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).reshape(len(pdf), -1).astype(np.float64)
            est = s_q[:, None] * pdf["mu"].to_numpy() + np.pi * (centred @ bits.T) * pdf["gamma"].to_numpy()
            est = est / np.maximum(np.sqrt(len(signs) * pdf["mu"].to_numpy() ** 2 + pdf["delta"].to_numpy() ** 2), 1e-300)
            own = pdf["vec_id"].to_numpy(np.int64)
            est = np.where(own[None, :] == qids[:, None], -np.inf, est)
            n = min(keep, len(own))
            order = np.argpartition(-est, n - 1, axis=1)[:, :n]
            yield pd.DataFrame({"qid": np.repeat(qids, n), "vec_id": own[order].ravel(), "score": np.take_along_axis(est, order, 1).ravel()})

    return run


def _reranked(queries: np.ndarray, qids: np.ndarray, signs: np.ndarray, kth: np.ndarray, k: int):
    """A pass over codes with their vectors: exact scores of all pairs whose bound reaches the k-th score
    known, keeping for each query the k best of the partition."""
    y = rotate(queries, signs)
    n, s_q = len(signs), y.sum(1)
    centred = y - y.mean(1)[:, None]
    c2, qn = (centred**2).sum(1), np.linalg.norm(queries, axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, top = np.zeros((len(qids), 0), np.int64), np.zeros((len(qids), 0))
        for pdf in batches:
            if not len(pdf):
                continue
            words = np.stack(pdf["code"].to_numpy()).view(np.uint64)
            sign = 2.0 * ((words[:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).reshape(len(pdf), -1).astype(np.float64) - 1.0
            mu, delta, gamma = (pdf[c].to_numpy() for c in ("mu", "delta", "gamma"))
            along = centred @ sign.T
            # A row is mu + gamma * sign + rest, the rest upright to sign: what is unknown of the product is that of two such rests.
            rest = np.sqrt(np.maximum(c2[:, None] - along**2 / n, 0.0)) * np.sqrt(np.maximum(delta**2 - n * gamma**2, 0.0))
            most = (s_q[:, None] * mu + along * gamma + rest) / np.maximum(qn[:, None] * np.sqrt(n * mu**2 + delta**2), 1e-300)
            own = pdf["vec_id"].to_numpy(np.int64)
            reach = ~(most + SLACK < kth[:, None]) & (own[None, :] != qids[:, None])
            at = np.flatnonzero(reach.any(0))
            if not len(at):
                continue
            x = np.stack(pdf["embedding"].to_numpy()[at]).astype(np.float64)
            s = np.where(reach[:, at], queries @ x.T / np.maximum(qn[:, None] * np.linalg.norm(x, axis=1), 1e-300), -np.inf)
            ids, top = _kept(ids, top, own[at], s, k)
        yield _best_rows(qids, ids, top)

    return run


def quantised_top_k(vectors: DataFrame, codes: DataFrame, queries: DataFrame, dim: int, k: int, pool: int = 100, seed: int = 42, block: int = 512) -> DataFrame:
    """(qid, vec_id, rank, score): the k nearest other vectors by exact cosine.

    The `pool` best of each query by asymmetric distance to the codes give a first k-th score. Then
    every row whose bound reaches that score is ranked by exact cosine, however many these are.
    """
    signs = rotation_signs(seed, padded(dim))
    coded = materialize(codes.join(vectors.select("vec_id", "embedding").where(F.size("embedding") == dim), "vec_id"), "coded")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    parts = None
    for qm, qids in _query_blocks(queries.where(F.size("embedding") == dim), block):
        near = coded.select("vec_id", "code", "mu", "delta", "gamma").mapInPandas(_adc(qm, qids, signs, max(pool, k)), _BEST)
        cand = near.where("vec_id != qid").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max(pool, k)).select("qid", "vec_id")
        q = queries.sparkSession.createDataFrame([(int(i), v.tolist()) for i, v in zip(qids, qm, strict=True)], "qid bigint, qv array<double>")
        exact = cand.join(coded.select("vec_id", "embedding"), "vec_id").join(q, "qid").select("qid", "vec_id", F.coalesce(cosine(F.col("embedding"), F.col("qv")), F.lit(0.0)).alias("score"))
        one = materialize(coded.mapInPandas(_reranked(qm, qids, signs, _kth(_ranked(exact, k), qids, k), k), _BEST), "nearest")  # before the next block is fetched
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        return codes.sparkSession.createDataFrame([], "qid bigint, vec_id bigint, rank int, score double")
    return _ranked(parts, k)


# ---- inverted lists -----------------------------------------------------------------------

#: Rows the cells are fitted on, and rounds of fitting.
FIT_ROWS, FIT_ROUNDS = 20_000, 12


def fit_cells(vectors: DataFrame, cells: int, rows: int = FIT_ROWS) -> np.ndarray:
    """Centres of the cells by spherical k-means on a bounded sample, chosen by hash."""
    sample = vectors.select("vec_id", "embedding").where("embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).collect()
    x = np.stack([np.asarray(r["embedding"], np.float64) for r in sample])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    rng = np.random.default_rng(5)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(FIT_ROUNDS):
        own = (x @ c.T).argmax(1)
        for i in range(len(c)):
            if (own == i).any():
                c[i] = x[own == i].sum(0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
    return c


def assign_cells(vectors: DataFrame, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """(vec_id, embedding, cell, angle): each vector in its nearest cell, or in the `probes` nearest ones, with
    the angle to the centre."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
                angle = _angles(x, centres)
                near = np.argsort(angle, axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"vec_id": np.repeat(pdf["vec_id"].to_numpy(), near.shape[1]), "embedding": np.repeat(pdf["embedding"].to_numpy(), near.shape[1]), "cell": near.ravel().astype(np.int32), "angle": np.take_along_axis(angle, near, 1).ravel()})

    return vectors.select("vec_id", "embedding").where("vec_id is not null and embedding is not null and size(embedding) > 0").mapInPandas(run, "vec_id bigint, embedding array<float>, cell int, angle double")


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300), -1.0, 1.0))


def _scan_cells(queries: np.ndarray, qids: np.ndarray, open_: np.ndarray, k: int):
    """A pass over the lists keeping for each query the k best of the partition, from the cells open to it."""
    qn = np.linalg.norm(queries, axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, top = np.zeros((len(qids), 0), np.int64), np.zeros((len(qids), 0))
        for pdf in batches:
            for cell, part in pdf.groupby("cell"):
                ask = np.flatnonzero(open_[:, cell])
                if len(ask):
                    x, own = np.stack(part["embedding"].to_numpy()).astype(np.float64), part["vec_id"].to_numpy(np.int64)
                    s = np.full((len(qids), len(own)), -np.inf)
                    s[ask] = queries[ask] @ x.T / np.maximum(qn[ask, None] * np.linalg.norm(x, axis=1), 1e-300)
                    s[own[None, :] == qids[:, None]] = -np.inf
                    ids, top = _kept(ids, top, own, s, k)
        yield _best_rows(qids, ids, top)

    return run


def cell_search(vectors: DataFrame, queries: DataFrame, k: int, cells: int = 16, probes: int = 6, block: int = 512) -> DataFrame:
    """(qid, vec_id, rank, score): the k nearest other vectors by exact cosine.

    The `probes` nearest cells of a query are searched first. A further cell is searched too unless
    its bound rules it out: no vector of it is nearer to the query than the angle to its centre less
    the angle of its outermost vector, so it can't reach the k-th score found.
    """
    centres = fit_cells(vectors, cells)
    lists = materialize(assign_cells(vectors, centres), "lists")
    radius, filled = np.zeros(len(centres)), np.zeros(len(centres), bool)
    for r in lists.groupBy("cell").agg(F.max("angle").alias("radius")).collect():
        radius[r["cell"]], filled[r["cell"]] = r["radius"], True
    parts = None
    for qm, qids in _query_blocks(queries.where("size(embedding) > 0"), block):
        angle = _angles(qm, centres)
        near = np.zeros(angle.shape, bool)
        np.put_along_axis(near, np.argsort(angle, axis=1, kind="stable")[:, :probes], True, axis=1)
        first = materialize(_ranked(lists.mapInPandas(_scan_cells(qm, qids, near, k), _BEST), k), "first")
        bound = np.cos(np.maximum(angle - radius - SLACK, 0.0)) + SLACK
        rest = filled & ~near & ~(bound < _kth(first, qids, k)[:, None])
        more = materialize(lists.mapInPandas(_scan_cells(qm, qids, rest, k), _BEST), "further")  # before the next block is fetched
        one = first.select("qid", "vec_id", "score").unionByName(more)
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        return vectors.sparkSession.createDataFrame([], "qid bigint, vec_id bigint, rank int, score double")
    return _ranked(parts, k)


def hash_embed(docs: DataFrame, key: str, text: str, dim: int = 64, seed: int = 0) -> DataFrame:
    """(key, embedding): three signed slots a word from its FNV-1a hash, scaled to length 1."""
    mask = (1 << 64) - 1

    def word_slots(word: str) -> list[tuple[int, float]]:
        h = 0xCBF29CE484222325
        for byte in word.encode():
            h = ((h ^ byte) * 0x100000001B3) & mask
        out = []
        for k in range(3):
            z = (h ^ seed) ^ ((k * 0x9E3779B97F4A7C15) & mask)
            z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
            z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
            out.append(((z >> 33) % dim, 1.0 if z & 1 == 0 else -1.0))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        known: dict[str, list[tuple[int, float]]] = {}
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                v = np.zeros(dim, np.float32)
                for w in re.findall(r"\w+", t or ""):
                    if w not in known:
                        if len(known) > 200_000:
                            known.clear()
                        known[w] = word_slots(w)
                    for at, s in known[w]:
                        v[at] += s
                n = float(np.linalg.norm(v))
                rows.append((v / n if n else v).tolist())
            yield pd.DataFrame({"key": pdf["key"], "embedding": rows})

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, embedding array<float>").withColumnRenamed("key", key)
