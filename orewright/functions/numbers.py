"""Exact integers, primes, special functions and linear algebra by Arrow-batched Python.

These have no built-in expression; each works on whole batches. Integers beyond 64 bits
come out as decimal strings.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import wraps

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orewright.functions.exact import factors, matrix, prime, zeta_of


def _udf(kind: str | T.DataType):
    """Marks a batch function; the Arrow function is made where it is used, as that needs a session."""

    def mark(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def use(*columns: Column | str) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        return use

    return mark


@_udf("bigint")
def gcd(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.gcd(a.to_numpy(np.int64), b.to_numpy(np.int64)))


@_udf("bigint")
def lcm(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.lcm(a.to_numpy(np.int64), b.to_numpy(np.int64)))


@_udf("boolean")
def is_prime(n: pd.Series) -> pd.Series:
    return n.map(lambda v: prime(int(v)))


@_udf("bigint")
def next_prime(n: pd.Series) -> pd.Series:
    def up(v: int) -> int:
        v += 1
        while not prime(v):
            v += 1
        return v

    return n.map(lambda v: up(int(v)))


@_udf("bigint")
def prev_prime(n: pd.Series) -> pd.Series:
    """The largest prime below n, null below 3."""

    def down(v: int) -> int | None:
        v -= 1
        while v > 1 and not prime(v):
            v -= 1
        return v if v > 1 else None

    return n.map(lambda v: down(int(v))).astype("Int64")


@_udf("array<bigint>")
def factorize(n: pd.Series) -> pd.Series:
    return n.map(lambda v: factors(int(v)) if v > 0 else [])


@_udf("string")
def fib(n: pd.Series) -> pd.Series:
    def one(k: int) -> str:
        a, b = 0, 1
        for bit in bin(k)[2:]:
            a, b = a * (2 * b - a), a * a + b * b
            if bit == "1":
                a, b = b, a + b
        return str(a)

    return n.map(lambda v: one(int(v)))


@_udf("string")
def binomial(n: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([str(math.comb(int(a), int(b))) if 0 <= b <= a <= 10_000 else None for a, b in zip(n, k, strict=True)])


@_udf("string")
def catalan(n: pd.Series) -> pd.Series:
    return n.map(lambda v: str(math.comb(2 * int(v), int(v)) // (int(v) + 1)) if 0 <= v <= 5_000 else None)


@_udf("string")
def factorial(n: pd.Series) -> pd.Series:
    return n.map(lambda v: str(math.factorial(int(v))) if 0 <= v <= 10_000 else None)


@_udf("double")
def gamma(x: pd.Series) -> pd.Series:
    def one(v: float) -> float:
        try:
            return math.gamma(v)
        except (ValueError, OverflowError):
            return math.nan if v == int(v) else math.inf

    return x.map(one)


@_udf("double")
def lgamma(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.lgamma(v) if v > 0 or v != int(v) else math.inf)


@_udf("double")
def beta(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([math.exp(math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)) for x, y in zip(a, b, strict=True)])


@_udf("double")
def zeta(s: pd.Series) -> pd.Series:
    return s.map(zeta_of)


MATRIX = T.ArrayType(T.ArrayType(T.DoubleType()))


@_udf(T.DoubleType())
def det(m: pd.Series) -> pd.Series:
    return m.map(lambda v: float(np.linalg.det(matrix(v))))


@_udf(MATRIX)
def inv(m: pd.Series) -> pd.Series:
    def one(v):  # noqa: ANN001, ANN202
        try:
            return np.linalg.inv(matrix(v)).tolist()
        except np.linalg.LinAlgError:
            return None

    return m.map(one)


@_udf(MATRIX)
def pinv(m: pd.Series) -> pd.Series:
    return m.map(lambda v: np.linalg.pinv(matrix(v)).tolist())


@_udf("struct<sign double, ln double>")
def logdet(m: pd.Series) -> pd.DataFrame:
    pairs = [np.linalg.slogdet(matrix(v)) for v in m]
    return pd.DataFrame({"sign": [float(p[0]) for p in pairs], "ln": [float(p[1]) for p in pairs]})


@_udf("array<double>")
def lsolve(m: pd.Series, b: pd.Series) -> pd.Series:
    def one(a, y):  # noqa: ANN001, ANN202
        try:
            return np.linalg.solve(matrix(a), np.asarray(y, float)).tolist()
        except np.linalg.LinAlgError:
            return None

    return pd.Series([one(a, y) for a, y in zip(m, b, strict=True)])


@_udf("array<struct<re double, im double>>")
def eigen(m: pd.Series) -> pd.Series:
    """Eigenvalues by real, then imaginary part."""
    return m.map(lambda v: [{"re": float(z.real), "im": float(z.imag)} for z in sorted(np.linalg.eigvals(matrix(v)), key=lambda z: (round(z.real, 9), z.imag))])


@_udf("array<double>")
def eigen_symmetric(m: pd.Series) -> pd.Series:
    return m.map(lambda v: np.linalg.eigvalsh(matrix(v)).tolist())


@_udf("array<double>")
def charpoly(m: pd.Series) -> pd.Series:
    """Coefficients from the highest power, by Faddeev and LeVerrier."""

    def one(v):  # noqa: ANN001, ANN202
        a = matrix(v)
        n, c, b = len(a), [1.0], np.eye(len(a))
        for k in range(1, n + 1):
            ab = a @ b
            c.append(float(-np.trace(ab) / k))
            b = ab + c[-1] * np.eye(n)
        return c

    return m.map(one)


@_udf(MATRIX)
def expm(m: pd.Series) -> pd.Series:
    """Matrix exponential by scaling, squaring and a [6/6] Pade quotient."""

    def one(v):  # noqa: ANN001, ANN202
        a = matrix(v)
        s = max(0, math.ceil(math.log2(max(np.abs(a).sum(1).max(), 1e-300))) + 1)
        a = a / 2**s
        p, q, x, c = np.eye(len(a)), np.eye(len(a)), np.eye(len(a)), 1.0
        for k in range(1, 7):
            c *= (7 - k) / (k * (13 - k))
            x = a @ x
            p, q = p + c * x, q + (-1) ** k * c * x
        e = np.linalg.solve(q, p)
        for _ in range(s):
            e = e @ e
        return e.tolist()

    return m.map(one)


@_udf("array<struct<re double, im double>>")
def schrodinger(h: pd.Series, psi: pd.Series, t: pd.Series) -> pd.Series:
    """The state ``exp(-i H t) psi`` for a symmetric real H and a real state at time 0, in natural units, by the
    eigenvectors of H; null where H isn't symmetric."""

    def one(a, x, time):  # noqa: ANN001, ANN202
        m = matrix(a)
        if not np.allclose(m, m.T):
            return None
        e, v = np.linalg.eigh(m)
        out = v @ (np.exp(-1j * e * time) * (v.T @ np.asarray(x, float)))
        return [{"re": float(z.real), "im": float(z.imag)} for z in out]

    return pd.Series([one(*x) for x in zip(h, psi, t, strict=True)])


@_udf(MATRIX)
def kron(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([np.kron(matrix(x), matrix(y)).tolist() for x, y in zip(a, b, strict=True)])


@_udf("array<struct<re double, im double>>")
def poly_roots(c: pd.Series) -> pd.Series:
    """Roots of a polynomial by its coefficients from the highest power."""
    return c.map(lambda v: [{"re": float(z.real), "im": float(z.imag)} for z in sorted(np.roots(np.asarray(v, float)), key=lambda z: (round(z.real, 9), z.imag))])
