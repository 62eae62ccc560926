"""Exact integer and numeric routines that the Arrow functions of :mod:`numbers` call."""

from __future__ import annotations

import math

import numpy as np

#: Witnesses that decide primality below 2^64. Fixed values.
WITNESSES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)


def prime(n: int) -> bool:
    if n < 2:
        return False
    for p in WITNESSES:
        if n % p == 0:
            return n == p
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in WITNESSES:
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def factors(n: int) -> list[int]:
    """Flat list of primes and exponents, by trial division and Pollard's rho."""
    out: dict[int, int] = {}

    def split(m: int) -> None:
        if m == 1:
            return
        if prime(m):
            out[m] = out.get(m, 0) + 1
            return
        for p in WITNESSES:
            if m % p == 0:
                out[p] = out.get(p, 0) + 1
                split(m // p)
                return
        c = 1
        while True:
            x = y = 2
            d = 1
            while d == 1:
                x = (x * x + c) % m
                y = (y * y + c) % m
                y = (y * y + c) % m
                d = math.gcd(abs(x - y), m)
            if d != m:
                split(d)
                split(m // d)
                return
            c += 1

    split(n)
    return [v for p in sorted(out) for v in (p, out[p])]


def zeta_of(s: float) -> float:
    """Riemann's zeta by Euler-Maclaurin, by the functional equation below 0."""
    if s == 1:
        return math.inf
    if s < 0:
        return 0.0 if s % 2 == 0 else 2**s * math.pi ** (s - 1) * math.sin(math.pi * s / 2) * math.gamma(1 - s) * zeta_of(1 - s)
    n = 20
    out = sum(k**-s for k in range(1, n)) + n ** (1 - s) / (s - 1) + n**-s / 2
    term, bern = s * n ** (-s - 1), (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730)
    fact = 2.0
    for k, b in enumerate(bern, 1):
        out += b / fact * term
        term *= (s + 2 * k - 1) * (s + 2 * k) / n**2
        fact *= (2 * k + 1) * (2 * k + 2)
    return out


def matrix(v) -> np.ndarray:  # noqa: ANN001
    return np.array([np.asarray(r, float) for r in v])
