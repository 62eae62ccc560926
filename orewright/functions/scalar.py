"""The scalar library on columns: elementary, special, log-domain and statistics functions.

Where a real function has no real value the result is null, and :func:`csqrt`,
:func:`cln` and :func:`casin` give the complex one as struct(re, im). ``log`` of one
argument is the decimal logarithm; of two, the base comes second. ``std`` is that of the
population.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def _c(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def ln(x: Column) -> Column:
    return F.when(x == 0, F.lit(-INF)).when(x > 0, F.ln(x))


def log10(x: Column) -> Column:
    return F.when(x == 0, F.lit(-INF)).when(x > 0, F.log10(x))


def log2(x: Column) -> Column:
    return F.when(x == 0, F.lit(-INF)).when(x > 0, F.log2(x))


def log(x: Column, base: float | None = None) -> Column:
    return log10(x) if base is None else F.when(x > 0, F.ln(x) / math.log(base))


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def csqrt(x: Column) -> Column:
    return complex_of(F.when(x >= 0, F.sqrt(x)).otherwise(0.0), F.when(x < 0, F.sqrt(-x)).otherwise(0.0))


def cln(x: Column) -> Column:
    return complex_of(F.when(x == 0, F.lit(-INF)).otherwise(F.ln(F.abs(x))), F.when(x < 0, F.lit(math.pi)).otherwise(0.0))


def casin(x: Column) -> Column:
    """asin; beyond 1, pi/2 with the sign of x and imaginary part of the other sign."""
    far = F.abs(x) > 1
    acosh = F.ln(F.abs(x) + F.sqrt(F.greatest(x * x - 1, F.lit(0.0))))
    return complex_of(F.when(far, F.signum(x) * math.pi / 2).otherwise(F.asin(x)), F.when(far, -F.signum(x) * acosh).otherwise(0.0))


def asin(x: Column) -> Column:
    return F.when(F.abs(x) <= 1, F.asin(x))


def acos(x: Column) -> Column:
    return F.when(F.abs(x) <= 1, F.acos(x))


def acosh(x: Column) -> Column:
    return F.when(x >= 1, F.acosh(x))


def atanh(x: Column) -> Column:
    return F.when(x == 1, F.lit(INF)).when(x == -1, F.lit(-INF)).when(F.abs(x) < 1, F.atanh(x))


def sind(x: Column) -> Column:
    return F.sin(F.radians(x))


def cosd(x: Column) -> Column:
    return F.cos(F.radians(x))


def tand(x: Column) -> Column:
    return F.tan(F.radians(x))


def atan2d(y: Column, x: Column) -> Column:
    return F.degrees(F.atan2(y, x))


def fract(x: Column) -> Column:
    """What trunc leaves, with the sign of x."""
    return x - F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))


def mod(a: Column, b: Column) -> Column:
    """Euclidean remainder: never negative."""
    m = a - F.abs(b) * F.floor(a / F.abs(b))
    return F.when(b != 0, m)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


#: Coefficients of the polynomial for erf (7.1.26 of the Handbook). Fixed values.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    t = 1.0 / (1.0 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (1.0 - poly * F.exp(-x * x)))


def erfc(x: Column) -> Column:
    return 1.0 - erf(x)


def lorentz(beta: Column) -> Column:
    return F.when(F.abs(beta) < 1, 1.0 / F.sqrt(1.0 - beta * beta)).when(F.abs(beta) == 1, F.lit(INF))


def hypot(a: Column, b: Column) -> Column:
    return F.hypot(a, b)


def norm2(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


# ---- log domain -------------------------------------------------------------------------


def logpow(b: Column | float, x: Column) -> Column:
    return x * F.ln(_c(b))


def logaddexp(a: Column, b: Column) -> Column:
    hi = F.greatest(a, b)
    return hi + F.log1p(F.exp(F.least(a, b) - hi))


def logsubexp(a: Column, b: Column) -> Column:
    """ln(e^a - e^b) for a > b, else null."""
    return F.when(a > b, a + F.log1p(-F.exp(b - a)))


def lpsum(v: Column) -> Column:
    """ln of the sum of e^x over an array."""
    hi = F.array_max(v)
    return hi + F.ln(F.aggregate(F.transform(v, lambda x: F.exp(x - hi)), F.lit(0.0), lambda a, x: a + x))


# ---- lists ------------------------------------------------------------------------------


def list_mean(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)


def list_median(v: Column) -> Column:
    s = F.array_sort(v)
    n = F.size(v)
    return (F.element_at(s, ((n + 1) / 2).cast("int")) + F.element_at(s, (n / 2).cast("int") + 1)) / 2


def list_std(v: Column) -> Column:
    m = list_mean(v)
    return F.sqrt(F.aggregate(F.transform(v, lambda x: (x - m) * (x - m)), F.lit(0.0), lambda a, x: a + x) / F.size(v))


# ---- matrices as arrays of rows -----------------------------------------------------------


def identity(n: int) -> Column:
    return F.array(*[F.array(*[F.lit(float(i == j)) for j in range(n)]) for i in range(n)])


def rot2(a: Column) -> Column:
    return F.array(F.array(F.cos(a), -F.sin(a)), F.array(F.sin(a), F.cos(a)))


def rot3(axis: str, a: Column) -> Column:
    c, s, o, z = F.cos(a), F.sin(a), F.lit(1.0), F.lit(0.0)
    rows = {"x": ((o, z, z), (z, c, -s), (z, s, c)), "y": ((c, z, s), (z, o, z), (-s, z, c)), "z": ((c, -s, z), (s, c, z), (z, z, o))}[axis]
    return F.array(*[F.array(*r) for r in rows])


def so_generator(n: int, i: int, j: int) -> Column:
    """The generator of rotations of the plane (i, j) in n dimensions: its exponential at an angle turns i towards j."""
    if i == j or not (0 <= i < n and 0 <= j < n):
        raise ValueError("two different places within the matrix")
    return F.array(*[F.array(*[F.lit(float((r == j and c == i) - (r == i and c == j))) for c in range(n)]) for r in range(n)])


def dagger(m: Column) -> Column:
    """The conjugate transpose of a matrix of structs (re, im)."""
    return F.transform(transpose(m), lambda r: F.transform(r, lambda z: F.struct(z["re"].alias("re"), (-z["im"]).alias("im"))))


def trace(m: Column) -> Column:
    return F.aggregate(F.transform(m, lambda r, i: F.get(r, i)), F.lit(0.0), lambda a, x: a + x)


def transpose(m: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(F.get(m, 0)) - 1), lambda j: F.transform(m, lambda r: F.get(r, j)))


def tridiag(n: int, low: float, mid: float, high: float) -> Column:
    return F.array(*[F.array(*[F.lit(mid if i == j else low if i == j + 1 else high if j == i + 1 else 0.0) for j in range(n)]) for i in range(n)])


def matvec(m: Column, v: Column) -> Column:
    return F.transform(m, lambda r: F.aggregate(F.zip_with(r, v, lambda a, b: a * b), F.lit(0.0), lambda u, x: u + x))


PAULI_X, PAULI_Z = ((0.0, 1.0), (1.0, 0.0)), ((1.0, 0.0), (0.0, -1.0))
#: Imaginary part; the real one is 0.
PAULI_Y = ((0.0, -1.0), (1.0, 0.0))
HADAMARD = ((1 / math.sqrt(2), 1 / math.sqrt(2)), (1 / math.sqrt(2), -1 / math.sqrt(2)))


def constant_matrix(m: tuple[tuple[float, ...], ...]) -> Column:
    return F.array(*[F.array(*[F.lit(x) for x in r]) for r in m])
