"""Calculator expressions as columns.

``calc("2 r^2 + 3 km to mi", {"r": F.col("x")})`` gives a column: the text is read once on
the driver and becomes built-in expressions, so it runs inside the plan like any other.

Grammar: ``+ - * / ^ !``, ``×`` and ``÷``, brackets, calls, a factor written next to another
(``2(x+1)``, ``3 x``), units behind numbers (``5 km``), ``to`` a unit at the end, and
``name = expression;`` before the last expression. ``^`` binds to the right and tighter
than a leading minus; ``log`` is decimal. Sums need equal dimensions; a result with a unit
comes out in that unit's base units unless ``to`` names another.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from orewright.functions import scalar as S
from orewright.functions.geo import UNITS
from orewright.functions.planets import CONSTANTS

_token = re.compile(r"\s*(?:(\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([^\W\d]\w*)|(.))", re.S)

FUNCTIONS: dict[str, tuple[int, Callable[..., Column]]] = {
    "sin": (1, F.sin), "cos": (1, F.cos), "tan": (1, F.tan), "asin": (1, S.asin), "acos": (1, S.acos), "atan": (1, F.atan), "atan2": (2, F.atan2), "sinh": (1, F.sinh), "cosh": (1, F.cosh), "tanh": (1, F.tanh), "asinh": (1, F.asinh), "acosh": (1, S.acosh), "atanh": (1, S.atanh),
    "sind": (1, S.sind), "cosd": (1, S.cosd), "tand": (1, S.tand), "atan2d": (2, S.atan2d), "exp": (1, F.exp), "ln": (1, S.ln), "log": (1, S.log10), "log2": (1, S.log2), "log10": (1, S.log10), "sqrt": (1, S.sqrt), "cbrt": (1, F.cbrt), "hypot": (2, F.hypot), "pow": (2, F.pow),
    "abs": (1, F.abs), "floor": (1, F.floor), "ceil": (1, F.ceil), "round": (1, F.round), "sign": (1, F.signum), "fract": (1, S.fract), "min": (0, F.least), "max": (0, F.greatest), "mod": (2, S.mod), "erf": (1, S.erf), "erfc": (1, S.erfc), "lorentz": (1, S.lorentz), "deg2rad": (1, F.radians), "rad2deg": (1, F.degrees),
}
Dim = tuple[tuple[str, int], ...]


class Quantity:
    """A column with the dimensions of its unit."""

    def __init__(self, value: Column, dim: Mapping[str, int] | Dim = ()):
        self.value = value
        self.dim: Dim = tuple(sorted((k, n) for k, n in dict(dim).items() if n))

    def times(self, other: Quantity, sign: int) -> Quantity:
        dim = dict(self.dim)
        for k, n in other.dim:
            dim[k] = dim.get(k, 0) + sign * n
        return Quantity(self.value * other.value if sign > 0 else self.value / F.nullif(other.value, F.lit(0.0)), dim)


class _Parser:
    def __init__(self, text: str, names: Mapping[str, Column]):
        self.tokens = [m.groups() for m in _token.finditer(text.strip())]
        self.names = {k: Quantity(v) for k, v in names.items()}
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return next(t for t in self.tokens[i] if t is not None) if i < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        t = self.peek()
        if not t or want and t != want:
            raise ValueError(f"{want or 'a value'} expected at {t or 'the end'}")
        self.at += 1
        return t

    def is_name(self, ahead: int = 0) -> bool:
        i = self.at + ahead
        return i < len(self.tokens) and self.tokens[i][1] is not None

    def program(self) -> Quantity:
        while self.is_name() and self.peek(1) == "=":
            name = self.take()
            self.take("=")
            self.names[name] = self.sum()
            self.take(";")
        out = self.sum()
        if self.peek() == "to":
            self.take()
            unit = self.take()
            kind, factor, shift = UNITS[unit] if unit in UNITS else (None, 1.0, 0.0)
            if kind is None or out.dim != ((kind, 1),):
                raise ValueError(f"can't be given in {unit}")
            out = Quantity((out.value - shift) / factor)
        if self.peek():
            raise ValueError(f"unexpected {self.peek()}")
        return out

    def sum(self) -> Quantity:
        out = self.product()
        while self.peek() in ("+", "-", "−"):
            op, right = self.take(), self.product()
            if out.dim != right.dim:
                raise ValueError("sum of different dimensions")
            out = Quantity(out.value + right.value if op == "+" else out.value - right.value, out.dim)
        return out

    def product(self) -> Quantity:
        out = self.signed()
        while True:
            if self.peek() in ("*", "×", "·"):
                self.take()
                out = out.times(self.signed(), 1)
            elif self.peek() in ("/", "÷"):
                self.take()
                out = out.times(self.signed(), -1)
            elif self.peek() == "(" or self.is_name() and self.peek() != "to":
                out = out.times(self.power(), 1)
            else:
                return out

    def signed(self) -> Quantity:
        if self.peek() in ("-", "−"):
            self.take()
            q = self.signed()
            return Quantity(-q.value, q.dim)
        if self.peek() == "+":
            self.take()
            return self.signed()
        return self.power()

    def power(self) -> Quantity:
        base = self.postfix()
        if self.peek() != "^":
            return base
        self.take()
        whole = int(self.peek()) if re.fullmatch(r"\d+", self.peek()) else None
        exp = self.signed()
        if exp.dim or base.dim and whole is None:
            raise ValueError("exponents have no unit, and units only whole ones")
        return Quantity(F.pow(base.value, exp.value), {k: n * (whole or 0) for k, n in base.dim})

    def postfix(self) -> Quantity:
        q = self.atom()
        while self.peek() == "!":
            self.take()
            q = Quantity(F.when(q.value.between(0, 20) & (q.value == F.floor(q.value)), F.factorial(q.value.cast("int")).cast("double")))
        return q

    def atom(self) -> Quantity:
        if self.peek() == "(":
            self.take()
            q = self.sum()
            self.take(")")
            return q
        if self.at < len(self.tokens) and self.tokens[self.at][0] is not None:
            value = float(self.take())
            if self.is_name() and self.peek() in UNITS and self.peek() not in self.names and self.peek(1) != "(":
                kind, factor, shift = UNITS[self.take()]
                return Quantity(F.lit(value * factor + shift), {kind: 1})
            return Quantity(F.lit(value))
        if not self.is_name():
            raise ValueError(f"a value expected at {self.peek() or 'the end'}")
        name = self.take()
        if name in self.names:
            return self.names[name]
        if name in FUNCTIONS and self.peek() == "(":
            self.take("(")
            args = [self.sum()]
            while self.peek() == ",":
                self.take()
                args.append(self.sum())
            self.take(")")
            many, f = FUNCTIONS[name]
            if many and len(args) != many or not many and len(args) < 2:
                raise ValueError(f"{name} takes {many or 'two or more'} values")
            if any(a.dim for a in args):
                raise ValueError(f"{name} takes numbers without a unit")
            return Quantity(f(*[a.value for a in args]).cast("double"))
        if name in CONSTANTS:
            return Quantity(F.lit(CONSTANTS[name][0]))
        raise ValueError(f"unknown name {name}")


def calc(text: str, names: Mapping[str, Column] | None = None) -> Column:
    """The column of an expression; `names` are its variables. Raises ValueError for what can't be read."""
    return _Parser(text, names or {}).program().value


