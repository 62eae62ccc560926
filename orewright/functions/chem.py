"""Formulas, molar masses, stoichiometry and molecular descriptors from SMILES."""

from __future__ import annotations

import re
from fractions import Fraction
from math import gcd

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Standard atomic masses in order of atomic number. Fixed values.
MASS: dict[str, float] = {
    "H": 1.008, "He": 4.0026, "Li": 6.94, "Be": 9.0122, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Ne": 20.180,
    "Na": 22.990, "Mg": 24.305, "Al": 26.982, "Si": 28.085, "P": 30.974, "S": 32.06, "Cl": 35.45, "Ar": 39.948, "K": 39.098, "Ca": 40.078,
    "Sc": 44.956, "Ti": 47.867, "V": 50.942, "Cr": 51.996, "Mn": 54.938, "Fe": 55.845, "Co": 58.933, "Ni": 58.693, "Cu": 63.546, "Zn": 65.38,
    "Ga": 69.723, "Ge": 72.630, "As": 74.922, "Se": 78.971, "Br": 79.904, "Kr": 83.798, "Rb": 85.468, "Sr": 87.62, "Y": 88.906, "Zr": 91.224,
    "Nb": 92.906, "Mo": 95.95, "Tc": 98.0, "Ru": 101.07, "Rh": 102.91, "Pd": 106.42, "Ag": 107.87, "Cd": 112.41, "In": 114.82, "Sn": 118.71,
    "Sb": 121.76, "Te": 127.60, "I": 126.90, "Xe": 131.29, "Cs": 132.91, "Ba": 137.33, "La": 138.91, "Ce": 140.12, "Pr": 140.91, "Nd": 144.24,
    "Pm": 145.0, "Sm": 150.36, "Eu": 151.96, "Gd": 157.25, "Tb": 158.93, "Dy": 162.50, "Ho": 164.93, "Er": 167.26, "Tm": 168.93, "Yb": 173.05,
    "Lu": 174.97, "Hf": 178.49, "Ta": 180.95, "W": 183.84, "Re": 186.21, "Os": 190.23, "Ir": 192.22, "Pt": 195.08, "Au": 196.97, "Hg": 200.59,
    "Tl": 204.38, "Pb": 207.2, "Bi": 208.98, "Po": 209.0, "At": 210.0, "Rn": 222.0, "Fr": 223.0, "Ra": 226.0, "Ac": 227.0, "Th": 232.04,
    "Pa": 231.04, "U": 238.03, "Np": 237.0, "Pu": 244.0, "Am": 243.0, "Cm": 247.0, "Bk": 247.0, "Cf": 251.0, "Es": 252.0, "Fm": 257.0,
    "Md": 258.0, "No": 259.0, "Lr": 266.0, "Rf": 267.0, "Db": 268.0, "Sg": 269.0, "Bh": 270.0, "Hs": 277.0, "Mt": 278.0, "Ds": 281.0,
    "Rg": 282.0, "Cn": 285.0, "Nh": 286.0, "Fl": 289.0, "Mc": 290.0, "Lv": 293.0, "Ts": 294.0, "Og": 294.0,
}
NUMBER = {s: i + 1 for i, s in enumerate(MASS)}


def composition(formula: str) -> dict[str, int] | None:
    """Atoms of a formula with brackets and a hydrate part; null if it can't be read."""
    out: dict[str, int] = {}
    for i, part in enumerate(re.split(r"[·*]", formula.strip())):
        m = re.match(r"\d+", part) if i else None
        times, text = (int(m.group()), part[m.end() :]) if m else (1, part)
        stack: list[dict[str, int]] = [{}]
        at = 0
        for t in re.finditer(r"([A-Z][a-z]?)(\d*)|([(\[])|([)\]])(\d*)", text):
            if t.start() != at:
                return None
            at = t.end()
            if t.group(1):
                if t.group(1) not in MASS:
                    return None
                stack[-1][t.group(1)] = stack[-1].get(t.group(1), 0) + int(t.group(2) or 1)
            elif t.group(3):
                stack.append({})
            else:
                if len(stack) < 2:
                    return None
                inner = stack.pop()
                for s, n in inner.items():
                    stack[-1][s] = stack[-1].get(s, 0) + n * int(t.group(5) or 1)
        if at != len(text) or len(stack) != 1 or not stack[0]:
            return None
        for s, n in stack[0].items():
            out[s] = out.get(s, 0) + n * times
    return out


def molar_mass(formula: str) -> float | None:
    c = composition(formula)
    return None if c is None else sum(MASS[s] * n for s, n in c.items())


def hill(formula: str) -> str | None:
    """The formula in Hill order: carbon, hydrogen, the rest by symbol."""
    c = composition(formula)
    if c is None:
        return None
    order = ([s for s in ("C", "H") if s in c] if "C" in c else []) + sorted(s for s in c if "C" not in c or s not in ("C", "H"))
    return "".join(s + (str(c[s]) if c[s] > 1 else "") for s in order)


def balance(left: list[str], right: list[str]) -> list[int] | None:
    """Least whole coefficients that balance a reaction; null unless there is just one way."""
    comps = [composition(f) for f in left + right]
    if any(c is None for c in comps):
        return None
    elements = sorted({s for c in comps for s in c})
    rows = [[Fraction(c.get(s, 0) * (1 if i < len(left) else -1)) for i, c in enumerate(comps)] for s in elements]
    n, pivots, r = len(comps), [], 0
    for col in range(n):
        p = next((i for i in range(r, len(rows)) if rows[i][col]), None)
        if p is None:
            continue
        rows[r], rows[p] = rows[p], rows[r]
        rows[r] = [v / rows[r][col] for v in rows[r]]
        for i in range(len(rows)):
            if i != r and rows[i][col]:
                rows[i] = [a - rows[i][col] * b for a, b in zip(rows[i], rows[r], strict=True)]
        pivots.append(col)
        r += 1
    free = [c for c in range(n) if c not in pivots]
    if len(free) != 1:
        return None
    sol = [Fraction(0)] * n
    sol[free[0]] = Fraction(1)
    for i, col in enumerate(pivots):
        sol[col] = -rows[i][free[0]]
    scale = 1
    for v in sol:
        scale = scale * v.denominator // gcd(scale, v.denominator)
    whole = [int(v * scale) for v in sol]
    if all(v < 0 for v in whole):
        whole = [-v for v in whole]
    return whole if all(v > 0 for v in whole) else None


#: Bonds an organic atom makes when nothing else is said. Fixed values.
VALENCE = {"B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "P": (3, 5), "S": (2, 4, 6), "F": (1,), "Cl": (1,), "Br": (1,), "I": (1,)}
_smiles = re.compile(r"\[(\d*)([A-Z][a-z]?|[bcnops]|se|as)(@{0,2})(H\d*)?([+-]\d+|[+]+|-+)?(?::\d+)?\]|(Cl|Br|[BCNOPSFI])|([bcnops])|([-=#:$/\\])|(%\d\d|\d)|([().])")


def smiles_graph(text: str) -> tuple[list[dict], list[tuple[int, int, float]]] | None:
    """Atoms (symbol, aromatic, charge, hydrogens) and bonds of a SMILES string; null if it can't be read."""
    atoms: list[dict] = []
    bonds: list[tuple[int, int, float]] = []
    stack: list[int | None] = []
    open_rings: dict[str, tuple[int, float | None]] = {}
    last: int | None = None
    order: float | None = None
    at = 0
    for m in _smiles.finditer(text):
        if m.start() != at:
            return None
        at = m.end()
        bracket, plain, arom, bond, digit, other = m.group(2), m.group(6), m.group(7), m.group(8), m.group(9), m.group(10)
        if bracket or plain or arom:
            s = bracket or plain or arom
            h = m.group(4)
            charge = m.group(5) or ""
            q = 0 if not charge else int(charge) if charge[1:].isdigit() else len(charge) * (1 if charge[0] == "+" else -1)
            atoms.append({"symbol": s.capitalize(), "aromatic": s[0].islower(), "charge": q, "h": (int(h[1:] or 1) if h else 0) if bracket else None})
            if last is not None:
                bonds.append((last, len(atoms) - 1, order or (1.5 if atoms[last]["aromatic"] and s[0].islower() else 1.0)))
            last, order = len(atoms) - 1, None
        elif bond:
            order = {"-": 1.0, "=": 2.0, "#": 3.0, "$": 4.0, ":": 1.5}.get(bond, 1.0)
        elif digit:
            if last is None:
                return None
            if digit in open_rings:
                a, o = open_rings.pop(digit)
                bonds.append((a, last, o or order or (1.5 if atoms[a]["aromatic"] and atoms[last]["aromatic"] else 1.0)))
            else:
                open_rings[digit] = (last, order)
            order = None
        elif other == "(":
            stack.append(last)
        elif other == ")":
            if not stack:
                return None
            last = stack.pop()
        else:
            last = None
    if at != len(text) or stack or open_rings or not atoms:
        return None
    used = [0.0] * len(atoms)
    for a, b, o in bonds:
        used[a] += o
        used[b] += o
    for i, x in enumerate(atoms):
        if x["h"] is None:
            sum_ = int(used[i] + 0.5 if used[i] % 1 else used[i])
            x["h"] = next((v - sum_ for v in VALENCE[x["symbol"]] if v >= sum_), 0)
    return atoms, bonds


def descriptors(smiles: str) -> dict | None:
    """Mass, rings, donors and acceptors of hydrogen bonds, rotatable bonds, and the rule of five without logP."""
    g = smiles_graph(smiles)
    if g is None:
        return None
    atoms, bonds = g
    near: dict[int, list[int]] = {i: [] for i in range(len(atoms))}
    for a, b, _ in bonds:
        near[a].append(b)
        near[b].append(a)
    seen: set[int] = set()
    parts = 0
    for i in range(len(atoms)):
        if i not in seen:
            parts += 1
            todo = [i]
            while todo:
                v = todo.pop()
                if v not in seen:
                    seen.add(v)
                    todo += near[v]
    mass = sum(MASS[x["symbol"]] + MASS["H"] * x["h"] for x in atoms)
    hetero = [x for x in atoms if x["symbol"] in ("N", "O")]
    donors = sum(x["h"] > 0 for x in hetero)

    def in_ring(a: int, b: int) -> bool:
        todo, done = [v for v in near[a] if v != b], {a}
        while todo:
            v = todo.pop()
            if v == b:
                return True
            if v not in done:
                done.add(v)
                todo += near[v]
        return False

    turn = sum(o == 1.0 and len(near[a]) > 1 and len(near[b]) > 1 and not in_ring(a, b) for a, b, o in bonds)
    return {"atoms": len(atoms), "mass": mass, "rings": len(bonds) - len(atoms) + parts, "donors": donors, "acceptors": len(hetero), "rotatable": turn, "charge": sum(x["charge"] for x in atoms), "five": donors <= 5 and len(hetero) <= 10 and mass <= 500}


def mass_column(formula: Column | str) -> Column:
    return F.pandas_udf(lambda f: f.map({v: molar_mass(v) for v in f.dropna().unique()}), "double")(formula)


def hill_column(formula: Column | str) -> Column:
    return F.pandas_udf(lambda f: f.map({v: hill(v) for v in f.dropna().unique()}), "string")(formula)


def descriptors_column(smiles: Column | str) -> Column:
    """Descriptors as a struct, null fields where the string can't be read."""
    names = ["atoms", "mass", "rings", "donors", "acceptors", "rotatable", "charge", "five"]

    def run(s: pd.Series) -> pd.DataFrame:
        rows = [(descriptors(v) if v is not None else None) or dict.fromkeys(names) for v in s]
        out = pd.DataFrame(rows, columns=names)
        for c in ("atoms", "rings", "donors", "acceptors", "rotatable", "charge"):
            out[c] = out[c].astype("Int64")
        return out.astype({"five": "boolean"})

    return F.pandas_udf(run, "atoms int, mass double, rings int, donors int, acceptors int, rotatable int, charge int, five boolean")(smiles)
