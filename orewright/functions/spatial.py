"""Relations of points, lines and polygons on an integer lattice, triangulation, isolines, cell addresses.

Geometries are arrays of (x, y): a ring is closed by itself. All decisions are made on
integers and fractions, so they are exact. The relation of two geometries is the string
of nine dimensions (F, 0, 1, 2) of the intersections of interior, boundary and exterior.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from fractions import Fraction

Point = tuple[int, int]
INSIDE, EDGE, OUTSIDE = "I", "B", "E"


def _cross(o, a, b):  # noqa: ANN001, ANN202
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def on_segment(p, a, b) -> bool:  # noqa: ANN001
    return _cross(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def in_ring(p, ring: Sequence[Point]) -> str:  # noqa: ANN001
    """Where a point lies of a ring, by the parity of crossings."""
    inside = False
    for a, b in zip(ring, [*ring[1:], ring[0]], strict=True):
        if on_segment(p, a, b):
            return EDGE
        if (a[1] > p[1]) != (b[1] > p[1]) and (_cross(a, b, p) > 0) == (b[1] > a[1]):
            inside = not inside
    return INSIDE if inside else OUTSIDE


def _area2(ring: Sequence[Point]) -> int:
    return sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))


class Polygon:
    """A ring with holes; outer rings run counter-clockwise and holes clockwise, so that the interior is to the left."""

    def __init__(self, ring: Sequence[Point], holes: Iterable[Sequence[Point]] = ()):
        shell = [tuple(p) for p in ring]
        self.rings = [shell if _area2(shell) > 0 else shell[::-1]]
        for h in holes:
            r = [tuple(p) for p in h]
            self.rings.append(r if _area2(r) < 0 else r[::-1])

    def edges(self) -> list[tuple]:
        return [(a, b) for r in self.rings for a, b in zip(r, [*r[1:], r[0]], strict=True) if a != b]

    def locate(self, p) -> str:  # noqa: ANN001
        where = in_ring(p, self.rings[0])
        for h in self.rings[1:]:
            w = in_ring(p, h)
            if w == EDGE:
                return EDGE
            if w == INSIDE:
                return OUTSIDE
        return where


class Line:
    """A chain of segments; its ends are its boundary unless it is closed."""

    def __init__(self, points: Sequence[Point]):
        self.points = [tuple(p) for p in points]
        self.ends = [] if self.points[0] == self.points[-1] else [self.points[0], self.points[-1]]

    def edges(self) -> list[tuple]:
        return [(a, b) for a, b in zip(self.points, self.points[1:], strict=False) if a != b]

    def locate(self, p) -> str:  # noqa: ANN001
        if p in self.ends:
            return EDGE
        return INSIDE if any(on_segment(p, a, b) for a, b in self.edges()) else OUTSIDE


def _cuts(e, f) -> list:  # noqa: ANN001
    """Points of segment e at which segment f meets it."""
    (a, b), (c, d) = e, f
    den = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
    if den == 0:
        return [p for p in (c, d) if on_segment(p, a, b)]
    t = Fraction((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0]), den)
    u = Fraction((c[0] - a[0]) * (b[1] - a[1]) - (c[1] - a[1]) * (b[0] - a[0]), den)
    return [(a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))] if 0 <= t <= 1 and 0 <= u <= 1 else []


def _split(edges: list, others: list) -> list[tuple]:
    out = []
    for e in edges:
        at = {e[0], e[1]}
        for f in others:
            at.update(_cuts(e, f))
        order = sorted(at, key=lambda p: (p[0] - e[0][0]) * (e[1][0] - e[0][0]) + (p[1] - e[0][1]) * (e[1][1] - e[0][1]))
        out += list(zip(order, order[1:], strict=False))
    return out


def _middle(e):  # noqa: ANN001, ANN202
    return (Fraction(e[0][0] + e[1][0]) / 2, Fraction(e[0][1] + e[1][1]) / 2)


def relate(a: Polygon | Line, b: Polygon | Line) -> str:
    """The nine dimensions, row by row: interior, boundary, exterior of a against those of b."""
    ea, eb = _split(a.edges(), b.edges()), _split(b.edges(), a.edges())
    on_b, on_a = [b.locate(_middle(e)) for e in ea], [a.locate(_middle(e)) for e in eb]
    nodes = {p for e in ea + eb for p in e}
    m = {x + y: -1 for x in "IBE" for y in "IBE"}
    m["EE"] = 2

    def at_least(k: str, d: int) -> None:
        m[k] = max(m[k], d)

    for p in nodes:
        x, y = a.locate(p), b.locate(p)
        if not (isinstance(a, Polygon) and x == INSIDE or isinstance(b, Polygon) and y == INSIDE or OUTSIDE in (x, y)):
            at_least(x + y, 0)
        elif isinstance(a, Line) and x == EDGE or isinstance(b, Line) and y == EDGE:
            at_least(x + y, 0)
    for own, wheres, flip in ((a, on_b, False), (b, on_a, True)):
        line = INSIDE if isinstance(own, Line) else EDGE
        for w in wheres:
            at_least(w + line if flip else line + w, 1)
    if isinstance(a, Polygon) and isinstance(b, Polygon):
        forward = set(eb)
        same = any(w == EDGE and e in forward for e, w in zip(ea, on_b, strict=True))
        against = any(w == EDGE and (e[1], e[0]) in forward for e, w in zip(ea, on_b, strict=True))
        if INSIDE in on_b or INSIDE in on_a or same:
            at_least("II", 2)
        if OUTSIDE in on_b or INSIDE in on_a or against:
            at_least("IE", 2)
        if OUTSIDE in on_a or INSIDE in on_b or against:
            at_least("EI", 2)
    elif isinstance(a, Polygon):
        at_least("IE", 2)
    elif isinstance(b, Polygon):
        at_least("EI", 2)
    return "".join("F" if m[k] < 0 else str(m[k]) for k in ("II", "IB", "IE", "BI", "BB", "BE", "EI", "EB", "EE"))


#: Patterns of the predicates: T any dimension, F none, * either. Fixed values.
PREDICATES = {
    "intersects": ("T********", "*T*******", "***T*****", "****T****"), "disjoint": ("FF*FF****",), "equals": ("T*F**FFF*",), "contains": ("T*****FF*",), "within": ("T*F**F***",),
    "covers": ("T*****FF*", "*T****FF*", "***T**FF*", "****T*FF*"), "covered_by": ("T*F**F***", "*TF**F***", "**FT*F***", "**F*TF***"), "touches": ("FT*******", "F**T*****", "F***T****"),
}


def _fits(code: str, pattern: str) -> bool:
    return all(p == "*" or (p == "F") == (c == "F") for c, p in zip(code, pattern, strict=True))


def holds(code: str, predicate: str, dim_a: int = 2, dim_b: int = 2) -> bool:
    if predicate == "overlaps":
        return dim_a == dim_b and code[0] == str(dim_a) and code[2] != "F" and code[6] != "F"
    if predicate == "crosses":
        return code[0] == "0" if dim_a == dim_b == 1 else dim_a != dim_b and code[0] != "F" and code[2 if dim_a < dim_b else 6] != "F"
    return any(_fits(code, p) for p in PREDICATES[predicate])


# ---- triangulation and isolines -----------------------------------------------------------


def hull(points: Iterable[Point]) -> list[Point]:
    """Convex hull, counter-clockwise from the least point."""
    p = sorted(set(map(tuple, points)))
    if len(p) < 3:
        return p

    def half(ps: list) -> list:
        out: list = []
        for q in ps:
            while len(out) > 1 and _cross(out[-2], out[-1], q) <= 0:
                out.pop()
            out.append(q)
        return out

    return half(p)[:-1] + half(p[::-1])[:-1]


def _in_circle(a, b, c, p) -> bool:  # noqa: ANN001
    m = [(q[0] - p[0], q[1] - p[1]) for q in (a, b, c)]
    s = [x * x + y * y for x, y in m]
    return m[0][0] * (m[1][1] * s[2] - m[2][1] * s[1]) - m[0][1] * (m[1][0] * s[2] - m[2][0] * s[1]) + s[0] * (m[1][0] * m[2][1] - m[2][0] * m[1][1]) > 0


def delaunay(points: Iterable[Point]) -> list[tuple[Point, Point, Point]]:
    """Triangles of the Delaunay triangulation by insertion into a large outer triangle."""
    ps = sorted(set(map(tuple, points)))
    if len(ps) < 3:
        return []
    size = 64 * (1 + max(max(abs(x), abs(y)) for x, y in ps)) ** 2
    outer = [(-3 * size, -3 * size), (3 * size, -3 * size), (0, 3 * size)]
    tris = {tuple(outer)}
    for p in ps:
        bad = [t for t in tris if _in_circle(*t, p)]
        edges = [e for t in bad for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))]
        rim = [e for e in edges if (e[1], e[0]) not in edges]
        tris.difference_update(bad)
        tris.update((a, b, p) for a, b in rim if _cross(a, b, p) > 0)
    out = [t for t in tris if not any(q in outer for q in t)]
    return sorted(tuple(sorted(t)) for t in out)


def isolines(grid: Sequence[Sequence[float]], level: float) -> list[tuple[tuple[float, float], tuple[float, float]]]:
    """Segments at which a grid of heights crosses a level, by marching squares; saddles by the mean."""
    out = []
    for i in range(len(grid) - 1):
        for j in range(len(grid[0]) - 1):
            corner = [(j, i, grid[i][j]), (j + 1, i, grid[i][j + 1]), (j + 1, i + 1, grid[i + 1][j + 1]), (j, i + 1, grid[i + 1][j])]
            cuts = []
            for (x1, y1, h1), (x2, y2, h2) in zip(corner, [*corner[1:], corner[0]], strict=True):
                if (h1 >= level) != (h2 >= level):
                    t = (level - h1) / (h2 - h1)
                    cuts.append((x1 + t * (x2 - x1), y1 + t * (y2 - y1)))
            if len(cuts) == 2:
                out.append((cuts[0], cuts[1]))
            elif len(cuts) == 4:
                high = sum(h for *_, h in corner) / 4 >= level
                first = corner[0][2] >= level
                out += [(cuts[0], cuts[1]), (cuts[2], cuts[3])] if high == first else [(cuts[3], cuts[0]), (cuts[1], cuts[2])]
    return out


# ---- addresses of hexagonal cells ---------------------------------------------------------

DIRECTIONS = ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))
#: Radius of the disk that six ternary digits number, and offsets of its codes. Fixed values.
DISK, SPIRAL_SHIFT, FACE_SHIFT = 13, 364, 13


def ring(k: int) -> list[tuple[int, int]]:
    """Cells at distance k, from the south-west on."""
    out, q, r = [], -k, k
    for dq, dr in DIRECTIONS if k > 0 else ():
        for _ in range(k):
            out.append((q, r))
            q, r = q + dq, r + dr
    return out


def spiral_index(q: int, r: int) -> int:
    k = (abs(q) + abs(r) + abs(q + r)) // 2
    return 0 if k == 0 else 3 * k * (k - 1) + 1 + ring(k).index((q, r))


def spiral_cell(s: int) -> tuple[int, int]:
    k = 0
    while 3 * k * (k + 1) < s:
        k += 1
    return (0, 0) if s == 0 else ring(k)[s - 3 * k * (k - 1) - 1]


def ternary(n: int, width: int) -> str:
    """Balanced ternary digits, filled with zeros to a width."""
    out = ""
    while n or len(out) < width:
        d = (n + 1) % 3 - 1
        out = "T01"[d + 1] + out
        n = (n - d) // 3
    return out


def number(digits: str) -> int:
    v = 0
    for c in digits:
        v = 3 * v + "T01".index(c) - 1
    return v


def world_address(face: int, q: int, r: int, res: int) -> str | None:
    """Face, spiral number of the coarsest cell and a pair of digits for each refinement; null
    outside the faces (20), refinements (6) or the disk."""
    if not (0 <= face < 20 and 0 <= res <= 6):
        return None
    tail = ""
    for _ in range(res):
        pq, pr = (q + 1) // 3, (r + 1) // 3
        tail = ternary(q - 3 * pq, 1) + ternary(r - 3 * pr, 1) + tail
        q, r = pq, pr
    if (abs(q) + abs(r) + abs(q + r)) // 2 > DISK:
        return None
    return ternary(face - FACE_SHIFT, 3) + ternary(spiral_index(q, r) - SPIRAL_SHIFT, 6) + tail


def address_cell(address: str) -> tuple[int, int, int, int] | None:
    """(face, q, r, res) of an address, null if it is none."""
    if not re.fullmatch(r"[T01]{9}(?:[T01]{2}){0,6}", address):
        return None
    s = number(address[3:9]) + SPIRAL_SHIFT
    if not 0 <= s <= 3 * DISK * (DISK + 1):
        return None
    q, r = spiral_cell(s)
    for i in range(9, len(address), 2):
        q, r = 3 * q + number(address[i]), 3 * r + number(address[i + 1])
    return number(address[:3]) + FACE_SHIFT, q, r, (len(address) - 9) // 2
