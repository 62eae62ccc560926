"""Positions of the planets from osculating elements, in columns, and physical constants.

A planet moves on its ellipse by Kepler's equation, which Newton's method solves in
radians; the place in the plane of the orbit is carried into the ecliptic by the two unit
vectors of that plane. Seen from the earth a planet stands at the sum of its place around
the sun and the sun's place around the earth, whose orbit is the sun's apparent one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements at the start of 2000 and their change a day, angles in degrees, axes in astronomical units: longitude of
#: the ascending node, inclination, argument of the perihelion, axis, eccentricity, mean anomaly. Fixed values.
ORBITS: dict[str, dict[str, tuple[float, float]]] = {
    "sun": {"node": (0.0, 0.0), "tilt": (0.0, 0.0), "peri": (282.9404, 4.70935e-5), "axis": (1.0, 0.0), "ecc": (0.016709, -1.151e-9), "mean": (356.0470, 0.9856002585)},
    "mercury": {"node": (48.3313, 3.24587e-5), "tilt": (7.0047, 5.00e-8), "peri": (29.1241, 1.01444e-5), "axis": (0.387098, 0.0), "ecc": (0.205635, 5.59e-10), "mean": (168.6562, 4.0923344368)},
    "venus": {"node": (76.6799, 2.46590e-5), "tilt": (3.3946, 2.75e-8), "peri": (54.8910, 1.38374e-5), "axis": (0.723330, 0.0), "ecc": (0.006773, -1.302e-9), "mean": (48.0052, 1.6021302244)},
    "mars": {"node": (49.5574, 2.11081e-5), "tilt": (1.8497, -1.78e-8), "peri": (286.5016, 2.92961e-5), "axis": (1.523688, 0.0), "ecc": (0.093405, 2.516e-9), "mean": (18.6021, 0.5240207766)},
    "jupiter": {"node": (100.4644, 2.76854e-5), "tilt": (1.3030, -1.557e-7), "peri": (273.8777, 1.64505e-5), "axis": (5.20256, 0.0), "ecc": (0.048498, 4.469e-9), "mean": (19.8950, 0.0830853001)},
    "saturn": {"node": (113.6634, 2.38980e-5), "tilt": (2.4886, -1.081e-7), "peri": (339.3939, 2.97661e-5), "axis": (9.55475, 0.0), "ecc": (0.055546, -9.499e-9), "mean": (316.9670, 0.0334442282)},
    "uranus": {"node": (74.0005, 1.3978e-5), "tilt": (0.7733, 1.9e-8), "peri": (96.6612, 3.0565e-5), "axis": (19.18171, 0.0), "ecc": (0.047318, 7.45e-9), "mean": (142.5905, 0.011725806)},
    "neptune": {"node": (131.7806, 3.0173e-5), "tilt": (1.7700, -2.55e-7), "peri": (272.8461, -6.027e-6), "axis": (30.05826, 0.0), "ecc": (0.008606, 2.15e-9), "mean": (260.2471, 0.005995147)},
}
#: What Jupiter and Saturn do to each other: a term is an amount, a wave, multiples of the mean anomalies of
#: Jupiter and Saturn, and a phase in degrees; longitude and latitude in degrees, distance in au. Fixed values.
PULLS: dict[str, dict[str, list[tuple[float, str, int, int, float]]]] = {
    "jupiter": {
        "lon": [(-0.332, "sin", 2, -5, -67.6), (-0.056, "sin", 2, -2, 21.0), (0.042, "sin", 3, -5, -71.0), (-0.036, "sin", 1, -2, 0.0), (0.022, "cos", 1, -1, 0.0), (0.023, "sin", 2, -3, 52.0), (-0.016, "sin", 1, -5, -69.0)],
        "lat": [],
        "dist": [(-0.047, "cos", 1, -1, 0.0), (-0.010, "cos", 2, -2, 0.0), (0.005, "cos", 1, 1, 0.0)],
    },
    "saturn": {
        "lon": [(0.812, "sin", 2, -5, -67.6), (-0.229, "cos", 2, -4, -2.0), (0.119, "sin", 1, -2, -3.0), (0.046, "sin", 2, -6, -69.0), (0.014, "sin", 1, -3, 32.0)],
        "lat": [(-0.020, "cos", 2, -4, -2.0), (0.018, "sin", 2, -6, -49.0)],
        "dist": [(0.055, "cos", 1, -1, 0.0), (-0.046, "cos", 2, -2, 0.0), (0.011, "cos", 2, -4, -2.0)],
    },
}
#: The start of 2000 as a Julian day, and Newton steps, which for planets' eccentricities reach the last digit.
START, STEPS = 2451543.5, 6


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _element(orbit: str, name: str, d: Column) -> Column:
    at, change = ORBITS[orbit][name]
    return F.lit(at) + F.lit(change) * d if change else F.lit(at)


def eccentric(mean: Column, ecc: Column) -> Column:
    """The eccentric anomaly of a mean one, both in radians."""
    step = lambda big, _: big - (big - ecc * F.sin(big) - mean) / (1.0 - ecc * F.cos(big))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), mean + ecc * F.sin(mean), step)


def place(orbit: str, d: Column) -> Column:
    """Struct of ecliptic x, y, z in au on an orbit, d days after :data:`START`."""

    def angles(q: Column) -> Column:
        return let(F.struct(q["e"].alias("e"), q["a"].alias("a"), q["w"].alias("w"), q["n"].alias("n"), q["i"].alias("i"), eccentric(q["m"], q["e"]).alias("big")), in_plane)

    def in_plane(q: Column) -> Column:
        return F.struct(
            (q["a"] * (F.cos(q["big"]) - q["e"])).alias("u"), (q["a"] * F.sqrt(1.0 - q["e"] * q["e"]) * F.sin(q["big"])).alias("v"),
            F.cos(q["w"]).alias("cw"), F.sin(q["w"]).alias("sw"), F.cos(q["n"]).alias("cn"), F.sin(q["n"]).alias("sn"), F.cos(q["i"]).alias("ci"), F.sin(q["i"]).alias("si"),
        )

    def in_space(q: Column) -> Column:
        along = (q["cw"] * q["cn"] - q["sw"] * q["sn"] * q["ci"], q["cw"] * q["sn"] + q["sw"] * q["cn"] * q["ci"], q["sw"] * q["si"])
        across = (-q["sw"] * q["cn"] - q["cw"] * q["sn"] * q["ci"], -q["sw"] * q["sn"] + q["cw"] * q["cn"] * q["ci"], q["cw"] * q["si"])
        return F.struct(*[(q["u"] * p + q["v"] * r).alias(name) for name, p, r in zip("xyz", along, across, strict=True)])

    rad = {k: F.radians(_element(orbit, k, d)) for k in ("node", "tilt", "peri", "mean")}
    start = F.struct(rad["node"].alias("n"), rad["tilt"].alias("i"), rad["peri"].alias("w"), rad["mean"].alias("m"), _element(orbit, "ecc", d).alias("e"), _element(orbit, "axis", d).alias("a"))
    return let(let(start, angles), in_space)


def _pull(planet: str, what: str, d: Column) -> Column:
    out = F.lit(0.0)
    for amount, wave, j, s, phase in PULLS[planet][what]:
        angle = F.radians(j * _element("jupiter", "mean", d) + s * _element("saturn", "mean", d) + phase)
        out = out + F.lit(amount) * (F.sin(angle) if wave == "sin" else F.cos(angle))
    return out


def _polar(p: Column) -> Column:
    """Struct of longitude and latitude in degrees, and distance."""
    flat = F.hypot(p["x"], p["y"])
    return F.struct(F.degrees(F.atan2(p["y"], p["x"])).alias("lon"), F.degrees(F.atan2(p["z"], flat)).alias("lat"), F.hypot(flat, p["z"]).alias("dist"))


def _pulled(planet: str, p: Column, d: Column) -> Column:
    def moved(q: Column) -> Column:
        lon, lat = F.radians(q["lon"] + _pull(planet, "lon", d)), F.radians(q["lat"] + _pull(planet, "lat", d))
        return let(
            F.struct(lon.alias("lon"), lat.alias("lat"), (q["dist"] + _pull(planet, "dist", d)).alias("r")),
            lambda t: F.struct((t["r"] * F.cos(t["lon"]) * F.cos(t["lat"])).alias("x"), (t["r"] * F.sin(t["lon"]) * F.cos(t["lat"])).alias("y"), (t["r"] * F.sin(t["lat"])).alias("z")),
        )

    return let(let(p, _polar), moved)


def planet(name: str, julian_day: Column) -> Column:
    """Struct of ecliptic longitude and latitude in degrees and distance in au of a planet on a Julian day,
    seen from the earth; ``earth`` gives the sun's. Null on a null day."""
    if name not in ORBITS and name != "earth":
        raise ValueError(f"unknown planet: {name}")
    own = "sun" if name == "earth" else name

    def seen(d: Column) -> Column:
        at = place(own, d)
        if own in PULLS:
            at = _pulled(own, at, d)
        if own != "sun":
            at = let(F.struct(at.alias("p"), place("sun", d).alias("s")), lambda q: F.struct(*[(q["p"][c] + q["s"][c]).alias(c) for c in "xyz"]))
        return let(let(at, _polar), lambda q: F.struct((F.pmod(q["lon"], F.lit(360.0))).alias("lon"), q["lat"].alias("lat"), q["dist"].alias("dist")))

    return let(julian_day - START, seen)


_C, _H, _K, _NA, _G, _MU0 = 299792458.0, 6.62607015e-34, 1.380649e-23, 6.02214076e23, 6.67430e-11, 1.25663706127e-6
_HB = _H / math.tau
_MP = math.sqrt(_HB * _C / _G)
#: name -> (value, unit). Fixed values and what follows from them.
CONSTANTS: dict[str, tuple[float, str]] = {
    "pi": (math.pi, ""), "tau": (math.tau, ""), "e": (math.e, ""), "phi": ((1 + math.sqrt(5)) / 2, ""), "sqrt2": (math.sqrt(2), ""), "ln2": (math.log(2), ""), "c": (_C, "m/s"), "h": (_H, "J*s"), "hbar": (_HB, "J*s"),
    "qe": (1.602176634e-19, "C"), "k_B": (_K, "J/K"), "N_A": (_NA, "1/mol"), "R": (_NA * _K, "J/(mol*K)"), "sigma_sb": (2 * math.pi**5 * _K**4 / (15 * _H**3 * _C**2), "W/(m^2*K^4)"), "mu0": (_MU0, "N/A^2"), "eps0": (1 / (_MU0 * _C * _C), "F/m"),
    "alpha": (1 / 137.035999177, ""), "m_e": (9.1093837139e-31, "kg"), "m_p": (1.67262192595e-27, "kg"), "m_n": (1.67492750056e-27, "kg"), "u": (1.66053906892e-27, "kg"), "eV": (1.602176634e-19, "J"), "G": (_G, "m^3/(kg*s^2)"), "g0": (9.80665, "m/s^2"),
    "au": (1.495978707e11, "m"), "pc": (648000 / math.pi * 1.495978707e11, "m"), "ly": (31557600 * _C, "m"), "GM_sun": (1.32712440018e20, "m^3/s^2"), "GM_earth": (3.986004418e14, "m^3/s^2"), "GM_moon": (4.902800066e12, "m^3/s^2"),
    "M_sun": (1.9885e30, "kg"), "M_earth": (5.9722e24, "kg"), "M_moon": (7.342e22, "kg"), "R_sun": (6.957e8, "m"), "R_earth": (6378137.0, "m"), "R_moon": (1.7374e6, "m"), "wien_b": (2.897771955e-3, "m*K"),
    "l_P": (math.sqrt(_HB * _G / _C**3), "m"), "t_P": (math.sqrt(_HB * _G / _C**5), "s"), "m_Pl": (_MP, "kg"), "E_P": (_MP * _C * _C, "J"), "T_Pl": (math.sqrt(_HB * _C**5 / _G) / _K, "K"), "trit": (math.log2(3), "bit"), "nat": (1 / math.log(2), "bit"), "psi": (2 * math.pi / 3, ""),
}


def constants_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, v, u) for n, (v, u) in CONSTANTS.items()], "name string, value double, unit string")
