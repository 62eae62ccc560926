"""Great circles, hexagonal cells, the sky, balanced ternary and units, on columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orewright.functions.scalar import cosd, mod, sind

#: Mean radius of the earth in km, and the ellipsoid's axis and flattening. Fixed values.
R_KM, WGS84_A, WGS84_F = 6371.0087714, 6378.137, 1 / 298.257223563


def dist(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    h = F.pow(sind((lat2 - lat1) / 2), 2) + cosd(lat1) * cosd(lat2) * F.pow(sind((lon2 - lon1) / 2), 2)
    return 2 * R_KM * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial course in degrees, [0, 360)."""
    y = sind(lon2 - lon1) * cosd(lat2)
    x = cosd(lat1) * sind(lat2) - sind(lat1) * cosd(lat2) * cosd(lon2 - lon1)
    return mod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def _lon(x: Column) -> Column:
    y = mod(x, F.lit(360.0))
    return F.when(y > 180, y - 360).otherwise(y)


def midpoint(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    bx, by = cosd(lat2) * cosd(lon2 - lon1), cosd(lat2) * sind(lon2 - lon1)
    lat = F.degrees(F.atan2(sind(lat1) + sind(lat2), F.hypot(cosd(lat1) + bx, by)))
    return F.struct(lat.alias("lat"), _lon(lon1 + F.degrees(F.atan2(by, cosd(lat1) + bx))).alias("lon"))


def dest(lat: Column, lon: Column, course: Column, km: Column) -> Column:
    d = F.degrees(km / R_KM)
    s = sind(lat) * cosd(d) + cosd(lat) * sind(d) * cosd(course)
    lat2 = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))))
    lon2 = lon + F.degrees(F.atan2(sind(course) * sind(d) * cosd(lat), cosd(d) - sind(lat) * sind(lat2)))
    return F.struct(lat2.alias("lat"), mod(lon2, F.lit(360.0)).alias("lon"))


def earth_radius(lat: Column) -> Column:
    """Geocentric radius of the ellipsoid in km."""
    b = WGS84_A * (1 - WGS84_F)
    n = F.pow(WGS84_A**2 * cosd(lat), 2) + F.pow(b**2 * sind(lat), 2)
    return F.sqrt(n / (F.pow(WGS84_A * cosd(lat), 2) + F.pow(b * sind(lat), 2)))


# ---- hexagons ---------------------------------------------------------------------------


def hexdist(q1: Column, r1: Column, q2: Column, r2: Column) -> Column:
    dq, dr = q1 - q2, r1 - r2
    return ((F.abs(dq) + F.abs(dr) + F.abs(dq + dr)) / 2).cast("bigint")


def hexdisk(q: Column, r: Column, k: int) -> Column:
    """Cells within k steps as array of structs."""
    span = F.sequence(F.lit(-k), F.lit(k))
    cells = F.flatten(F.transform(span, lambda a: F.transform(span, lambda b: F.struct((q + a).alias("q"), (r + b).alias("r"), ((F.abs(a) + F.abs(b) + F.abs(a + b)) / 2).cast("int").alias("d")))))
    return F.filter(cells, lambda c: c["d"] <= k)


def hexring(q: Column, r: Column, k: int) -> Column:
    return F.filter(hexdisk(q, r, k), lambda c: c["d"] == k)


def h3children(q: Column, r: Column) -> Column:
    three = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return F.flatten(F.transform(three, lambda i: F.transform(three, lambda j: F.struct((3 * q + i).alias("q"), (3 * r + j).alias("r")))))


def h3parent(q: Column, r: Column) -> Column:
    return F.struct(F.floor((q + 1) / 3).alias("q"), F.floor((r + 1) / 3).alias("r"))


# ---- the sky ----------------------------------------------------------------------------


def julian_day(ts: Column) -> Column:
    """Julian day of a UTC time stamp."""
    t = ts.cast("timestamp")
    return F.unix_micros(t) / 86_400_000_000.0 + 2440587.5


def _day(ts: Column) -> Column:
    return julian_day(ts) - 2451543.5


def _norm(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


def let(value: Column, use) -> Column:  # noqa: ANN001
    """`use` of a value that is computed once a row, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _sun(d: Column) -> tuple[Column, Column, Column]:
    return 282.9404 + 4.70935e-5 * d, 0.016709 - 1.151e-9 * d, _norm(356.0470 + 0.9856002585 * d)


def _centre(e: Column | float, m: Column) -> Column:
    return 360.0 / math.pi * e * sind(m) * (1.0 + e * cosd(m))


def _sun_lon_at(d: Column) -> Column:
    w, e, m = _sun(d)
    return let(m, lambda m: _norm(m + w + _centre(e, m)))


def sun_lon(ts: Column) -> Column:
    return let(_day(ts), _sun_lon_at)


def _equatorial(lon: Column, lat: Column, tilt: Column) -> Column:
    """Right ascension and declination of a place given by ecliptic longitude and latitude."""
    given = F.struct(lon.alias("lon"), lat.alias("lat"), tilt.alias("tilt"))

    def turn(p: Column) -> Column:
        x = cosd(p["lon"]) * cosd(p["lat"])
        y = sind(p["lon"]) * cosd(p["lat"]) * cosd(p["tilt"]) - sind(p["lat"]) * sind(p["tilt"])
        z = sind(p["lon"]) * cosd(p["lat"]) * sind(p["tilt"]) + sind(p["lat"]) * cosd(p["tilt"])
        return F.struct(_norm(F.degrees(F.atan2(y, x))).alias("ra"), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z)))).alias("dec"))

    return let(given, turn)


def _tilt(ts: Column) -> Column:
    return 23.4393 - 3.563e-7 * _day(ts)


def sun_ra(ts: Column) -> Column:
    return _equatorial(sun_lon(ts), F.lit(0.0), _tilt(ts))["ra"]


def sun_dec(ts: Column) -> Column:
    return _equatorial(sun_lon(ts), F.lit(0.0), _tilt(ts))["dec"]


#: Periodic terms of the moon: amplitude and multiples of (its anomaly, elongation, the sun's
#: anomaly, argument of latitude). Fixed values.
MOON_LON = ((-1.274, 1, -2, 0, 0), (0.658, 0, 2, 0, 0), (-0.186, 0, 0, 1, 0), (-0.059, 2, -2, 0, 0), (-0.057, 1, -2, 1, 0), (0.053, 1, 2, 0, 0), (0.046, 0, 2, -1, 0), (0.041, 1, 0, -1, 0), (-0.035, 0, 1, 0, 0), (-0.031, 1, 0, 1, 0), (-0.015, 0, -2, 0, 2), (0.011, 1, -4, 0, 0))
MOON_LAT = ((5.128, 0, 0, 0, 1), (0.280, 1, 0, 0, 1), (0.277, 1, 0, 0, -1), (0.173, 0, 2, 0, -1), (0.055, -1, 2, 0, 1), (0.046, -1, 2, 0, -1))
MOON_E, MOON_A, SYNODIC = 0.0549, 60.2666, 29.530588853


def _moon(ts: Column, use) -> Column:  # noqa: ANN001
    """`use` of a struct: base (mean longitude), m (anomaly), el (elongation), ms (the sun's
    anomaly) and f (argument of latitude), all made once."""

    def args(d: Column) -> Column:
        w, _, ms = _sun(d)
        n, wm, m = _norm(125.1228 - 0.0529538083 * d), _norm(318.0634 + 0.1643573223 * d), _norm(115.3654 + 13.0649929509 * d)
        raw = F.struct(w.alias("w"), ms.alias("ms"), n.alias("n"), wm.alias("wm"), m.alias("m"))

        def derive(r: Column) -> Column:
            base = r["m"] + r["wm"] + r["n"]
            return F.struct(base.alias("base"), r["m"].alias("m"), _norm(_norm(base) - _norm(r["ms"] + r["w"])).alias("el"), r["ms"].alias("ms"), _norm(_norm(base) - r["n"]).alias("f"))

        return let(raw, derive)

    return let(let(_day(ts), args), use)


def _series(terms: tuple, a: Column) -> Column:
    out = F.lit(0.0)
    for amp, i, j, k, x in terms:
        out = out + amp * sind(i * a["m"] + j * a["el"] + k * a["ms"] + x * a["f"])
    return out


def moon_lon(ts: Column) -> Column:
    return _moon(ts, lambda a: _norm(_norm(a["base"] + _centre(MOON_E, a["m"])) + _series(MOON_LON, a)))


def moon_lat(ts: Column) -> Column:
    return _moon(ts, lambda a: _series(MOON_LAT, a))


def moon_dist(ts: Column) -> Column:
    """Distance in km."""
    return _moon(ts, lambda a: WGS84_A * (MOON_A * (1 - MOON_E * cosd(a["m"])) - 0.58 * cosd(a["m"] - 2 * a["el"]) - 0.46 * cosd(2 * a["el"])))


def moon_elongation(ts: Column) -> Column:
    return _norm(moon_lon(ts) - sun_lon(ts))


def moon_phase(ts: Column) -> Column:
    return 180.0 - moon_elongation(ts)


def moon_illum(ts: Column) -> Column:
    return (1 + cosd(moon_phase(ts))) / 2


def moon_age(ts: Column) -> Column:
    return moon_elongation(ts) / 360.0 * SYNODIC


def moon_ra(ts: Column) -> Column:
    return _equatorial(moon_lon(ts), moon_lat(ts), _tilt(ts))["ra"]


def moon_dec(ts: Column) -> Column:
    return _equatorial(moon_lon(ts), moon_lat(ts), _tilt(ts))["dec"]


#: Fourier terms of the equation of time (minutes) and the declination (radians) in the year's
#: angle: (multiple, cosine, sine). Fixed values.
EQ_TIME = ((0, 0.000075, 0.0), (1, 0.001868, -0.032077), (2, -0.014615, -0.040849))
DECLINATION = ((0, 0.006918, 0.0), (1, -0.399912, 0.070257), (2, -0.006758, 0.000907), (3, -0.002697, 0.00148))


def _fourier(terms: tuple, g: Column) -> Column:
    out = F.lit(0.0)
    for k, c, s in terms:
        out = out + c * F.cos(k * g) + s * F.sin(k * g)
    return out


def _sun_times(ts: Column, lat: Column, lon: Column, side: int) -> Column:
    g = 2 * math.pi / 365 * (F.dayofyear(ts) - 1)
    given = F.struct((229.18 * _fourier(EQ_TIME, g)).alias("eq"), _fourier(DECLINATION, g).alias("decl"), F.radians(lat).alias("lat"), lon.alias("lon"))

    def hours(p: Column) -> Column:
        h = math.cos(math.radians(90.833)) / (F.cos(p["lat"]) * F.cos(p["decl"])) - F.tan(p["lat"]) * F.tan(p["decl"])
        return F.when(F.abs(h) <= 1, 12 - p["lon"] / 15 - p["eq"] / 60 + side * F.degrees(F.acos(h)) / 15)

    return let(given, hours)


def sunrise(ts: Column, lat: Column, lon: Column) -> Column:
    """Hours UTC, null where the sun doesn't rise or set that day."""
    return _sun_times(ts, lat, lon, -1)


def sunset(ts: Column, lat: Column, lon: Column) -> Column:
    return _sun_times(ts, lat, lon, 1)


# ---- balanced ternary -------------------------------------------------------------------


def trit_val(s: Column) -> Column:
    """The number a string of the digits 1, 0 and T stands for."""
    return F.aggregate(F.transform(F.split(s, ""), lambda c: F.when(c == "1", 1).when(c == "T", -1).otherwise(0).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a * 3 + x)


def trit_not(s: Column) -> Column:
    return F.translate(s, "1T", "T1")


def _kleene(a: Column, b: Column, pick) -> Column:  # noqa: ANN001
    n = F.greatest(F.length(a), F.length(b))
    digits = lambda s: F.transform(F.split(F.lpad(s, n, "0"), ""), lambda c: F.when(c == "1", 1).when(c == "T", -1).otherwise(0))
    return F.array_join(F.transform(F.zip_with(digits(a), digits(b), pick), lambda x: F.when(x == 1, "1").when(x == -1, "T").otherwise("0")), "")


def trit_and(a: Column, b: Column) -> Column:
    return _kleene(a, b, lambda x, y: F.least(x, y))


def trit_or(a: Column, b: Column) -> Column:
    return _kleene(a, b, lambda x, y: F.greatest(x, y))


def trits(n: Column) -> Column:
    """The balanced ternary digits of an integer: the plain ternary ones of n + (3^39 - 1) / 2, less one each."""
    half = (3**39 - 1) // 2
    powers = F.array(*[F.lit(3**k).cast("bigint") for k in range(38, -1, -1)])
    digit = lambda p: F.call_function("div", n.cast("bigint") + F.lit(half), p) % 3
    text = F.array_join(F.transform(powers, lambda p: F.element_at(F.array(F.lit("T"), F.lit("0"), F.lit("1")), (digit(p) + 1).cast("int"))), "")
    cut = F.regexp_replace(text, "^0+", "")
    return F.when(cut == "", "0").otherwise(cut)


# ---- units ------------------------------------------------------------------------------

#: name -> (kind, factor to the base unit, offset). Fixed values.
UNITS: dict[str, tuple[str, float, float]] = {
    "m": ("length", 1.0, 0.0), "km": ("length", 1e3, 0.0), "cm": ("length", 1e-2, 0.0), "mm": ("length", 1e-3, 0.0), "um": ("length", 1e-6, 0.0), "nm": ("length", 1e-9, 0.0), "ang": ("length", 1e-10, 0.0),
    "au": ("length", 1.495978707e11, 0.0), "pc": ("length", 3.085677581491367e16, 0.0), "ly": ("length", 9.4607304725808e15, 0.0), "mi": ("length", 1609.344, 0.0), "ft": ("length", 0.3048, 0.0), "in": ("length", 0.0254, 0.0), "nmi": ("length", 1852.0, 0.0),
    "kg": ("mass", 1.0, 0.0), "g": ("mass", 1e-3, 0.0), "t": ("mass", 1e3, 0.0), "mg": ("mass", 1e-6, 0.0), "lb": ("mass", 0.45359237, 0.0), "oz": ("mass", 0.028349523125, 0.0), "u": ("mass", 1.66053906892e-27, 0.0),
    "s": ("time", 1.0, 0.0), "ms": ("time", 1e-3, 0.0), "us": ("time", 1e-6, 0.0), "ns": ("time", 1e-9, 0.0), "min": ("time", 60.0, 0.0), "h": ("time", 3600.0, 0.0), "day": ("time", 86400.0, 0.0), "yr": ("time", 31557600.0, 0.0),
    "K": ("temperature", 1.0, 0.0), "degC": ("temperature", 1.0, 273.15), "degF": ("temperature", 5.0 / 9.0, 255.37222222222223),
    "rad": ("angle", 1.0, 0.0), "deg": ("angle", math.pi / 180, 0.0), "arcmin": ("angle", math.pi / 10800, 0.0), "arcsec": ("angle", math.pi / 648000, 0.0), "turn": ("angle", 2 * math.pi, 0.0),
    "bit": ("information", 1.0, 0.0), "byte": ("information", 8.0, 0.0), "KB": ("information", 8e3, 0.0), "MB": ("information", 8e6, 0.0), "GB": ("information", 8e9, 0.0), "TB": ("information", 8e12, 0.0),
    "KiB": ("information", 1024.0, 0.0), "MiB": ("information", 1048576.0, 0.0), "GiB": ("information", 1073741824.0, 0.0), "nat": ("information", 1 / math.log(2), 0.0), "trit": ("information", math.log2(3), 0.0),
    "J": ("energy", 1.0, 0.0), "kJ": ("energy", 1e3, 0.0), "eV": ("energy", 1.602176634e-19, 0.0), "keV": ("energy", 1.602176634e-16, 0.0), "MeV": ("energy", 1.602176634e-13, 0.0),
    "W": ("power", 1.0, 0.0), "kW": ("power", 1e3, 0.0), "MW": ("power", 1e6, 0.0), "Pa": ("pressure", 1.0, 0.0), "kPa": ("pressure", 1e3, 0.0), "MPa": ("pressure", 1e6, 0.0), "atm": ("pressure", 101325.0, 0.0), "bar": ("pressure", 1e5, 0.0),
    "Hz": ("frequency", 1.0, 0.0), "kHz": ("frequency", 1e3, 0.0), "MHz": ("frequency", 1e6, 0.0), "GHz": ("frequency", 1e9, 0.0),
}


def units_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, k, f, o) for n, (k, f, o) in UNITS.items()], "unit string, kind string, factor double, shift double")


def convert(x: Column, source: str, target: str) -> Column:
    """A value from one unit to another of the same kind."""
    (k1, f1, o1), (k2, f2, o2) = UNITS[source], UNITS[target]
    if k1 != k2:
        raise ValueError(f"{source} and {target} differ in kind: {k1}, {k2}")
    return (x * f1 + o1 - o2) / f2
