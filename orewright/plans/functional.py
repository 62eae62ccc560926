"""Queries of the scalar library over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orewright.functions import calc as K
from orewright.functions import geo as G
from orewright.functions import numbers as N
from orewright.functions import planets as P
from orewright.functions import scalar as S
from orewright.session import table


def _ev(s, d):
    """Numbers to feed the functions: x from the value, y within (-2, 2), and places on the globe."""
    e = table(s, d, "events").select("event_id", "ts", "user_id", F.col("value").alias("x"))
    k = F.col("event_id").cast("double")
    return e.select(
        "event_id", "ts", "user_id", "x", ((F.col("event_id") % 401) / 100.0 - 2).alias("y"), ((F.col("event_id") % 171) - 85.0).alias("lat1"), ((F.col("event_id") % 359) - 179.0).alias("lon1"),
        (((k * 7) % 163) - 81.0).alias("lat2"), (((k * 11) % 353) - 176.0).alias("lon2"),
    )


def _r(df, n=6, keep=("event_id",)):
    return df.select(*keep, *[F.round(c, n).alias(c) for c in df.columns if c not in keep])


def _cols(make):
    def run(s, d, n=6):
        f = make(*[F.col(c) for c in ("x", "y", "lat1", "lon1", "lat2", "lon2", "ts")])
        return _r(_ev(s, d).select("event_id", *[v.alias(k) for k, v in f.items()]), n)

    return run


def _int(s, d):
    return table(s, d, "events").select("event_id", (F.col("event_id") % 997).alias("a"), (F.col("event_id") % 360 + 1).alias("b"))


def _list(s, d):
    """Values of each user as a list."""
    return table(s, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("value")).alias("v"))


def _matrix(s, d):
    a = F.col("event_id") % 7 + 1.0
    b = F.col("event_id") % 5 + 0.5
    return table(s, d, "events").select("event_id", F.array(F.array(a, b, F.lit(0.5)), F.array(b, a + 3, F.lit(1.0)), F.array(F.lit(0.5), F.lit(1.0), a + b)).alias("m"), F.array(a, b, F.lit(2.0)).alias("v"))


QUERIES = {
    "fn_trig": _cols(lambda x, y, la1, lo1, la2, lo2, ts: dict(sin=F.sin(x), cos=F.cos(x), tan_y=F.tan(y), atan=F.atan(x), atan2=F.atan2(y, x + 0.5), sinh=F.sinh(y), cosh=F.cosh(y), tanh=F.tanh(y), asinh=F.asinh(y), sind=S.sind(x), cosd=S.cosd(x), tand=S.tand(y), atan2d=S.atan2d(y, x + 0.5), rad=F.radians(x), deg=F.degrees(y))),
    "fn_inverse": _cols(lambda x, y, la1, lo1, la2, lo2, ts: dict(asin=S.asin(y), acos=S.acos(y), acosh=S.acosh(y), atanh=F.when(F.abs(y) != 1, S.atanh(y)), casin_re=S.casin(y)["re"], casin_im=S.casin(y)["im"])),
    "fn_log": _cols(lambda x, y, la1, lo1, la2, lo2, ts: dict(ln=F.when(y != 0, S.ln(y)), log=F.when(y != 0, S.log(y)), log2=F.when(y != 0, S.log2(y)), log_base3=S.log(y, 3), exp=F.exp(y), sqrt=S.sqrt(y), csqrt_im=S.csqrt(y)["im"], cln_im=F.when(y != 0, S.cln(y)["im"]), cbrt=F.cbrt(y), hypot=S.hypot(x, y), pow=F.pow(F.abs(y), 1.5))),
    "fn_round": _cols(lambda x, y, la1, lo1, la2, lo2, ts: dict(floor=F.floor(y).cast("double"), ceil=F.ceil(y).cast("double"), round=F.round(y), sign=F.signum(y), fract=S.fract(y), mod=S.mod(y, F.lit(0.7)), mod_neg=S.mod(x, F.lit(-3.0)), clamp=S.clamp(y, -1.0, 1.0), least=F.least(x, y), greatest=F.greatest(x, y), abs=F.abs(y))),
    "fn_special": _cols(lambda x, y, la1, lo1, la2, lo2, ts: dict(erf=S.erf(y), erfc=S.erfc(y), lorentz=F.when(F.abs(y) != 1, S.lorentz(y)))),
    "fn_logdomain": _cols(lambda x, y, la1, lo1, la2, lo2, ts: dict(logpow=S.logpow(2.0, x), logaddexp=S.logaddexp(x, y), logsubexp=S.logsubexp(y + 3, y), expneg=-F.abs(y), lpsum=S.lpsum(F.array(x, y, y + 1)))),
    "fn_list_stats": lambda s, d: _r(_list(s, d).select("user_id", S.list_mean(F.col("v")).alias("mean"), S.list_median(F.col("v")).alias("median"), S.list_std(F.col("v")).alias("std"), S.norm2(F.col("v")).alias("norm")), 4, ("user_id",)),
    "fn_group_stats": lambda s, d: _r(table(s, d, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_pop("value").alias("std"), F.min("value").alias("lo"), F.max("value").alias("hi")), 4, ("event_type",)),
    "fn_geodesy": _cols(lambda x, y, la1, lo1, la2, lo2, ts: dict(dist=G.dist(la1, lo1, la2, lo2), bearing=G.bearing(la1, lo1, la2, lo2), mid_lat=G.midpoint(la1, lo1, la2, lo2)["lat"], dest_lat=G.dest(la1, lo1, F.lit(33.0), F.lit(500.0))["lat"], dest_lon=G.dest(la1, lo1, F.lit(33.0), F.lit(500.0))["lon"], earth=G.earth_radius(la1))),
    "fn_sun": _cols(lambda x, y, la1, lo1, la2, lo2, ts: dict(jd=G.julian_day(ts), lon=G.sun_lon(ts), ra=G.sun_ra(ts), dec=G.sun_dec(ts))),
    "fn_moon": _cols(lambda x, y, la1, lo1, la2, lo2, ts: dict(lon=G.moon_lon(ts), lat=G.moon_lat(ts), dist=G.moon_dist(ts), phase=G.moon_phase(ts), illum=G.moon_illum(ts), age=G.moon_age(ts), dec=G.moon_dec(ts))),
    "fn_sunrise": lambda s, d: _r(_ev(s, d).select("event_id", G.sunrise(F.col("ts"), F.col("lat1"), F.col("lon1")).alias("rise"), G.sunset(F.col("ts"), F.col("lat1"), F.col("lon1")).alias("set"))),
    "fn_calculator": lambda s, d: _r(_ev(s, d).select("event_id", *[K.calc(t, {"x": F.col("x"), "y": F.col("y")}).alias(n) for n, t in (("a", "2 x^2 - sqrt(abs(y)) + log(100)"), ("b", "r = x + 1; pi r^2 / 2!"), ("c", "1 km + 200 m to mi"), ("d", "-y^2 + max(x, y, 3)"))])),
    "fn_planets": lambda s, d: _r(_ev(s, d).select("event_id", *[P.planet(n, G.julian_day(F.col("ts")))[c].alias(f"{n}_{c}") for n, c in _PLANETS])),
    "fn_constants": lambda s, d: _r(_ev(s, d).crossJoin(F.broadcast(P.constants_table(s).where("name in ('pi', 'phi', 'g0', 'trit')"))).groupBy("name").agg(F.sum(F.col("y") * F.col("value")).alias("total")), 3, ("name",)),
    "fn_hex": lambda s, d: _int(s, d).select("event_id", G.hexdist(F.col("a"), F.col("b"), F.col("b"), F.col("a")).alias("dist"), F.size(G.hexdisk(F.col("a"), F.col("b"), 3)).alias("disk"), F.size(G.hexring(F.col("a"), F.col("b"), 3)).alias("ring"), G.h3parent(F.col("a"), F.col("b"))["q"].alias("pq"), G.h3parent(F.col("a"), F.col("b"))["r"].alias("pr")),
    "fn_hex_children": lambda s, d: _int(s, d).select("event_id", F.inline(G.h3children(F.col("a"), F.col("b")))),
    "fn_trits": lambda s, d: _int(s, d).select("event_id", G.trits(F.col("a") - 500).alias("t"), G.trit_val(G.trit_not(G.trits(F.col("a") - 500))).alias("neg"), G.trit_and(G.trits(F.col("a")), G.trits(F.col("b"))).alias("t_and"), G.trit_or(G.trits(F.col("a")), G.trits(F.col("b"))).alias("t_or")),
    "fn_units": _cols(lambda x, y, la1, lo1, la2, lo2, ts: dict(mi_km=G.convert(x, "mi", "km"), lb_kg=G.convert(x, "lb", "kg"), f_c=G.convert(x, "degF", "degC"), deg_rad=G.convert(x, "deg", "rad"), gib_mb=G.convert(x, "GiB", "MB"), yr_day=G.convert(x, "yr", "day"))),
    "fn_units_table": lambda s, d: _ev(s, d).join(F.broadcast(G.units_table(s).where("kind = 'length' and factor between 0.001 and 10000")), F.lit(True)).select("event_id", "unit", F.round(F.col("x") * F.col("factor") + F.col("shift"), 4).alias("si")).groupBy("unit").agg(F.count("*").alias("n"), F.round(F.max("si"), 2).alias("top")),
    "fn_integers": lambda s, d: _int(s, d).select("event_id", N.gcd("a", "b").alias("gcd"), N.lcm("a", "b").alias("lcm")),
    "fn_primes": lambda s, d: _int(s, d).select("a").distinct().select("a", N.is_prime("a").alias("is_prime"), N.next_prime("a").alias("next"), N.prev_prime("a").alias("prev"), F.array_join(N.factorize("a"), ",").alias("factors")),
    "fn_divisors": lambda s, d: _int(s, d).select("b").distinct().select("b", F.array_join(F.filter(F.sequence(F.lit(1), F.col("b").cast("int")), lambda k: F.col("b") % k == 0), ",").alias("divisors")),
    "fn_big_integers": lambda s, d: _int(s, d).select((F.col("b") - 1).alias("n")).distinct().select("n", N.fib("n").alias("fib"), N.factorial("n").alias("fact"), N.catalan("n").alias("catalan"), N.binomial(F.col("n") + 2, F.lit(3)).alias("choose")),
    "fn_gamma": lambda s, d: _r(_ev(s, d).select("event_id", N.gamma(F.abs("y") + 0.5).alias("gamma"), N.lgamma(F.abs("y") + 0.5).alias("lgamma"), N.beta(F.abs("y") + 0.5, F.lit(2.0)).alias("beta"))),
    "fn_matrix": lambda s, d: _r(_matrix(s, d).select("event_id", S.trace(F.col("m")).alias("trace"), N.det("m").alias("det"), F.get(S.matvec(F.col("m"), F.col("v")), 1).alias("mv1"), F.get(F.get(S.transpose(F.col("m")), 2), 0).alias("t20"), F.get(F.get(S.rot2(F.get("v", 0)), 0), 1).alias("rot"))),
    "fn_rotations": lambda s, d: _rotations(s, d),
    "fn_zeta": lambda s, d: _r(_ev(s, d).select("event_id", N.zeta(F.abs("y") + 1.5).alias("zeta"))),
    "fn_linear_algebra": lambda s, d: _r(_matrix(s, d).select("event_id", F.get(F.get(N.inv("m"), 0), 0).alias("inv00"), F.get(N.lsolve("m", "v"), 0).alias("x0"), N.logdet("m")["ln"].alias("logdet"), F.get(N.charpoly("m"), 3).alias("c3"), F.get(N.eigen_symmetric("m"), 2).alias("top"))),
}

_EV = "(SELECT event_id, ts, user_id, value AS x, (event_id % 401) / 100.0::DOUBLE - 2 AS y, (event_id % 171) - 85.0::DOUBLE AS lat1, (event_id % 359) - 179.0::DOUBLE AS lon1, ((event_id * 7) % 163) - 81.0::DOUBLE AS lat2, ((event_id * 11) % 353) - 176.0::DOUBLE AS lon2 FROM events)"


def _sql(n=6, **f):
    return "SELECT event_id, " + ", ".join(f"round({v}, {n}) AS {k}" for k, v in f.items()) + f" FROM {_EV}"


_H = "pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)"
_M360 = lambda e: f"(({e}) - 360 * floor(({e}) / 360))"
_ERF = "(CASE WHEN y = 0 THEN 0 ELSE sign(y) * (1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-y * y)) END)"
_D = "(epoch_us(ts) / 86400000000.0 + 2440587.5 - 2451543.5)"
_SKY = f"""WITH a AS (SELECT event_id, {_D} AS d FROM events), b AS (SELECT *, 282.9404 + 4.70935e-5 * d AS w, 0.016709 - 1.151e-9 * d AS e, {_M360("356.0470 + 0.9856002585 * d")} AS ms, {_M360("125.1228 - 0.0529538083 * d")} AS n, {_M360("318.0634 + 0.1643573223 * d")} AS wm, {_M360("115.3654 + 13.0649929509 * d")} AS m, radians(23.4393 - 3.563e-7 * d) AS tilt FROM a),
c AS (SELECT *, {_M360("ms + w + 360 / pi() * e * sin(radians(ms)) * (1 + e * cos(radians(ms)))")} AS sun, {_M360("m + wm + n")} AS lm, {_M360("ms + w")} AS ls FROM b), g AS (SELECT *, {_M360("lm - ls")} AS el, {_M360("lm - n")} AS f FROM c)"""
_term = lambda a, i, j, k, q: f"{a} * sin(radians({i} * m + {j} * el + {k} * ms + {q} * f))"
_LON = " + ".join(f"({_term(*t)})" for t in G.MOON_LON)
_LAT = " + ".join(f"({_term(*t)})" for t in G.MOON_LAT)
_INT = "(SELECT event_id, event_id % 997 AS a, event_id % 360 + 1 AS b FROM events)"
_MAT = "(SELECT event_id, event_id % 7 + 1.0::DOUBLE AS a, event_id % 5 + 0.5::DOUBLE AS b FROM events)"
_DET = "(a * ((a + 3) * (a + b) - 1) - b * (b * (a + b) - 0.5) + 0.5 * (b - 0.5 * (a + 3)))"



def _rotations(s, d):
    """Entries of constant matrices, rotations, products and states that two levels pass through."""
    e, at = _ev(s, d), lambda m, i, j: F.get(F.get(m, i), j)
    y = F.col("y")
    two = F.array(F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0)))
    plane = F.transform(S.so_generator(3, 0, 2), lambda r: F.transform(r, lambda x: x * y))
    held = F.array(F.array(F.struct(y.alias("re"), F.lit(1.0).alias("im")), F.struct(F.lit(2.0).alias("re"), y.alias("im"))))
    state = N.schrodinger(two, F.array(F.lit(1.0), F.lit(0.0)), y)
    made = e.select(
        "event_id", at(S.rot3("x", y), 1, 2).alias("rx"), at(S.rot3("y", y), 0, 2).alias("ry"), at(S.rot3("z", y), 1, 0).alias("rz"), at(S.identity(3), 1, 1).alias("one"),
        at(S.tridiag(4, -1.0, 2.0, -1.0), 2, 1).alias("tri"), at(N.kron(S.rot2(y), S.constant_matrix(S.HADAMARD)), 3, 3).alias("kron"), at(N.pinv(S.rot2(y)), 0, 1).alias("pinv"),
        at(N.expm(plane), 0, 2).alias("turned"), at(S.dagger(held), 1, 0)["im"].alias("conj"), F.get(state, 0)["re"].alias("stay"), F.get(state, 1)["im"].alias("pass"),
    )
    return _r(made.select("event_id", *[(F.lit(0.0) + F.col(c)).alias(c) for c in made.columns[1:]]))  # no zero below zero


def _planets_sql(wanted: list[tuple[str, str]]) -> str:
    """The planets' positions written as steps of one query: elements, Newton steps, vectors, pulls, view from the earth."""
    names = sorted({n for n, _ in wanted})
    ctes = [f"d0 AS (SELECT event_id, epoch_us(ts) / 86400000000.0 + 2440587.5 - {P.START} AS d FROM events)"]
    els = ", ".join(f"{P.ORBITS[o][k][0]} + {P.ORBITS[o][k][1]} * d AS {o}_{k}" for o in ["sun", "jupiter", "saturn", *(n for n in names if n not in ("jupiter", "saturn"))] for k in ("node", "tilt", "peri", "axis", "ecc", "mean"))
    ctes.append(f"e0 AS (SELECT event_id, {els} FROM d0)")
    orbits = ["sun", *names]
    ctes.append("k0 AS (SELECT *, " + ", ".join(f"radians({o}_mean) AS {o}_k0" for o in orbits) + " FROM e0)")
    for i in range(1, 9):
        step = ", ".join(f"{o}_k{i - 1} - ({o}_k{i - 1} - {o}_ecc * sin({o}_k{i - 1}) - radians({o}_mean)) / (1 - {o}_ecc * cos({o}_k{i - 1})) AS {o}_k{i}" for o in orbits)
        ctes.append(f"k{i} AS (SELECT *, {step} FROM k{i - 1})")
    # true anomaly and radius, then the angle from the node
    ctes.append("v AS (SELECT *, " + ", ".join(f"{o}_axis * (1 - {o}_ecc * cos({o}_k8)) AS {o}_r, radians({o}_peri) + 2 * atan2(sqrt(1 + {o}_ecc) * sin({o}_k8 / 2), sqrt(1 - {o}_ecc) * cos({o}_k8 / 2)) AS {o}_u" for o in orbits) + " FROM k8)")
    ctes.append(
        "h AS (SELECT *, "
        + ", ".join(
            f"degrees(radians({o}_node) + atan2(sin({o}_u) * cos(radians({o}_tilt)), cos({o}_u))) AS {o}_l, degrees(asin(sin({o}_u) * sin(radians({o}_tilt)))) AS {o}_b"
            for o in orbits
        )
        + " FROM v)"
    )

    def pull(n: str, what: str) -> str:
        terms = P.PULLS.get(n, {}).get(what, [])
        return "".join(f" + {a} * {w}(radians({j} * jupiter_mean + {s} * saturn_mean + {p}))" for a, w, j, s, p in terms)

    ctes.append("p AS (SELECT *, " + ", ".join(f"{n}_l{pull(n, 'lon')} AS {n}_pl, {n}_b{pull(n, 'lat')} AS {n}_pb, {n}_r{pull(n, 'dist')} AS {n}_pr" for n in names) + " FROM h)")
    xyz = ", ".join(
        f"{n}_pr * cos(radians({n}_pb)) * cos(radians({n}_pl)) + sun_r * cos(radians(sun_l)) AS {n}_x, {n}_pr * cos(radians({n}_pb)) * sin(radians({n}_pl)) + sun_r * sin(radians(sun_l)) AS {n}_y, {n}_pr * sin(radians({n}_pb)) AS {n}_z"
        for n in names
    )
    ctes.append(f"g AS (SELECT event_id, {xyz} FROM p)")
    form = {
        "lon": "(degrees(atan2({0}_y, {0}_x)) + 360) % 360", "lat": "degrees(atan2({0}_z, sqrt({0}_x * {0}_x + {0}_y * {0}_y)))", "dist": "sqrt({0}_x * {0}_x + {0}_y * {0}_y + {0}_z * {0}_z)",
    }
    return f"WITH {', '.join(ctes)} SELECT event_id, " + ", ".join(f"round({form[c].format(n)}, 6) AS {n}_{c}" for n, c in wanted) + " FROM g"


_PLANETS = [("mars", "lon"), ("mars", "dist"), ("jupiter", "lon"), ("saturn", "dist"), ("saturn", "lat"), ("venus", "lat"), ("mercury", "lon"), ("uranus", "lon"), ("neptune", "dist")]

SQL = {
    "fn_planets": _planets_sql(_PLANETS),
    "fn_trig": _sql(sin="sin(x)", cos="cos(x)", tan_y="tan(y)", atan="atan(x)", atan2="atan2(y, x + 0.5)", sinh="(exp(y) - exp(-y)) / 2", cosh="(exp(y) + exp(-y)) / 2", tanh="(exp(2 * y) - 1) / (exp(2 * y) + 1)", asinh="ln(y + sqrt(y * y + 1))", sind="sin(radians(x))", cosd="cos(radians(x))", tand="tan(radians(y))", atan2d="degrees(atan2(y, x + 0.5))", rad="radians(x)", deg="degrees(y)"),
    "fn_inverse": _sql(asin="CASE WHEN abs(y) <= 1 THEN asin(y) END", acos="CASE WHEN abs(y) <= 1 THEN acos(y) END", acosh="CASE WHEN y >= 1 THEN ln(y + sqrt(y * y - 1)) END", atanh="CASE WHEN abs(y) < 1 THEN 0.5 * ln((1 + y) / (1 - y)) END", casin_re="CASE WHEN abs(y) > 1 THEN sign(y) * pi() / 2 ELSE asin(y) END", casin_im="CASE WHEN abs(y) > 1 THEN -sign(y) * ln(abs(y) + sqrt(y * y - 1)) ELSE 0 END"),
    "fn_log": _sql(ln="CASE WHEN y > 0 THEN ln(y) END", log="CASE WHEN y > 0 THEN log10(y) END", log2="CASE WHEN y > 0 THEN log2(y) END", log_base3="CASE WHEN y > 0 THEN ln(y) / ln(3) END", exp="exp(y)", sqrt="CASE WHEN y >= 0 THEN sqrt(y) END", csqrt_im="CASE WHEN y < 0 THEN sqrt(-y) ELSE 0 END", cln_im="CASE WHEN y < 0 THEN pi() WHEN y > 0 THEN 0 END", cbrt="cbrt(y)", hypot="sqrt(x * x + y * y)", pow="pow(abs(y), 1.5)"),
    "fn_round": _sql(floor="floor(y)", ceil="ceil(y)", round="round(y)", sign="sign(y)::DOUBLE", fract="y - trunc(y)", mod="y - 0.7 * floor(y / 0.7)", mod_neg="x - 3 * floor(x / 3)", clamp="least(greatest(y, -1), 1)", least="least(x, y)", greatest="greatest(x, y)", abs="abs(y)"),
    "fn_special": f"SELECT event_id, round({_ERF}, 6) AS erf, round(1 - {_ERF}, 6) AS erfc, round(CASE WHEN abs(y) < 1 THEN 1 / sqrt(1 - y * y) END, 6) AS lorentz FROM (SELECT *, 1 / (1 + 0.3275911 * abs(y)) AS t FROM {_EV})",
    "fn_logdomain": _sql(logpow="x * ln(2)", logaddexp="greatest(x, y) + ln(1 + exp(least(x, y) - greatest(x, y)))", logsubexp="ln(exp(y + 3) - exp(y))", expneg="-abs(y)", lpsum="greatest(x, y + 1) + ln(exp(x - greatest(x, y + 1)) + exp(y - greatest(x, y + 1)) + exp(y + 1 - greatest(x, y + 1)))"),
    "fn_list_stats": "SELECT user_id, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(stddev_pop(value), 4) AS std, round(sqrt(sum(value * value)), 4) AS norm FROM events GROUP BY user_id",
    "fn_group_stats": "SELECT event_type, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(stddev_pop(value), 4) AS std, round(min(value), 4) AS lo, round(max(value), 4) AS hi FROM events GROUP BY event_type",
    "fn_geodesy": _sql(
        dist=f"2 * 6371.0087714 * asin(least(sqrt({_H}), 1))", bearing=_M360("degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1))))"),
        mid_lat="degrees(atan2(sin(radians(lat1)) + sin(radians(lat2)), sqrt(pow(cos(radians(lat1)) + cos(radians(lat2)) * cos(radians(lon2 - lon1)), 2) + pow(cos(radians(lat2)) * sin(radians(lon2 - lon1)), 2))))",
        dest_lat="degrees(asin(sin(radians(lat1)) * cos(500 / 6371.0087714) + cos(radians(lat1)) * sin(500 / 6371.0087714) * cos(radians(33))))",
        earth="sqrt((pow(6378.137 * 6378.137 * cos(radians(lat1)), 2) + pow(pow(6378.137 * (1 - 1 / 298.257223563), 2) * sin(radians(lat1)), 2)) / (pow(6378.137 * cos(radians(lat1)), 2) + pow(6378.137 * (1 - 1 / 298.257223563) * sin(radians(lat1)), 2)))",
        dest_lon=_M360("lon1 + degrees(atan2(sin(radians(33)) * sin(500 / 6371.0087714) * cos(radians(lat1)), cos(500 / 6371.0087714) - sin(radians(lat1)) * (sin(radians(lat1)) * cos(500 / 6371.0087714) + cos(radians(lat1)) * sin(500 / 6371.0087714) * cos(radians(33)))))"),
    ),
    "fn_sun": f"{_SKY} SELECT event_id, round(d + 2451543.5, 6) AS jd, round(sun, 6) AS lon, round({_M360('degrees(atan2(sin(radians(sun)) * cos(tilt), cos(radians(sun))))')}, 6) AS ra, round(degrees(asin(sin(radians(sun)) * sin(tilt))), 6) AS dec FROM g",
    "fn_moon": f"""{_SKY}, h AS (SELECT *, {_M360("m + wm + n + 360 / pi() * 0.0549 * sin(radians(m)) * (1 + 0.0549 * cos(radians(m)))")} + {_LON} AS l0, {_LAT} AS lat FROM g), k AS (SELECT *, {_M360("l0")} AS lon FROM h), z AS (SELECT *, {_M360("lon - sun")} AS elong FROM k)
SELECT event_id, round(lon, 6) AS lon, round(lat, 6) AS lat, round(6378.137 * (60.2666 * (1 - 0.0549 * cos(radians(m))) - 0.58 * cos(radians(m - 2 * el)) - 0.46 * cos(radians(2 * el))), 6) AS dist, round(180 - elong, 6) AS phase, round((1 + cos(radians(180 - elong))) / 2, 6) AS illum, round(elong / 360 * 29.530588853, 6) AS age,
round(degrees(asin(sin(radians(lon)) * cos(radians(lat)) * sin(tilt) + sin(radians(lat)) * cos(tilt))), 6) AS dec FROM z""",
    "fn_sunrise": f"""WITH a AS (SELECT *, 2 * pi() / 365 * (dayofyear(ts) - 1) AS g FROM {_EV}), b AS (SELECT *, 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS eq,
0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS decl FROM a), c AS (SELECT *, cos(radians(90.833)) / (cos(radians(lat1)) * cos(decl)) - tan(radians(lat1)) * tan(decl) AS h FROM b)
SELECT event_id, round(CASE WHEN h BETWEEN -1 AND 1 THEN 12 - lon1 / 15 - eq / 60 - degrees(acos(h)) / 15 END, 6) AS rise, round(CASE WHEN h BETWEEN -1 AND 1 THEN 12 - lon1 / 15 - eq / 60 + degrees(acos(h)) / 15 END, 6) AS set FROM c""",
    "fn_calculator": _sql(a="2 * x * x - sqrt(abs(y)) + 2", b="pi() * (x + 1) * (x + 1) / 2", c="1200 / 1609.344", d="greatest(x, y, 3) - y * y"),
    "fn_constants": f"WITH c(name, value) AS (VALUES ('pi', pi()), ('phi', (1 + sqrt(5)) / 2), ('g0', 9.80665::DOUBLE), ('trit', log2(3))) SELECT name, round(sum(y * value), 3) AS total FROM {_EV}, c GROUP BY name",
    "fn_hex": f"SELECT event_id, (abs(a - b) + abs(b - a) + abs((a - b) + (b - a))) // 2 AS dist, 37::INT AS disk, 18::INT AS ring, floor((a + 1) / 3)::BIGINT AS pq, floor((b + 1) / 3)::BIGINT AS pr FROM {_INT}",
    "fn_hex_children": f"SELECT event_id, 3 * a + i AS q, 3 * b + j AS r FROM {_INT}, (VALUES (-1), (0), (1)) u(i), (VALUES (-1), (0), (1)) v(j)",
    "fn_trits": f"""WITH RECURSIVE num AS (SELECT DISTINCT n FROM (SELECT a - 500 AS n FROM {_INT} UNION ALL SELECT a FROM {_INT} UNION ALL SELECT b FROM {_INT})),
t(n, rest, s) AS (SELECT n, n, '' FROM num UNION ALL SELECT n, CASE WHEN ((rest % 3) + 3) % 3 = 2 THEN (rest + 1) // 3 ELSE (rest - ((rest % 3) + 3) % 3) // 3 END, CASE ((rest % 3) + 3) % 3 WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE 'T' END || s FROM t WHERE rest != 0),
f AS (SELECT n, CASE WHEN s = '' THEN '0' ELSE s END AS s FROM t WHERE rest = 0),
p AS (SELECT e.event_id, e.a, c.s AS t, x.s AS sa, y.s AS sb, greatest(length(x.s), length(y.s)) AS n FROM {_INT} e JOIN f c ON c.n = e.a - 500 JOIN f x ON x.n = e.a JOIN f y ON y.n = e.b),
q AS (SELECT *, lpad(sa, n::INT, '0') AS pa, lpad(sb, n::INT, '0') AS pb FROM p)
SELECT event_id, t, 500 - a AS neg, list_aggregate(list_transform(range(1, n + 1), lambda i: CASE WHEN pa[i] = 'T' OR pb[i] = 'T' THEN 'T' WHEN pa[i] = '0' OR pb[i] = '0' THEN '0' ELSE '1' END), 'string_agg', '') AS t_and,
list_aggregate(list_transform(range(1, n + 1), lambda i: CASE WHEN pa[i] = '1' OR pb[i] = '1' THEN '1' WHEN pa[i] = '0' OR pb[i] = '0' THEN '0' ELSE 'T' END), 'string_agg', '') AS t_or FROM q""",
    "fn_units": _sql(mi_km="x * 1.609344", lb_kg="x * 0.45359237", f_c="(x - 32) * 5 / 9", deg_rad="radians(x)", gib_mb="x * 1073741824.0 / 8e6", yr_day="x * 365.25"),
    "fn_units_table": "WITH u(unit, factor) AS (VALUES ('m', 1.0::DOUBLE), ('km', 1000), ('cm', 0.01), ('mm', 0.001), ('mi', 1609.344), ('ft', 0.3048), ('in', 0.0254), ('nmi', 1852)) SELECT unit, count(*) AS n, round(max(round(value * factor, 4)), 2) AS top FROM events, u GROUP BY unit",
    "fn_integers": f"SELECT event_id, gcd(a, b)::BIGINT AS gcd, lcm(a, b)::BIGINT AS lcm FROM {_INT}",
    "fn_primes": f"""WITH n AS (SELECT DISTINCT a FROM {_INT}), r AS (SELECT unnest(range(2, 1100)) AS p), pr AS (SELECT p FROM r WHERE NOT EXISTS (SELECT 1 FROM r q WHERE q.p < r.p AND q.p * q.p <= r.p AND r.p % q.p = 0)),
pw AS (SELECT a, p, max(k) AS k FROM n, pr, (SELECT unnest(range(1, 11)) AS k) WHERE a > 0 AND CASE WHEN pow(p, k) <= 1000 THEN a % pow(p, k)::BIGINT = 0 ELSE false END GROUP BY a, p)
SELECT a, a IN (SELECT p FROM pr) AS is_prime, (SELECT min(p) FROM pr WHERE p > a) AS next, (SELECT max(p) FROM pr WHERE p < a) AS prev, coalesce((SELECT string_agg(p || ',' || k, ',' ORDER BY p) FROM pw WHERE pw.a = n.a), '') AS factors FROM n""",
    "fn_divisors": f"SELECT b, string_agg(k::VARCHAR, ',' ORDER BY k) AS divisors FROM (SELECT DISTINCT b FROM {_INT}), (SELECT unnest(range(1, 361)) AS k) WHERE b % k = 0 GROUP BY b",
    "fn_gamma": _sql(gamma="gamma(abs(y) + 0.5)", lgamma="lgamma(abs(y) + 0.5)", beta="exp(lgamma(abs(y) + 0.5) + lgamma(2) - lgamma(abs(y) + 2.5))"),
    "fn_linear_algebra": f"""WITH t AS (SELECT *, {_DET} AS det, (3 * a + b + 3) / 3 AS q FROM {_MAT}), p AS (SELECT *, sqrt((pow(a - q, 2) + pow(a + 3 - q, 2) + pow(a + b - q, 2) + 2 * (b * b + 1.25)) / 6) AS p FROM t),
r AS (SELECT *, ((a - q) * ((a + 3 - q) * (a + b - q) - 1) - b * (b * (a + b - q) - 0.5) + 0.5 * (b - 0.5 * (a + 3 - q))) / (2 * p * p * p) AS r FROM p)
SELECT event_id, round(((a + 3) * (a + b) - 1) / det, 6) AS inv00, round((a * ((a + 3) * (a + b) - 1) - b * (b * (a + b) - 2) + 0.5 * (b - 2 * (a + 3))) / det, 6) AS x0, round(ln(abs(det)), 6) AS logdet, round(-det, 6) AS c3, round(q + 2 * p * cos(acos(greatest(-1, least(1, r))) / 3), 6) AS top FROM r""",
    "fn_rotations": _sql(rx="0 - sin(y)", ry="sin(y)", rz="sin(y)", one="1.0::DOUBLE", tri="-1.0::DOUBLE", kron="-cos(y) / sqrt(2)", pinv="sin(y)", turned="0 - sin(y)", conj="0 - y", stay="cos(y)", **{"pass": "0 - sin(y)"}),
    "fn_zeta": _sql(zeta="list_sum(list_transform(range(1, 200), lambda k: pow(k, -(abs(y) + 1.5)))) + pow(200, -(abs(y) + 0.5)) / (abs(y) + 0.5) + 0.5 * pow(200, -(abs(y) + 1.5)) + (abs(y) + 1.5) / 12 * pow(200, -(abs(y) + 2.5))"),
    "fn_matrix": f"SELECT event_id, round(a + (a + 3) + (a + b), 6) AS trace, round({_DET}, 6) AS det, round(b * a + (a + 3) * b + 2, 6) AS mv1, round(0.5, 6)::DOUBLE AS t20, round(-sin(a), 6) AS rot FROM {_MAT}",

}

