"""Queries of the standards' time scales, arguments, vectors and rotations, of operators on whole numbers and of raw files, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import dates, sofa, special
from lattica.functions import vectors as v
from lattica.ndarray import NdArray
from lattica.operators import elementwise as el
from lattica.queries import ev, out, q, r4, tab

_JD = "(select o_orderkey, epoch(o_orderdate) / 86400.0 + 2440587.5 as j from orders)"


@q(f"""select o_orderkey, round(2000 + (j - 2451545.0) / 365.25, 7) as epj, round(1900 + (j - 2415020.31352) / 365.242198781, 7) as epb, round(51544.5 + ((1990 + o_orderkey % 50 + 0.25) - 2000) * 365.25, 6) as from_epj,
round(15019.81352 + ((1950 + o_orderkey % 50 + 0.25) - 1900) * 365.242198781, 6) as from_epb, round((84381.448 + c * (-46.8150 + c * (-0.00059 + c * 0.001813))) * pi() / 648000, 10) as obl80, round(c * -0.000047 * pi() / 648000, 14) + 0.0 as sp00
from (select *, (j - 2451545.0) / 36525 as c from {_JD})""")
def standard_epochs(spark, sf):
    j, k = dates.jd(F.col("o_orderdate")), F.col("o_orderkey") % 50
    return tab(spark, sf, "orders").select("o_orderkey", r4(sofa.epj(j), "epj", 7), r4(sofa.epb(j), "epb", 7), r4(sofa.epj2jd(1990 + k + 0.25)[1], "from_epj", 6), r4(sofa.epb2jd(1950 + k + 0.25)[1], "from_epb", 6), r4(special.column(sofa.obl80, j), "obl80", 10), (F.round(special.column(sofa.sp00, j), 14) + 0.0).alias("sp00"))


_D = "86400.0"
_T77 = "(2443144.5 + 32.184 / 86400.0)"


@q(f"""select o_orderkey, round((b + 32.184 / {_D}) * {_D}, 5) as taitt, round((b - 32.184 / {_D}) * {_D}, 5) as tttai, round((b - 30.5 / {_D}) * {_D}, 5) as taiut1, round((b + 30.5 / {_D}) * {_D}, 5) as ut1tai, round((b - 62.5 / {_D}) * {_D}, 5) as ttut1,
round((b + 62.5 / {_D}) * {_D}, 5) as ut1tt, round((b - 0.0016 / {_D}) * {_D}, 5) as tdbtt, round((b + 0.0016 / {_D}) * {_D}, 5) as tttdb, round((b - 0.25 / {_D}) * {_D}, 5) as ut1utc, round((j - {_T77}) * 6.969290134e-10 / (1 - 6.969290134e-10) * {_D}, 5) as tttcg,
round(-(j - {_T77}) * 6.969290134e-10 * {_D}, 5) as tcgtt, round((-6.55e-5 / {_D} - (j - {_T77}) * 1.550519768e-8) * {_D}, 4) as tcbtdb, round((6.55e-5 / {_D} + (j + 6.55e-5 / {_D} - {_T77}) * 1.550519768e-8 / (1 - 1.550519768e-8)) * {_D}, 4) as tdbtcb
from (select *, 0.001 * (o_orderkey % 900) as b, 2400000.5 + (o_orderkey % 30000) + 0.001 * (o_orderkey % 900) as j from orders)""")
def time_scales(spark, sf):
    a, b = 2400000.5 + (F.col("o_orderkey") % 30000), 0.001 * (F.col("o_orderkey") % 900)
    sec = lambda pair, name, places=5: r4(pair[1] * 86400.0, name, places)
    change = lambda pair, name, places=5: r4((pair[1] - b) * 86400.0, name, places)
    return tab(spark, sf, "orders").select(
        "o_orderkey", sec(sofa.taitt(a, b), "taitt"), sec(sofa.tttai(a, b), "tttai"), sec(sofa.taiut1(a, b, -30.5), "taiut1"), sec(sofa.ut1tai(a, b, -30.5), "ut1tai"), sec(sofa.ttut1(a, b, 62.5), "ttut1"), sec(sofa.ut1tt(a, b, 62.5), "ut1tt"),
        sec(sofa.tdbtt(a, b, 0.0016), "tdbtt"), sec(sofa.tttdb(a, b, 0.0016), "tttdb"), sec(sofa.ut1utc(a, b, 0.25), "ut1utc"), change(sofa.tttcg(a, b), "tttcg"), change(sofa.tcgtt(a, b), "tcgtt"), change(sofa.tcbtdb(a, b), "tcbtdb", 4), change(sofa.tdbtcb(a, b), "tdbtcb", 4),
    )


def _horner(c) -> str:
    text = "0.0"
    for x in reversed(c):
        text = f"({text} * t + {x!r}::double)"
    return text


_LUNAR_SQL = ", ".join(f"round(({_horner(c)} % 1296000) * pi() / 648000, 6) as a_{n}" for n, c in sofa._LUNAR.items())
_PLANET_SQL = ", ".join(f"round({_horner(c)} % (2 * pi()), 6) as a_{n}" for n, c in sofa._PLANETS.items())


@q(f"select s_suppkey, {_LUNAR_SQL}, {_PLANET_SQL}, round((0.02438175 + 0.00000538691 * t) * t, 10) as a_pa from (select s_suppkey, 0.001 * s_suppkey + 0.0005 as t from supplier)")
def fundamental_arguments(spark, sf):
    t = 0.001 * F.col("s_suppkey") + 0.0005
    names = [*sofa._LUNAR, *sofa._PLANETS]
    return tab(spark, sf, "supplier").select("s_suppkey", *(r4(special.column(lambda x, n=n: sofa.fundamental(n, x), t), f"a_{n}", 6) for n in names), r4(special.column(lambda x: sofa.fundamental("pa", x), t), "a_pa", 10))


# Vectors p, q, their rates u, w, and angles a, b, from a customer's numbers.
_V = """(select c_custkey, (c_custkey % 17 - 8.5)::double as p1, c_nationkey * 0.5::double as p2, c_acctbal / 1000.0 as p3, (c_custkey % 5 + 1.0)::double as q1, (c_custkey % 7 - 3.0)::double as q2, 1.5::double as q3,
(c_custkey % 3)::double as u1, 0.25::double as u2, (c_custkey % 11 - 5)::double as u3, 0.5::double as w1, (c_custkey % 13)::double as w2, -1.0::double as w3, c_custkey * 0.01 as a, c_nationkey * 0.05 - 0.6 as b from customer)"""


def _vectors(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    t = tab(spark, sf, "customer")
    p, q_ = v.vec(k % 17 - 8.5, n * 0.5, F.col("c_acctbal") / 1000), v.vec(k % 5 + 1, k % 7 - 3, 1.5)
    return t.select("c_custkey", p.alias("p"), q_.alias("q"), v.vec(k % 3, 0.25, k % 11 - 5).alias("u"), v.vec(0.5, k % 13, -1.0).alias("w"), (k * 0.01).alias("a"), (n * 0.05 - 0.6).alias("b"))


_CROSS = "(p2 * q3 - p3 * q2), (p3 * q1 - p1 * q3), (p1 * q2 - p2 * q1)"


@q(f"""select c_custkey, round(p1 * q1 + p2 * q2 + p3 * q3, 6) as pdp, round(p2 * q3 - p3 * q2, 6) as pxp, round(sqrt(p1 * p1 + p2 * p2 + p3 * p3), 6) as pm, round(p1 / sqrt(p1 * p1 + p2 * p2 + p3 * p3), 6) as pn, round(p1 + q1, 6) as ppp, round(p2 - q2, 6) as pmp,
round(2.5 * p3, 6) as sxp, round(p1 + 2.5 * q1, 6) as ppsp, 0.0::double as zp, round(atan2(p2, p1), 6) as c2s, round(atan2(p3, sqrt(p1 * p1 + p2 * p2)), 6) as p2s, round(2.0 * sin(a) * cos(b), 6) as s2p,
round(atan2(sqrt(power(p2 * q3 - p3 * q2, 2) + power(p3 * q1 - p1 * q3, 2) + power(p1 * q2 - p2 * q1, 2)), p1 * q1 + p2 * q2 + p3 * q3), 6) as sepp,
round(acos(greatest(-1.0, least(1.0, sin(b) * sin(0.311) + cos(b) * cos(0.311) * cos(a - 0.503)))), 5) as seps, round(atan2(sin(0.503 - a) * cos(0.311), sin(0.311) * cos(b) - cos(0.311) * sin(b) * cos(0.503 - a)), 6) as pas from {_V}""")
def vector_algebra(spark, sf):
    p, q_, a, b = (F.col(c) for c in "pqab")
    h, e = F.lit(0.503), F.lit(0.311)
    return _vectors(spark, sf).select(
        "c_custkey", r4(v.pdp(p, q_), "pdp", 6), r4(v.pxp(p, q_)[0], "pxp", 6), r4(v.pm(p), "pm", 6), r4(v.pn(p)[0], "pn", 6), r4(v.ppp(p, q_)[0], "ppp", 6), r4(v.pmp(p, q_)[1], "pmp", 6), r4(v.sxp(2.5, p)[2], "sxp", 6), r4(v.ppsp(p, 2.5, q_)[0], "ppsp", 6),
        v.zp()[1].alias("zp"), r4(v.c2s(p)[0], "c2s", 6), r4(v.p2s(p)[1], "p2s", 6), r4(v.s2p(a, b, F.lit(2.0))[1], "s2p", 6), r4(v.sepp(p, q_), "sepp", 6), r4(v.seps(a, b, h, e), "seps", 5), r4(v.pas(a, b, h, e), "pas", 6),
    )


@q(f"""select c_custkey, round(cos(a) * p2 + sin(a) * p3, 6) as rx, round(cos(a) * p1 - sin(a) * p3, 6) as ry, round(cos(a) * p1 + sin(a) * p2, 6) as rz, round(cos(a) * p2 - sin(a) * p3, 6) as trxp, round(-cos(a) * sin(b), 6) + 0.0 as rxr, round(sin(a), 6) as tr_, 1.0::double as ir, 0.0::double as zr,
round(cos(a) * u2 + sin(a) * u3, 6) as rxpv, round(cos(a) * u2 - sin(a) * u3, 6) as trxpv from {_V}""")
def rotations(spark, sf):
    p, u, a, b = (F.col(c) for c in "puab")
    x, pair = v.rx(a, v.ir()), v.pv(p, u)
    return _vectors(spark, sf).select(
        "c_custkey", r4(v.rxp(x, p)[1], "rx", 6), r4(v.rxp(v.ry(a, v.ir()), p)[0], "ry", 6), r4(v.rxp(v.rz(a, v.ir()), p)[0], "rz", 6), r4(v.trxp(x, p)[1], "trxp", 6), (F.round(v.rxr(x, v.turn_z(b))[1][0], 6) + 0.0).alias("rxr"), r4(v.tr(x)[2][1], "tr_", 6), v.ir()[2][2].alias("ir"), v.zr()[1][1].alias("zr"),
        r4(v.rxpv(x, pair)[1][1], "rxpv", 6), r4(v.trxpv(x, pair)[1][1], "trxpv", 6),
    )


@q(f"""select c_custkey, round(p1 * q1 + p2 * q2 + p3 * q3, 6) as pvdpv, round(p1 * w1 + p2 * w2 + p3 * w3 + u1 * q1 + u2 * q2 + u3 * q3, 6) as pvdpv_rate, round(p2 * w3 - p3 * w2 + u2 * q3 - u3 * q2, 6) as pvxpv, round(sqrt(u1 * u1 + u2 * u2 + u3 * u3), 6) as pvm,
round(u3 + w3, 6) as pvppv, round(u2 - w2, 6) as pvmpv, round(3.0 * u1, 6) as s2xpv, round(2.0 * p3, 6) as sxpv, round(p1 + 1.5 * u1, 6) as pvu, round(p3 + 1.5 * u3, 6) as pvup, 0.0::double as p2pv, round(p2, 6) as pv2p, 0.0::double as zpv from {_V}""")
def position_velocity(spark, sf):
    p, q_, u, w = (F.col(c) for c in "pquw")
    a, b = v.pv(p, u), v.pv(q_, w)
    return _vectors(spark, sf).select(
        "c_custkey", r4(v.pvdpv(a, b)[0], "pvdpv", 6), r4(v.pvdpv(a, b)[1], "pvdpv_rate", 6), r4(v.pvxpv(a, b)[1][0], "pvxpv", 6), r4(v.pvm(a)[1], "pvm", 6), r4(v.pvppv(a, b)[1][2], "pvppv", 6), r4(v.pvmpv(a, b)[1][1], "pvmpv", 6), r4(v.s2xpv(2.0, 3.0, a)[1][0], "s2xpv", 6), r4(v.sxpv(2.0, a)[0][2], "sxpv", 6),
        r4(v.pvu(1.5, a)[0][0], "pvu", 6), r4(v.pvup(1.5, a)[2], "pvup", 6), v.p2pv(p)[1][0].alias("p2pv"), r4(v.pv2p(a)[1], "pv2p", 6), v.zpv()[1][2].alias("zpv"),
    )


@q("""with x as (select o_orderkey, o_custkey - 700 as a, case when o_orderkey % 3 = 0 then -7 else 7 end as b from orders)
select o_orderkey, floor(a::double / b)::bigint as fdiv, (a - b * floor(a::double / b))::bigint as fmod, ((a - case when 2 * pm > 7 then pm - 7 else pm end) / 7)::bigint as sdiv, (a = b)::bigint as eq, (a <> b)::bigint as ne, (a >= b)::bigint as ge, (a < b)::bigint as lt, (a <= b)::bigint as le,
(a <> 0 and b > 0)::bigint as andif, (a = 0 or b > 0)::bigint as orif from (select *, ((a % 7) + 7) % 7 as pm from x)""")
def whole_number_operators(spark, sf):
    a, b = (F.col("o_custkey") - 700), F.when(F.col("o_orderkey") % 3 == 0, -7).otherwise(7).cast("bigint")
    c = lambda x, n: x.cast("bigint").alias(n)
    return tab(spark, sf, "orders").select("o_orderkey", c(el.fdiv(a, b, whole=True), "fdiv"), c(el.fmod(a, b), "fmod"), c(el.sdiv(a, F.lit(7)), "sdiv"), c(el.eq(a, b), "eq"), c(el.ne(a, b), "ne"), c(el.ge(a, b), "ge"), c(el.lt(a, b), "lt"), c(el.le(a, b), "le"), c(el.andif(a, (b > 0).cast("int")), "andif"), c(el.orif((a == 0).cast("int"), (b > 0).cast("int")), "orif"))


@q("""select l_orderkey, l_linenumber, round(acosh(1 + l_quantity) + asinh(l_tax) + atanh(l_discount) + cosh(l_discount) + sinh(l_tax) + tanh(l_discount) + ln(l_quantity) + log10(l_quantity) + (exp(l_tax) - 1) + ln(1 + l_discount), 5) as v, isnan(l_tax)::bigint as n from lineitem""")
def hyperbolic_functions(spark, sf):
    n, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    x = F.acosh(1 + n) + F.asinh(t) + F.atanh(d) + F.cosh(d) + F.sinh(t) + F.tanh(d) + F.log(n) + F.log10(n) + F.expm1(t) + F.log1p(d)
    return tab(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r4(x, "v", 5), F.isnan(t).cast("bigint").alias("n"))


@q("select event_id as i0, round(value, 4) as v from events")
def raw_file_array(spark, sf):
    """Event values written as a raw file's records and mapped as an array of it."""
    from lattica.sources import rawarrays

    a = ev(spark, sf)
    path = rawarrays.scratch(spark)
    rawarrays.write_array(a, path, "float64")
    return out(rawarrays.file_array(spark, path, "float64", a.dims))


@q("select l_quantity::bigint as i0, count(*) as v from lineitem group by 1")
def counted_quantities(spark, sf):
    """Cells of a whole-number file array, counted by value."""
    from lattica.sources import rawarrays

    t = tab(spark, sf, "lineitem").select(F.col("l_quantity").cast("bigint").alias("v"), F.monotonically_increasing_id().alias("k"))
    from lattica.ndarray import with_row_index

    rows = with_row_index(t, [F.col("k")])
    a = NdArray(rows.select("i0", "v"), (rows.count(),))
    path = rawarrays.scratch(spark)
    rawarrays.write_array(a, path, "int16")
    return rawarrays.file_array(spark, path, "int16", a.dims).df.groupBy(F.col("v").cast("bigint").alias("i0")).agg(F.count("*").alias("v"))


@q("""with x as (select o_orderkey, 1500000 + (o_orderkey * 37) % 1000000 as j from orders), e as (select *, j + 32082 as c, j - 1448638 as n, j - 584283 as l from x),
f as (select *, c - (1461 * ((4 * c + 3) // 1461)) // 4 as t, (4 * c + 3) // 1461 as k, n - 365 * floor(n / 365.0)::bigint as r, date '1970-01-01' + (j - 2440588)::integer as g from e),
h as (select *, (5 * t + 2) // 153 as w from f)
select o_orderkey, (k - 4800 + w // 10)::bigint as jul_year, (w + 3 - 12 * (w // 10))::bigint as jul_month, (t - (153 * w + 2) // 5 + 1)::bigint as jul_day, (floor(n / 365.0) + 1)::bigint as egypt_year, (r // 30 + 1)::bigint as egypt_month, (r % 30 + 1)::bigint as egypt_day,
(l // 144000)::bigint as baktun, (l // 7200 % 20)::bigint as katun, (l // 360 % 20)::bigint as tun, (l // 20 % 18)::bigint as uinal, (l % 20)::bigint as kin, year(g)::bigint as year, month(g)::bigint as month, day(g)::bigint as day,
j::bigint as from_julian, j::bigint as from_egyptian, j::bigint as from_mayan, j::bigint as from_islamic, j::bigint as from_common from h""")
def calendar_dates(spark, sf):
    """Day numbers as dates of five calendars, and back."""
    j = F.lit(1500000) + (F.col("o_orderkey") * 37) % 1000000
    x = tab(spark, sf, "orders").select("o_orderkey", j.cast("bigint").alias("j"))
    j = F.col("j")
    x = x.select("o_orderkey", "j", dates.jdn_to_julian(j).alias("jul"), dates.jdn_to_egyptian(j).alias("egypt"), dates.jdn_to_mayan(j).alias("maya"), dates.jdn_to_islamic(j).alias("islam"), dates.jdn_to_gregorian(j).alias("greg"))
    ymd = lambda name: [F.col(f"{name}.{k}") for k in ("year", "month", "day")]
    long_count = [F.col(f"maya.{k}") for k in ("baktun", "katun", "tun", "uinal", "kin")]
    common = F.when(j >= 2299161, dates.common_to_jdn(*ymd("greg"))).otherwise(dates.common_to_jdn(*ymd("jul")))
    back = {"julian": dates.julian_to_jdn(*ymd("jul")), "egyptian": dates.egyptian_to_jdn(*ymd("egypt")), "mayan": dates.mayan_to_jdn(*long_count), "islamic": dates.islamic_to_jdn(*ymd("islam")), "common": common}
    parts = [c.cast("bigint").alias(f"{n}_{k}") for n in ("jul", "egypt") for c, k in zip(ymd(n), ("year", "month", "day"), strict=True)]
    names = ("baktun", "katun", "tun", "uinal", "kin", "year", "month", "day")
    parts += [c.cast("bigint").alias(n) for c, n in zip((*long_count, *ymd("greg")), names, strict=True)]
    return x.select("o_orderkey", *parts, *(c.cast("bigint").alias(f"from_{n}") for n, c in back.items()))


_LEAPS = " + ".join(f"(ts >= timestamp '{d} 00:00:00')::bigint" for d in dates.LEAP_DAYS)


@q(f"""with x as (select o_orderkey, o_orderdate::timestamp + to_hours((o_orderkey % 24)::integer) as ts from orders), y as (select *, 9 + {_LEAPS} as leap from x)
select o_orderkey, round(epoch(ts) / 86400.0 + 2440588, 6) as cjd, epoch(ts)::bigint as from_jd, (epoch(ts) - epoch(timestamp '1977-01-01 00:00:00') + leap - 15)::bigint as tai, epoch(ts)::bigint as from_tai, leap::bigint as leap from y""")
def atomic_time(spark, sf):
    """Chronological Julian dates, leap seconds and seconds of atomic time, and the timestamps that they give back."""
    ts = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 24 * 3_600_000_000)
    second = lambda t, n: F.round(F.unix_micros(t) / 1e6).cast("bigint").alias(n)
    x = tab(spark, sf, "orders").select("o_orderkey", ts.alias("ts"))
    t, tai = F.col("ts"), dates.tai_from_date(F.col("ts"))
    return x.select("o_orderkey", r4(dates.cjd(t), "cjd", 6), second(dates.timestamp_of_jd(dates.jd(t)), "from_jd"), tai.cast("bigint").alias("tai"), second(dates.date_from_tai(tai), "from_tai"), dates.leap_seconds(t).cast("bigint").alias("leap"))


@q("""with x as (select l_orderkey, l_linenumber, l_partkey * 331 - 40000 as k, l_quantity as n, l_discount as d, case when l_linenumber = 3 then 'nan'::double else l_tax end as t from lineitem)
select l_orderkey, l_linenumber, (k & 255)::bigint as byte, (case when k & 65535 >= 32768 then (k & 65535) - 65536 else k & 65535 end)::bigint as short, (((k & 255) << 8) | ((k >> 8) & 255))::bigint as swapped2,
(((k & 255) << 24) | (((k >> 8) & 255) << 16) | (((k >> 16) & 255) << 8) | ((k >> 24) & 255))::bigint as swapped4, round(case when isnan(t) then 0.5 else t end, 4) as t, round(n + 2 * d, 4) as re, round(d - n, 4) as im, round(sqrt(n * n + d * d), 4) as size from x""")
def byte_operators(spark, sf):
    """Conversions to bytes and short whole numbers, bytes swapped, NaNs replaced, sums and sizes of complex numbers."""
    k, n, d = F.col("l_partkey").cast("bigint") * 331 - 40000, F.col("l_quantity").cast("double"), F.col("l_discount").cast("double")
    t = el.zero_nans(el.set_nan(F.col("l_tax").cast("double"), (F.col("l_linenumber") == 3).cast("int")), 0.5)
    z = el.cadd(el.cplx(n, d), el.conjugate(el.cplx(2 * d, n)))
    c = lambda x, name: x.cast("bigint").alias(name)
    whole = [c(el.to_byte(k), "byte"), c(el.wrapped(k, 16), "short"), c(el.swab(k, 2), "swapped2"), c(el.swab(k, 4), "swapped4")]
    return tab(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *whole, r4(t, "t"), r4(z["re"], "re"), r4(z["im"], "im"), r4(el.cabs(el.cplx(n, d)), "size"))
