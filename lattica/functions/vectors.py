"""Vectors, rotations and position-velocity pairs as columns: arrays of three doubles, of three rows, and of two vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(x, y, z) -> Column:
    return F.array(*((c if isinstance(c, Column) else F.lit(float(c))).cast("double") for c in (x, y, z)))


def _each(fn, *vs) -> Column:
    return F.array(*(fn(*(v[k] for v in vs)) for k in range(3)))


def pdp(a: Column, b: Column) -> Column:
    """Inner product."""
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def pxp(a: Column, b: Column) -> Column:
    """Outer product."""
    return vec(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def pm(a: Column) -> Column:
    """Length."""
    return F.sqrt(pdp(a, a))


def pn(a: Column) -> Column:
    """Unit vector; of a zero vector the zero vector."""
    return _each(lambda x: F.when(pm(a) > 0, x / pm(a)).otherwise(0.0), a)


def ppp(a: Column, b: Column) -> Column:
    return _each(lambda x, y: x + y, a, b)


def pmp(a: Column, b: Column) -> Column:
    return _each(lambda x, y: x - y, a, b)


def sxp(s: Column | float, a: Column) -> Column:
    return _each(lambda x: s * x, a)


def ppsp(a: Column, s: Column | float, b: Column) -> Column:
    """a + s b."""
    return _each(lambda x, y: x + s * y, a, b)


def zp() -> Column:
    return vec(0, 0, 0)


def s2c(theta: Column, phi: Column) -> Column:
    """Unit vector of spherical angles."""
    return vec(F.cos(theta) * F.cos(phi), F.sin(theta) * F.cos(phi), F.sin(phi))


def s2p(theta: Column, phi: Column, r: Column) -> Column:
    return sxp(r, s2c(theta, phi))


def c2s(a: Column) -> tuple[Column, Column]:
    """Spherical angles of a vector."""
    return F.atan2(a[1], a[0]), F.atan2(a[2], F.sqrt(a[0] * a[0] + a[1] * a[1]))


def p2s(a: Column) -> tuple[Column, Column, Column]:
    return (*c2s(a), pm(a))


def sepp(a: Column, b: Column) -> Column:
    """Angle between two vectors."""
    return F.atan2(pm(pxp(a, b)), pdp(a, b))


def seps(al: Column, ap: Column, bl: Column, bp: Column) -> Column:
    return sepp(s2c(al, ap), s2c(bl, bp))


def pas(al: Column, ap: Column, bl: Column, bp: Column) -> Column:
    """Position angle of the second direction from the first."""
    d = bl - al
    return F.atan2(F.sin(d) * F.cos(bp), F.sin(bp) * F.cos(ap) - F.cos(bp) * F.sin(ap) * F.cos(d))


# Rotations.


def rows(*r: Column) -> Column:
    return F.array(*r)


def ir() -> Column:
    return rows(vec(1, 0, 0), vec(0, 1, 0), vec(0, 0, 1))


def zr() -> Column:
    return rows(zp(), zp(), zp())


def turn_x(phi: Column) -> Column:
    """Rotation about the first axis."""
    return rows(vec(1, 0, 0), vec(0, F.cos(phi), F.sin(phi)), vec(0, -F.sin(phi), F.cos(phi)))


def turn_y(theta: Column) -> Column:
    return rows(vec(F.cos(theta), 0, -F.sin(theta)), vec(0, 1, 0), vec(F.sin(theta), 0, F.cos(theta)))


def turn_z(psi: Column) -> Column:
    return rows(vec(F.cos(psi), F.sin(psi), 0), vec(-F.sin(psi), F.cos(psi), 0), vec(0, 0, 1))


def tr(r: Column) -> Column:
    """Transpose."""
    return F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.transform(r, lambda row: F.get(row, k)))


def rxr(a: Column, b: Column) -> Column:
    return F.transform(a, lambda row: F.transform(tr(b), lambda col: pdp(row, col)))


def rxp(r: Column, p: Column) -> Column:
    return F.transform(r, lambda row: pdp(row, p))


def trxp(r: Column, p: Column) -> Column:
    return rxp(tr(r), p)


def rx(phi: Column, r: Column) -> Column:
    """A rotation turned further about the first axis."""
    return rxr(turn_x(phi), r)


def ry(theta: Column, r: Column) -> Column:
    return rxr(turn_y(theta), r)


def rz(psi: Column, r: Column) -> Column:
    return rxr(turn_z(psi), r)


# Pairs of position and velocity.


def pv(p: Column, v: Column) -> Column:
    return F.array(p, v)


def p2pv(p: Column) -> Column:
    return pv(p, zp())


def pv2p(a: Column) -> Column:
    return a[0]


def zpv() -> Column:
    return pv(zp(), zp())


def pvdpv(a: Column, b: Column) -> tuple[Column, Column]:
    """Inner product and its rate."""
    return pdp(a[0], b[0]), pdp(a[0], b[1]) + pdp(a[1], b[0])


def pvxpv(a: Column, b: Column) -> Column:
    """Outer product and its rate."""
    return pv(pxp(a[0], b[0]), ppp(pxp(a[0], b[1]), pxp(a[1], b[0])))


def pvm(a: Column) -> tuple[Column, Column]:
    return pm(a[0]), pm(a[1])


def pvppv(a: Column, b: Column) -> Column:
    return pv(ppp(a[0], b[0]), ppp(a[1], b[1]))


def pvmpv(a: Column, b: Column) -> Column:
    return pv(pmp(a[0], b[0]), pmp(a[1], b[1]))


def s2xpv(s1: Column | float, s2: Column | float, a: Column) -> Column:
    return pv(sxp(s1, a[0]), sxp(s2, a[1]))


def sxpv(s: Column | float, a: Column) -> Column:
    return s2xpv(s, s, a)


def pvu(dt: Column | float, a: Column) -> Column:
    """The pair after a time."""
    return pv(ppsp(a[0], dt, a[1]), a[1])


def pvup(dt: Column | float, a: Column) -> Column:
    return ppsp(a[0], dt, a[1])


def rxpv(r: Column, a: Column) -> Column:
    return pv(rxp(r, a[0]), rxp(r, a[1]))


def trxpv(r: Column, a: Column) -> Column:
    return rxpv(tr(r), a)
