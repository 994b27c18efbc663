"""Kepler's equation, planets by mean elements, the sun's disk, sidereal time, precession, constellations of permutations."""

from __future__ import annotations

import math
from itertools import permutations as _permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAD = math.pi / 180
J2000 = 2451545.0

# Mean elements at J2000 and their change by century (a in au, e, inclination, mean longitude,
# longitude of perihelion and node in degrees), for 1800 to 2050.
ELEMENTS = {
    "mercury": ((0.38709927, 0.20563593, 7.00497902, 252.25032350, 77.45779628, 48.33076593), (0.00000037, 0.00001906, -0.00594749, 149472.67411175, 0.16047689, -0.12534081)),
    "venus": ((0.72333566, 0.00677672, 3.39467605, 181.97909950, 131.60246718, 76.67984255), (0.00000390, -0.00004107, -0.00078890, 58517.81538729, 0.00268329, -0.27769418)),
    "earth": ((1.00000261, 0.01671123, -0.00001531, 100.46457166, 102.93768193, 0.0), (0.00000562, -0.00004392, -0.01294668, 35999.37244981, 0.32327364, 0.0)),
    "mars": ((1.52371034, 0.09339410, 1.84969142, -4.55343205, -23.94362959, 49.55953891), (0.00001847, 0.00007882, -0.00813131, 19140.30268499, 0.44441088, -0.29257343)),
    "jupiter": ((5.20288700, 0.04838624, 1.30439695, 34.39644051, 14.72847983, 100.47390909), (-0.00011607, -0.00013253, -0.00183714, 3034.74612775, 0.21252668, 0.20469106)),
    "saturn": ((9.53667594, 0.05386179, 2.48599187, 49.95424423, 92.59887831, 113.66242448), (-0.00125060, -0.00050991, 0.00193609, 1222.49362201, -0.41897216, -0.28867794)),
    "uranus": ((19.18916464, 0.04725744, 0.77263783, 313.23810451, 170.95427630, 74.01692503), (-0.00196176, -0.00004397, -0.00242939, 428.48202785, 0.40805281, 0.04240589)),
    "neptune": ((30.06992276, 0.00859048, 1.77004347, -55.12002969, 44.96476227, 131.78422574), (0.00026291, 0.00005105, 0.00035372, 218.45945325, -0.32241464, -0.00508664)),
}


def kepler(df: DataFrame, mean_anomaly: str, eccentricity: float, out: str = "true_anomaly", what: str = "true", rounds: int = 6) -> DataFrame:
    """`df` with the true (or eccentric) anomaly for a mean anomaly in radians; elliptic orbits.

    Newton steps from a start that converges for every eccentricity below 1; each step is a projection of
    its own, so that no expression is computed twice.
    """
    e = F.lit(float(eccentricity))
    m = F.col(mean_anomaly) - F.floor((F.col(mean_anomaly) + math.pi) / (2 * math.pi)) * (2 * math.pi)
    df = df.withColumn("__m", m).withColumn("__e", F.col("__m") + F.signum("__m") * 0.85 * e)
    for _ in range(rounds):
        df = df.withColumn("__e", F.col("__e") - (F.col("__e") - e * F.sin("__e") - F.col("__m")) / (1 - e * F.cos("__e")))
    root = math.sqrt((1 + eccentricity) / (1 - eccentricity))
    value = 2 * F.atan(root * F.tan(F.col("__e") / 2)) if what == "true" else F.col("__e")
    return df.withColumn(out, value).drop("__m", "__e")


def kepler_solve(m: np.ndarray, e: float, rounds: int = 8) -> np.ndarray:
    """Eccentric anomalies, on a worker."""
    m = (np.asarray(m, float) + np.pi) % (2 * np.pi) - np.pi
    x = m + np.sign(m) * 0.85 * e
    for _ in range(rounds):
        x = x - (x - e * np.sin(x) - m) / (1 - e * np.cos(x))
    return x


def planet(name: str, jd: np.ndarray) -> np.ndarray:
    """Heliocentric ecliptic coordinates (3, n) in au, equinox J2000, to a few arc minutes."""
    t = (np.asarray(jd, float) - J2000) / 36525
    a, e, i, l, w, o = (p + q * t for p, q in zip(*ELEMENTS[name], strict=True))
    x = np.array([kepler_solve(v, f) for v, f in zip(np.atleast_1d((l - w) * RAD), np.atleast_1d(e), strict=True)]).reshape(np.shape(t))
    px, py = a * (np.cos(x) - e), a * np.sqrt(1 - e * e) * np.sin(x)
    w0, o, i = (w - o) * RAD, o * RAD, i * RAD
    cw, sw, co, so, ci, si = np.cos(w0), np.sin(w0), np.cos(o), np.sin(o), np.cos(i), np.sin(i)
    return np.stack([(cw * co - sw * so * ci) * px + (-sw * co - cw * so * ci) * py, (cw * so + sw * co * ci) * px + (-sw * so + cw * co * ci) * py, sw * si * px + cw * si * py])


def geocentric(name: str, jd: np.ndarray) -> np.ndarray:
    """(longitude, latitude, distance) as seen from the earth, ecliptic of J2000, in radians and au."""
    x, y, z = planet(name, jd) - planet("earth", jd) if name != "sun" else -planet("earth", jd)
    return np.stack([np.arctan2(y, x) % (2 * np.pi), np.arctan2(z, np.hypot(x, y)), np.sqrt(x * x + y * y + z * z)])


def sidereal_time(jd: Column) -> Column:
    """Mean sidereal time at Greenwich, in radians (0 to 2 pi)."""
    d = jd - J2000
    t = d / 36525
    deg = 280.46061837 + 360.98564736629 * d + 0.000387933 * t * t - t * t * t / 38710000
    return F.radians(deg - F.floor(deg / 360) * 360)


def _sun(jd: Column) -> tuple[Column, Column, Column]:
    """Apparent longitude of the sun and of the node of its equator in degrees, and its distance in au."""
    t = (jd - J2000) / 36525
    l0, m = 280.46646 + 36000.76983 * t, F.radians(357.52911 + 35999.05029 * t)
    e = 0.016708634 - 0.000042037 * t
    c = (1.914602 - 0.004817 * t) * F.sin(m) + 0.019993 * F.sin(2 * m) + 0.000289 * F.sin(3 * m)
    return l0 + c - 0.00569, 73.6667 + 1.3958333 * (jd - 2396758) / 36525, 1.000001018 * (1 - e * e) / (1 + e * F.cos(m + F.radians(c)))


def solar_disk(jd: Column) -> Column:
    """Struct (p, b, l, r): position angle of the sun's axis, latitude and longitude of the disk's center (degrees), radius (arc seconds)."""
    lam, k, r = _sun(jd)
    theta = (jd - 2398220) * (360 / 25.38)
    i, eps = math.radians(7.25), F.radians(23.439291 - 0.0130042 * (jd - J2000) / 36525)
    d = F.radians(lam - k)
    x, y = F.atan(-F.cos(F.radians(lam)) * F.tan(eps)), F.atan(-F.cos(d) * math.tan(i))
    eta = F.degrees(F.atan2(-F.sin(d) * math.cos(i), -F.cos(d)))
    l = eta - theta
    return F.struct(F.degrees(x + y).alias("p"), F.degrees(F.asin(F.sin(d) * math.sin(i))).alias("b"), (l - F.floor(l / 360) * 360).alias("l"), (959.63 / r).alias("r"))


def precess(lon: np.ndarray, lat: np.ndarray, jd0: float, jd1: float) -> tuple[np.ndarray, np.ndarray]:
    """Equatorial coordinates (radians) brought from one equinox to another (IAU 1976)."""
    from lattica.functions.sofa import pmat, s2c

    v = np.asarray(s2c(lon, lat))
    v = pmat(jd1) @ pmat(jd0).T @ v.reshape(3, -1)
    return np.arctan2(v[1], v[0]) % (2 * np.pi), np.arcsin(np.clip(v[2], -1, 1))


def permutation_number(p, circular: bool = False) -> int:
    """Rank of a permutation of 0 .. n - 1 in the order of the dictionary; circular: with its smallest in front."""
    p = list(p)
    if circular:
        k = p.index(min(p))
        p = [x - 1 for x in (p[k:] + p[:k])[1:]]
    out = 0
    for i, x in enumerate(p):
        out += sum(y < x for y in p[i + 1 :]) * math.factorial(len(p) - 1 - i)
    return out


def permutation(n: int, number: int) -> list[int]:
    """The permutation of a rank."""
    left, out = list(range(n)), []
    for i in range(n - 1, -1, -1):
        k, number = divmod(number, math.factorial(i))
        out.append(left.pop(k))
    return out


def permutation_distance(p, q, circular: bool = False) -> int:
    """Least number of exchanges of neighbours from one to the other; circular: over all turns of one."""
    turns = [list(q)[k:] + list(q)[:k] for k in range(len(q))] if circular else [list(q)]
    best = None
    for t in turns:
        at = {x: i for i, x in enumerate(t)}
        s = [at[x] for x in p]
        d = sum(s[i] > s[j] for i in range(len(s)) for j in range(i + 1, len(s)))
        best = d if best is None else min(best, d)
    return best


def all_permutations(n: int):
    return list(_permutations(range(n)))
