"""Interpolation, splines, least squares and fits.

Sums over the cells are Spark aggregates; only the small normal equations are solved on the driver.
Splines along an axis are kernels over whole lines.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.ndarray import NdArray
from lattica.plans.lineage import cut


def lsq(df: DataFrame, y: Column, terms: Sequence[Column], weight: Column | None = None) -> dict:
    """Linear least squares of y on the terms: coefficients, covariance, chisq, n. One pass for the sums."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    t = [c.cast("double") for c in terms]
    k = len(t)
    ok = y.isNotNull()
    sums = [F.sum(F.when(ok, w * t[i] * t[j])) for i in range(k) for j in range(i, k)] + [F.sum(F.when(ok, w * t[i] * y)) for i in range(k)] + [F.sum(F.when(ok, w * y * y)), F.count(y)]
    row = list(df.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first())
    m = np.zeros((k, k))
    it = iter(row)
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = next(it) or 0.0
    b = np.array([next(it) or 0.0 for _ in range(k)])
    yy, n = next(it) or 0.0, next(it)
    inverse = np.linalg.pinv(m)
    x = inverse @ b
    chisq = float(yy - x @ b)
    return {"coefficients": x, "covariance": inverse * (chisq / max(1, n - k)), "chisq": chisq, "n": n}


def pit(df: DataFrame, x: Column, y: Column, order: int, weight: Column | None = None) -> np.ndarray:
    """Coefficients of the polynomial of an order that fits y over x best, the constant first.

    x is shifted and scaled by its mean and spread for the sums, and the result is expanded again.
    """
    m, s = df.agg(F.avg(x), F.stddev_pop(x)).first()
    m, s = m or 0.0, s or 1.0
    u = (x.cast("double") - m) / s
    c = lsq(df, y, [F.pow(u, F.lit(k)) for k in range(order + 1)], weight)["coefficients"]
    out = np.zeros(1)
    for k in range(order, -1, -1):  # Horner on polynomials in (x - m) / s
        out = np.polynomial.polynomial.polyadd(np.polynomial.polynomial.polymul(out, [-m / s, 1 / s]), [c[k]])
    return np.pad(out, (0, order + 1))[: order + 1]


def trend(a: NdArray, order: int = 1) -> NdArray:
    """The polynomial of an order in the index that fits a 1-D array best."""
    c = pit(a.df, F.col("i0"), F.col("v"), order)
    return a.with_index(lambda v, i: sum((F.lit(float(k)) * F.pow(i, F.lit(p)) for p, k in enumerate(c)), F.lit(0.0)))


def detrend(a: NdArray, order: int = 1) -> NdArray:
    c = pit(a.df, F.col("i0"), F.col("v"), order)
    return a.with_index(lambda v, i: v - sum((F.lit(float(k)) * F.pow(i, F.lit(p)) for p, k in enumerate(c)), F.lit(0.0)))


def polate(table: DataFrame, x: str, y: str, points: DataFrame, at: str) -> DataFrame:
    """`points` with v: y of the piecewise linear table at each point, beyond the ends by the end pieces.

    Points and table are put in order together, in ranges; a point takes the knots on its two sides from its range, or
    else the nearest of the ranges before and after.  Points that are null or NaN, and all if the table has fewer than
    two knots, are left out; between knots of the same x v is null.
    """
    knot = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    knots = table.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).select(knot.alias("k"))
    low, high = knots.orderBy("k").limit(2).collect(), knots.orderBy(F.desc("k")).limit(2).collect()[::-1]
    point = F.struct(*points.columns)
    spots = points.select(F.col(at).cast("double").alias("x"), F.lit(1).alias("side"), F.xxhash64(point).cast("double").alias("tie"), F.lit(None).cast("struct<x:double,y:double>").alias("k"), point.alias("point"))
    spots = spots.where(F.col("x").isNotNull() & ~F.isnan("x"))
    order = ["x", "side", "tie"]
    both = knots.select(F.col("k.x").alias("x"), F.lit(0).alias("side"), F.col("k.y").alias("tie"), "k").unionByName(spots, allowMissingColumns=True)
    ranged = cut(both.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    up, down = W.partitionBy("part").orderBy(*order), W.partitionBy("part").orderBy(*map(F.desc, order))
    # A row for each range: the last knot before it and the first after it.
    ends = ranged.groupBy("part").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    before = F.max("last").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    after = F.min("first").over(W.orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select("part", before.alias("before"), after.alias("after"))
    placed = ranged.withColumns({"a": F.last("k", True).over(up.rowsBetween(W.unboundedPreceding, 0)), "b": F.last("k", True).over(down.rowsBetween(W.unboundedPreceding, 0))}).where("side = 1").join(F.broadcast(ends), "part")
    placed = placed.select("point", "x", F.coalesce("a", "before").alias("a"), F.coalesce("b", "after").alias("b"))
    if len(low) < 2:
        placed, low, high = placed.where("false"), [Row(k=Row(x=0.0, y=0.0))] * 2, [Row(k=Row(x=0.0, y=0.0))] * 2
    fixed = lambda r: F.struct(F.lit(r["k"]["x"]).cast("double").alias("x"), F.lit(r["k"]["y"]).cast("double").alias("y"))
    of = lambda k, name: F.when(F.col("a").isNull(), fixed(low[k])).when(F.col("b").isNull(), fixed(high[k])).otherwise(F.col(name))
    placed = placed.select("point", "x", of(0, "a").alias("a"), of(1, "b").alias("b"))
    rise = F.try_divide((F.col("x") - F.col("a.x")) * (F.col("b.y") - F.col("a.y")), F.col("b.x") - F.col("a.x"))
    return placed.select("point.*", (F.col("a.y") + rise).alias("v"))


def spline(x: np.ndarray, y: np.ndarray, periodic: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Knots and second derivatives of the natural (or periodic) cubic spline."""
    n = len(x)
    h = np.diff(x)
    m = np.zeros((n, n))
    r = np.zeros(n)
    for i in range(1, n - 1):
        m[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    if periodic:
        m[0, 0], m[0, -1] = 1, -1
        m[-1, 0], m[-1, 1], m[-1, -2], m[-1, -1] = 2 * h[0], h[0], h[-1], 2 * h[-1]
        r[-1] = 6 * ((y[1] - y[0]) / h[0] - (y[-1] - y[-2]) / h[-1])
    else:
        m[0, 0] = m[-1, -1] = 1
    return x, np.linalg.solve(m, r)


def cspline(x: Sequence[float], y: Sequence[float], at: Sequence[float], periodic: bool = False, derivative: bool = False) -> np.ndarray:
    """Values (or slopes) of the cubic spline through (x, y)."""
    x, y, at = np.asarray(x, float), np.asarray(y, float), np.asarray(at, float)
    if periodic:
        at = x[0] + (at - x[0]) % (x[-1] - x[0])
    _, m = spline(x, y, periodic)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    h, a, b = x[k + 1] - x[k], x[k + 1] - at, at - x[k]
    if derivative:
        return (y[k + 1] - y[k]) / h - h / 6 * (m[k + 1] - m[k]) + (b * b * m[k + 1] - a * a * m[k]) / (2 * h)
    return (m[k] * a**3 + m[k + 1] * b**3) / (6 * h) + (y[k] / h - m[k] * h / 6) * a + (y[k + 1] / h - m[k + 1] * h / 6) * b


def cspline_integral(x: Sequence[float], y: Sequence[float], at: Sequence[float]) -> np.ndarray:
    """Integral of the cubic spline from the first knot to each place within the knots."""
    x, y, at = np.asarray(x, float), np.asarray(y, float), np.asarray(at, float)
    _, m = spline(x, y)
    h = np.diff(x)
    whole = np.concatenate([[0], np.cumsum(h * (y[1:] + y[:-1]) / 2 - h**3 * (m[1:] + m[:-1]) / 24)])
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    w, b = h[k], at - x[k]
    a = w - b
    part = m[k] * (w**4 - a**4) / (24 * w) + m[k + 1] * b**4 / (24 * w) + (y[k] / w - m[k] * w / 6) * (w**2 - a**2) / 2 + (y[k + 1] / w - m[k + 1] * w / 6) * b**2 / 2
    return whole[k] + part


def akima(x: Sequence[float], y: Sequence[float], at: Sequence[float]) -> np.ndarray:
    """Values of the Akima spline through (x, y)."""
    x, y, at = np.asarray(x, float), np.asarray(y, float), np.asarray(at, float)
    s = np.diff(y) / np.diff(x)
    s = np.concatenate([[3 * s[0] - 2 * s[1], 2 * s[0] - s[1]], s, [2 * s[-1] - s[-2], 3 * s[-1] - 2 * s[-2]]]) if len(s) > 1 else np.full(5, s[0])
    d = np.abs(np.diff(s))
    w1, w2 = d[2 : 2 + len(x)], d[: len(x)]
    t = np.where(w1 + w2 > 1e-12, (w1 * s[1 : 1 + len(x)] + w2 * s[2 : 2 + len(x)]) / np.maximum(w1 + w2, 1e-300), (s[1 : 1 + len(x)] + s[2 : 2 + len(x)]) / 2)
    return _hermite(x, y, t, at)


def _hermite(x, y, slope, at) -> np.ndarray:
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    h = x[k + 1] - x[k]
    u = (at - x[k]) / h
    return y[k] * (1 + 2 * u) * (1 - u) ** 2 + slope[k] * h * u * (1 - u) ** 2 + y[k + 1] * u**2 * (3 - 2 * u) + slope[k + 1] * h * u**2 * (u - 1)


def monotone_interpolate(x: Sequence[float], y: Sequence[float], at: Sequence[float], limiter: str = "circle") -> np.ndarray:
    """Cubic interpolation that keeps the data's monotony; slopes are limited to a region (none, circle, square, wide)."""
    x, y, at = (np.asarray(v, float) for v in (x, y, at))
    s = np.diff(y) / np.diff(x)
    t = np.concatenate([[s[0]], (s[1:] + s[:-1]) / 2, [s[-1]]])
    if limiter != "none":
        for k in range(len(s)):
            if s[k] == 0:
                t[k] = t[k + 1] = 0
                continue
            a, b = max(0.0, t[k] / s[k]), max(0.0, t[k + 1] / s[k])
            if limiter == "circle" and a * a + b * b > 9:
                f = 3 / np.hypot(a, b)
                a, b = a * f, b * f
            elif limiter == "square":
                a, b = min(a, 3.0), min(b, 3.0)
            elif limiter == "wide" and a + b > 4:
                f = 4 / (a + b)
                a, b = a * f, b * f
            t[k], t[k + 1] = a * s[k], b * s[k]
    return _hermite(x, y, t, at)


def cspline_find(x: Sequence[float], y: Sequence[float], value: float) -> np.ndarray:
    """Places where the cubic spline has a value."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    _, m = spline(x, y)
    out = []
    for k in range(len(x) - 1):
        h = x[k + 1] - x[k]
        c = [(m[k + 1] - m[k]) / (6 * h), m[k] / 2, (y[k + 1] - y[k]) / h - h * (2 * m[k] + m[k + 1]) / 6, y[k] - value]
        roots = np.roots(np.trim_zeros(c, "f")) if any(c[:-1]) else []
        out += [x[k] + r.real for r in roots if abs(r.imag) < 1e-9 and -1e-12 <= r.real < h - 1e-12 * h or k == len(x) - 2 and abs(r - h) < 1e-9]
    return np.unique(np.round(out, 12))


def cspline_extremes(x: Sequence[float], y: Sequence[float]) -> list[tuple[float, float, int]]:
    """(place, value, sign) of the spline's extremes; sign 1 for a maximum."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    _, m = spline(x, y)
    out = []
    for k in range(len(x) - 1):
        h = x[k + 1] - x[k]
        c = [(m[k + 1] - m[k]) / (2 * h), m[k], (y[k + 1] - y[k]) / h - h * (2 * m[k] + m[k + 1]) / 6]
        for r in np.roots(np.trim_zeros(c, "f")) if any(c[:-1]) else []:
            if abs(r.imag) < 1e-12 and 0 <= r.real < h:
                p = x[k] + r.real
                out.append((float(p), float(cspline(x, y, [p])[0]), -1 if 2 * c[0] * r.real + c[1] > 0 else 1))
    return out


def tension_spline(x: Sequence[float], y: Sequence[float], at: Sequence[float], tension: float) -> np.ndarray:
    """Spline under tension through (x, y): tension 0 is nearly the cubic spline, a large one nearly straight lines."""
    x, y, at = (np.asarray(v, float) for v in (x, y, at))
    s = max(1e-6, tension) * (len(x) - 1) / (x[-1] - x[0])
    h, n = np.diff(x), len(x)
    e = 1 / h - s / np.sinh(s * h)
    d = s / np.tanh(s * h) - 1 / h
    m, r = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        m[i, i - 1 : i + 2] = e[i - 1], d[i - 1] + d[i], e[i]
        r[i] = (y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1]
    z = np.linalg.solve(m, r)  # second derivatives over s squared
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    a, b = x[k + 1] - at, at - x[k]
    return (z[k] * np.sinh(s * a) + z[k + 1] * np.sinh(s * b)) / np.sinh(s * h[k]) + ((y[k] - z[k]) * a + (y[k + 1] - z[k + 1]) * b) / h[k]


def tension_curve(x: Sequence[float], y: Sequence[float], n: int, tension: float, closed: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """n points of the tension spline through points of the plane, by chord length; closed: back to the first."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if closed:
        x, y = np.concatenate([x[-3:], x, x[:4]]), np.concatenate([y[-3:], y, y[:4]])
    t = np.concatenate([[0], np.cumsum(np.hypot(np.diff(x), np.diff(y)))])
    lo, hi = (t[3], t[-4]) if closed else (t[0], t[-1])
    at = np.linspace(lo, hi, n)
    return tension_spline(t, x, at, tension), tension_spline(t, y, at, tension)


def fit(model: Callable[[np.ndarray, np.ndarray], np.ndarray], x, y, start, weights=None, rounds: int = 100, bounds=None) -> tuple[np.ndarray, float]:
    """General least squares of model(x, parameters) to y by damped Gauss-Newton steps: parameters and chi squared."""
    x, y, p = np.asarray(x, float), np.asarray(y, float), np.asarray(start, float)
    w = np.ones(len(y)) if weights is None else np.asarray(weights, float)
    damp, r = 1e-3, y - model(x, p)
    chi = float((w * r * r).sum())
    for _ in range(rounds):
        step = np.maximum(1e-7, 1e-6 * np.abs(p))
        j = np.stack([(model(x, p + step * (np.arange(len(p)) == k)) - model(x, p)) / step[k] for k in range(len(p))], axis=1)
        a, b = j.T @ (w[:, None] * j), j.T @ (w * r)
        q = p + np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), b, rcond=None)[0]
        if bounds is not None:
            q = np.clip(q, *bounds)
        s = y - model(x, q)
        new = float((w * s * s).sum())
        if new < chi:
            done = chi - new < 1e-12 * max(chi, 1e-300)
            p, r, chi, damp = q, s, new, damp / 10
            if done:
                break
        else:
            damp *= 10
            if damp > 1e12:
                break
    return p, chi


def fit_genetic(model, x, y, low, high, population: int = 60, generations: int = 200, seed: int = 1) -> tuple[np.ndarray, float]:
    """Least squares by a genetic search within bounds, the best parameters refined at the end."""
    rng = np.random.RandomState(seed)
    low, high = np.asarray(low, float), np.asarray(high, float)
    chi = lambda p: float(((np.asarray(y) - model(np.asarray(x, float), p)) ** 2).sum())
    pop = low + (high - low) * rng.rand(population, len(low))
    cost = np.array([chi(p) for p in pop])
    for _ in range(generations):
        a, b = (np.minimum(rng.randint(population, size=population), rng.randint(population, size=population)) for _ in range(2))
        order = np.argsort(cost)
        mix = rng.rand(population, len(low))
        child = pop[order][a] * mix + pop[order][b] * (1 - mix) + (high - low) * 0.05 * rng.randn(population, len(low)) * (rng.rand(population, len(low)) < 0.2)
        child = np.clip(child, low, high)
        c = np.array([chi(p) for p in child])
        both, costs = np.concatenate([pop, child]), np.concatenate([cost, c])
        best = np.argsort(costs)[:population]
        pop, cost = both[best], costs[best]
    return fit(model, x, y, pop[0], bounds=(low, high))
