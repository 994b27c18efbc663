"""Special and distribution functions: numpy kernels, and pandas UDFs over them."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma, _erf, _erfc = np.vectorize(math.lgamma, otypes=[float]), np.vectorize(math.erf, otypes=[float]), np.vectorize(math.erfc, otypes=[float])


def column(fn: Callable, *args: Column | float) -> Column:
    """fn over columns, in Arrow batches."""

    def run(*series: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(fn(*(s.to_numpy(float) for s in series)), float))

    cols = [a if isinstance(a, Column) else F.lit(float(a)) for a in args]
    kinds = {1: _one, 2: _two, 3: _three}[len(cols)]
    return kinds(run)(*cols)


def _one(run):
    def f(a: pd.Series) -> pd.Series:
        return run(a)

    return F.pandas_udf(f, "double")


def _two(run):
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    return F.pandas_udf(f, "double")


def _three(run):
    def f(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return run(a, b, c)

    return F.pandas_udf(f, "double")


def gamma(x, log: bool = False):
    x = np.asarray(x, float)
    if log:
        return _lgamma(x)
    with np.errstate(invalid="ignore"):
        return np.where(x > 0, np.exp(_lgamma(np.where(x > 0, x, 1.0))), np.pi / (np.sin(np.pi * x) * np.exp(_lgamma(np.where(x > 0, 1.0, 1 - x)))))


def beta(a, b, log: bool = False):
    v = _lgamma(a) + _lgamma(b) - _lgamma(np.asarray(a, float) + b)
    return v if log else np.exp(v)


def erf(x):
    return _erf(x)


def erfc(x):
    return _erfc(x)


def factorial(n):
    return np.rint(np.exp(_lgamma(np.asarray(n, float) + 1)))


def _igamma(a: float, x: float) -> tuple[float, float]:
    """Lower and upper regularised incomplete gamma function."""
    if not x > 0:
        return 0.0, 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return total * front, 1 - total * front
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h, front * h


def igamma(a, x, complement: bool = False):
    return np.vectorize(lambda p, q: _igamma(p, q)[complement], otypes=[float])(a, x)


def _ibeta(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _ibeta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or 1e-300)
            c = 1 + top / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def ibeta(x, a, b, complement: bool = False):
    v = np.vectorize(_ibeta, otypes=[float])(x, a, b)
    return 1 - v if complement else v


def chi2(x, n, complement: bool = False):
    """Probability that a chi squared of n degrees of freedom is at most x."""
    return igamma(np.asarray(n, float) / 2, np.asarray(x, float) / 2, complement)


def student(t, n, complement: bool = False):
    t, n = np.asarray(t, float), np.asarray(n, float)
    tail = ibeta(n / (n + t * t), n / 2, 0.5) / 2
    v = np.where(t > 0, 1 - tail, tail)
    return 1 - v if complement else v


def fratio(f, n1, n2, complement: bool = False):
    f = np.asarray(f, float)
    return ibeta(n1 * f / (n1 * f + n2), np.asarray(n1, float) / 2, np.asarray(n2, float) / 2, complement)


def ncchi2(x, n, noncentral):
    """Non-central chi squared: a Poisson mixture of central ones."""

    def one(x, n, d):
        total, j, p = 0.0, 0, math.exp(-d / 2)
        while True:
            total += p * _igamma(n / 2 + j, x / 2)[0]
            j += 1
            p *= d / 2 / j
            if j > d / 2 and p < 1e-17:
                return total

    return np.vectorize(one, otypes=[float])(x, n, noncentral)


def _grid(n: int, top: float) -> tuple[np.ndarray, np.ndarray]:
    t = (np.arange(n) + 0.5) * (top / n)
    return t, np.full(n, top / n)


def bessel_j(n: int, x):
    """J_n by its integral; the midpoint rule converges faster than any power for a whole period."""
    x = np.asarray(x, float)
    m = int(60 + 2 * abs(n) + 2 * np.max(np.abs(x), initial=0))
    t = (np.arange(m) + 0.5) * np.pi / m
    return np.cos(n * t - x[..., None] * np.sin(t)).mean(axis=-1)


def bessel_y(n: int, x):
    x = np.asarray(x, float)
    nodes, weights = np.polynomial.legendre.leggauss(int(80 + 2 * abs(n) + 2 * np.max(np.abs(x), initial=0)))
    t = (nodes + 1) * np.pi / 2
    first = (np.sin(x[..., None] * np.sin(t) - n * t) * weights).sum(axis=-1) / 2
    with np.errstate(divide="ignore"):
        top = np.arcsinh(800 / np.maximum(x, 1e-12))
    s = (nodes + 1) / 2
    u = s * top[..., None]
    grow = np.logaddexp(n * u, -n * u) if n % 2 == 0 else None
    body = np.exp(grow - x[..., None] * np.sinh(u)) if grow is not None else np.exp(n * u - x[..., None] * np.sinh(u)) - np.exp(-n * u - x[..., None] * np.sinh(u))
    return np.where(x > 0, first - (body * weights).sum(axis=-1) * top / 2 / np.pi, -np.inf)


def bessel_i(n: int, x, deflate: bool = False):
    """I_n; deflated: times exp(-|x|)."""
    x = np.asarray(x, float)
    m = int(80 + 2 * n + 3 * np.sqrt(np.max(np.abs(x), initial=0)) + np.max(np.abs(x), initial=0))
    t = (np.arange(m) + 0.5) * np.pi / m
    v = (np.exp(x[..., None] * np.cos(t) - np.abs(x)[..., None]) * np.cos(n * t)).mean(axis=-1)
    return v if deflate else v * np.exp(np.abs(x))


def bessel_k(n: int, x):
    x = np.asarray(x, float)
    top = np.arccosh(1 + 750 / np.maximum(x, 1e-12)) if np.size(x) else x
    m = 2000
    s = (np.arange(m) + 0.5) / m
    u = s * top[..., None]
    return (np.exp(np.clip(np.logaddexp(n * u, -n * u) - np.log(2) - x[..., None] * np.cosh(u), -745, 709))).mean(axis=-1) * top


def legendre(n: int, x, normalise: bool = False):
    """Legendre polynomial; normalised to unit norm on (-1, 1)."""
    v = np.polynomial.legendre.legval(np.asarray(x, float), [0] * n + [1])
    return v * math.sqrt(n + 0.5) if normalise else v


def voigt(a, u):
    """Voigt function H(a, u), a > 0: a Gaussian seen through a Lorentzian of width a."""
    a, u = np.broadcast_arrays(np.asarray(a, float), np.asarray(u, float))
    # The real part of w(u + i a), from its rational expansion in powers of (l + iz) / (l - iz).
    n, m2 = 64, 256
    k = np.arange(-m2 + 1, m2)
    l = math.sqrt(n / math.sqrt(2))
    t = l * np.tan(k * np.pi / m2 / 2)
    f = np.concatenate([[0], np.exp(-t * t) * (l * l + t * t)])
    c = np.fft.fft(np.fft.fftshift(f)).real / (2 * m2)
    c = c[1 : n + 1][::-1]
    z = u + 1j * a
    q = (l + 1j * z) / (l - 1j * z)
    return (2 * np.polyval(c, q) / (l - 1j * z) ** 2 + (1 / math.sqrt(math.pi)) / (l - 1j * z)).real


def next235(n: int) -> int:
    """The least whole number of at least n without prime factors but 2, 3 and 5."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1
