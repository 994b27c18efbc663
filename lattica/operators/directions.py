"""Operators along a direction field, surface-filling coordinates and map projection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lattica.ndarray import NdArray
from lattica.operators.images import _sample


def _step(a: NdArray, direction: NdArray):
    """`a` with the values one cell ahead and behind along each cell's direction (radians), to the nearest of eight."""
    d = direction.df.withColumnRenamed("v", "__d")
    df = a.df.join(d, a.axes).withColumns({"__x": F.rint(F.cos("__d")).cast("bigint"), "__y": F.rint(F.sin("__d")).cast("bigint")})
    for name, sign in (("__ahead", 1), ("__behind", -1)):
        near = a.df.select(F.col("i0").alias("__p"), F.col("i1").alias("__q"), F.col("v").alias(name))
        df = df.join(near, (F.col("i0") + sign * F.col("__x") == F.col("__p")) & (F.col("i1") + sign * F.col("__y") == F.col("__q")), "left").drop("__p", "__q")
    return df


def maxdir(a: NdArray, direction: NdArray) -> NdArray:
    """1 where a cell is above both neighbours along the direction."""
    hit = (F.col("v") > F.col("__ahead")) & (F.col("v") > F.col("__behind"))
    return NdArray(_step(a, direction).select("i0", "i1", F.coalesce(hit, F.lit(False)).cast("int").alias("v")), a.dims)


def segmentdir(a: NdArray, direction: NdArray, sign: int = 1) -> NdArray:
    """1 where the second difference along the direction is of a hill (sign 1) or a valley (-1)."""
    curve = F.col("__ahead") - 2 * F.col("v") + F.col("__behind")
    return NdArray(_step(a, direction).select("i0", "i1", F.coalesce(sign * curve < 0, F.lit(False)).cast("int").alias("v")), a.dims)


def polar_to_curve(longitude: np.ndarray, latitude: np.ndarray, levels: int = 20) -> np.ndarray:
    """Position (0 to 1) on a surface-filling curve of the sphere: octants, each cut in four triangles again and again."""
    v = np.stack([np.cos(latitude) * np.cos(longitude), np.cos(latitude) * np.sin(longitude), np.sin(latitude)], axis=-1)
    return np.array([_locate(p, levels) for p in v.reshape(-1, 3)]).reshape(np.shape(longitude))


def _octant(k: int) -> list[np.ndarray]:
    sign = np.array([1 - 2 * (k & 1), 1 - 2 * (k >> 1 & 1), 1 - 2 * (k >> 2 & 1)], float)
    return [np.array([sign[0], 0, 0]), np.array([0, sign[1], 0]), np.array([0, 0, sign[2]])]


def _quarters(t: list[np.ndarray]) -> list[list[np.ndarray]]:
    a, b, c = t
    ab, bc, ca = ((x + y) / np.linalg.norm(x + y) for x, y in ((a, b), (b, c), (c, a)))
    return [[a, ab, ca], [ab, b, bc], [ab, bc, ca], [ca, bc, c]]


def _inside(p: np.ndarray, t: list[np.ndarray]) -> float:
    return float(np.linalg.solve(np.array(t).T, p).min())


def _locate(p: np.ndarray, levels: int) -> float:
    k = int(p[0] < 0) | int(p[1] < 0) << 1 | int(p[2] < 0) << 2
    t, out, scale = _octant(k), k / 8, 1 / 8
    for _ in range(levels):
        parts = _quarters(t)
        q = int(np.argmax([_inside(p, x) for x in parts]))
        scale /= 4
        out += q * scale
        t = parts[q]
    return out


def curve_to_polar(position: float, levels: int = 20) -> tuple[float, float]:
    """(longitude, latitude) of a position on the curve, the middle of its smallest triangle."""
    x = position * 8
    k = min(7, int(x))
    t, x = _octant(k), x - k
    for _ in range(levels):
        x *= 4
        q = min(3, int(x))
        x -= q
        t = _quarters(t)[q]
    m = sum(t)
    return float(np.arctan2(m[1], m[0])), float(np.arctan2(m[2], np.hypot(m[0], m[1])))


def project_map(image: np.ndarray, height: float, angle: float, size: int) -> np.ndarray:
    """A map over longitude and latitude seen on a sphere from a height (in radii), turned by an angle; NaN off the disk."""
    y, x = np.meshgrid(np.linspace(-1, 1, size), np.linspace(-1, 1, size), indexing="ij")
    r2 = x * x + y * y
    z = np.sqrt(np.maximum(0, 1 - r2))
    scale = 1 if np.isinf(height) else (height + 1 - z) / height
    x, y = x * scale, y * scale
    z = np.sqrt(np.maximum(0, 1 - x * x - y * y))
    lon, lat = (np.arctan2(x, z) + angle) % (2 * np.pi), np.arcsin(np.clip(y, -1, 1))
    out = _sample(image, lon / (2 * np.pi) * image.shape[0], (lat / np.pi + 0.5) * (image.shape[1] - 1), 1)
    return np.where(x * x + y * y <= 1, out, np.nan)
