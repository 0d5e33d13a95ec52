"""Sampling grids of the sphere as DataFrames built from ``range``."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sphere import pol2cart, rot, within_cone


def _turned(df: DataFrame, r: np.ndarray) -> DataFrame:
    m = r.tolist()
    keep = [c for c in df.columns if c not in "xyz"]
    return df.select(*keep, *((F.col("x") * m[k][0] + F.col("y") * m[k][1] + F.col("z") * m[k][2]).alias(c) for k, c in enumerate("xyz")))


def _unit(direction) -> np.ndarray:
    d = np.asarray(direction, float)
    n = np.linalg.norm(d)
    if d.shape != (3,) or not n:
        raise ValueError("direction must be a non-zero vector of three numbers")
    return d / n


def _to(d: np.ndarray) -> np.ndarray:
    """Rotation of the pole towards a direction."""
    axis = np.cross([0, 0, 1], d)
    if np.allclose(axis, 0):
        return np.diag([1.0, 1.0, 1.0 if d[2] > 0 else -1.0])
    return rot(axis, math.acos(max(-1.0, min(1.0, d[2]))))


def _mesh(spark: SparkSession, height: int, width: int) -> DataFrame:
    return spark.range(height * width).select(F.col("id").alias("pixel_id"), F.floor(F.col("id") / width).alias("row"), (F.col("id") % width).alias("col"))


def _line(i: Column, lo: float, hi: float, n: int) -> Column:
    return F.lit(lo) + i * ((hi - lo) / (n - 1) if n > 1 else 0.0)


def spherical(spark: SparkSession, direction, fov: float, size: tuple[int, int]) -> DataFrame:
    d = _unit(direction)
    g = _mesh(spark, *size)
    x, y, z = pol2cart(F.lit(1.0), _line(F.col("row"), 0, fov / 2, size[0]), _line(F.col("col"), 0, 2 * math.pi, size[1]))
    return _turned(g.select("*", x.alias("x"), y.alias("y"), z.alias("z")), _to(d))


def uniform(spark: SparkSession, direction, fov: float, size: tuple[int, int]) -> DataFrame:
    """Points outside the unit disc become the pole's direction's origin (0, 0, 0)."""
    d = _unit(direction)
    lim = math.sin(fov / 2)
    g = _mesh(spark, *size).withColumn("a", _line(F.col("col"), -lim, lim, size[1])).withColumn("b", _line(F.col("row"), -lim, lim, size[0]))
    rest = 1 - F.col("a") * F.col("a") - F.col("b") * F.col("b")
    inside = rest >= 0
    g = g.select("pixel_id", "row", "col", F.when(inside, F.col("a")).otherwise(0.0).alias("x"), F.when(inside, F.col("b")).otherwise(0.0).alias("y"), F.when(inside, F.sqrt(F.greatest(rest, F.lit(0.0)))).otherwise(0.0).alias("z"))
    return _turned(g, _to(d) @ rot([0, 0, 1], math.atan2(d[1], d[0])))


def equal_angle(spark: SparkSession, n: int, direction=None, fov: float | None = None) -> DataFrame:
    """``q, l, colat, lon``; with a direction only the region around it, wrapped at longitude 0."""
    if n <= 0:
        raise ValueError("N must be positive")
    k = 2 * n + 2
    g = spark.range(k * k).select(F.floor(F.col("id") / k).alias("q"), (F.col("id") % k).alias("l"))
    g = g.select("q", "l", ((F.col("q") + 0.5) * (math.pi / k)).alias("colat"), (F.col("l") * (2 * math.pi / k)).alias("lon"))
    if direction is None:
        return g
    if fov is None or not 0 < fov <= math.radians(179):
        raise ValueError("fov must be in (0, 179] degrees")
    d = _unit(direction)
    if np.allclose(d[:2], 0):
        raise ValueError("grids around a pole aren't supported")
    colat, lon = math.acos(d[2]), math.atan2(d[1], d[0])
    lo, hi = (lon - fov / 2) % (2 * math.pi), (lon + fov / 2) % (2 * math.pi)
    band = F.col("colat").between(max(math.radians(0.5), colat - fov / 2), min(colat + fov / 2, math.radians(179.5)))
    turn = F.col("lon").between(lo, hi) if lo < hi else (F.col("lon") >= lo) | (F.col("lon") <= hi)
    return g.where(band & turn)


def _cone(df: DataFrame, direction, fov: float | None) -> DataFrame:
    if direction is None:
        return df
    if fov is None or not 0 < fov < 2 * math.pi:
        raise ValueError("fov must be in (0, 360) degrees")
    return df.where(within_cone(F.col("x"), F.col("y"), F.col("z"), _unit(direction), fov))


def fibonacci(spark: SparkSession, n: int, direction=None, fov: float | None = None) -> DataFrame:
    if n < 0:
        raise ValueError("N must be non-negative")
    total = 4 * (n + 1) ** 2
    x, y, z = pol2cart(F.lit(1.0), F.acos(1 - (2 * F.col("id") + 1) / F.lit(float(total))), F.col("id") * (4 * math.pi / (1 + math.sqrt(5))))
    return _cone(spark.range(total).select(F.col("id").alias("pixel_id"), x.alias("x"), y.alias("y"), z.alias("z")), direction, fov)


def healpix(spark: SparkSession, n: int, direction=None, fov: float | None = None) -> DataFrame:
    """Pixel centres in ring order."""
    if n < 0:
        raise ValueError("N must be non-negative")
    s = (n + 1) // 2
    if not s:
        return spark.createDataFrame([], "pixel_id bigint, x double, y double, z double")
    total = 12 * s * s
    cap = 2 * s * (s - 1)
    i = F.col("id")

    def ring_of(p: Column) -> Column:
        return F.floor((1 + F.floor(F.sqrt(1 + 2 * p))) / 2)

    rn, rs = ring_of(i), ring_of(total - 1 - i)
    north, south = i < cap, i >= total - cap
    jn, js = i + 1 - 2 * rn * (rn - 1), 4 * rs + 1 - ((total - i) - 2 * rs * (rs - 1))
    k = i - cap
    ring, j = F.floor(k / (4 * s)) + s, k % (4 * s) + 1
    shift = F.when((ring + s) % 2 == 0, 0.5).otherwise(1.0)
    z = F.when(north, 1 - rn * rn / (3.0 * s * s)).when(south, -1 + rs * rs / (3.0 * s * s)).otherwise((2 * s - ring) * (2.0 / (3 * s)))
    phi = F.when(north, (jn - 0.5) * (math.pi / 2) / rn).when(south, (js - 0.5) * (math.pi / 2) / rs).otherwise((j - shift) * (math.pi / (2 * s)))
    flat = F.sqrt(1 - F.col("z") * F.col("z"))
    df = spark.range(total).select(i.alias("pixel_id"), z.alias("z"), phi.alias("phi"))
    return _cone(df.select("pixel_id", (flat * F.cos("phi")).alias("x"), (flat * F.sin("phi")).alias("y"), "z"), direction, fov)
