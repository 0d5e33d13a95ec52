"""The local uvw frame, the imaging grid and baseline order."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uvw_basis(ra: float, dec: float) -> np.ndarray:
    """Columns are the u, v and w directions at the field centre (radians)."""
    sa, ca, sd, cd = math.sin(ra), math.cos(ra), math.sin(dec), math.cos(dec)
    return np.array([[-sa, -ca * sd, ca * cd], [ca, -sa * sd, sa * cd], [0.0, cd, sd]])


def to_uvw(x: Column, y: Column, z: Column, basis: np.ndarray) -> tuple[Column, Column, Column]:
    b = basis.tolist()
    return tuple(x * b[0][k] + y * b[1][k] + z * b[2][k] for k in range(3))


def lmn_grid(spark: SparkSession, size: int, fov: float) -> DataFrame:
    """``pixel_id, row, col, l, m, n``: l is moved by half a pixel up, m by half a pixel down."""
    if size < 1 or not 0 < fov <= math.pi:
        raise ValueError("size must be positive and the field of view in (0, pi]")
    lim = math.sin(fov / 2)
    step = 2 * lim / (size - 1) if size > 1 else 0.0
    half = lim / size
    p = spark.range(size * size).select(F.col("id").alias("pixel_id"), F.floor(F.col("id") / size).cast("int").alias("row"), (F.col("id") % size).cast("int").alias("col"))
    p = p.withColumn("l", F.lit(-lim + half) + F.col("col") * step).withColumn("m", F.lit(-lim - half) + F.col("row") * step)
    return p.withColumn("n", F.sqrt(1 - F.col("l") * F.col("l") - F.col("m") * F.col("m")))


def grid_xyz(pixels: DataFrame, basis: np.ndarray) -> DataFrame:
    """The grid's directions in the outer frame."""
    b = basis.tolist()
    return pixels.select("*", *((F.col("l") * b[k][0] + F.col("m") * b[k][1] + F.col("n") * b[k][2]).alias(c) for k, c in enumerate("xyz")))


def baseline_index(i: Column, j: Column, n: int) -> Column:
    """Place of the pair (i, j) in column-major order."""
    return j * n + i


def mjd(ts: Column) -> Column:
    """Modified Julian date of a timestamp (UTC session zone)."""
    return F.unix_micros(ts.cast("timestamp")) / 86400e6 + 40587


def sidereal_angle(mjd_: float) -> float:
    """The earth's rotation angle in radians."""
    return 2 * math.pi * ((0.7790572732640 + 1.00273781191135448 * (mjd_ - 51544.5)) % 1.0)


def icrs_position(x: Column, y: Column, z: Column, mjd_: Column) -> tuple[Column, Column, Column]:
    """Earth-fixed positions turned by the sidereal angle; precession and polar motion are left out."""
    angle = F.lit(2 * math.pi) * F.pmod(F.lit(0.7790572732640) + 1.00273781191135448 * (mjd_ - 51544.5), F.lit(1.0))
    c, s = F.cos(angle), F.sin(angle)
    return x * c - y * s, x * s + y * c, z
