"""Spatial partitions of points: cells, offsets and permutations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Partition:
    kind: str = "auto"
    dims: tuple[int, int, int] = (1, 1, 1)

    @classmethod
    def auto(cls) -> Partition:
        return cls()

    @classmethod
    def none(cls) -> Partition:
        return cls("none")

    @classmethod
    def grid(cls, dims) -> Partition:
        d = tuple(int(x) for x in dims)
        if len(d) != 3 or min(d) < 1:
            raise ValueError("three positive grid sizes")
        return cls("grid", d)


def extents(points: DataFrame, cols=("x", "y", "z")):
    r = points.agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    return [(r[f"lo{i}"] or 0.0, r[f"hi{i}"] or 0.0) for i in range(3)]


def cell(cols: tuple[str, str, str], bounds, dims: tuple[int, int, int]) -> Column:
    """(cz gy + cy) gx + cx; an axis without extent has one cell."""
    gx, gy, gz = dims

    def one(c: str, b: tuple[float, float], g: int) -> Column:
        lo, hi = b
        if hi <= lo or g <= 1:
            return F.lit(0).cast("bigint")
        return F.least((F.lit(float(g)) * (F.col(c) - lo) / (hi - lo)).cast("bigint"), F.lit(g - 1))

    cx, cy, cz = (one(c, b, g) for c, b, g in zip(cols, bounds, dims, strict=True))
    return ((cz * gy + cy) * gx + cx).cast("bigint")


def grid_cells(points: DataFrame, dims, cols=("x", "y", "z")) -> DataFrame:
    """Points with their ``cell``: two passes, no shuffle."""
    if dims[0] * dims[1] * dims[2] <= 1:
        return points.withColumn("cell", F.lit(0).cast("bigint"))
    return points.withColumn("cell", cell(cols, extents(points, cols), dims))


def offsets(cells: DataFrame) -> DataFrame:
    """``cell, size, begin``; as many rows as cells."""
    c = cells.groupBy("cell").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    return c.withColumn("begin", F.coalesce(before, F.lit(0)).cast("bigint"))


def largest(cells: DataFrame) -> int:
    """Points of the fullest cell."""
    return offsets(cells).agg(F.max("size")).first()[0] or 0


def sample_blocks(samples: DataFrame, parts: int, key: str = "sample_id") -> DataFrame:
    """Samples with ``part``: contiguous blocks of ceil(n / parts) in key order, the last ones shorter or empty."""
    if parts < 1:
        raise ValueError("at least one part")
    size = max(1, -(-samples.count() // parts))
    order = samples.select(key).distinct().orderBy(key)
    rank = F.row_number().over(Window.orderBy(key)) - 1  # keys alone: one number per sample
    return samples.join(order.select(key, F.floor(rank / size).cast("int").alias("part")), key)


def permutation(cells: DataFrame, *order: str) -> DataFrame:
    """Points with ``target``: their place when cells follow each other; ranked within cells only."""
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(*order))
    return cells.withColumn("_r", rank).join(F.broadcast(offsets(cells).select("cell", "begin")), "cell").withColumn("target", F.col("begin") + F.col("_r") - 1).drop("_r", "begin")  # one row per cell


def apply_permutation(values: DataFrame, perm: DataFrame, key: str = "i") -> DataFrame:
    """Values at their targets (scatter)."""
    return values.join(perm.select(key, "target"), key).drop(key).withColumnRenamed("target", key)


def reverse_permutation(values: DataFrame, perm: DataFrame, key: str = "i") -> DataFrame:
    """Back from targets (gather)."""
    p = perm.select(F.col("target").alias(key), F.col(key).alias("_to"))
    return values.join(p, key).drop(key).withColumnRenamed("_to", key)


def auto_dims(uvw_extent, pixel_extent, limit_bytes: float, bytes_per_cell: int = 16, oversample: float = 2.0, most: int = 4096) -> tuple[int, int, int]:
    """Grow the axis with the largest uvw x pixel extent until a cell's transform grid fits; ties prefer y, z, x."""
    dims = [1, 1, 1]

    def memory() -> float:
        n = bytes_per_cell
        for u, p, g in zip(uvw_extent, pixel_extent, dims, strict=True):
            n *= max(1.0, oversample * (u / g) * p / 3.141592653589793) + 10
        return n

    while memory() > limit_bytes and max(dims) < most:
        load = [u / g * p for u, p, g in zip(uvw_extent, pixel_extent, dims, strict=True)]
        dims[max((1, 2, 0), key=lambda k: load[k])] += 1
    return tuple(dims)
