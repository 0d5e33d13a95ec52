"""Zonal interpolation on the sphere with the Dirichlet kernel."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import dirichlet


def interpolate(support: DataFrame, target: DataFrame, n: int, mask: DataFrame | None = None) -> DataFrame:
    """``r_id, value``: sum of weight f K_n(<support, target>); a mask (s_id, r_id) limits the pairs."""
    s = support.select("s_id", "weight", "f", *(F.col(c).alias(f"s{c}") for c in "xyz"))
    pairs = target.crossJoin(s) if mask is None else target.join(mask, "r_id").join(s, "s_id")
    dot = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("x") * F.col("sx") + F.col("y") * F.col("sy") + F.col("z") * F.col("sz")))
    return pairs.groupBy("r_id").agg(F.sum(F.col("weight") * F.col("f") * dirichlet(dot, n)).alias("value"))


def equal_angle_weights(grid: DataFrame, n: int) -> DataFrame:
    """Quadrature weights of an equal-angle grid's rows: ``q, l, colat, lon, weight``."""
    odd = F.aggregate(F.sequence(F.lit(0), F.lit(n)), F.lit(0.0), lambda a, k: a + F.sin((2 * k + 1) * F.col("colat")) / (2 * k + 1))
    return grid.withColumn("weight", odd * F.sin("colat") * (2 * math.pi / (n + 1) ** 2))


def sparsity_mask(support: DataFrame, target: DataFrame, n: int, lobes: float = 1.0) -> DataFrame:
    """Pairs near enough for the kernel's first lobes: angle at most lobes x pi / n."""
    s = support.select("s_id", *(F.col(c).alias(f"s{c}") for c in "xyz"))
    near = F.col("x") * F.col("sx") + F.col("y") * F.col("sy") + F.col("z") * F.col("sz") >= math.cos(min(math.pi, lobes * math.pi / max(n, 1)))
    return target.crossJoin(s).where(near).select("s_id", "r_id")


def layer_sum(images: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """Sum of the chosen images, per pixel; an unknown tag is an error."""
    if tags is not None:
        known = {r.tag for r in images.select("tag").distinct().collect()}
        if set(tags) - known:
            raise KeyError(sorted(set(tags) - known))
        images = images.where(F.col("tag").isin(list(tags)))
    return images.groupBy("pixel_id").agg(F.sum("value").alias("value"))
