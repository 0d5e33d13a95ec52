"""From eigenvalues to levels, masks and selections."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import array_filter, check_name, masked_filter
from ..schema import check_tag

FLOAT_MAX = 3.4028234663852886e38


def eigenvalues(samples: DataFrame) -> DataFrame:
    return samples.select("sample_id", F.posexplode("d").alias("eig_idx", "d"))


def in_range(values: DataFrame, d_min: float = 0.0, d_max: float = FLOAT_MAX) -> DataFrame:
    return values.where((F.col("d") != 0) & F.col("d").between(d_min, d_max))


def trimmed(values: DataFrame, sigma: float, most: int = 1_000_000) -> DataFrame:
    """Without the top int((1 - sigma) n) values, ties broken by (sample, place); nothing goes if that is 0.

    The cut value comes from counts per value range, so no task sorts all values: bounded histograms
    narrow the range that holds the cut down to ``most`` values, or to equal ones, and only those are ranked.
    """
    if not 0 <= sigma < 1:
        return values
    n, lo, hi = values.agg(F.count("*"), F.min("d"), F.max("d")).first()
    keep = n - int((1 - sigma) * n) if n else 0
    if keep == n:
        return values
    d, below = F.col("d"), 0
    inside = F.lit(True)  # the values among which the cut lies; ``below`` are less than all of them
    while n > most and lo < hi:
        b = F.least(F.floor((d - lo) / ((hi - lo) / 4096)), F.lit(4095)).cast("int").alias("b")
        rows = values.where(inside).groupBy(b).agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).orderBy("b").collect()  # at most 4096 rows
        for r in rows:
            if below + r.n >= keep:
                break
            below += r.n
        n, lo, hi = r.n, r.lo, r.hi
        inside = d.between(lo, hi)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("d", "sample_id", "eig_idx"))  # at most ``most`` values, or equal ones
    last = values.where(inside).withColumn("_r", rank).where(F.col("_r") <= keep - below).drop("_r")
    return values.where(d < lo).unionByName(last)


def quantiles(values: DataFrame, column: str, shares: list[float], most: int = 1_000_000) -> list[float]:
    """Exact quantiles, interpolated between neighbours; [] without values.

    Histograms of 4096 ranges narrow each wanted rank's range down to ``most`` values, or to equal ones, and
    only those are ranked: no task sees all values.
    """
    v = values.select(F.col(column).cast("double").alias("x")).where("x is not null")
    n, lo, hi = v.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return []
    places = [(n - 1) * q for q in shares]
    ranges = {(lo, hi): (n, 0)}  # its values, and those below it
    at = dict.fromkeys(sorted({f(p) for p in places for f in (math.floor, math.ceil)}), (lo, hi))
    while wide := sorted({r for r in at.values() if ranges[r][0] > most and r[0] < r[1]}):
        for a, z in wide:
            b = F.least(F.floor((F.col("x") - a) / ((z - a) / 4096)), F.lit(4095)).cast("int").alias("b")
            rows = v.where(F.col("x").between(a, z)).groupBy(b).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("b").collect()  # at most 4096 rows
            below = ranges[a, z][1]
            for r in rows:
                ranges[r.lo, r.hi] = (r.n, below)
                at.update({k: (r.lo, r.hi) for k, old in at.items() if old == (a, z) and below <= k < below + r.n})
                below += r.n
    found: dict[int, float] = {}
    for a, z in sorted(set(at.values())):
        mine = [k for k, r in at.items() if r == (a, z)]
        below = ranges[a, z][1]
        rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("x")) - 1 + below
        found |= {k: a for k in mine} if a == z else {r.k: r.x for r in v.where(F.col("x").between(a, z)).select("x", rank.alias("k")).where(F.col("k").isin(mine)).collect()}
    return [found[math.floor(p)] + (found[math.ceil(p)] - found[math.floor(p)]) * (p - math.floor(p)) for p in places]


def kmeans_1d(values: DataFrame, k: int, log: bool = False, rounds: int = 100, fixed: bool = False) -> list[float]:
    """Lloyd's rounds from quantile seeds; deterministic, and each round moves k sums only."""
    if k < 1:
        raise ValueError("at least one level")
    v = values.select((F.log("d") if log else F.col("d").cast("double")).alias("x")).persist()  # read by every round
    try:
        cent = quantiles(v, "x", [(i + 0.5) / k for i in range(k)])
        for _ in range(rounds if cent else 0):
            dist = F.array(*(F.abs(F.col("x") - c) for c in cent))
            got = {r.c: r.m for r in v.groupBy((F.array_position(dist, F.array_min(dist)) - 1).alias("c")).agg(F.avg("x").alias("m")).collect()}
            new = [got.get(i, cent[i]) for i in range(k)]
            if not fixed and new == cent:
                break
            cent = new
    finally:
        v.unpersist()
    return sorted((math.exp(c) if log else c for c in cent), reverse=True)


def centroid_intervals(centroids: DataFrame, d_min: float = 0.0, d_max: float = FLOAT_MAX) -> DataFrame:
    """``level, lo, hi`` by falling centroid (column ``c``): cuts half-way between neighbours."""
    w = Window.orderBy(F.col("c").desc())
    up, down = F.lag("c").over(w), F.lead("c").over(w)
    return centroids.select("c").select(
        (F.row_number().over(w) - 1).cast("int").alias("level"),
        F.when(down.isNull(), F.lit(float(d_min))).otherwise((F.col("c") + down) / 2).alias("lo"),
        F.when(up.isNull(), F.lit(float(d_max))).otherwise((F.col("c") + up) / 2).alias("hi"),
    )  # one row per level


def infer_intervals(values: DataFrame, levels: int, sigma: float, cluster: str, d_min: float, d_max: float) -> list[tuple[float, float]]:
    if cluster not in ("none", "log"):
        raise ValueError(f"unknown cluster function {cluster!r}")
    if cluster == "log" and d_min < 0:
        raise ValueError("log clustering needs a non-negative minimum")
    cent = kmeans_1d(trimmed(in_range(values, d_min, d_max), sigma), levels, cluster == "log")
    if len(cent) <= 1:
        return [(d_min, d_max)]
    mid = [(a + b) / 2 for a, b in zip(cent, cent[1:], strict=False)]
    return list(zip([*mid, d_min], [d_max, *mid], strict=True))


@dataclass(frozen=True)
class Spec:
    """filter, levels, sigma, cluster function, min, max"""

    filter: str
    levels: int
    sigma: float
    cluster: str
    d_min: float
    d_max: float

    @classmethod
    def parse(cls, text: str) -> Spec:
        p = [x.strip() for x in text.split(",")]
        if len(p) != 6:
            raise ValueError(f"six comma-separated fields expected: {text!r}")
        return cls(check_name(p[0]), int(p[1]), float(p[2]), p[3].lower(), float(p[4]), float(p[5]))


def level_tag(index: int, name: str, lo: float, hi: float) -> str:
    return check_tag(f"s{index}_{name}_[{lo:.4E},{hi:.4E})".replace(".", "_"))


def select(samples: DataFrame, specs: list[Spec], sample_range: tuple[int, int, int] = (0, -1, 1)) -> DataFrame:
    """``tag, sample_id, d`` of every level of every spec; sample ids stay what they are."""
    from .visibility import in_slice

    s = samples.select("sample_id", "d").where(in_slice(F.col("sample_id"), *sample_range))
    return levels(s, [(spec.filter, infer_intervals(eigenvalues(s), spec.levels, spec.sigma, spec.cluster, spec.d_min, spec.d_max)) for spec in specs])


def levels(samples: DataFrame, intervals: list[tuple[str, list[tuple[float, float]]]]) -> DataFrame:
    """``tag, sample_id, d`` of every interval of every filter; one pass over the samples for all tags."""
    parts = [F.struct(F.lit(level_tag(i, name, lo, hi)).alias("tag"), array_filter(name, F.col("d"), lo, hi).alias("d")) for i, (name, cuts) in enumerate(intervals) for lo, hi in cuts]
    return samples.select("sample_id", F.explode(F.array(*parts)).alias("p")).select("p.tag", "sample_id", "p.d")


def masked(values: DataFrame, name: str, lo: float, hi: float, right_open: bool = False) -> DataFrame:
    return values.withColumn("d", masked_filter(name, F.col("d"), lo, hi, right_open))


def energy(values: DataFrame) -> DataFrame:
    """Share of the sum reached by each sample's eigenvalues in falling order."""
    w = Window.partitionBy("sample_id").orderBy(F.desc("d"), "eig_idx")
    return values.withColumn("rank", F.row_number().over(w)).withColumn("ratio", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("d").over(Window.partitionBy("sample_id")))
