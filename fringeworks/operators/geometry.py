"""Baselines, distances, centroids and beam weights."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import complexes as Z
from ..functions.frame import baseline_index, to_uvw
from ..functions.thresholds import jv_series_threshold, spherical_jn_series_threshold


def ordinals(df: DataFrame, *keys: str, name: str = "ordinal") -> DataFrame:
    """0-based dense places in key order; instruments have thousands of rows at most."""
    return df.withColumn(name, (F.dense_rank().over(Window.orderBy(*keys)) - 1).cast("bigint"))


def centred(antennas: DataFrame) -> DataFrame:
    """Positions about the array's centroid: the one-row mean goes to the rows, not the other way round."""
    mean = antennas.agg(*(F.avg(c).alias(f"_{c}") for c in "xyz"))
    return antennas.crossJoin(F.broadcast(mean)).select(*(c for c in antennas.columns if c not in "xyz"), *((F.col(c) - F.col(f"_{c}")).alias(c) for c in "xyz"))


def baselines(antennas: DataFrame, n: int, basis=None) -> DataFrame:
    """All ordered pairs: ``k, i, j`` and x_i - x_j; as u, v, w if a basis is given.  Needs ``ordinal``."""
    a = antennas.select(F.col("ordinal").alias("i"), *(F.col(c).alias(f"{c}i") for c in "xyz"))
    b = antennas.select(F.col("ordinal").alias("j"), *(F.col(c).alias(f"{c}j") for c in "xyz"))
    d = a.crossJoin(b).select("i", "j", *((F.col(f"{c}i") - F.col(f"{c}j")).alias(c) for c in "xyz"))
    out = d if basis is None else d.select("i", "j", *(e.alias(c) for e, c in zip(to_uvw(F.col("x"), F.col("y"), F.col("z"), basis), "uvw", strict=True)))
    return out.select(baseline_index(F.col("i"), F.col("j"), n).alias("k"), *out.columns)


def distances(antennas: DataFrame) -> DataFrame:
    """``i, j, dist`` for i < j; the other half is its mirror."""
    a = antennas.select(F.col("ordinal").alias("i"), *(F.col(c).alias(f"{c}i") for c in "xyz"))
    b = antennas.select(F.col("ordinal").alias("j"), *(F.col(c).alias(f"{c}j") for c in "xyz"))
    d2 = sum((F.col(f"{c}i") - F.col(f"{c}j")) * (F.col(f"{c}i") - F.col(f"{c}j")) for c in "xyz")
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", F.sqrt(d2).alias("dist"))


def nyquist_rate(antennas: DataFrame, wl: float) -> int:
    top = distances(antennas).agg(F.max("dist")).first()[0] or 0.0
    return spherical_jn_series_threshold(2 * math.pi / wl * top)


def kernel_bandwidth(antennas: DataFrame, wl: float, rotation) -> int:
    """2 N + 1 for positions turned into the plane of rotation."""
    m = [[float(v) for v in r] for r in rotation]
    flat = antennas.select("ordinal", *(sum(F.col(c) * m[k][i] for i, c in enumerate("xyz")).alias(c) for k, c in enumerate("xy")), F.lit(0.0).alias("z"))
    top = distances(flat).agg(F.max("dist")).first()[0] or 0.0
    return 2 * jv_series_threshold(2 * math.pi / wl * top) + 1


def rotation_plane(positions):
    """Rotation that puts z along the normal of the plane antennas turn in; (A, T, 3) positions over time."""
    import numpy as np

    abc = np.array([np.linalg.lstsq(np.c_[p[:, :2], np.ones(len(p))], p[:, 2], rcond=None)[0] for p in positions])
    a, b, _ = abc.mean(0)
    z, y = np.array([a, b, -1.0]), np.array([b, -a, 0.0])
    if np.hypot(a, b) < 1e-12:  # the plane is level: any direction in it will do
        z, y = np.array([0.0, 0.0, -1.0]), np.array([0.0, 1.0, 0.0])
    r = np.stack([np.cross(z, y), y, z])
    return r / np.linalg.norm(r, axis=1, keepdims=True)


def beam_weights(antennas: DataFrame, config: DataFrame, wl: float) -> DataFrame:
    """``station_id, antenna_id, beam_id, re, im``: exp(-i 2 pi <x / wl, focus>) for a station's own beams."""
    phase = (2 * math.pi / wl) * (F.col("x") * F.col("fx") + F.col("y") * F.col("fy") + F.col("z") * F.col("fz"))
    c = config.select("station_id", "beam_id", *(F.col(k).alias(f"f{k}") for k in "xyz"))
    re, im = Z.conj(Z.expi(phase))
    return centred(antennas).join(c, "station_id").select("station_id", "antenna_id", "beam_id", re.alias("re"), im.alias("im"))


def dense_weights(weights: DataFrame) -> DataFrame:
    """``row, col, re, im`` with dense ordinals of (station, antenna) and beam; absent entries are 0."""
    rows = ordinals(weights.select("station_id", "antenna_id").distinct(), "station_id", "antenna_id", name="row")
    cols = ordinals(weights.select("beam_id").distinct(), "beam_id", name="col")
    full = rows.crossJoin(cols).join(weights, ["station_id", "antenna_id", "beam_id"], "left")
    return full.select("row", "col", F.coalesce("re", F.lit(0.0)).alias("re"), F.coalesce("im", F.lit(0.0)).alias("im"))


def sorted_weights(weights: DataFrame) -> DataFrame:
    """By station, antenna and beam."""
    return weights.orderBy("station_id", "antenna_id", "beam_id")


def steering(directions: DataFrame, antennas: DataFrame, wl: float) -> DataFrame:
    """``src_id, ordinal, re, im``: exp(-i 2 pi / wl <direction, antenna>)."""
    if wl <= 0:
        raise ValueError("wavelength must be positive")
    a = antennas.select("ordinal", *(F.col(c).alias(f"a{c}") for c in "xyz"))
    re, im = Z.conj(Z.expi((2 * math.pi / wl) * sum(F.col(c) * F.col(f"a{c}") for c in "xyz")))
    return directions.crossJoin(a).select("src_id", "ordinal", re.alias("re"), im.alias("im"))


def same_index(a: DataFrame, b: DataFrame, *keys: str) -> bool:
    """Equal sets of index rows."""
    x, y = a.select(*keys), b.select(*keys)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def gram(antennas: DataFrame, weights: DataFrame, wl: float) -> DataFrame:
    """``beam_i, beam_j, re, im`` of W^H sinc W as joins and sums; ``weights``: ordinal, beam_id, re, im."""
    d = distances(antennas)
    s = F.sin(2 * math.pi / wl * F.col("dist")) / (2 * math.pi / wl * F.col("dist"))
    half = d.select("i", "j", F.when(F.col("dist") == 0, 1.0).otherwise(s).alias("s"))
    b = half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "s")).unionByName(antennas.select(F.col("ordinal").alias("i"), F.col("ordinal").alias("j"), F.lit(1.0).alias("s")))
    left = weights.select(F.col("ordinal").alias("i"), F.col("beam_id").alias("beam_i"), F.col("re").alias("ar"), F.col("im").alias("ai"))
    right = weights.select(F.col("ordinal").alias("j"), F.col("beam_id").alias("beam_j"), F.col("re").alias("br"), F.col("im").alias("bi"))
    half = b.join(right, "j").groupBy("i", "beam_j").agg(F.sum(F.col("s") * F.col("br")).alias("br"), F.sum(F.col("s") * F.col("bi")).alias("bi"))
    re, im = Z.mul(Z.conj((F.col("ar"), F.col("ai"))), (F.col("br"), F.col("bi")))
    return left.join(half, "i").groupBy("beam_i", "beam_j").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


def source_phases(sources: DataFrame, antennas: DataFrame, wl: float) -> DataFrame:
    """``src_id, ordinal, re, im``: exp(i 2 pi / wl <source, antenna>)."""
    a = antennas.select("ordinal", *(F.col(c).alias(f"a{c}") for c in "xyz"))
    re, im = Z.expi((2 * math.pi / wl) * sum(F.col(c) * F.col(f"a{c}") for c in "xyz"))
    return sources.crossJoin(a).select("src_id", "ordinal", "intensity", re.alias("re"), im.alias("im"))


def expected_visibility(sources: DataFrame, antennas: DataFrame, wl: float) -> DataFrame:
    """Noiseless covariance ``i, j, re, im`` of antennas under point sources."""
    p = source_phases(sources, antennas, wl)
    q = p.select("src_id", F.col("ordinal").alias("j"), F.col("re").alias("br"), F.col("im").alias("bi"))
    re, im = Z.mul(Z.conj((F.col("re"), F.col("im"))), (F.col("br"), F.col("bi")))
    return p.join(q, "src_id").groupBy(F.col("ordinal").alias("i"), "j").agg(F.sum(F.col("intensity") * re).alias("re"), F.sum(F.col("intensity") * im).alias("im"))


def top_sources(sources: DataFrame, n: int, direction=None, fov: float | None = None) -> DataFrame:
    """The n brightest within a cone, in ascending order of intensity; fewer are an error."""
    from ..functions.sphere import within_cone

    s = sources if direction is None else sources.where(within_cone(F.col("x"), F.col("y"), F.col("z"), direction, fov))
    top = s.orderBy(F.desc("intensity"), "src_id").limit(n)
    if top.count() < n:
        raise ValueError(f"fewer than {n} sources")
    return top.orderBy("intensity", F.desc("src_id"))
