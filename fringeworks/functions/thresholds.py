"""Orders past which Bessel functions or their series are negligible.

Computed by stable downward recurrences on the usual support points (1, 2, ...,
1000, then every 500) and scaled in between as a step ratio.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bessel(x: float, kind: str) -> np.ndarray:
    """Orders 0, 1, ... of J_n ("j"), spherical j_n ("sph") or exp(-x) I_n ("i") at x > 0."""
    n = int(x + 60 + 10 * x ** (1 / 3))
    if kind == "i":
        n = min(n, int(60 + 12 * math.sqrt(x) + x / 20))
    f = np.zeros(n + 2)
    f[n] = 1e-300
    for k in range(n, 0, -1):
        f[k - 1] = ((2 * k + 1) if kind == "sph" else 2 * k) / x * f[k] + (f[k + 1] if kind == "i" else -f[k + 1])
        if abs(f[k - 1]) > 1e250:
            f *= 1e-250
    if kind == "sph":
        s0, s1 = math.sin(x) / x, math.sin(x) / x**2 - math.cos(x) / x
        return f * (s0 / f[0] if abs(s0) >= abs(s1) else s1 / f[1])
    return f / (f[0] + 2 * (f[2::2].sum() if kind == "j" else f[1:].sum()))


def _last_above(values: np.ndarray, eps: float) -> int:
    above = np.flatnonzero(np.abs(values) >= eps)
    return int(above[-1]) + 1 if len(above) else 0


def _support(x: float) -> float:
    return float(math.floor(x)) if x < 1500 and x <= 1000 else float(min(max(1000, math.floor(x / 500) * 500), 399500))


@lru_cache(maxsize=4096)
def _order(kind: str, x: float) -> int:
    return _last_above(bessel(x, kind), 1e-10 if kind == "i" else 1e-5)


def _scaled(x: float, at: float, n: int) -> int:
    return int(math.ceil(n / at * x))


def _threshold(kind: str, x: float) -> int:
    x = abs(x)
    if x < 1:
        return _order(kind, 1.0)
    at = _support(x)
    return _scaled(x, at, _order(kind, at))


def jv_threshold(x: float) -> int:
    return _threshold("j", x)


def spherical_jn_threshold(x: float) -> int:
    return _threshold("sph", x)


def ive_threshold(x: float) -> int:
    return _threshold("i", x)


@lru_cache(maxsize=4096)
def _series(kind: str, x: float, eps: float) -> int:
    f = bessel(x, kind) ** 2
    if kind == "sph":  # terms q < n
        total = np.cumsum((2 * np.arange(len(f)) + 1) * f)
        n = int(0.95 * x)
        while True:
            n += 1
            if 1 - total[n - 1] < eps:
                return n
    total = f[0] + 2 * np.cumsum(np.concatenate([[0], f[1:]]))
    return int(np.flatnonzero(1 - total < eps)[0])


def _coarse(x: float) -> float:
    return max(v for v in (1000.0, 2000.0, 5000.0, 10000.0) if v <= max(x, 1000.0))


def spherical_jn_series_threshold(x: float, table_lookup: bool = True, epsilon: float = 1e-2) -> int:
    if not 0 < epsilon < 1:
        raise ValueError("epsilon must lie in (0, 1)")
    if not table_lookup:
        return _series("sph", x, epsilon)
    x = abs(x)
    if x < 1:
        return _series("sph", 1.0, 1e-2)
    at = float(math.floor(x)) if x <= 1000 else _coarse(x)
    return _scaled(x, at, _series("sph", at, 1e-2))


def jv_series_threshold(x: float) -> int:
    x = abs(x)
    if x < 1:
        return _series("j", 1.0, 1e-2)
    at = float(math.floor((x - 1) / 50) * 50 + 1) if x < 1000 else _coarse(x)
    return _scaled(x, at, _series("j", at, 1e-2))


def lookup(values: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """As-of lookup: the ratio of the last support point at or below each value (the first below all).

    ``table`` (x, n_threshold) is a support table of a fixed, small number of rows; it becomes one
    sorted array, so values aren't shuffled.
    """
    rows = table.select("x", "n_threshold").orderBy("x").collect()
    xs, ns = [float(r.x) for r in rows], [int(r.n_threshold) for r in rows]
    pairs = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(n).alias("n")) for x, n in zip(xs, ns, strict=True)))
    v = F.abs(F.col(column))
    last = F.element_at(F.filter(pairs, lambda p: p["x"] <= v), -1)
    n: Column = F.when(v < xs[0], F.lit(ns[0])).otherwise(F.ceil(last["n"] / last["x"] * v).cast("int"))
    return values.withColumn("n_threshold", n)
