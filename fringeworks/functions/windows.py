"""Tukey window, spherical Dirichlet kernel and the Kent density."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .thresholds import ive_threshold


def tukey(x: Column, t: float, beta: float, alpha: float) -> Column:
    """Support t around beta; the share alpha of it is tapered."""
    if t <= 0 or not 0 <= alpha <= 1:
        raise ValueError("T must be positive and alpha in [0, 1]")
    y = x - beta + t / 2
    left, right = t * alpha / 2, t - t * alpha / 2
    body = F.when((y >= left) & (y <= right), F.lit(1.0))
    if math.isclose(alpha, 0, abs_tol=1e-8):
        return body.otherwise(F.lit(0.0))
    w = math.pi / (t * alpha)
    return body.when((y >= 0) & (y < left), F.pow(F.sin(y * w), 2)).when((y > right) & (y <= t), F.pow(F.sin((F.lit(t) - y) * w), 2)).otherwise(F.lit(0.0))


def _legendre(n: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P_n and P_{n+1}."""
    a, b = np.ones_like(x), x
    for k in range(1, n + 1):
        a, b = b, ((2 * k + 1) * x * b - k * a) / (k + 1)
    return a, b


def dirichlet(x: Column, n: int) -> Column:
    """Order-n spherical Dirichlet kernel at x in [-1, 1], by the three-term recurrence inside the plan."""
    if n < 0:
        raise ValueError("N must be non-negative")
    start = F.struct(F.lit(1.0).alias("a"), x.cast("double").alias("b"))
    if n:
        pair = F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, lambda s, k: F.struct(s["b"].alias("a"), (((2 * k + 1) * x * s["b"] - k * s["a"]) / (k + 1)).alias("b")))
    else:
        pair = start
    value = F.when(x == 1, F.lit(float(n + 1))).otherwise((pair["b"] - pair["a"]) / F.when(x == 1, F.lit(1.0)).otherwise(x - 1))
    good = F.when(x.between(-1, 1), value).otherwise(F.raise_error(F.lit("x must lie in [-1, 1]")).cast("double"))
    return good * ((n + 1) / (4 * math.pi))


def dirichlet_np(x, n: int) -> np.ndarray:
    x = np.atleast_1d(np.asarray(x, float))
    if n < 0 or (np.abs(x) > 1).any():
        raise ValueError("N must be non-negative and x in [-1, 1]")
    a, b = _legendre(n, x)
    with np.errstate(invalid="ignore", divide="ignore"):
        v = (b - a) / (x - 1)
    return np.where(x == 1, n + 1.0, v) * (n + 1) / (4 * math.pi)


class DirichletSpline:
    """Natural cubic spline of the windowed kernel near 1, zero elsewhere; for N > 10."""

    def __init__(self, n: int, samples: int = 1000):
        if n <= 10:
            raise ValueError("the approximation needs N > 10")
        top = math.pi
        while np.abs(np.sign(np.diff(np.sign(dirichlet_np(np.cos(np.linspace(0, top, samples)), n))))).sum() > 10:
            top /= 2
        edge, near = math.cos(min(2 * top, math.pi)), math.cos(top)
        self.x = np.concatenate([np.linspace(edge, near, samples, endpoint=False), np.linspace(near, 1, samples)])
        t = 2 - 2 * edge
        y = self.x - 1 + t / 2
        w = np.where(y < t / 4, np.sin(2 * math.pi / t * y) ** 2, 1.0)
        self.y = dirichlet_np(self.x, n) * w
        h = np.diff(self.x)
        m = len(self.x)
        rhs = np.zeros(m)
        rhs[1:-1] = 6 * (np.diff(self.y[1:]) / h[1:] - np.diff(self.y[:-1]) / h[:-1])
        diag, up = np.ones(m), np.zeros(m)
        diag[1:-1] = 2 * (h[:-1] + h[1:])
        low = np.zeros(m)
        low[1:-1], up[1:-1] = h[:-1], h[1:]
        for i in range(1, m):  # tridiagonal elimination
            f = low[i] / diag[i - 1]
            diag[i] -= f * up[i - 1]
            rhs[i] -= f * rhs[i - 1]
        self.m2 = np.zeros(m)
        for i in range(m - 1, -1, -1):
            self.m2[i] = (rhs[i] - up[i] * (self.m2[i + 1] if i + 1 < m else 0)) / diag[i]

    def __call__(self, v) -> np.ndarray:
        v = np.atleast_1d(np.asarray(v, float))
        i = np.clip(np.searchsorted(self.x, v, side="right") - 1, 0, len(self.x) - 2)
        h = self.x[i + 1] - self.x[i]
        a, b = (self.x[i + 1] - v) / h, (v - self.x[i]) / h
        s = a * self.y[i] + b * self.y[i + 1] + ((a**3 - a) * self.m2[i] + (b**3 - b) * self.m2[i + 1]) * h * h / 6
        return np.where((v >= self.x[0]) & (v <= 1), s, 0.0)


class Kent:
    """FB5 density with mean direction g1, major axis towards a, scale k and ellipticity beta."""

    def __init__(self, k: float, beta: float, g1, a):
        if k <= 0 or not 0 <= beta < 1:
            raise ValueError("k must be positive and beta in [0, 1)")
        self.k, self.beta = float(k), float(beta)
        self.g1 = np.asarray(g1, float) / np.linalg.norm(g1)
        a = np.asarray(a, float) / np.linalg.norm(a)
        if np.allclose(self.g1, a):
            raise ValueError("g1 and a must not be colinear")
        g2 = a - (a @ self.g1) * self.g1
        self.g2 = g2 / np.linalg.norm(g2)
        self.g3 = np.cross(self.g1, self.g2)
        terms = int((ive_threshold(k) - 0.5) // 2 + 2)
        half = _half_orders(k, 2 * terms + 2)
        j = np.arange(terms)
        beta_fn = np.array([math.exp(math.lgamma(i + 0.5) + math.lgamma(0.5) - math.lgamma(i + 1)) for i in j])
        self.norm = math.sqrt(8 * math.pi / k) * float(np.sum(beta_fn * self.beta ** (2 * j) * half[2 * j]))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.atleast_2d(np.asarray(x, float))
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        e = x @ self.g1 - 1 + 0.5 * self.beta * ((x @ self.g2) ** 2 - (x @ self.g3) ** 2)
        return np.exp(self.k * e) / self.norm

    def column(self, x: Column, y: Column, z: Column) -> Column:
        """The density of unit vectors as an expression."""
        dot = lambda g: x * float(g[0]) + y * float(g[1]) + z * float(g[2])
        return F.exp(self.k * (dot(self.g1) - 1 + 0.5 * self.beta * (F.pow(dot(self.g2), 2) - F.pow(dot(self.g3), 2)))) / self.norm

    @staticmethod
    def angular_support(k: float, beta: float, eps: float = 1e-2) -> float:
        """First angle at which the density along the major axis falls to eps of its peak; pi if never."""
        if k <= 0 or not 0 <= beta < 1 or not 0 < eps < 1:
            raise ValueError("k must be positive, beta in [0, 1) and eps in (0, 1)")
        theta = np.linspace(0, math.pi, 100_000)
        low = np.flatnonzero(np.cos(theta) + 0.5 * beta * np.sin(theta) ** 2 <= 1 + math.log(eps) / k)
        return float(theta[low[0]]) if len(low) else math.pi

    @staticmethod
    def min_scale(alpha: float, beta: float, eps: float = 1e-2) -> float:
        if not 0 < alpha <= math.pi or not 0 <= beta < 1 or not 0 < eps < 1:
            raise ValueError("alpha must be in (0, pi], beta in [0, 1) and eps in (0, 1)")
        d = math.cos(alpha) + 0.5 * beta * math.sin(alpha) ** 2 - 1
        return math.inf if math.isclose(d, 0, abs_tol=1e-8) else abs(math.log(eps) / d)


def _half_orders(x: float, n: int) -> np.ndarray:
    """exp(-x) I_{m + 1/2}(x) for m = 0 .. n - 1, by downward recurrence from well above."""
    top = n + 40 + int(2 * math.sqrt(x) * 8)
    f = np.zeros(top + 2)
    f[top] = 1e-300
    for m in range(top, 0, -1):
        f[m - 1] = (2 * m + 1) / x * f[m] + f[m + 1]
        if f[m - 1] > 1e250:
            f *= 1e-250
    first = math.sqrt(2 / (math.pi * x)) * (1 - math.exp(-2 * x)) / 2
    return (f * (first / f[0]))[:n]
