"""Polar, equatorial and Cartesian coordinates, as columns and in NumPy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Triple = tuple[Column, Column, Column]


def pol2eq(colat: Column) -> Column:
    return F.lit(math.pi / 2) - colat


eq2pol = pol2eq


def eq2cart(r: Column, lat: Column, lon: Column) -> Triple:
    return r * F.cos(lat) * F.cos(lon), r * F.cos(lat) * F.sin(lon), r * F.sin(lat)


def pol2cart(r: Column, colat: Column, lon: Column) -> Triple:
    """A negative radius is an error when the row is read."""
    ok = F.when(r >= 0, r).otherwise(F.raise_error(F.lit("radius must be non-negative")).cast("double"))
    return ok * F.sin(colat) * F.cos(lon), ok * F.sin(colat) * F.sin(lon), ok * F.cos(colat)


def cart2eq(x: Column, y: Column, z: Column) -> Triple:
    """Radius, latitude, longitude in [0, 2 pi)."""
    flat = F.sqrt(x * x + y * y)
    return F.sqrt(x * x + y * y + z * z), F.atan2(z, flat), F.pmod(F.atan2(y, x), F.lit(2 * math.pi))


def cart2pol(x: Column, y: Column, z: Column) -> Triple:
    r, lat, lon = cart2eq(x, y, z)
    return r, F.lit(math.pi / 2) - lat, lon


def wrap_degrees(deg: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(deg + 180.0, F.lit(360.0)) - 180.0


def unit(lat: float, lon: float) -> np.ndarray:
    return np.array([math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)])


def rot(axis, angle: float) -> np.ndarray:
    """Right-handed rotation about an axis."""
    a = np.asarray(axis, float)
    n = np.linalg.norm(a)
    if not n:
        raise ValueError("axis must not be zero")
    x, y, z = a / n
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * (k @ k)


def z_rot2angle(r: np.ndarray) -> float:
    """Angle of a rotation about z, in (-pi, pi]."""
    r = np.asarray(r, float)
    if r.shape != (3, 3) or not np.allclose(r[2], [0, 0, 1]) or not np.allclose(r @ r.T, np.eye(3)):
        raise ValueError("not a rotation about the z axis")
    return math.atan2(r[1, 0], r[0, 0])


def within_cone(x: Column, y: Column, z: Column, direction, fov: float) -> Column:
    d = np.asarray(direction, float)
    d = d / np.linalg.norm(d)
    return x * float(d[0]) + y * float(d[1]) + z * float(d[2]) >= math.cos(fov / 2)
