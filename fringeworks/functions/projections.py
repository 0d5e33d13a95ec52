"""Map projections of longitude and latitude (radians) about a centre, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _terms(lon: Column, lat: Column, lon0: float, lat0: float):
    d = lon - lon0
    cos_c = math.sin(lat0) * F.sin(lat) + math.cos(lat0) * F.cos(lat) * F.cos(d)
    east = F.cos(lat) * F.sin(d)
    north = math.cos(lat0) * F.sin(lat) - math.sin(lat0) * F.cos(lat) * F.cos(d)
    return cos_c, east, north


def project(kind: str, lon: Column, lat: Column, lon0: float = 0.0, lat0: float = 0.0, parallels: tuple[float, float] = (math.radians(33), math.radians(45))) -> tuple[Column, Column]:
    """x, y on a unit sphere; null where a projection doesn't show the point."""
    kind = kind.upper()
    if kind == "LCC":
        a, b = parallels
        n = math.sin(a) if math.isclose(a, b) else math.log(math.cos(a) / math.cos(b)) / math.log(math.tan(math.pi / 4 + b / 2) / math.tan(math.pi / 4 + a / 2))
        f = math.cos(a) * math.tan(math.pi / 4 + a / 2) ** n / n
        rho = f / F.pow(F.tan(F.lit(math.pi / 4) + lat / 2), F.lit(n))
        rho0 = f / math.tan(math.pi / 4 + lat0 / 2) ** n
        return rho * F.sin(n * (lon - lon0)), F.lit(rho0) - rho * F.cos(n * (lon - lon0))
    if kind == "ROBIN":
        length = [1.0, 0.9986, 0.9954, 0.99, 0.9822, 0.973, 0.96, 0.9427, 0.9216, 0.8962, 0.8679, 0.835, 0.7986, 0.7597, 0.7186, 0.6732, 0.6213, 0.5722, 0.5322]
        height = [0.0, 0.062, 0.124, 0.186, 0.248, 0.31, 0.372, 0.434, 0.4958, 0.5571, 0.6176, 0.6769, 0.7346, 0.7903, 0.8435, 0.8936, 0.9394, 0.9761, 1.0]
        deg = F.degrees(F.abs(lat)) / 5
        i = F.least(F.floor(deg), F.lit(17)).cast("int")
        at = lambda t: (lambda arr: F.get(arr, i) + (F.get(arr, i + 1) - F.get(arr, i)) * (deg - i))(F.array(*map(F.lit, t)))
        return 0.8487 * at(length) * (lon - lon0), 1.3523 * at(height) * F.signum(lat)
    if kind == "HEALPIX":
        d, z = F.pmod(lon - lon0 + math.pi, F.lit(2 * math.pi)) - math.pi, F.sin(lat)
        pole = F.sqrt(F.greatest(3 * (1 - F.abs(z)), F.lit(0.0)))
        centre = (2 * F.least(F.floor((d + math.pi) * (2 / math.pi)), F.lit(3)) + 1) * (math.pi / 4) - math.pi
        flat = F.abs(z) <= 2 / 3
        return F.when(flat, d).otherwise(centre + (d - centre) * pole), F.when(flat, z * (3 * math.pi / 8)).otherwise(F.signum(z) * (2 - pole) * (math.pi / 4))
    cos_c, east, north = _terms(lon, lat, lon0, lat0)
    if kind == "GNOM":
        return F.when(cos_c > 0, east / cos_c), F.when(cos_c > 0, north / cos_c)
    if kind == "LAEA":
        k = F.when(cos_c > -1, F.sqrt(2 / (1 + cos_c)))
        return k * east, k * north
    if kind == "AEQD":
        c = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_c)))
        k = F.when(F.sin(c) == 0, F.lit(1.0)).otherwise(c / F.sin(c))
        return k * east, k * north
    raise ValueError(f"unknown projection {kind}")
