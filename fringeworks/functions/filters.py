"""The five eigenvalue filters and the interval mask, as columns.

The mask is closed at both ends and turns values outside to 0 without removing
them; zeros stay zeros in every filter.  ``right_open`` makes levels disjoint.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

FILTERS = ("lsq", "std", "sqrt", "inv", "inv_sqrt")


def check_name(name: str) -> str:
    key = name.lower()
    if key not in FILTERS:
        raise ValueError(f"unknown filter {name!r}; one of {', '.join(FILTERS)}")
    return key


def apply_filter(name: str, d: Column) -> Column:
    name = check_name(name)
    zero = F.lit(0.0)
    if name == "lsq":
        return d
    if name == "std":
        return F.signum(d)
    root = F.signum(d) * F.sqrt(F.abs(d))
    if name == "sqrt":
        return root
    return F.when(d == 0, zero).otherwise(1 / d if name == "inv" else 1 / root)


def mask(d: Column, lower: float, upper: float, right_open: bool = False) -> Column:
    inside = (d >= lower) & ((d < upper) if right_open else (d <= upper))
    return F.when(inside, d).otherwise(F.lit(0.0))


def masked_filter(name: str, d: Column, lower: float, upper: float, right_open: bool = False) -> Column:
    """Mask first, so the filter sees zeros."""
    return apply_filter(name, mask(d, lower, upper, right_open))


def array_filter(name: str, values: Column, lower: float, upper: float) -> Column:
    """The same over an array column, without exploding it."""
    return F.transform(values, lambda x: masked_filter(name, x, lower, upper))


def register(spark: SparkSession) -> None:
    """SQL functions ``ev_<filter>(d)``; temporary SQL functions, so they inline into the plan."""
    bodies = {"lsq": "d", "std": "signum(d)", "sqrt": "signum(d) * sqrt(abs(d))", "inv": "if(d = 0, 0D, try_divide(1D, d))", "inv_sqrt": "if(d = 0, 0D, try_divide(1D, signum(d) * sqrt(abs(d))))"}
    for k, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ev_{k}(d DOUBLE) RETURNS DOUBLE RETURN {body}")
