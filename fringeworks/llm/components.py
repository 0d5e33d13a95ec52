"""Connected components by alternating large-star and small-star rounds on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return r[0], r[1]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: hang each vertex's larger (or smaller) neighbours below its least neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """``u, v`` with u > v for every vertex but the least of its component, v being that least one.

    ``edges`` has bigint columns ``u, v`` without nulls; direction, repetition and loops don't
    matter.  The rounds end when one changes nothing (their number grows with the logarithm of
    the largest component); hubs are spread by adaptive skew joins.
    """
    now = ws.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _mark(now)
    while True:
        nxt = ws.write(_star(_star(now, True), False), "edges")
        mark = _mark(nxt)
        ws.drop(now)
        now = nxt
        if mark == seen:
            return now
        seen = mark
