"""From main-table rows to weighted visibilities, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.observations import time_table


def in_slice(i: Column, start: int = 0, stop: int = -1, step: int = 1) -> Column:
    """start, stop (exclusive; -1 is open), step."""
    if stop < -1 or start < 0 or step < 1:
        raise ValueError("start must be non-negative, stop at least -1, step positive")
    ok = (i >= start) & ((i - start) % step == 0)
    return ok if stop == -1 else ok & (i < stop)


def reduce_polarisations(main: DataFrame, column: str = "data", channels: tuple[int, int] | None = None) -> DataFrame:
    """``time, channel_id, beam_i, beam_j, re, im, weight`` from the first and last of four polarisations.

    The mean of both; a flag on either makes it 0; the lesser weight counts (null without weights).
    The row of antennas (1, 2) goes to the lower triangle: beam_i = antenna2, beam_j = antenna1.
    """
    for c in (f"{column}_re", f"{column}_im"):
        if c not in main.columns:
            raise ValueError(f"no column {c}")
    has_weight = "weight_spectrum" in main.columns
    cols = [f"{column}_re", f"{column}_im", "flag"] + (["weight_spectrum"] if has_weight else [])
    each = main.select("time", "antenna1", "antenna2", F.posexplode(F.arrays_zip(*cols)).alias("channel_id", "c"))
    if channels is not None:
        each = each.where((F.col("channel_id") >= channels[0]) & (F.col("channel_id") < channels[1]))
    flagged = F.col("c.flag")[0] | F.col("c.flag")[3]
    mean = lambda c: F.when(flagged, 0.0).otherwise((F.col(f"c.{c}")[0] + F.col(f"c.{c}")[3]) / 2)
    weight = F.when(flagged, 0.0).otherwise(F.least(F.col("c.weight_spectrum")[0], F.col("c.weight_spectrum")[3])) if has_weight else F.lit(None).cast("double")
    return each.select("time", F.col("channel_id").cast("bigint").alias("channel_id"), F.col("antenna2").cast("bigint").alias("beam_i"), F.col("antenna1").cast("bigint").alias("beam_j"), mean(f"{column}_re").alias("re"), mean(f"{column}_im").alias("im"), weight.alias("weight"))


def flag_autocorrelations(vis: DataFrame) -> DataFrame:
    auto = F.col("beam_i") == F.col("beam_j")
    return vis.withColumns({c: F.when(auto, 0.0).otherwise(F.col(c)) for c in ("re", "im")})


def weighted(vis: DataFrame, keys: tuple[str, ...] = ("time", "channel_id")) -> DataFrame:
    """v w / sum(w) x number of non-zero visibilities, if the group has a non-zero weight."""
    w = Window.partitionBy(*keys)
    on = (F.col("re") != 0) | (F.col("im") != 0)
    weight = F.when(on, F.col("weight")).otherwise(0.0)
    total, n = F.sum(weight).over(w), F.sum(F.when(on, 1).otherwise(0)).over(w)
    factor = F.when(F.coalesce(total, F.lit(0.0)) == 0, 1.0).otherwise(weight * n / total)
    return vis.withColumn("_f", factor).withColumns({c: F.col(c) * F.col("_f") for c in ("re", "im")}).drop("_f")


def drop_empty(vis: DataFrame, keys: tuple[str, ...] = ("time", "channel_id"), eps: float = 1e-8) -> DataFrame:
    """Without groups all of whose visibilities are (nearly) zero."""
    w = Window.partitionBy(*keys)
    return vis.withColumn("_m", F.max(F.greatest(F.abs("re"), F.abs("im"))).over(w)).where(F.col("_m") > eps).drop("_m")


def visibilities(main: DataFrame, column: str = "data", times: tuple[int, int, int] = (0, -1, 1), channels: tuple[int, int] | None = None, conjugate: bool = False) -> DataFrame:
    """The main source: slices, polarisations, flags, weights, autocorrelations, empty groups."""
    ids = time_table(main).where(in_slice(F.col("time_id"), *times))
    vis = drop_empty(weighted(flag_autocorrelations(reduce_polarisations(main.join(F.broadcast(ids.select("time")), "time", "left_semi"), column, channels))))  # one row per integration
    vis = vis.join(F.broadcast(ids), "time")
    return vis.withColumn("im", -F.col("im")) if conjugate else vis


def working_beams(vis: DataFrame) -> DataFrame:
    """Beams with any non-zero visibility in their row or column, per group."""
    on = vis.where((F.col("re") != 0) | (F.col("im") != 0))
    return on.select("time_id", "channel_id", F.col("beam_i").alias("beam_id")).union(on.select("time_id", "channel_id", "beam_j")).distinct()


def count_scale(vis: DataFrame) -> DataFrame:
    """``n_vis, scale`` per group; visibilities off the diagonal count twice."""
    on = (F.col("re") != 0) | (F.col("im") != 0)
    n = F.sum(F.when(on, F.when(F.col("beam_i") == F.col("beam_j"), 1).otherwise(2)).otherwise(0))
    g = vis.groupBy("time_id", "channel_id").agg(n.alias("n_vis"))
    return g.withColumn("scale", F.when(F.col("n_vis") == 0, 0.0).otherwise(1.0 / F.col("n_vis")))


def mirrored(vis: DataFrame, hermitian: bool = True) -> DataFrame:
    """Adds the transposed entries, conjugated unless weights are mirrored."""
    off = vis.where(F.col("beam_i") != F.col("beam_j"))
    im = -F.col("im") if hermitian else F.col("im")
    return vis.unionByName(off.withColumns({"beam_i": F.col("beam_j"), "beam_j": F.col("beam_i"), "im": im}))


def matrix_stats(vis: DataFrame, *keys: str) -> DataFrame:
    """Least, greatest and summed parts of each group's entries."""
    return vis.groupBy(*keys).agg(F.count("*").alias("entries"), *(f(c).alias(f"{n}_{c}") for c in ("re", "im") for n, f in (("min", F.min), ("max", F.max), ("sum", F.sum))))


def unsorted_times(main: DataFrame, block: int = 1_000_000) -> DataFrame:
    """Places where time runs backwards in row order (``ordinal``, from 0 on without gaps as a row's number has it).

    Rows are compared within blocks of ordinals; a block's first row is compared with the last of the
    block before, of which there is one row each.
    """
    part = F.floor(F.col("ordinal") / block)
    rows = main.select("ordinal", "time", part.alias("part"))
    ends = rows.groupBy("part").agg(F.max_by("time", "ordinal").alias("last"))
    ends = ends.select("part", F.lag("last").over(Window.orderBy("part")).alias("last"))  # a row per block
    w = Window.partitionBy("part").orderBy("ordinal")
    seen = rows.join(F.broadcast(ends), "part").select("ordinal", "time", F.coalesce(F.lag("time").over(w), "last").alias("before"))
    return seen.where("before > time")
