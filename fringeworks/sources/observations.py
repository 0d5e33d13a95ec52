"""Observation tables: normalised measurement sets, instruments and catalogues.

A measurement set is a folder of Parquet tables: ``main`` (time, antenna1,
antenna2, data_re, data_im, flag, weight_spectrum; arrays of channel x pol),
``field`` (ra, dec), ``spectral_window`` (chan_freq), ``antenna`` (position),
and for stations of elements ``antenna_field`` (position, element_offset,
element_flag).
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sphere import rot

C = 299792458.0
DEFAULT_ANTENNAS = {"skalow": 512, "mwa": 128, "lofar": 37}


@dataclass
class MeasurementSet:
    spark: SparkSession
    path: str

    def __post_init__(self):
        local = self.path.removeprefix("file://")
        if "://" not in local and not os.path.isdir(local):
            raise ValueError(f"{self.path} is not a folder")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def field_center(self) -> tuple[float, float]:
        r = self.table("field").select("ra", "dec").first()
        return r.ra, r.dec

    def channels(self) -> DataFrame:
        """``channel_id, frequency, wl`` of the first window."""
        return channel_table(self.table("spectral_window"))

    def times(self) -> DataFrame:
        return time_table(self.table("main"))

    def main(self) -> DataFrame:
        return self.table("main")


def channel_table(windows: DataFrame) -> DataFrame:
    return windows.limit(1).select(F.posexplode("chan_freq").alias("channel_id", "frequency")).withColumn("wl", C / F.col("frequency"))


def channel_range(channels: DataFrame, start: int = 0, stop: int = -1) -> DataFrame:
    """Channels from ``start`` up to ``stop`` (exclusive; -1 is open)."""
    if start < 0 or stop < -1 or -1 < stop <= start:
        raise ValueError(f"no channels from {start} to {stop}")
    c = F.col("channel_id")
    return channels.where(c >= start) if stop == -1 else channels.where((c >= start) & (c < stop))


def time_table(main: DataFrame, column: str = "time") -> DataFrame:
    """``time_id, time``: distinct times in order; they are few, one per integration."""
    d = main.select(F.col(column).alias("time")).distinct()
    return d.select((F.row_number().over(Window.orderBy("time")) - 1).cast("bigint").alias("time_id"), "time")


def first_stations(antennas: DataFrame, n: int | None) -> DataFrame:
    """The n least station ids; asking for more than there are is an error."""
    if n is None:
        return antennas
    ids = antennas.select("station_id").distinct().orderBy("station_id").limit(n)
    if ids.count() < n:
        raise ValueError(f"fewer than {n} stations")
    return antennas.join(F.broadcast(ids), "station_id")  # n rows


def station_centroids(antennas: DataFrame) -> DataFrame:
    return antennas.groupBy("station_id").agg(*(F.avg(c).alias(c) for c in "xyz")).select("station_id", F.lit(0).cast("bigint").alias("antenna_id"), "x", "y", "z")


def element_stations(fields: DataFrame, n_station: int | None = None, station_only: bool = False) -> DataFrame:
    """Stations of elements: position plus offset of each element that isn't flagged."""
    e = fields.select("station_id", "position", F.posexplode(F.arrays_zip("element_offset", "element_flag")).alias("antenna_id", "e")).where(~F.exists("e.element_flag", lambda f: f))
    a = e.select("station_id", F.col("antenna_id").cast("bigint").alias("antenna_id"), *((F.col("position")[k] + F.col("e.element_offset")[k]).alias(c) for k, c in enumerate("xyz")))
    a = first_stations(a, n_station)
    return station_centroids(a) if station_only else a


def plain_stations(antenna: DataFrame) -> DataFrame:
    """One antenna a station; ``ordinal`` is the row's place."""
    return antenna.select(F.col("ordinal").cast("bigint").alias("station_id"), F.lit(0).cast("bigint").alias("antenna_id"), *(F.col("position")[k].alias(c) for k, c in enumerate("xyz")))


def instrument_csv(spark: SparkSession, path: str, n_station: int | None = None, station_only: bool = False) -> DataFrame:
    """STATION_ID, [ANTENNA_ID,] X, Y, Z in metres."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    names = {c.upper(): c for c in raw.columns}
    antenna = F.col(names["ANTENNA_ID"]).cast("bigint") if "ANTENNA_ID" in names else F.lit(0).cast("bigint")
    a = raw.select(F.col(names["STATION_ID"]).cast("bigint").alias("station_id"), antenna.alias("antenna_id"), *(F.col(names[c.upper()]).cast("double").alias(c) for c in "xyz"))
    a = first_stations(a, n_station)
    return station_centroids(a) if station_only else a


def tile_elements(stations: DataFrame, half: float = 1.65) -> DataFrame:
    """4 x 4 elements on a square tile tangent to the earth at each station (Arrow batches; 16 rows a station)."""

    def run(batches):
        import pandas as pd

        line = np.linspace(-half, half, 4)
        gy, gx = np.meshgrid(line, line, indexing="ij")
        flat = np.stack([gx.ravel(), gy.ravel(), np.zeros(16)])
        for b in batches:
            out = []
            for s, *p in b[["station_id", "x", "y", "z"]].itertuples(index=False):
                p = np.array(p)
                u = p / np.linalg.norm(p)
                axis = np.cross([0, 0, 1], u)
                r = (rot(axis, np.arccos(u[2])) if np.linalg.norm(axis) > 1e-12 else np.eye(3)) @ rot([0, 0, 1], np.arctan2(u[1], u[0]))
                e = (p[:, None] + r @ flat).T
                out.append(pd.DataFrame({"station_id": s, "antenna_id": np.arange(16), "x": e[:, 0], "y": e[:, 1], "z": e[:, 2]}))
            if out:
                yield pd.concat(out)

    return stations.select("station_id", "x", "y", "z").mapInPandas(run, "station_id bigint, antenna_id bigint, x double, y double, z double")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """``x, y, z, intensity`` from a tab-separated catalogue with RA, DEC (degrees) and Total_flux columns."""
    raw = spark.read.csv(path, header=True, sep="\t")
    ra, dec = F.radians(F.col("RA").cast("double")), F.radians(F.col("DEC").cast("double"))
    return raw.select((F.cos(dec) * F.cos(ra)).alias("x"), (F.cos(dec) * F.sin(ra)).alias("y"), F.sin(dec).alias("z"), F.col("Total_flux").cast("double").alias("intensity"))
