"""The whole dataflows: observation to dataset, dataset to selection, dataset to images."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frame import icrs_position, lmn_grid
from ..operators import geometry as G
from ..operators.eigen import Instrument, solved_samples
from ..operators.selection import Spec, select
from ..operators.synthesis import Options, image_synthesis
from ..operators.visibility import visibilities
from ..sources.observations import MeasurementSet, channel_range, first_stations
from ..sources.stores import Dataset, Images, PixelSet, default_selection, store_selection, stored_selection


def instrument_of(antennas: DataFrame, ra: float, dec: float, earth_fixed: bool = True) -> tuple[Instrument, list[int]]:
    """The instrument in dense order, and the station of each beam."""
    a = G.ordinals(antennas, "station_id", "antenna_id").orderBy("ordinal").toPandas()  # thousands of rows at most
    stations = sorted(set(a.station_id.tolist()))
    return Instrument(a[["x", "y", "z"]].to_numpy(float), np.searchsorted(stations, a.station_id.to_numpy()), ra, dec, earth_fixed), stations


def build_dataset(ms: MeasurementSet, antennas: DataFrame, path: str, telescope: str, description: str = "", times=(0, -1, 1), channels: tuple[int, int] = (0, -1), earth_fixed: bool = True, column: str = "data", n_station: int | None = None) -> Dataset:
    """One sample per kept integration and channel of ``channels`` (start, exclusive end; -1 is the last).

    Weights and baselines are those of each sample's own time and wavelength.  With ``n_station`` only the
    first stations take part.
    """
    ra, dec = ms.field_center()
    every = ms.channels()
    total = every.count()
    lo, hi = channels[0], total if channels[1] == -1 else channels[1]
    if not 0 <= lo < hi <= total:
        raise ValueError(f"channels {channels} aren't within 0 and {total}")
    instrument, stations = instrument_of(first_stations(antennas, n_station), ra, dec, earth_fixed)
    place = F.broadcast(ms.spark.createDataFrame([(int(s), k) for k, s in enumerate(stations)], "beam bigint, at bigint"))  # a row per station
    vis = visibilities(ms.main(), column, times, (lo, hi), conjugate=telescope == "lofar")
    for c in ("beam_i", "beam_j"):
        vis = vis.join(place, vis[c] == place["beam"]).withColumn(c, F.col("at")).drop("beam", "at")
    vis = vis.join(F.broadcast(channel_range(every, lo, hi).select(F.col("channel_id").cast("bigint").alias("channel_id"), "wl")), "channel_id")  # a row per channel
    ds = Dataset.create(ms.spark, path, description or telescope, len(instrument.xyz), len(stations), float(np.degrees(ra)), float(np.degrees(dec)))
    ds.append(solved_samples(vis, instrument, hi - lo, lo))
    return ds


def build_selection(ds: Dataset, path: str, specs: list[str], sample_range=(0, -1, 1)) -> DataFrame:
    chosen = select(ds.samples, [Spec.parse(s) for s in specs], sample_range)
    store_selection(chosen, path)
    return stored_selection(ds.spark, path)


def build_pixels(spark: SparkSession, path: str, size: int, fov_deg: float) -> PixelSet:
    return PixelSet.create(spark, path, size, size, fov_deg, lmn_grid(spark, size, float(np.radians(fov_deg))))


def build_images(ds: Dataset, pixels: PixelSet, path: str, selection: str | None = None, options: Options = Options()) -> Images:
    chosen = stored_selection(ds.spark, selection) if selection else default_selection(ds.samples)
    img = image_synthesis(ds.samples, chosen, pixels.pixels, ds.header["n_antenna"], ds.header["n_beam"], options)
    h = pixels.header
    out = Images.create(ds.spark, path, h["height"], h["width"], h["fov_deg"], ds.header["ra_deg"], ds.header["dec_deg"])
    out.set(img)
    return out


__all__ = ["build_dataset", "build_images", "build_pixels", "build_selection", "icrs_position", "instrument_of"]
