"""Command line: dataset, selection, image_prop, synthesis, plot (values as text)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fringeworks")
    sub = p.add_subparsers(dest="command", required=True)
    d = sub.add_parser("dataset")
    d.add_argument("--ms", required=True)
    d.add_argument("--telescope", choices=["skalow", "mwa", "lofar"], required=True)
    d.add_argument("--output", "-o", required=True)
    d.add_argument("--time_range", nargs=3, type=int, default=[0, -1, 1])
    d.add_argument("--channel", "-c", nargs=2, type=int, default=[0, -1], metavar=("START", "END"), help="end exclusive; -1 is the last")
    d.add_argument("--data", "-d", default="DATA", help="column, such as DATA, CORRECTED_DATA, MODEL_DATA")
    d.add_argument("--antenna", "-a", type=int, help="number of antennas")
    d.add_argument("--station", "-s", type=int, help="number of stations")
    d.add_argument("--description", default="")
    s = sub.add_parser("selection")
    s.add_argument("--dataset", required=True)
    s.add_argument("--selection", "-s", action="append", required=True)
    s.add_argument("--range", nargs=3, type=int, default=[0, -1, 1])
    s.add_argument("--output", "-o", required=True)
    s.add_argument("--json", action="store_true", help="one JSON document in place of Parquet")
    i = sub.add_parser("image_prop")
    i.add_argument("--npixel", "--width", "-w", type=int, required=True, help="pixels of a side")
    i.add_argument("--fov", type=float, required=True, help="degrees")
    i.add_argument("--output", "-o", required=True)
    y = sub.add_parser("synthesis")
    y.add_argument("--dataset", required=True)
    y.add_argument("--image_prop", required=True)
    y.add_argument("--selection")
    y.add_argument("--precision", choices=["single", "double"], default="single")
    y.add_argument("--tolerance", type=float, default=1e-3)
    y.add_argument("--output", "-o", required=True)
    t = sub.add_parser("plot")
    t.add_argument("--images", required=True)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    from .operators.synthesis import Options
    from .plans import dataflow as P
    from .sources.observations import DEFAULT_ANTENNAS, MeasurementSet, element_stations, plain_stations
    from .sources.stores import Dataset, Images, PixelSet, write_selection

    spark = SparkSession.builder.appName("fringeworks").getOrCreate()
    if a.command == "dataset":
        ms = MeasurementSet(spark, a.ms)
        antennas = element_stations(ms.table("antenna_field")) if a.telescope == "lofar" else plain_stations(ms.table("antenna"))
        there = antennas.select("station_id").distinct().count()
        stations = a.station or a.antenna or min(there, DEFAULT_ANTENNAS[a.telescope])
        P.build_dataset(ms, antennas, a.output, a.telescope, a.description, tuple(a.time_range), tuple(a.channel), column=a.data.lower(), n_station=stations)
    elif a.command == "selection":
        chosen = P.build_selection(Dataset.open(spark, a.dataset), a.output, a.selection, tuple(a.range))
        if a.json:
            write_selection(chosen, f"{a.output}.json")
    elif a.command == "image_prop":
        P.build_pixels(spark, a.output, a.npixel, a.fov)
    elif a.command == "synthesis":
        P.build_images(Dataset.open(spark, a.dataset), PixelSet.open(spark, a.image_prop), a.output, a.selection, Options().with_(precision=a.precision, tolerance=a.tolerance))
    else:
        images = Images.open(spark, a.images)
        for tag in images.tags():
            print(tag, images.get(tag).summary("min", "mean", "max").collect())


if __name__ == "__main__":
    main()
