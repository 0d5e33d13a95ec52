"""Datasets, pixel sets, images and selections as Parquet folders with a header.

A store is a folder: ``header.json`` (one row) beside ``data`` (Parquet).  Data
are sorted by their key when written, so row groups prune by sample or tag.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S


def _write_header(spark: SparkSession, path: str, **values) -> None:
    row = {"major": S.FORMAT[0], "minor": S.FORMAT[1], **values}
    spark.createDataFrame([tuple(row.values())], list(row)).coalesce(1).write.mode("overwrite").json(f"{path}/header")


def _header(spark: SparkSession, path: str) -> dict:
    row = spark.read.json(f"{path}/header").first().asDict()
    S.check_version(int(row["major"]), int(row["minor"]))
    return row


@dataclass
class Dataset:
    """Samples: eigenpairs, uvw, wavelength, time and scale."""

    spark: SparkSession
    path: str
    header: dict

    @classmethod
    def create(cls, spark: SparkSession, path: str, description: str, n_antenna: int, n_beam: int, ra_deg: float, dec_deg: float) -> Dataset:
        _write_header(spark, path, description=description, n_antenna=int(n_antenna), n_beam=int(n_beam), ra_deg=float(ra_deg), dec_deg=float(dec_deg))
        spark.createDataFrame([], S.SAMPLES).write.mode("overwrite").parquet(f"{path}/data")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Dataset:
        return cls(spark, path, _header(spark, path))

    @property
    def samples(self) -> DataFrame:
        return self.spark.read.schema(S.SAMPLES).parquet(f"{self.path}/data")

    def append(self, samples: DataFrame) -> None:
        """Add samples; arrays must have the header's lengths (checked as rows are written)."""
        a, b = self.header["n_antenna"], self.header["n_beam"]
        ok = (F.size("d") == b) & (F.size("v_re") == a * b) & (F.size("v_im") == a * b) & (F.size("uvw") == 3 * a * a)
        guarded = samples.withColumn("d", F.when(ok, F.col("d")).otherwise(F.raise_error(F.lit("array lengths differ from the header's")).cast("array<double>")))
        guarded.select([f.split()[0] for f in S.SAMPLES.split(", ")]).sortWithinPartitions("sample_id").write.mode("append").parquet(f"{self.path}/data")

    def num_samples(self) -> int:
        return self.samples.count()

    def field(self, name: str, sample_id: int):
        """One field of one sample: a pruned, filtered scan."""
        rows = self.samples.where(F.col("sample_id") == sample_id).select(name).take(1)
        if not rows:
            raise IndexError(f"no sample {sample_id}")
        return rows[0][0]


@dataclass
class PixelSet:
    """Direction cosines of an image and free meta data."""

    spark: SparkSession
    path: str
    header: dict

    @classmethod
    def create(cls, spark: SparkSession, path: str, height: int, width: int, fov_deg: float, pixels: DataFrame) -> PixelSet:
        _write_header(spark, path, height=int(height), width=int(width), fov_deg=float(fov_deg))
        pixels.select("pixel_id", "l", "m", "n").write.mode("overwrite").parquet(f"{path}/data")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PixelSet:
        return cls(spark, path, _header(spark, path))

    @property
    def pixels(self) -> DataFrame:
        return self.spark.read.schema(S.PIXELS).parquet(f"{self.path}/data")

    def _meta(self) -> DataFrame | None:
        try:
            return self.spark.read.json(f"{self.path}/meta", schema="name string, i bigint, f double, a array<double>")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def meta_data(self) -> dict:
        m = self._meta()
        return {} if m is None else {r.name: next(v for v in (r.i, r.f, r.a) if v is not None) for r in m.collect()}

    def set_meta(self, name: str, value) -> None:
        """Integers, floats and non-empty lists of floats; a name can be set once."""
        if name in self.meta_data():
            raise ValueError(f"meta data {name!r} exist")
        if isinstance(value, list | tuple) and not value:
            raise ValueError("empty meta data")
        is_list, is_int = isinstance(value, list | tuple), isinstance(value, int)
        row = (name, value if is_int else None, None if is_list or is_int else float(value), [float(v) for v in value] if is_list else None)
        self.spark.createDataFrame([row], "name string, i bigint, f double, a array<double>").write.mode("append").json(f"{self.path}/meta")


@dataclass
class Images:
    """Images by tag."""

    spark: SparkSession
    path: str
    header: dict

    @classmethod
    def create(cls, spark: SparkSession, path: str, height: int, width: int, fov_deg: float, ra_deg: float, dec_deg: float) -> Images:
        _write_header(spark, path, height=int(height), width=int(width), fov_deg=float(fov_deg), ra_deg=float(ra_deg), dec_deg=float(dec_deg))
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Images:
        return cls(spark, path, _header(spark, path))

    def set(self, images: DataFrame) -> None:
        """Insert or replace the given tags only."""
        for r in images.select("tag").distinct().collect():
            S.check_tag(r.tag)
        images.select("pixel_id", F.col("value").cast("float").alias("value"), "tag").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tag").parquet(f"{self.path}/data")

    @property
    def images(self) -> DataFrame:
        return self.spark.read.schema("pixel_id bigint, value float, tag string").parquet(f"{self.path}/data")

    def tags(self) -> list[str]:
        return sorted(r.tag for r in self.images.select("tag").distinct().collect())

    def get(self, tag: str) -> DataFrame:
        df = self.images.where(F.col("tag") == tag)
        n = df.count()
        if not n:
            raise KeyError(tag)
        if n != self.header["height"] * self.header["width"]:
            raise S.FormatError("image size differs from the header's")
        return df.orderBy("pixel_id")


def selection_to_json(selection: DataFrame) -> DataFrame:
    """One row, ``json``: tag -> sample id -> eigenvalues."""
    per_tag = selection.groupBy("tag").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("sample_id").cast("string").alias("k"), F.col("d").alias("v"))))).alias("m"))
    by_tag = F.array_sort(F.collect_list(F.struct("tag", "m")), lambda a, b: F.when(a["tag"] < b["tag"], -1).when(a["tag"] > b["tag"], 1).otherwise(0))
    return per_tag.agg(F.to_json(F.map_from_entries(by_tag)).alias("json"))


def selection_from_json(df: DataFrame, column: str = "json") -> DataFrame:
    m = F.from_json(F.col(column), "map<string,map<string,array<double>>>")
    return df.select(F.explode(m).alias("tag", "s")).select("tag", F.explode("s").alias("id", "d")).select("tag", F.col("id").cast("bigint").alias("sample_id"), "d")


def write_selection(selection: DataFrame, path: str) -> None:
    selection_to_json(selection).coalesce(1).write.mode("overwrite").text(path)


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    return selection_from_json(spark.read.text(path, wholetext=True).select(F.col("value").alias("json")))


def store_selection(selection: DataFrame, path: str) -> None:
    """As Parquet, a folder per tag: for stages that follow; JSON is for exchange."""
    for r in selection.select("tag").distinct().collect():
        S.check_tag(r.tag)
    selection.select("sample_id", "d", "tag").write.mode("overwrite").partitionBy("tag").parquet(path)


def stored_selection(spark: SparkSession, path: str) -> DataFrame:
    """A selection in either form."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(sc._jvm.org.apache.hadoop.fs.Path(path, "tag=*"))
    if files is None or not len(files):
        return read_selection(spark, path)
    return spark.read.schema("sample_id bigint, d array<double>, tag string").parquet(path).select("tag", "sample_id", "d")


def default_selection(samples: DataFrame) -> DataFrame:
    """All samples, unfiltered."""
    return samples.select(F.lit("full_image").alias("tag"), "sample_id", "d")
