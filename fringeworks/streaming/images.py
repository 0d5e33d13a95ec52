"""Running images over a stream of samples or visibilities.

State is (sum, count) per tag and pixel; dividing happens when images are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..sources.stores import Dataset


def sample_stream(spark: SparkSession, dataset: Dataset, files: int = 16) -> DataFrame:
    """Samples as they are appended."""
    return spark.readStream.schema(S.SAMPLES).option("maxFilesPerTrigger", files).parquet(f"{dataset.path}/data")


def append_samples(stream: DataFrame, dataset: Dataset, checkpoint: str):
    """A query that appends each batch of new samples to the dataset."""
    return stream.writeStream.foreachBatch(lambda df, _: dataset.append(df)).option("checkpointLocation", checkpoint).start()


def running_images(vis: DataFrame, pixels: DataFrame) -> DataFrame:
    """Complete-mode sums of pixel contributions of streamed visibilities (tag, sample_id, i, j, u, v, w, re, im).

    Samples are counted by their first autocorrelation (i = j = 0), which each has once, so the state is
    two numbers per pixel.
    """
    phase = F.col("l") * F.col("u") + F.col("m") * F.col("v") + F.col("n") * F.col("w")
    term = F.col("re") * F.cos(phase) - F.col("im") * F.sin(phase)
    # pixels are static; the visibilities of a batch are the stream's side
    return vis.crossJoin(pixels).groupBy("tag", "pixel_id").agg(F.sum(term).alias("sum"), F.count_if((F.col("i") == 0) & (F.col("j") == 0)).alias("samples"))


class Accumulator:
    """foreachBatch sink that keeps one partial image per batch and adds them up on reading.

    A batch that is run again replaces its own partial, so results are exactly once.
    """

    def __init__(self, spark: SparkSession, path: str, synthesise):
        self.spark, self.path, self.synthesise = spark, path, synthesise

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        n = batch.select("sample_id").distinct().count()
        if n:
            out = self.synthesise(batch).withColumn("samples", F.lit(n))
            out.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def images(self, normalize: bool = True) -> DataFrame:
        parts = self.spark.read.parquet(self.path)
        count = parts.select("batch", "samples").distinct().agg(F.sum("samples")).first()[0] or 1
        total = parts.groupBy("tag", "pixel_id").agg(F.sum("value").alias("value"))
        return total.withColumn("value", F.col("value") / float(count)) if normalize else total
