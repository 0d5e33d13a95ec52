"""Written tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder; a private one is made only where a
local session has none, as in tests; a cluster without one is an error.  A table written here cuts lineage and outlives
lost executors.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="fringeworks-")
        spark.sparkContext.setCheckpointDir(path)
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)  # with its file system, as tasks may open it without Spark
    return target.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(target).toString()


class Workspace:
    """A folder for one run of an operator; it goes when the program ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self._made = 0
        atexit.register(self._remove_quietly, self.root)

    def path(self, name: str) -> str:
        self._made += 1
        return f"{self.root}/{self._made:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._workspace_path = path
        return back

    def drop(self, df: DataFrame | None) -> None:
        """Remove a table that nothing reads any more."""
        path = getattr(df, "_workspace_path", None)
        if path:
            self.remove(path)

    def remove(self, path: str) -> None:
        sc = self.spark.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)

    def _remove_quietly(self, path: str) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self.remove(path)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            pass


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df
