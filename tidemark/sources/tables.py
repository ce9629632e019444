"""Reading the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.files import with_current_names


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Loader:
    """Tables by path, planned anew when their files change: what is kept is known by newest time and total bytes, and a missing table never is.

    `legacy` columns get their current names. Nothing but plans and file listings is held.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._known: dict[str, tuple[tuple[int, int], DataFrame]] = {}

    def _state(self, path: str) -> tuple[int, int]:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(target):
            raise FileNotFoundError(path)
        status = files.getFileStatus(target)
        parts = files.listStatus(target) if status.isDirectory() else [status]
        return max((p.getModificationTime() for p in parts), default=0), files.getContentSummary(target).getLength()

    def load(self, path: str) -> DataFrame:
        state = self._state(path)
        if path not in self._known or self._known[path][0] != state:
            self.spark.catalog.refreshByPath(path)
            self._known[path] = state, with_current_names(self.spark.read.parquet(path))
        return self._known[path][1]
