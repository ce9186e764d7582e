"""Empty files that say what is done."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Markers:
    """Names below a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def has(self, name: str) -> bool:
        files, path = self._at(name)
        return files.exists(path)

    def put(self, name: str) -> None:
        files, path = self._at(name)
        files.create(path, True).close()
