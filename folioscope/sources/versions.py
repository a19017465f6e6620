"""Tables in numbered versions: a version counts once its writer has committed, so a reader never sees half of one.

A version is a folder; Spark leaves ``_SUCCESS`` in it when the whole job has been committed. What a killed job leaves behind has
no such marker and is ignored, and overwritten when that version is written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Versions:
    """The versions of one table below ``path``, on any file system that Spark reads. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _folder(self, number: int) -> str:
        return f"{self.path}/v{number:012d}"

    def complete(self) -> list[int]:
        """Numbers of the committed versions, in order."""
        paths = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = paths(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(paths(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(paths(self.path)) if s.isDirectory()]
        numbers = sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())
        return [n for n in numbers if fs.exists(paths(f"{self._folder(n)}/_SUCCESS"))]

    def read(self, *numbers: int) -> DataFrame:
        """The rows of these versions together; no rows for none."""
        if not numbers:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(self._folder(n) for n in numbers))

    def write(self, rows: DataFrame, number: int) -> None:
        """Commit ``rows`` as a version; an uncommitted one of this number is replaced."""
        rows.select(*self.schema.names).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(self._folder(number))

    def drop(self, number: int) -> None:
        paths = self.spark._jvm.org.apache.hadoop.fs.Path
        paths(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(paths(self._folder(number)), True)
