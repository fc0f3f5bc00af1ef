"""Working tables of one operator call, in the shared folder, removed when its result is written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.session import scratch

# While a table is written: its shuffle files go as soon as it is done, and tasks get texts in small batches.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def put(frame: DataFrame, path: str, **options: str) -> DataFrame:
    """Write a frame to a new folder and return the written copy."""
    spark = frame.sparkSession
    before = {key: spark.conf.get(key, None) for key in _WRITING}
    for key, value in _WRITING.items():
        spark.conf.set(key, value)
    try:
        frame.write.parquet(path, **options)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(frame.schema).parquet(path)


class Workspace:
    """Tables written below one fresh folder of the shared store."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self._n = spark, scratch(spark, name), 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.folder}/{self._n}-{name}"

    def keep(self, frame: DataFrame, name: str = "table") -> DataFrame:
        """Write a frame and return the written copy: lineage ends here and a lost executor costs a re-read."""
        return put(frame, self.path(name))

    def drop(self, *names: str) -> None:
        """Remove written tables that no later step reads."""
        for i in range(1, self._n + 1):
            for name in names:
                self.remove(f"{self.folder}/{i}-{name}")

    def remove(self, folder: str | None = None) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(folder or self.folder)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def unused(frame: DataFrame, name: str) -> str:
    """The name, lengthened until no column of the frame has it."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def worked_out(spark: SparkSession, name: str, build: Callable[[Workspace], DataFrame]) -> DataFrame:
    """Run `build` with a workspace, write its result on its own and remove the workspace."""
    work, result = Workspace(spark, name), Workspace(spark, f"{name}-result")
    try:
        return result.keep(build(work), name)
    finally:
        work.remove()
