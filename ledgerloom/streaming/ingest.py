"""Incremental file ingestion: each file is read exactly once, on demand rather than continuously."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.sinks.tables import Store
from ledgerloom.sources.files import conformed_names, options_of, provenance, readable, schema_of
from ledgerloom.sources.schemas import SOURCES


def run_available(stream: DataFrame, data: str, checkpoint: str) -> int:
    """Append whatever is new to a parquet folder and stop; returns the number of rows read."""
    before = _stored_rows(stream.sparkSession, data)
    query = stream.writeStream.format("parquet").outputMode("append") \
        .option("path", data).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return _stored_rows(stream.sparkSession, data) - before


def _stored_rows(spark: SparkSession, data: str) -> int:
    """Rows of a table that the sink has committed, counted from file footers; 0 before the first batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{data}/_spark_metadata")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return 0
    return spark.read.parquet(data).count()


class Bronze:
    """Bronze tables below one folder: per table a generation holding data and checkpoint.

    A full refresh starts a new generation and publishes it only when its load has finished, so
    readers see the old rows until then. Use it when a landed file has been corrected: files that
    were already read are never read again within a generation.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def ingest(self, landing: str, name: str, full_refresh: bool = False,
               aliases: dict[str, str] | None = None, max_files: int = 1000) -> int:
        """Load new files of a source; returns the number of rows added."""
        source = SOURCES[name]
        current = self.store.current(name)
        fresh = current is None or full_refresh
        home = self.store.next_path(name) if fresh else current
        stream = self.spark.readStream.format(source.kind).options(**options_of(source)) \
            .option("maxFilesPerTrigger", max_files).schema(schema_of(source, aliases)) \
            .load(f"{landing.rstrip('/')}/{source.pattern}")
        stream = conformed_names(stream.select("*", *provenance()), aliases)
        added = run_available(stream, f"{home}/data", f"{home}/checkpoint")
        if fresh:
            self.store.publish(home)
        return added

    def read_path(self, home: str) -> DataFrame:
        return self.spark.read.parquet(f"{home}/data")

    def read(self, name: str, with_unreadable: bool = False) -> DataFrame:
        frame = self.read_path(self.store.current(name))
        return frame if with_unreadable else readable(frame)


def ingest_folder(spark: SparkSession, folder: str, pattern: str, schema, data: str, checkpoint: str) -> DataFrame:
    """Stream the parquet files of a folder that match a pattern into a table; returns the table."""
    stream = spark.readStream.format("parquet").schema(schema).option("pathGlobFilter", pattern).load(folder)
    run_available(stream.select("*", *provenance()), data, checkpoint)
    return spark.read.parquet(data)
