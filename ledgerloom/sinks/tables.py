"""Tables as parquet folders: atomic overwrite, append, keyed upsert, export.

Every overwrite writes a new version folder. Spark's own _SUCCESS (or our marker for a stream)
commits it; readers take the newest committed version. One writer per table at a time.

A table made with `create_bucketed` is split by a hash of its key. An upsert rewrites, inside the current version, only
the buckets that the source has keys of; files of all others stay as they are.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.lake import settled
from ledgerloom.session import scratch

BUCKET = "_bucket"
WIDENED = "_WIDENED"  # marks a version whose files differ in their columns


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _fs(self, text: str):
        return self._path(text).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self, name: str, committed: bool) -> list[int]:
        pattern = f"{self.root}/{name}/v*" + ("/_SUCCESS" if committed else "")
        found = self._fs(pattern).globStatus(self._path(pattern)) or []
        paths = [f.getPath() for f in found]
        folders = [p.getParent().getName() if committed else p.getName() for p in paths]
        return sorted(int(n[1:]) for n in folders)

    def current(self, name: str) -> str | None:
        versions = self._versions(name, committed=True)
        return f"{self.root}/{name}/v{versions[-1]:06d}" if versions else None

    def next_path(self, name: str) -> str:
        versions = self._versions(name, committed=False)
        return f"{self.root}/{name}/v{(versions[-1] if versions else 0) + 1:06d}"

    def publish(self, home: str) -> None:
        """Commit a folder Spark's file committer did not mark itself."""
        self._fs(home).create(self._path(f"{home}/_SUCCESS"), True).close()

    def read(self, name: str, merge_schema: bool = False) -> DataFrame:
        path = self.current(name)
        if path is None:
            raise FileNotFoundError(f"no table {name} below {self.root}")
        return self._stored(name, path, merge_schema).drop(BUCKET)

    def _stored(self, name: str, path: str, merge_schema: bool = False) -> DataFrame:
        facts = self._buckets(name)
        if facts and not merge_schema:  # a table in buckets has no file while it is empty
            return self.spark.read.schema(facts["schema"]).parquet(path)
        widened = merge_schema or self._fs(path).exists(self._path(f"{path}/{WIDENED}"))
        return self.spark.read.option("mergeSchema", str(widened).lower()).parquet(path)

    def overwrite(self, name: str, df: DataFrame, partition_by: list[str] = ()) -> DataFrame:
        """Replace rows and schema. The old version may be read while the new one is written."""
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(self.next_path(name))
        return self.read(name)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Add rows; columns may be new, older rows then show NULL, for every later reader too."""
        path = self.current(name)
        if path is None:
            return self.overwrite(name, df)
        if set(df.columns) != set(self.read(name).columns):
            self._fs(path).create(self._path(f"{path}/{WIDENED}"), True).close()
        df.write.mode("append").parquet(path)
        return self.read(name, merge_schema=True)

    def create_empty(self, name: str, schema: StructType | str) -> DataFrame:
        """A typed table without rows, unless the table exists."""
        if self.current(name) is None:
            return self.overwrite(name, self.spark.createDataFrame([], schema))
        return self.read(name)

    def create_bucketed(self, name: str, df: DataFrame, key: list[str], buckets: int = 64) -> DataFrame:
        """Write a table whose upserts on `key` rewrite only the buckets they touch."""
        rows = df.withColumn(BUCKET, _bucket(key, buckets))
        facts = self.spark.createDataFrame([(list(key), buckets, rows.schema.json())], "key array<string>, buckets int, schema string")
        facts.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{name}/_buckets")
        self._write_buckets(rows, self.next_path(name))
        return self.read(name)

    def _buckets(self, name: str) -> dict | None:
        path = f"{self.root}/{name}/_buckets"
        if not self._fs(path).exists(self._path(path)):
            return None
        facts = self.spark.read.parquet(path).first()
        return {"key": facts["key"], "buckets": facts["buckets"], "schema": StructType.fromJson(json.loads(facts["schema"]))}

    def _write_buckets(self, rows: DataFrame, path: str, gathered: bool = False) -> None:
        """Replace the buckets that `rows` has, and no others; one shuffle gathers each in files of even size, unless it is so stored."""
        (rows if gathered else rows.hint("rebalance", BUCKET)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
        self.publish(path)  # Spark marks no folder that it overwrites in part

    def upsert(self, name: str, source: DataFrame, key: list[str]) -> DataFrame:
        """Matched keys take the source row, new keys are inserted. The source is evaluated once.

        A bucketed table must be upserted on its own key. Its touched buckets are merged into a copy first, so a run
        that was broken off can be repeated: the same source gives the same table.
        """
        source = settled(source, "upsert")
        check_unique(source, key)
        facts = self._buckets(name)
        if facts is None:
            return self.overwrite(name, merged(self.read(name), source, key, checked=True))
        if list(key) != facts["key"]:
            raise ValueError(f"{name} is bucketed by {facts['key']}, not by {list(key)}")
        path, bucket = self.current(name), _bucket(facts["key"], facts["buckets"])
        touched = [r[0] for r in source.select(bucket.alias(BUCKET)).distinct().collect()]  # at most the number of buckets
        if not touched:
            return self.read(name)
        target = self._stored(name, path).where(F.col(BUCKET).isin(touched))
        rows, copy = merged(target.drop(BUCKET), source, key, checked=True).withColumn(BUCKET, bucket), scratch(self.spark, "merged")
        self._write_buckets(rows, copy)
        self._write_buckets(self.spark.read.schema(rows.schema).parquet(copy), path, gathered=True)
        return self.read(name)

    def drop_old(self, name: str, keep: int = 2) -> None:
        for version in self._versions(name, committed=True)[:-keep]:
            path = f"{self.root}/{name}/v{version:06d}"
            self._fs(path).delete(self._path(path), True)


def _bucket(key: list[str], buckets: int):
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in key]), F.lit(buckets)).cast("int")


def check_unique(df: DataFrame, key: list[str]) -> None:
    """A key matched twice would make the outcome of a merge depend on row order."""
    repeated = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").limit(5).collect()
    if repeated:
        raise ValueError(f"duplicate keys in merge source: {[tuple(r[k] for k in key) for r in repeated]}")


def merged(target: DataFrame, source: DataFrame, key: list[str], checked: bool = False) -> DataFrame:
    if not checked:
        check_unique(source, key)
    keys = source.select(*[F.col(k).alias(f"_r_{k}") for k in key])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in key])
    kept = target.join(keys, same, "left_anti")  # a NULL key is a key, so that repeating a merge changes nothing
    return kept.select(*target.columns).unionByName(source.select(*target.columns))


def replace_view(name: str, df: DataFrame) -> None:
    df.createOrReplaceTempView(name)


def export(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write files for other systems: csv (with header), parquet or json lines."""
    writer = df.write.mode("errorifexists")
    if kind == "csv":
        writer.option("header", "true").csv(path)
    else:
        getattr(writer, kind)(path)
