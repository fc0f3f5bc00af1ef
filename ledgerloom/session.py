"""Session defaults and the shared folder for checkpoints and scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings the plans in this package rely on. AQE splits hot join keys; forcing the split
# accepts one more shuffle of the (small) aggregate above it rather than one giant task.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(app: str = "ledgerloom", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: the context's checkpoint folder, else what spark.checkpoint.dir names.

    A temporary folder stands in for it in local mode only; on a cluster a folder of one machine would lose rows.
    """
    context = spark.sparkContext
    path = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
        path = context.getCheckpointDir()
    return path


_open_scopes: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the scratch tables that were written inside; use what is read from them before it ends."""
    made: list[str] = []
    _open_scopes.append(made)
    try:
        yield
    finally:
        _open_scopes.remove(made)
        for path in made:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh directory name below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _open_scopes:
        _open_scopes[-1].append(path)
    return path


def cut(df):
    """Truncate lineage through the shared folder, so a lost executor costs a re-read, not a re-run."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
