"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that matter on a cluster: adaptive re-planning (coalescing, skewed
# join splitting, switching to broadcast after the real size is known) and a
# size-gated broadcast threshold.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "cellshift", master: str | None = None, **conf: object) -> SparkSession:
    """Create a session with the engine defaults; keyword values override them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Return the shared folder for checkpoints and written intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    (local tests) a temporary folder is made and remembered in the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("cellshift.scratch", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("cellshift.scratch", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """Return a fresh path below the scratch folder."""
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a frame in reliable storage so lost executors do not replay a loop."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def released(spark: SparkSession, *labels: str) -> None:
    """Delete this application's written tables of the given labels, once nothing reads them any more."""
    root = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for label in labels:
        for path in _WRITTEN.pop((spark.sparkContext.applicationId, label), []):
            system.delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query are deleted when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_DROP_SHUFFLES)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)


# Tables written by this process: (application, label) -> paths.
_WRITTEN: dict[tuple[str, str], list[str]] = {}


def written(df: DataFrame, label: str, *partition_by: str, compression: str | None = None) -> DataFrame:
    """Write a frame once to the scratch folder and read it back.

    Used where one expensive intermediate feeds several branches of a plan.  The
    compression is the session's unless one is named.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.mode("error")
    if compression:
        writer = writer.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _WRITTEN.setdefault((spark.sparkContext.applicationId, label), []).append(path)
    return spark.read.parquet(path)
