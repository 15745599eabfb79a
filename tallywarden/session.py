"""Session settings and the folder shared by driver and executors."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that results or plans depend on. Sizes such as the number of shuffle
# partitions belong to the cluster and are left to it.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join also where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # State of many entities lives on disk, not on the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}
# Spark's switch for deleting the shuffle files of a statement when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "tallywarden", **extra: str) -> SparkSession:
    """A session with the library's settings; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@contextmanager
def configured(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session in this block only."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local path would be lost with the executor that wrote it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    root = spark.sparkContext.getCheckpointDir()
    if root:
        return root
    # Executors of local-cluster are processes of their own, like those of any cluster.
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="tallywarden-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/tallywarden/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Compute once and keep in the shared folder, for tables used several times.

    Meant for tables much smaller than their input. Survives lost executors.
    """
    shared_root(df.sparkSession)
    return df.checkpoint()


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Statements that end in this block leave no shuffle files behind; what they wrote is all that is read later."""
    with configured(spark, CLEANUP, "true"):
        yield


def kept(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    It cuts the lineage, keeps only the columns given and survives lost executors.
    """
    spark = df.sparkSession
    shared_root(spark)
    path = shared_folder(spark, purpose)
    with shuffles_deleted(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.kept_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``kept`` returned and that nothing will read again, lazy results included."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.kept_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers of this machine import the package from where the driver found it.

    On a cluster it is shipped like any other package, with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
