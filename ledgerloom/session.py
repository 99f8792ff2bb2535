"""What every job needs from its session: shared scratch space, shipped code, materialised tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.abspath(__file__))
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is made on a local master (tests); on a cluster that is an error,
    because executors would not see each other's files there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(scratch_root, "folder", None) or "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        scratch_root.folder = folder
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there, and lost executors
    cost only the tasks that were running."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of the shared folder that are read only until ``clear``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def materialise(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        while self.paths:
            remove(self.spark, self.paths.pop())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that is no longer read."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that tasks can import it.

    Where the session leaves the size of Arrow batches at Spark's default of 64 MB, they are set to 8 MB: what a Python task and
    its executor hold at a time is then bounded in bytes, however long the rows are.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH_BYTES, None) == "67108864b":
        spark.conf.set(_BATCH_BYTES, "8m")
    if getattr(ship, "sent_to", None) == context.applicationId:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="ledgerloom-code-"), "ledgerloom_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(_ROOT):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(_ROOT)))
    context.addPyFile(path)
    ship.sent_to = context.applicationId


def tasks(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
