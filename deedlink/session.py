"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators rely on. Partition counts are left to the cluster.
SESSION_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed side even where that costs one more exchange further up
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # write timestamps into parquet as logical microseconds (readable by every engine)
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}

#: Spark's switch that removes the shuffles of a statement when it ends; releases that don't know it ignore it.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_cut_folders: ContextVar[list[str] | None] = ContextVar("cut_folders", default=None)


def local_session(cpus: int | str = "*", app: str = "deedlink", **extra: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    n = os.cpu_count() if cpus == "*" else int(cpus)
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        **SESSION_SETTINGS,
        "spark.sql.shuffle.partitions": str(n),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Only a session on one machine may leave it out and gets a temporary folder; elsewhere the driver's disk would be a
    folder that executors cannot see, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not _is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="deedlink-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again, so that lost executors cannot change it.

    Spark's checkpoints hold rows as they lie in memory; compressed columns take a fraction of that disk, and later readers
    read only the columns they use. The shuffles that made ``df`` go as soon as it is written.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    folders = _cut_folders.get()
    if folders is not None:
        folders.append(folder)
    return spark.read.schema(df.schema).parquet(folder)


@contextmanager
def passing_cuts(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Frames cut inside are deleted at the end, so nothing made of them may be read later. What the given function cuts stays."""
    outer, own = _cut_folders.get(), []
    token = _cut_folders.set(own)

    def kept(df: DataFrame) -> DataFrame:
        inner = _cut_folders.set(outer)
        try:
            return cut_lineage(df)
        finally:
            _cut_folders.reset(inner)

    try:
        yield kept
    finally:
        _cut_folders.reset(token)
        for folder in own:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
