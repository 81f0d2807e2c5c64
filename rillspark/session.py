"""The session that the tests and the bench use, and the place of shared scratch tables."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A UTC session with AQE for local runs; on a cluster use the session that it gives."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rillspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("RILLSPARK_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one where that is unset and all of Spark is one local process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class _Written(threading.local):
    """Paths of the tables written by one thread of this driver and not yet removed, oldest first."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_tables = _Written()


DROPPED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str = "cut", by: Sequence[str] = (), drop_shuffles: bool = False) -> DataFrame:
    """``df`` written as Parquet in the shared folder, in folders by some columns if asked for, and read again.

    With ``drop_shuffles`` the shuffle files of the job go as soon as the table stands, not when the driver collects garbage.

    Cuts the lineage: an executor that is lost afterwards costs no earlier stage.  The table
    stays until :func:`removed` takes it away.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(DROPPED, None)
    if drop_shuffles:
        spark.conf.set(DROPPED, "true")
    try:
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.set(DROPPED, was) if was else spark.conf.unset(DROPPED)
    _tables.paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def tables_so_far() -> int:
    """A mark for :func:`removed`."""
    return len(_tables.paths)


def removed(spark: SparkSession, since: int = 0, keep: Sequence[DataFrame] = (), keep_last: bool = False) -> int:
    """Removes the tables that this thread wrote since a mark, but those to keep and, if asked for, the last one; how many these were.

    For the caller of a job, once its result is written or read; inside an operator, for the tables that
    its result does not need.
    """
    kept = {df._written_at for df in keep} | set(_tables.paths[-1:] if keep_last else ())
    gone = [p for p in _tables.paths[since:] if p not in kept]
    _tables.paths[since:] = [p for p in _tables.paths[since:] if p in kept]
    for path in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(gone)
