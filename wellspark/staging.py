"""Written tables that cut lineage in the middle of a plan.

A stage is a parquet table under the shared folder the cluster names in
``spark.checkpoint.dir``. Re-reading it costs one columnar scan, survives the
loss of any executor, and gives the optimizer the real byte size of the table,
so a join side is broadcast only when that size is under
``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None
_shipped: set[str] = set()
_BATCH_BYTES = "16m"


def root(spark: SparkSession) -> str:
    """Folder for staged tables: the cluster's shared one; a temporary one on a single machine."""
    global _local_root
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="spark-wellspark-", dir="/tmp")
    return _local_root


def folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{root(spark)}/wellspark-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Deletes this application's staged tables; frames read from them stop working."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, *steps: Callable[[], object]) -> list:
    """Runs independent steps at the same time, so their jobs share the cluster."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]]


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers, wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.realpath(__file__))
    folder = os.path.realpath(tempfile.mkdtemp(prefix="wellspark-code-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    copy = os.path.join(folder, "src", os.path.basename(package))
    shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
    archive = shutil.make_archive(os.path.join(folder, "wellspark"), "zip", os.path.dirname(copy))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on: wall-clock timestamps are read as UTC; workers have the package and get
    batches of bounded bytes, however long the rows are."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", _BATCH_BYTES)
    ship(spark)
    return spark
