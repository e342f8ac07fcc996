"""Parquet table loaders and the shared-folder helpers every operator uses."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per application, wherever they start."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestack_shipped", False):
        return
    sc._lodestack_shipped = True
    package = Path(__file__).resolve().parent.parent
    name = os.path.join(tempfile.mkdtemp(prefix="lodestack-"), "lodestack")  # the driver's own file server hands it out
    sc.addPyFile(shutil.make_archive(name, "zip", package.parent, package.name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data directory; one parquet file or folder each."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors reach, as the cluster names it; a local one only on a local master where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no shared folder: intermediate tables need one off a local master")
    return os.path.join(tempfile.gettempdir(), "lodestack-checkpoints")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialise in the reliable checkpoint folder, so lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def stored(df: DataFrame, **options: str) -> DataFrame:
    """As `cut`, by a table written once to the shared folder and read back; the shuffle files behind it go with the write.

    For frames of our own columns (plain types, names of a table); options are the writer's. The application's tables are removed when it ends.
    """
    spark = df.sparkSession
    folder = _own_folder(spark)
    path = f"{folder}/{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    try:
        spark.conf.set(cleanup, "true")
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def _own_folder(spark: SparkSession) -> str:
    """A folder of this application inside the shared one, removed at its end."""
    sc = spark.sparkContext
    got = getattr(sc, "_lodestack_folder", None)
    if got is None:
        got = sc._lodestack_folder = f"{shared_folder(spark)}/lodestack-{uuid.uuid4().hex}"

        def remove() -> None:
            try:
                path = sc._jvm.org.apache.hadoop.fs.Path(got)
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
            except Exception:  # noqa: BLE001 - the session is gone already, and with it the way to the folder
                return

        atexit.register(remove)
    return got


def task_slots(spark: SparkSession) -> int:
    """Number of partitions to spread Python work over: the session's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
