"""Intermediate data in the folder that driver and executors share: written and read again, they outlive any executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of each application's intermediate data, within the shared folder.
_folders: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset (tests, local mode only)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints/weftmill"


def _file(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the application's folder of the shared one; the JVM removes that folder when it ends, even long after spark.stop()."""
    key = spark.sparkContext.applicationId, shared_dir(spark)
    if key not in _folders:
        _folders[key] = f"{key[1]}/weftmill-{key[0]}-{uuid.uuid4().hex}"
        files, p = _file(spark, _folders[key])
        files.mkdirs(p)
        files.deleteOnExit(p)
    return f"{_folders[key]}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str, instead_of: DataFrame | None = None) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage in a way that outlives any executor.

    instead_of: saved data that this one replaces, as in the rounds of an iteration; they are removed once df is written.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    if instead_of is not None:
        discard(instead_of)
    found = spark.read.schema(df.schema).parquet(path)
    found._saved_at = path
    return found


def discard(df: DataFrame) -> None:
    """Removes what saved() wrote for df; nothing may read it any more. Other data frames are left alone."""
    path = getattr(df, "_saved_at", None)
    if path:
        files, p = _file(df.sparkSession, path)
        files.delete(p, True)
