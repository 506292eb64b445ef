"""Intermediate tables in the shared folder of the cluster: lineage is cut there, and scopes delete what they made."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Without one, only a local master may use /tmp."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/checkpoints/tessera"


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the JVM's Hadoop client."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def drop(spark: SparkSession, path: str) -> None:
    files, where = file_system(spark, path)
    files.delete(where, True)


def _made(spark: SparkSession, path: str, outlive: bool) -> None:
    """The table goes with the innermost open scope (or the one around it), at the latest when the session ends."""
    scopes = _scopes[:-1] if outlive else _scopes
    if scopes:
        scopes[-1].append(path)
    files, where = file_system(spark, path)
    files.deleteOnExit(where)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what the block cuts and stores, but for what is made to outlive it."""
    own: list[str] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.remove(own)
        for path in own:
            drop(spark, path)


def cut(df: DataFrame, outlive: bool = False) -> DataFrame:
    """Compute df once into the shared checkpoint folder and forget its lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    found = df.checkpoint(eager=True)
    file = found._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        _made(spark, file.get(), outlive)
    return found


def new_path(spark: SparkSession) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    _made(spark, path, False)
    return path


def store(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df as a compressed Parquet table (in the shared folder, if no path is given) and read it from there."""
    path = path or new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
