"""Folders and small files in whatever file system Spark knows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it is not there."""
    fs, where = _at(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    fs, where = _at(spark, path)
    _, there = _at(spark, to)
    fs.mkdirs(there.getParent())
    if not fs.exists(where) or not fs.rename(where, there):
        raise OSError(f"{path} can't become {to}")


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """A new small file, whole or not at all; False if it is there already. Of two writers at once one fails where renaming never
    replaces a file, as in HDFS."""
    fs, where = _at(spark, path)
    _, part = _at(spark, f"{path}.{uuid.uuid4().hex}.part")
    stream = fs.create(part, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(where) or not fs.rename(part, where):
        fs.delete(part, False)
        return False
    return True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Only a local session, one machine, may leave it out."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "/tmp/checkpoints"
    return named.rstrip("/")


def through_folder(spark: SparkSession, make: Callable[[str], DataFrame]) -> DataFrame:
    """The rows of a frame that is made by way of files in a new folder: they are checkpointed, and the folder is removed."""
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    try:
        return settled(make(folder))
    finally:
        remove(spark, folder)


def settled(df: DataFrame) -> DataFrame:
    """What several joins or the next round read, written once to the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
