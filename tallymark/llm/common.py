"""What the operators of this subpackage share: input columns, the shared folder, byte-bounded batches."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Checkpoints go here only where the session names no shared folder (local tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder, read by Spark alone (any file system that it knows)."""
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{PurePosixPath(name)}.parquet")


def position(df: DataFrame, name: str) -> int:
    """Which column a name means: the exact spelling first, then one that differs in case alone, the first of equals."""
    at = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not at:
        raise ValueError(f"no column {name!r} among {df.columns}")
    return at[0]


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Exactly the asked columns, `new=old`. Other columns, names that differ in case alone and repeated names don't matter."""
    unique = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return unique.select(*[unique[f"_{position(df, old)}"].alias(new) for new, old in columns.items()])


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it. Only a local session, which is one machine, may leave
    it out."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = LOCAL_CHECKPOINTS
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """The name of a new folder in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there, in whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: written once to the shared folder, so a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Collects the driver's garbage, so that Spark removes shuffle files and checkpoints that nothing refers to any more.
    For the few places where an operator has just let go of much."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Hands memory that is free again back to the system: Spark keeps a task's worker for the next ones, beside the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that `column` holds about `max_bytes` in each, one row at least. After the last, memory goes back."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64")
        ends, start = np.cumsum(sizes), 0
        while start < len(sizes):
            stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + max_bytes, side="right"))
            stop = min(max(stop, start + 1), len(sizes))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def partitions(df: DataFrame, least: int = 1) -> int:
    """How many partitions an exchange of this session gets."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


#: A key with more than one in so many of all rows is looked up by broadcast: fewer keys than this can have that many.
SHARES = 1000


def looked_up(rows: DataFrame, facts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Each of `rows` with the columns that `facts` has for its key; rows without a fact go. `facts` has a row for each key,
    and in `n` how many of `rows` have it. Keys with over 1 in SHARES of all rows, fewer than SHARES, are broadcast; the
    others meet their rows in an exchange, where none of them is large. Both inputs are read twice: checkpoint them before."""
    total = facts.agg(F.sum(n)).first()[0] or 0
    hot, cold = F.broadcast(facts.where(F.col(n) * SHARES > total)), facts.where(F.col(n) * SHARES <= total)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))
