"""Writing measures. Every sink writes in parallel into a folder, new or replaced as a whole."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.values import iso
from tallymark.operators.upsert import kept, rejects
from tallymark.sources import files
from tallymark.sources.measuretable import MeasureTable

EXPORT_LIMIT = 10_000


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON, for formats without them."""
    return df.select([F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name) for f in df.schema])


def csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    flat(df).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def text_files(df: DataFrame, path_of: Callable[[int], str], n: int, order: str, encoding: str = "UTF-8") -> list[str]:
    """At most n delimited files with names of their own, each a range of the rows by `order` and in it; written in parallel,
    then renamed. No file is written for an empty table."""
    parts = f"{path_of(0)}.parts"
    df.repartitionByRange(n, order).sortWithinPartitions(order).write.csv(parts, header=True, escape='"', encoding=encoding)
    spark, done = df.sparkSession, []
    for i, name in enumerate(sorted(x for x in files.listed(spark, parts) if x.startswith("part-"))):
        files.rename(spark, f"{parts}/{name}", path_of(i))
        done.append(path_of(i))
    files.remove(spark, parts)
    return done


def json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def json_with_summary(df: DataFrame, summary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """measures/ as JSON lines and summary/ as one line beside it."""
    df.write.mode(mode).json(f"{path}/measures")
    summary.write.mode(mode).json(f"{path}/summary")


def export(df: DataFrame, path: str, kind: str = "csv", limit: int = EXPORT_LIMIT) -> None:
    """At most `limit` measures, the latest first."""
    {"csv": csv, "json": json}[kind](df.orderBy(F.desc_nulls_last("year"), "id").limit(limit), path)


def backup(df: DataFrame, folder: str, now: datetime) -> str:
    """A copy in a folder of its own, named by the time."""
    path = f"{folder}/backup_{now:%Y%m%d_%H%M%S}"
    df.write.parquet(path)
    return path


#: Counters of a run that are logged.
RUN_COUNTERS = ["measures_checked", "new_measures", "updated_measures", "duplicates_found"]
#: Statuses that end a run; others leave it without an end.
ENDED = ["success", "failed"]
RUN = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("run_id", "run_type")], *[T.StructField(c, T.TimestampType()) for c in ("started_at", "completed_at")],
    *[T.StructField(c, T.StringType()) for c in ("status", "error_message")], *[T.StructField(c, T.LongType()) for c in RUN_COUNTERS],
])


def log_run(spark, path: str, run_id: str, run_type: str, started: datetime, status: str = "running", completed: datetime | None = None, error_message: str | None = None, **counters: int) -> None:
    """Appends a run's state; counters that aren't given are 0, others than RUN_COUNTERS don't count."""
    row = {"run_id": run_id, "run_type": run_type, "started_at": started, "completed_at": completed if status in ENDED else None, "status": status, "error_message": error_message}
    spark.createDataFrame([row | {c: counters.get(c, 0) for c in RUN_COUNTERS}], RUN).write.mode("append").parquet(path)


def update_run(table: MeasureTable, incoming: DataFrame, log: str, run_id: str, as_of: str, now: datetime) -> dict[str, int]:
    """Takes a batch into a stored table as one logged run: rows without a year or a source are errors and stay out. Inserted,
    updated, duplicates and errors; a run with errors ends with `completed_with_errors`, one that breaks off with `failed`."""
    spark = table.spark
    log_run(spark, log, run_id, "update", now)
    try:
        checked, errors = incoming.count(), rejects(incoming).count()
        fates = {r["fate"]: r["n"] for r in table.upsert(kept(incoming), as_of).groupBy("fate").agg(F.count("*").alias("n")).collect()}
    except Exception as e:
        log_run(spark, log, run_id, "update", now, "failed", now, str(e)[:500])
        raise
    out = {"inserted": fates.get("inserted", 0), "updated": fates.get("updated", 0), "duplicates": fates.get("duplicate", 0), "errors": errors}
    status = "completed_with_errors" if errors else "success"
    log_run(spark, log, run_id, "update", now, status, now, f"{errors} rows failed" if errors else None, measures_checked=checked, new_measures=out["inserted"], updated_measures=out["updated"], duplicates_found=out["duplicates"])
    return out


def last_state(log: DataFrame) -> DataFrame:
    """The last entry of each run: one of a run that goes on no longer, if there is one."""
    order = F.struct((F.col("status") != "running").alias("a"), F.coalesce("completed_at", "started_at").alias("b"))
    return log.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "run_id"]), order).alias("r")).select("run_id", "r.*")


def raw_scrape(df: DataFrame, folder: str, source: str, now: datetime) -> str:
    """A raw scrape as JSON lines, in a place named by its source and the time."""
    path = f"{folder}/{source.replace(' ', '_')}_{now:%Y%m%d_%H%M%S}"
    json(df, path)
    return path


def site_state(df: DataFrame, built: datetime | None, force: bool = False) -> DataFrame:
    """(data_changed, stale): the last change of the measures, and whether a site that was built then must be built again."""
    changed = F.max(F.col("updated_at").cast("timestamp"))
    stale = F.lit(True) if force or built is None else F.coalesce(changed > F.lit(built).cast("timestamp"), F.lit(False))
    return df.agg(iso(changed).alias("data_changed"), stale.alias("stale"))


def is_stale(data_changed: datetime, site_built: datetime | None, force: bool = False) -> bool:
    """Whether a site must be built again."""
    return force or site_built is None or data_changed > site_built
