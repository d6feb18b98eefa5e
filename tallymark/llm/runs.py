"""Sorted immutable runs in a folder, and which of them are live: the storage of a log-structured index.

A run is a folder of Parquet: rows of (bucket, part, a, b), where a bucket is a range of keys and a row holds sorted keys (a)
with a number each (b). A run is never changed. Manifests say which runs are live, each manifest a new file; the newest
counts, so a job that fails half-way leaves the index as it was. When a level has `fanout` runs they are merged into one of
the next level, and removed once no manifest names them."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import remove

MANIFEST = "version long, level int, run string"
RUN = "bucket int, part int, a binary, b binary"


class Runs:
    def __init__(self, spark: SparkSession, folder: str, fanout: int = 4):
        self.spark, self.folder, self.fanout = spark, folder.rstrip("/"), fanout
        self.version, self.live = 0, []
        try:
            found = spark.read.schema(MANIFEST).json(f"{self.folder}/manifests/*").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = []
        if found:
            self.version = max(r["version"] for r in found)
            self.live = sorted((r["level"], r["run"]) for r in found if r["version"] == self.version and r["run"])

    def new(self) -> str:
        """A name for a folder that a run can be written to."""
        return f"batch-{uuid.uuid4().hex}"

    def read(self, names: list[str] | None = None) -> DataFrame | None:
        """All live runs (or the named), a column `run` with their numbers."""
        out = None
        for i, name in enumerate([run for _, run in self.live] if names is None else names):
            one = self.spark.read.schema(RUN).parquet(f"{self.folder}/{name}").withColumn("run", F.lit(i))
            out = one if out is None else out.unionByName(one)
        return out

    def add(self, name: str, merge: Callable[[DataFrame], DataFrame]) -> None:
        """Takes in a run that has been written, then compacts full levels. merge: many runs into one."""
        live, old = [*self.live, (0, name)], []
        while full := [level for level, n in Counter(level for level, _ in live).items() if n >= self.fanout]:
            level = min(full)
            names = [run for at, run in live if at == level]
            merged = self.new()
            merge(self.read(names)).select("bucket", "part", "a", "b").write.parquet(f"{self.folder}/{merged}")
            live, old = [x for x in live if x[0] != level] + [(level + 1, merged)], old + names
        self.version, self.live = self.version + 1, sorted(live)
        self.spark.createDataFrame([(self.version, level, run) for level, run in self.live], MANIFEST).coalesce(1).write.json(f"{self.folder}/manifests/{self.version:09d}")
        for x in old:
            remove(self.spark, f"{self.folder}/{x}")
