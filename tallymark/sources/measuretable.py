"""The measures as a stored table with versions.

Rows are dealt into buckets by their fingerprint; a bucket is Parquet files that Spark writes and that are never changed. A step
rewrites the buckets that it touches, or only adds files where rows come in, and then makes a new version known by a manifest, a
small file that is created once: a step that fails before leaves the table as it was, and of two writers that start
from one version the second fails. A fingerprint is there once: every step checks the buckets that it writes. Columns
can be added without touching a file (a null in one reads as its default). Older versions can be read and restored until they are
cleaned away."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators import upsert as batches
from tallymark.sources.files import exists, listed, read_text, remove, settled, write_once


class Conflict(RuntimeError):
    """Another writer was first."""


class NotUnique(ValueError):
    """A fingerprint would be there twice."""


class MeasureTable:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        known = self.versions()
        self.state = self.at(known[-1]) if known else None

    @classmethod
    def create(cls, spark: SparkSession, folder: str, rows: DataFrame, buckets: int = 64) -> MeasureTable:
        """A new table of rows with id, fingerprint and more."""
        out = cls(spark, folder)
        if out.state:
            raise Conflict(f"there is a table in {folder}")
        out.state = {"version": 0, "step": None, "n_buckets": buckets, "columns": [[f.name, f.dataType.simpleString(), None] for f in rows.schema], "buckets": {}}
        out.commit("create", out.written(rows))
        return out

    def versions(self) -> list[int]:
        return sorted(int(x.removesuffix(".json")) for x in listed(self.spark, f"{self.folder}/versions") if x.endswith(".json"))

    def at(self, version: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.folder}/versions/{version:09d}.json"))

    def bucket(self):
        return F.pmod(F.xxhash64("fingerprint"), F.lit(self.state["n_buckets"])).cast("int")

    def read(self, version: int | None = None, buckets: list[int] | None = None, columns: list[str] | None = None) -> DataFrame:
        """The rows of a version (the newest), of some buckets alone if they are given. Columns younger than a file have their
        default."""
        state = self.state if version is None else self.at(version)
        paths = [p for b, own in state["buckets"].items() if buckets is None or int(b) in buckets for p in own]
        wanted = [c for c in state["columns"] if columns is None or c[0] in columns]
        schema = ", ".join(f"`{name}` {kind}" for name, kind, _ in wanted)
        if not paths:
            return self.spark.createDataFrame([], schema)
        raw = self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in paths])
        return raw.select([F.col(n) if d is None else F.coalesce(F.col(n), F.lit(d).cast(k)).alias(n) for n, k, d in wanted])

    def written(self, rows: DataFrame) -> dict[str, list[str]]:
        """Writes rows by bucket; the new files' folders by bucket."""
        name = f"data-{uuid.uuid4().hex}"
        own = rows.select([F.col(n).cast(k).alias(n) if n in rows.columns else F.lit(d).cast(k).alias(n) for n, k, d in self.state["columns"]])
        own.select("*", self.bucket().alias("_bucket")).repartition(self.state["n_buckets"], "_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{name}")
        return {x.removeprefix("_bucket="): [f"{name}/{x}"] for x in listed(self.spark, f"{self.folder}/{name}") if x.startswith("_bucket=")}

    def commit(self, step: str, files: dict[str, list[str]], replaced: list[int] | None = None, new: bool = True, **changes) -> None:
        """Makes a version known: `replaced` buckets have only the new files, others get them besides. replaced: None for none."""
        gone = {str(b) for b in replaced or []}
        buckets = {b: [*([] if b in gone else self.state["buckets"].get(b, [])), *files.get(b, [])] for b in {*self.state["buckets"], *files}}
        state = self.state | changes | {"version": self.state["version"] + 1, "step": step, "buckets": {b: p for b, p in buckets.items() if p}}
        touched = sorted(int(b) for b in {*files, *gone})
        try:
            self.unique(state, touched)
            if not write_once(self.spark, f"{self.folder}/versions/{state['version']:09d}.json", json.dumps(state)):
                raise Conflict(f"version {state['version']} is there already")
        except (NotUnique, Conflict):
            for folder in {p.split("/")[0] for own in files.values() for p in own if new}:
                remove(self.spark, f"{self.folder}/{folder}")
            raise
        self.state = state

    def unique(self, state: dict, buckets: list[int]) -> None:
        before, self.state = self.state, state
        try:
            again = buckets and self.read(buckets=buckets, columns=["fingerprint"]).where("fingerprint IS NOT NULL").groupBy("fingerprint").count().where("count > 1").select("fingerprint").take(1)
        finally:
            self.state = before
        if again:
            raise NotUnique(f"Measure already exists: {again[0][0]}")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of rows (fingerprint)."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def insert(self, rows: DataFrame) -> DataFrame:
        """Takes in rows whose fingerprint is new, as files beside the others; the conflicts, as batches.insert() has them."""
        keys = settled(self.read(columns=["id", "fingerprint"]))
        _, conflicts = batches.insert(keys, rows)
        conflicts = settled(conflicts)
        self.commit("insert", self.written(rows.join(conflicts.select("id"), "id", "left_anti")))
        return conflicts

    def update(self, changes: DataFrame, as_of: str) -> None:
        """Sets the given columns of rows by id."""
        changes = settled(changes.select([c for c in changes.columns if c == "id" or c in [x[0] for x in self.state["columns"]]]))
        hit = self.touched(self.read(columns=["id", "fingerprint"]).join(changes.select("id"), "id", "left_semi"))
        self.commit("update", self.written(batches.update(self.read(buckets=hit), changes, as_of)), hit)

    def upsert(self, incoming: DataFrame, as_of: str) -> DataFrame:
        """Takes in a batch as batches.upsert() does; what became of its rows. The whole table is read for its keys alone; rows
        are read and written in the buckets of updated rows. What the updates change is written to the audit in the same step."""
        keys = self.read(columns=["id", "is_duplicate", *batches.KEYS.values()])
        found = settled(batches.sorted_in(keys, incoming))
        hit = self.touched(keys.join(found.where("fate = 'updated'").select(F.col("matched_id").alias("id")), "id", "left_semi"))
        new = batches.coming_in([c[0] for c in self.state["columns"]], found)
        if not hit:
            self.commit("upsert", self.written(new), hit)
            return found
        old = self.read(buckets=hit)
        pairs = found.where("fate = 'updated'").select("matched_id", F.struct(*incoming.columns).alias("new")).join(old.select(F.col("id").alias("matched_id"), F.struct(*old.columns).alias("old")), "matched_id")
        audit = f"audit-{uuid.uuid4().hex}"
        fields = [f for f in batches.WATCHED if f in old.columns and f in incoming.columns]
        batches.changes_of(pairs, fields, F.col("new.data_source")).withColumn("updated_at", F.lit(as_of)).write.parquet(f"{self.folder}/{audit}")
        both = batches.updated(old, found, as_of).unionByName(new, allowMissingColumns=True)
        self.commit("upsert", self.written(both), hit, audit=[*self.state.get("audit", []), audit])
        return found

    def audit(self) -> DataFrame:
        """(measure_id, field_name, old_value, new_value, update_source, updated_at) of all updates so far."""
        paths = [f"{self.folder}/{x}" for x in self.state.get("audit", [])]
        schema = "measure_id long, field_name string, old_value string, new_value string, update_source string, updated_at string"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def add_column(self, name: str, kind: str, default=None) -> None:
        if name in [c[0] for c in self.state["columns"]]:
            raise ValueError(f"there is a column {name}")
        self.commit("add_column", {}, columns=[*self.state["columns"], [name, kind, default]])

    def restore(self, version: int) -> None:
        """The rows and columns of an older version, as a new one."""
        old = self.at(version)
        self.commit("restore", old["buckets"], [int(b) for b in self.state["buckets"]], new=False, columns=old["columns"])

    def clean(self, keep: int = 1) -> None:
        """Forgets all but the newest versions, and removes the files that no version has."""
        known = self.versions()
        used = {p.split("/")[0] for v in known[-keep:] for own in self.at(v)["buckets"].values() for p in own}
        for v in known[:-keep]:
            remove(self.spark, f"{self.folder}/versions/{v:09d}.json")
        for x in listed(self.spark, self.folder):
            if x.startswith("data-") and x not in used and exists(self.spark, f"{self.folder}/{x}"):
                remove(self.spark, f"{self.folder}/{x}")
