"""A stored full-text index: immutable segments of postings, which Spark writes and reads as partitioned Parquet.

A segment is a batch of documents: its words with their places, partitioned by term range and sorted by term within a file, so a
search opens the ranges of its terms alone and skips what lies beside them. Deleting writes tombstones, which count for all
older segments; a document that comes again is a deletion and an addition in one step. What is live stands in manifests, each
a new small file that is created once: a step that fails before its manifest changes nothing, and of two writers that
start from the same manifest the second fails. Segments are merged into one, without what was deleted, by merge().

Documents have an id of any type; a null id is left out, as are later rows of an id within a batch. Empty documents count."""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators.filters import first_per
from tallymark.operators.match import Phrase, length_of, occurrences, parsed, scored, starts, wanted
from tallymark.sources.files import listed, read_text, remove, write_once

RANGES = 64
#: Rows of words that a file of a segment has room for.
FILE_ROWS = 5_000_000


class Conflict(RuntimeError):
    """Another writer was first."""


class TextIndex:
    def __init__(self, spark: SparkSession, folder: str, columns: list[str]):
        self.spark, self.folder, self.columns = spark, folder.rstrip("/"), columns
        self.state = self.newest()

    def newest(self) -> dict:
        names = sorted(x for x in listed(self.spark, f"{self.folder}/manifests") if x.endswith(".json"))
        if not names:
            return {"version": 0, "splits": None, "segments": [], "tombstones": [], "n": 0, "total": 0}
        return json.loads(read_text(self.spark, f"{self.folder}/manifests/{names[-1]}"))

    def commit(self, **changes) -> None:
        state = self.state | changes | {"version": self.state["version"] + 1}
        if not write_once(self.spark, f"{self.folder}/manifests/{state['version']:09d}.json", json.dumps(state)):
            raise Conflict(f"version {state['version']} is there already")
        self.state = state

    def range_of(self, term: Column, splits: list[str]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(x) for x in splits]).cast("array<string>"), lambda x: x <= term))

    def segment(self, batch: DataFrame, doc: str, splits: list[str] | None) -> tuple[dict, list[str]]:
        """Writes the words and the lengths of a batch."""
        own = first_per(batch.where(F.col(doc).isNotNull()), [doc], [F.xxhash64(*self.columns)])
        words, name, gen = occurrences(own, doc, self.columns), f"segment-{uuid.uuid4().hex}", self.state["version"] + 1
        if splits is None:
            # the first segment's words decide the ranges; repeats in a sample make frequent words ranges of their own
            some = words.select("term").where(F.pmod(F.xxhash64("doc", "pos"), F.lit(50)) == 0)
            ends = some.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(RANGES - 1).select("term")
            splits = sorted(r.term for r in ends.collect())
        path = f"{self.folder}/{name}"
        self.write_words(words.withColumn("range", self.range_of(F.col("term"), splits)), path)
        own.select(F.col(doc).alias("doc"), length_of(self.columns).alias("length")).write.parquet(f"{path}/docs")
        n, total = self.spark.read.parquet(f"{path}/docs").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        return {"name": name, "gen": gen, "n": n, "total": total}, splits

    def write_words(self, words: DataFrame, path: str) -> None:
        """By range, and each range to as many tasks as there are to spare: a frequent word's postings are no one task's."""
        spread = 1 + 4 * int(self.spark.conf.get("spark.sql.shuffle.partitions")) // RANGES
        dealt = words.repartition("range", F.pmod(F.xxhash64("doc"), F.lit(spread))).sortWithinPartitions("range", "term")
        dealt.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("range").parquet(f"{path}/words")

    def without_deleted(self, part: str, read=lambda df: df) -> DataFrame | None:
        """Rows of the live segments whose document hasn't been deleted since."""
        out = None
        for s in self.state["segments"]:
            one = read(self.spark.read.parquet(f"{self.folder}/{s['name']}/{part}")).withColumn("gen", F.lit(s["gen"]))
            out = one if out is None else out.unionByName(one)
        if out is None:
            return None
        gone = None
        for t in self.state["tombstones"]:
            one = self.spark.read.parquet(f"{self.folder}/{t['name']}").select(F.col("doc").alias("_doc"), F.lit(t["gen"]).alias("_gen"))
            gone = one if gone is None else gone.unionByName(one)
        if gone is not None:
            gone = gone.groupBy("_doc").agg(F.max("_gen").alias("_gen"))
            out = out.join(gone, (F.col("doc") == F.col("_doc")) & (F.col("gen") < F.col("_gen")), "left_anti")
        return out.drop("gen")

    def bury(self, ids: DataFrame) -> tuple[list[dict], int, int]:
        """Tombstones of those ids (doc) that are live; how many documents and words they take away."""
        live = self.without_deleted("docs")
        if live is None:
            return self.state["tombstones"], 0, 0
        name = f"tombstones-{uuid.uuid4().hex}"
        live.join(ids.select("doc").distinct(), "doc", "left_semi").write.parquet(f"{self.folder}/{name}")
        n, total = self.spark.read.parquet(f"{self.folder}/{name}").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        if not n:
            remove(self.spark, f"{self.folder}/{name}")
            return self.state["tombstones"], 0, 0
        return [*self.state["tombstones"], {"name": name, "gen": self.state["version"] + 1}], n, total

    def add(self, batch: DataFrame, doc: str = "id") -> None:
        """Takes in a batch; documents that are there already are replaced."""
        new, splits = self.segment(batch, doc, self.state["splits"])
        tombs, n, total = self.bury(batch.select(F.col(doc).alias("doc")))
        self.commit(splits=splits, segments=[*self.state["segments"], new], tombstones=tombs, n=self.state["n"] + new["n"] - n, total=self.state["total"] + new["total"] - total)

    def delete(self, ids: DataFrame) -> None:
        """Takes the documents with these ids (a column doc) out."""
        tombs, n, total = self.bury(ids)
        self.commit(tombstones=tombs, n=self.state["n"] - n, total=self.state["total"] - total)

    def merge(self) -> None:
        """One segment of all live documents; older segments and tombstones are removed once the manifest is there."""
        words, docs, old = self.without_deleted("words"), self.without_deleted("docs"), self.state
        if words is None or docs is None:
            return
        path = f"{self.folder}/{(name := f'segment-{uuid.uuid4().hex}')}"
        self.write_words(words, path)
        docs.write.parquet(f"{path}/docs")
        self.commit(segments=[{"name": name, "gen": old["version"] + 1, "n": old["n"], "total": old["total"]}], tombstones=[])
        for x in [*old["segments"], *old["tombstones"]]:
            remove(self.spark, f"{self.folder}/{x['name']}")

    def ranges(self, phrases: list[Phrase]) -> list[int]:
        """The term ranges that a search needs."""
        splits, out = self.state["splits"] or [], set()
        for p in phrases:
            for i, t in enumerate(p.terms):
                low = bisect_right(splits, t)
                high = bisect_right(splits, t + "\U0010ffff") if p.prefix and i == len(p.terms) - 1 else low
                out.update(range(low, high + 1))
        return sorted(out)

    def places(self, phrases: list[Phrase]) -> DataFrame | None:
        """The live occurrences of the words of some phrases: only their ranges are opened."""
        return self.without_deleted("words", lambda df: df.where(F.col("range").isin(self.ranges(phrases)) & wanted(phrases)).drop("range"))

    def search(self, query: str) -> DataFrame:
        """(doc, score) of the live documents that satisfy an expression, best not first."""
        node, phrases = parsed(query, self.columns)
        found = self.places(phrases)
        if found is None:
            raise ValueError("the index is empty")
        return scored(starts(found, phrases), node, phrases, self.state["n"], self.state["total"])
