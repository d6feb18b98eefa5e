"""Exact dedup by a minimal perfect hash over the digests of earlier texts.

Texts are equal when they are identical without ASCII white space; what is compared is the SHA-256 of what is left. Of equal
texts the row with the most code points stays, then the one with the smallest doc_id, then the first of repeated rows.

The index holds each distinct digest of history once. Digests are dealt out to shards by a checksum; a shard is a minimal
perfect hash (levels of bits: a digest that is alone in its place of a level takes it, the others go on to the next level) and
as many slots as digests. A slot holds the full digest, the number of rows and the locator of the row that stays. A batch is
reduced to its distinct digests before it moves; each is looked up in its shard, and as a minimal perfect hash gives
strangers a slot too, all 32 bytes in the slot are compared. Members are repeats and join their slot; nonmembers are
groups of their own. Shards stand before their lookups in sorted partitions, so a task holds one shard (SHARD_KEYS digests) and
what streams by. An index is written as generations; the newest whole one counts, so a job that fails leaves it as it was.

Null texts count as empty; texts of any length are hashed in Spark and never leave their rows. doc_ids must be integers; a row
without one counts as the largest. Repeated rows each come out, one of them kept. An empty table gives no rows; other
columns, whatever their names, don't matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import cut, exists, looked_up, partitions, pick, remove, scratch
from tallymark.llm.spans import U, scramble

SHARD_KEYS = 1 << 16
WHITE = " \t\n\x0b\x0c\r"
#: What a slot knows besides its digest: the number of rows, and the locator in order of preference (least first).
FACTS = ["n", "less", "none", "doc_id", "gen", "row"]
GROUP = "digest binary, " + ", ".join(f"{x} long" for x in FACTS)
SHARD = "shard int, shards int, levels binary, digests binary, facts binary"
GAMMA = 2


def digest(text: Column) -> Column:
    """SHA-256 of a text without ASCII white space."""
    return F.unhex(F.sha2(F.encode(F.translate(F.coalesce(text, F.lit("")), WHITE, ""), "UTF-8"), 256))


class PerfectHash:
    """Distinct 32-byte digests to the numbers 0 to n - 1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0, *[int(x.sum()) for x in levels]])
        self.ranks = [np.cumsum(x, dtype="i8") - 1 for x in levels]

    @staticmethod
    def places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        words = keys.view("<u8").reshape(-1, 4)
        return (scramble(words[:, 0] ^ scramble(words[:, 1] + U(2 * level + 1))) % U(size)).astype("i8")

    @classmethod
    def over(cls, keys: np.ndarray) -> PerfectHash:
        """keys: bytes, n x 32, no two alike."""
        levels: list[np.ndarray] = []
        while len(keys):
            at = cls.places(keys, len(levels), size := GAMMA * len(keys) + 1)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            keys = np.ascontiguousarray(keys[~alone[at]])
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some strangers, any slot for the others."""
        out, open_ = np.full(len(keys), -1), np.arange(len(keys))
        for i, level in enumerate(self.levels):
            at = self.places(np.ascontiguousarray(keys[open_]), i, len(level))
            hit = level[at]
            out[open_[hit]] = self.before[i] + self.ranks[i][at[hit]]
            open_ = open_[~hit]
        return out

    def pack(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], "<i8").tobytes()
        return head + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def unpack(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        sizes, at, levels = np.frombuffer(data, "<i8", n, 8).tolist(), 8 + 8 * n, []
        for size in sizes:
            levels.append(np.unpackbits(np.frombuffer(data, "u1", -(-size // 8), at), count=size).astype(bool))
            at += -(-size // 8)
        return cls(levels)


def keys_of(column: pa.Array) -> np.ndarray:
    """32-byte digests as n x 32 bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), "u1").reshape(-1, 32)


def facts_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(x).to_numpy(zero_copy_only=False).astype("i8") for x in FACTS], 1)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of sorted partitions by shard: (shard, some consecutive rows of it)."""
    for batch in batches:
        if batch.num_rows:
            shard = batch.column("shard").to_numpy(zero_copy_only=False)
            ends = [*(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for start, end in zip([0, *ends], ends):
                yield int(shard[start]), batch.slice(start, end - start)


def as_groups(keys: np.ndarray, facts: np.ndarray) -> pa.RecordBatch:
    digests = pa.Array.from_buffers(pa.binary(32), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys).tobytes())]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([digests, *[pa.array(facts[:, i]) for i in range(len(FACTS))]], ["digest", *FACTS])


def groups(rows: DataFrame) -> DataFrame:
    """Distinct digests of rows (digest, less, none, doc_id, gen, row), with the facts of a slot. Reduced before they move."""
    best = F.min(F.struct(*FACTS[1:]))
    return rows.groupBy("digest").agg(F.count("*").alias("n"), best.alias("best")).select("digest", "n", *[F.col(f"best.{x}").cast("long").alias(x) for x in FACTS[1:]])


def dealt(df: DataFrame, shards: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.crc32("digest"), F.lit(shards)).cast("int"))


def build(found: DataFrame, path: str) -> None:
    """Writes an index of distinct digests with their facts. `found` is read twice: checkpoint it before."""
    shards = max(1, -(-found.count() // SHARD_KEYS))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one() -> pa.RecordBatch:
            keys, facts = np.concatenate(held), np.concatenate(known)
            hashed = PerfectHash.over(keys)
            order = np.argsort(hashed.slots(keys))
            blobs = hashed.pack(), keys[order].tobytes(), facts[order].tobytes()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([shards], pa.int32()), *[pa.array([x], pa.binary()) for x in blobs]], ["shard", "shards", "levels", "digests", "facts"])

        at, held, known = -1, [], []
        for shard, batch in runs(batches):
            if held and shard != at:
                yield one()
                held, known = [], []
            at = shard
            held.append(keys_of(batch.column("digest")))
            known.append(facts_of(batch))
        if held:
            yield one()

    tasks = min(shards, 8 * partitions(found))
    found.transform(dealt, shards).repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(make, SHARD).write.parquet(path)


def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the locators `a` go before `b`."""
    less, same = np.zeros(len(a), bool), np.ones(len(a), bool)
    for i in range(1, len(FACTS)):
        less |= same & (a[:, i] < b[:, i])
        same &= a[:, i] == b[:, i]
    return less


def absorb(index: DataFrame, found: DataFrame) -> DataFrame:
    """All digests of an index and of a batch's groups, once each, with the facts of both. Members change their slot's
    facts; nonmembers pass through."""
    shards = index.agg(F.max("shards")).first()[0]
    if shards is None:
        return found
    blank = lambda names: [F.lit(None).cast("binary" if x in ("levels", "digests", "facts", "digest") else "long").alias(x) for x in names]
    first = index.select("shard", F.lit(0).alias("kind"), "levels", "digests", "facts", *blank(["digest", *FACTS]))
    then = found.transform(dealt, shards).select("shard", F.lit(1).alias("kind"), *blank(["levels", "digests", "facts"]), "digest", *FACTS)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hashed, keys, facts = -1, None, np.zeros((0, 32), "u1"), np.zeros((0, len(FACTS)), "i8")
        for shard, batch in runs(batches):
            if shard != at:
                if len(keys):
                    yield as_groups(keys, facts)
                at, hashed, keys, facts = shard, None, keys[:0], facts[:0]
            stored = int(np.count_nonzero(batch.column("kind").to_numpy(zero_copy_only=False) == 0))
            if stored:
                row = batch.slice(0, 1)
                hashed = PerfectHash.unpack(row.column("levels")[0].as_py())
                keys = np.frombuffer(row.column("digests")[0].as_py(), "u1").reshape(-1, 32)
                facts = np.frombuffer(row.column("facts")[0].as_py(), "<i8").reshape(-1, len(FACTS)).copy()
            batch = batch.slice(stored)
            if not batch.num_rows:
                continue
            own, news = keys_of(batch.column("digest")), facts_of(batch)
            member = np.zeros(len(own), bool)
            if hashed is not None:
                slot = hashed.slots(own)
                maybe = np.flatnonzero(slot >= 0)
                member[maybe] = (keys[slot[maybe]] == own[maybe]).all(1)
                to, more = slot[member], news[member]
                n, won = facts[to, 0] + more[:, 0], better(more, facts[to])
                facts[to[won]] = more[won]
                facts[to, 0] = n
            if not member.all():
                yield as_groups(own[~member], news[~member])
        if len(keys):
            yield as_groups(keys, facts)

    tasks = min(shards, 8 * partitions(index))
    return first.union(then).repartition(tasks, "shard").sortWithinPartitions("shard", "kind").mapInArrow(meet, GROUP)


def located(docs: DataFrame, gen: int, doc_id: str, text: str) -> DataFrame:
    """digest, locator and nothing else of each row, checkpointed."""
    own = pick(docs, doc_id=doc_id, text=text)
    if own.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("doc_id must be an integer")
    length = F.length(F.coalesce("text", F.lit("")))
    own = own.select(digest(F.col("text")).alias("digest"), (-length).cast("long").alias("less"), F.col("doc_id").isNull().cast("long").alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.lit(gen).cast("long").alias("gen"))
    return cut(own.withColumn("row", F.monotonically_increasing_id()))


def judged(rows: DataFrame, verdict: DataFrame, here: str = "n") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row. here: how many of `rows` have a digest."""
    facts = verdict.select("digest", F.col("n").alias("group_size"), F.col(here).alias("n"), F.when(F.col("none") == 0, F.col("doc_id")).alias("keep_id"), F.col("gen").alias("keep_gen"), F.col("row").alias("keep_row"))
    kept = (F.col("gen") == F.col("keep_gen")) & (F.col("row") == F.col("keep_row"))
    return looked_up(rows, facts, "digest").select(F.when(F.col("none") == 0, F.col("doc_id")).alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def generations(spark: SparkSession, folder: str) -> list[str]:
    """The whole generations of an index, oldest first."""
    if not exists(spark, folder):
        return []
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [x.getPath().getName() for x in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]
    return sorted(x for x in names if x.startswith("gen-") and exists(spark, f"{folder}/{x}/_SUCCESS"))


def deduplicate_batch(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What becomes of each row of a batch, given the index in `folder` (made if it is not there), which then holds the batch
    too. A row of the batch that goes before the one of history takes its place in the index."""
    spark, folder = docs.sparkSession, folder.rstrip("/")
    old = generations(spark, folder)
    gen = int(old[-1].removeprefix("gen-")) + 1 if old else 1
    rows = located(docs, gen, doc_id, text)
    own = cut(groups(rows))
    merged = cut(absorb(spark.read.schema(SHARD).parquet(f"{folder}/{old[-1]}"), own)) if old else own
    remove(spark, f"{folder}/gen-{gen:09d}")  # what a job left that failed
    build(merged, f"{folder}/gen-{gen:09d}")
    for x in old:
        remove(spark, f"{folder}/{x}")
    counts = own.select("digest", F.col("n").alias("here"))
    verdict = merged.join(counts, "digest")
    return judged(rows, cut(verdict), "here")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What becomes of each row of a table. Half of the rows, by a hash of doc_id, make the history whose digests are indexed;
    the other half is a batch that is looked up in it."""
    spark = docs.sparkSession
    rows = located(docs, 0, doc_id, text)
    early = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    path = scratch(spark, "digests")
    try:
        build(cut(groups(rows.where(early))), path)
        verdict = cut(absorb(spark.read.schema(SHARD).parquet(path), groups(rows.where(~early))))
    finally:
        remove(spark, path)
    return judged(rows, verdict)
