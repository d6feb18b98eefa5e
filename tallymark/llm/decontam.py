"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all other characters beyond ASCII. A window is ten
consecutive words of a benchmark item; an item with one to nine words is one window by itself. Of the six five-word grams in a
window the least hash is kept, so whatever ten words a document shares with an item, both keep the same gram of it. An item of
fewer words keeps the hash of them all.

A document's kept grams are looked up in a filter of bounded size (a Bloom filter of the benchmark's kept grams, at most
FILTER_BITS), which lets few others pass. What passes is joined to the benchmark's fingerprints by Spark, on the gram and two
independent 64-bit hashes of the whole window: the gram brings the two together, the hashes extend the hit to the ten words.
Spark chooses how to join by the sizes, so a benchmark of any size is joined in one scan. Texts are told apart by a digest:
copies of a text of any number are one text in the joins, and get their results at the end.

Documents' rows are kept one for one, repeated rows too. Null and empty texts have no words; texts of any length are searched
whole. An item without words has no window. Items with a null id mark words as hit but are listed nowhere; rows with equal
item_id are one item. Empty tables give no rows, or no hits. Other columns, whatever their names, don't matter."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.llm.common import cut, pick, position, slices
from tallymark.llm.spans import FACTORS, U, Words, grams, layout, scramble

WINDOW, GRAM = 10, 5
STEP_BYTES = 2 << 20
#: The filter has so many bits for each kept gram, FILTER_BITS at most, and looks at PROBES of them.
BITS_EACH, FILTER_BITS, PROBES = 24, 1 << 27, 3
#: Letters in lower case and bytes beyond ASCII belong to words; all else is white space.
PLAIN = np.full(256, 32, "u1")
PLAIN[48:58], PLAIN[97:123], PLAIN[65:91], PLAIN[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)
WINDOWS = "gram long, w0 long, w1 long, n int"


def plain_words(texts: pa.Array) -> Words:
    data, at = layout(texts)
    return Words(PLAIN[data], at)


class Windows:
    """All windows of `size` words, as their kept gram and two hashes; size is WINDOW, or the length of short items."""

    def __init__(self, words: Words, size: int):
        self.at = words.windows(size)
        self.lanes = [grams(words.hashes(i), size, i, self.at) + FACTORS[i][size] for i in (0, 1)]
        if size < WINDOW:
            self.gram = scramble(self.lanes[0] ^ self.lanes[1])
            return
        h = grams(words.hashes(0), GRAM, 0)
        least = h[: max(len(h) - (WINDOW - GRAM), 0)]
        for i in range(1, WINDOW - GRAM + 1):
            least = np.minimum(least, h[i : i + len(least)])
        self.gram = scramble(least[self.at] + FACTORS[0][0])


def item_windows(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """gram, w0, w1, n and item of every window of every item."""
    own = pick(benchmark, item=item_id, text=text).where(F.col("text").isNotNull()).select(F.col("item").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", STEP_BYTES):
            words = plain_words(part.column("text"))
            for size in range(1, WINDOW + 1):
                own = Windows(words, size)
                doc = words.doc[own.at]
                fits = np.ones(len(doc), bool) if size == WINDOW else words.n[doc] == size
                columns = [pa.array(x[fits].view("i8")) for x in (own.gram, *own.lanes)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(fits.sum(), size, "i4")), part.column("item").take(pa.array(doc[fits]))], ["gram", "w0", "w1", "n", "item"])

    return own.mapInArrow(run, f"{WINDOWS}, item string").distinct()


def places(gram: np.ndarray, bits: int) -> list[np.ndarray]:
    """Where a filter has the bits of these grams."""
    return [scramble(gram + U(i)) & U(bits - 1) for i in range(PROBES)]


def filter_of(windows: DataFrame) -> np.ndarray:
    """A Bloom filter of the windows' grams, as bytes; a few tasks make a part each."""
    distinct = windows.select("gram").distinct()
    bits = min(FILTER_BITS, max(1 << 13, 1 << math.ceil(math.log2(BITS_EACH * max(distinct.count(), 1)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for batch in batches:
            for at in places(batch.column("gram").to_numpy(zero_copy_only=False).view("u8"), bits):
                own[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], ["bits"])

    out = np.zeros(bits // 8, "u1")
    for r in distinct.repartition(4).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(bytes(r["bits"]), "u1")
    return out


def digests(texts: list[bytes | None]) -> np.ndarray:
    """Two numbers that tell texts apart."""
    return np.frombuffer(b"".join([blake2b(x or b"", digest_size=16).digest() for x in texts]) + bytes(16), "<i8").reshape(-1, 2)[: len(texts)]


def met_windows(docs: DataFrame, fits: np.ndarray, sizes: list[int]) -> DataFrame:
    """k0, k1 (the text), start and the window of all windows whose gram the filter lets pass. One scan."""
    sent = docs.sparkSession.sparkContext.broadcast(fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = 8 * len(sent.value)
        for part in slices(batches, "text", STEP_BYTES):
            words, key = plain_words(part.column("text")), None
            for size in sizes:
                own = Windows(words, size)
                met = np.ones(len(own.at), bool)
                for at in places(own.gram, bits):
                    met[met] = (sent.value[at[met] >> U(3)] >> (at[met] & U(7)).astype("u1")) & 1 > 0
                if not met.any():
                    continue
                key = digests(part.column("text").to_pylist()) if key is None else key
                at = own.at[met]
                doc = words.doc[at]
                columns = [*(key[doc, i] for i in (0, 1)), at - words.first[doc], *(x[met].view("i8") for x in (own.gram, *own.lanes))]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x)) for x in columns), pa.array(np.full(len(at), size, "i4"))], ["k0", "k1", "start", "gram", "w0", "w1", "n"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, f"k0 long, k1 long, start long, {WINDOWS}")


WHICH = ["gram", "w0", "w1", "n"]


def hits(docs: DataFrame, benchmark: DataFrame, item_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(windows, items): k0, k1, start, n and set (of items, by two numbers) of each window that a text shares with the
    benchmark, and the items of each set. docs: column text."""
    items = cut(item_windows(benchmark, item_id, text))
    sizes = sorted(r["n"] for r in items.select("n").distinct().collect())  # ten at most
    own = F.coalesce(F.xxhash64("item"), F.lit(0)), F.coalesce(F.xxhash64("item", F.lit("b")), F.lit(0))
    # windows of the same items share a set: its items are listed once
    windows = cut(items.groupBy(*WHICH).agg(F.sum(F.shiftright(own[0], 8)).alias("s0"), F.sum(F.shiftright(own[1], 8)).alias("s1")))
    first = windows.groupBy("s0", "s1").agg(F.min(F.struct(*WHICH)).alias("w")).select("s0", "s1", "w.*")
    members = items.where(F.col("item").isNotNull()).join(first, WHICH).select("s0", "s1", "item")
    # repeated texts meet here and are one
    met = met_windows(docs, filter_of(windows), sizes).join(windows, WHICH).select("k0", "k1", "start", "n", "s0", "s1").distinct()
    return met, members


def keyed(docs: DataFrame, at: int) -> DataFrame:
    """`docs` with columns c0, c1, ..., and n_words, k0, k1 of the text, which is column `at`."""
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, f"c{at}", STEP_BYTES):
            key = digests(part.column(at).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(plain_words(part.column(at)).n.astype("i8")), *(pa.array(np.ascontiguousarray(key[:, i])) for i in (0, 1))], [*part.schema.names, "n_words", "k0", "k1"])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, *(T.StructField(x, T.LongType()) for x in ("n_words", "k0", "k1"))]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document."""
    own = pick(docs, doc_id=doc_id, text=text)
    found, members = hits(own, benchmark, item_id, item_text)
    found = cut(found)
    # a text's windows in order: what each adds to those before it
    before = F.max(F.col("start") + F.col("n")).over(Window.partitionBy("k0", "k1").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1))
    adds = F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", F.coalesce(before, F.lit(0))))
    covered = found.select("k0", "k1", adds.alias("adds")).groupBy("k0", "k1").agg(F.sum("adds").alias("n_hit"))
    listed = found.select("k0", "k1", "s0", "s1").distinct().join(members, ["s0", "s1"]).select("k0", "k1", "item").distinct()
    names = listed.groupBy("k0", "k1").agg(F.array_sort(F.collect_list("item")).alias("items"))
    of_text = cut(covered.join(names, ["k0", "k1"], "left"))
    n_hit, items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return keyed(own, 1).join(of_text, ["k0", "k1"], "left").select(
        F.col("c0").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that share no window with the benchmark, whatever their columns are called."""
    found, _ = hits(pick(docs, text="text"), benchmark, "item_id", "text")
    dirty = cut(found.select("k0", "k1").distinct())
    return keyed(docs, position(docs, "text")).join(dirty, ["k0", "k1"], "left_anti").select([f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
