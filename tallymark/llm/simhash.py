"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Fingerprints of 64 bits are eight positional bytes. Two that differ in at most two bits share at least six of them. The index
posts each fingerprint under its bytes at four positions at once (a list of one byte alone would hold 1/256 of everything),
for the 14 sets of positions whose numbers have exclusive-or zero: of these any six positions hold three, which cover the
six. Each pair that meets in a list brings the list's positions; the positions are tallied over all its lists, pairs with six
or more (the guaranteed least) are kept, and the differing bits of those are counted. Pairs that share four or five bytes
meet as well, with a tally of four: the count filter drops them.

A list of more than `most` fingerprints (a large family of near copies) is taken apart by longer keys, nothing else changes:
by two more positions (any pair with six shared positions in it meets in the list of these six), and if need be by two of the
four half bytes of the other two positions, where two differing bits leave two half bytes whole. Lists of this last kind have
256 members at most. So no list of any length emits the square of its members, and no pair is lost.

Equal fingerprints are one node. A text without words has fingerprint zero, linked like any other; null and empty texts are
such. A text of any length is counted whole. Rows with a null doc_id get the component's smallest doc_id too, null if it has
none. Repeated rows are kept. An empty table gives no rows. Other columns, whatever their names, don't matter."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.llm.common import cut, pick, position, slices
from tallymark.llm.components import roots

STEP_BYTES, SEED = 2 << 20, 42
#: Fingerprints link at so many differing bits or fewer; the lists are made for two.
BITS = 2
#: Spreads the bits of a byte over the eight byte lanes of a word: lanes can be summed 255 times without carry.
LANES = np.array([sum(1 << 8 * b for b in range(8) if v >> b & 1) for v in range(256)], "<u8")


def shingle_hashes(text: bytes, size: int = 3) -> list[int]:
    """XXH64 of each shingle of a text whose ASCII letters are in lower case already; white space is ASCII's."""
    words = text.split()
    if not words:
        return []
    if len(words) < size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[: len(words) - size])]
    return [digest(line[s:e], SEED) for s, e in zip(starts, ends[size - 1 :])]


def fingerprints(texts: list[bytes | None]) -> np.ndarray:
    """The unsigned fingerprint of each text: a bit is set if it is in over half the shingles' hashes."""
    lists = [shingle_hashes(t.lower()) if t else [] for t in texts]
    n = np.array([len(x) for x in lists], "int64")
    out = np.zeros(len(texts), "<u8")
    some = np.flatnonzero(n)
    if not len(some):
        return out
    h = np.fromiter((v for x in lists for v in x), "<u8", int(n.sum())).view("u1").reshape(-1, 8)
    blocks = (n[some] + 254) // 255
    first = np.cumsum(n[some]) - n[some]
    of = np.repeat(np.arange(len(some)), blocks)
    nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts, at = first[of] + 255 * nth, np.cumsum(blocks) - blocks
    for byte in range(8):
        counts = np.add.reduceat(np.add.reduceat(LANES[h[:, byte]], starts).view("u1").reshape(-1, 8).astype("int64"), at, axis=0)
        bits = np.packbits(2 * counts > n[some, None], axis=1, bitorder="little")[:, 0]
        out[some] |= bits.astype("<u8") << np.uint64(8 * byte)
    return out


def text_hash(text: Column) -> Column:
    """Tells texts of a doc_id apart; null of null."""
    return F.when(text.isNotNull(), F.xxhash64(text.cast("binary")))


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, fp): fp is the fingerprint as a signed long, h the text's hash."""
    own = pick(docs, doc_id=doc_id, text=text)
    own = own.select("doc_id", F.col("text").cast("binary").alias("text"), text_hash(F.col("text")).alias("h"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", STEP_BYTES):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(fingerprints(part.column("text").to_pylist()).view("<i8"))], ["doc_id", "h", "fp"])

    return own.mapInArrow(run, f"doc_id {kind}, h long, fp long")


#: Lists of more fingerprints are taken apart.
MOST = 32
#: Which positions a list goes by, as bits: four each, and any six.
FOURS = [sum(1 << i for i in c) for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
SIXES = [sum(1 << i for i in c) for c in combinations(range(8), 6)]
#: Two of four half bytes.
HALVES = list(combinations(range(4), 2))


def bits_at(fp: Column, width: int, places: list[int]) -> Column:
    """The parts of a fingerprint, `width` bits each, at some places, side by side."""
    out = F.lit(0).cast("long")
    for p in places:
        out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned(fp, width * p).bitwiseAND(F.lit((1 << width) - 1)))
    return out


def positions(mask: int) -> list[int]:
    return [i for i in range(8) if mask >> i & 1]


def under(fp: Column, mask: int, halves: int = 0, extra: Column | None = None) -> Column:
    """A posting: the list's positions, which half bytes, the bytes and half bytes themselves."""
    value = bits_at(fp, 8, positions(mask))
    return F.struct(F.lit(mask).alias("mask"), F.lit(halves).alias("halves"), (value if extra is None else F.shiftleft(value, 8).bitwiseOR(extra)).alias("value"))


def by_four(postings: DataFrame) -> DataFrame:
    return postings.select("fp", F.explode(F.array(*[under(F.col("fp"), m) for m in FOURS])).alias("k")).select("fp", "k.*")


def by_six(postings: DataFrame) -> DataFrame:
    """Postings under the same positions and two more."""
    every = F.array(*[under(F.col("fp"), m) for m in SIXES])
    own = F.filter(every, lambda k: k["mask"].bitwiseAND(F.col("mask")) == F.col("mask"))
    return postings.select("fp", F.explode(own).alias("k")).select("fp", "k.*").distinct()


def by_half_bytes(postings: DataFrame) -> DataFrame:
    """Postings under the same six positions and two half bytes of the others."""
    own = F.lit(None).cast("array<struct<mask:int,halves:int,value:bigint>>")
    for m in SIXES:
        rest = [2 * i + j for i in range(8) if not m >> i & 1 for j in (0, 1)]
        own = F.when(F.col("mask") == m, F.array(*[under(F.col("fp"), m, n + 1, bits_at(F.col("fp"), 4, [rest[a], rest[b]])) for n, (a, b) in enumerate(HALVES)])).otherwise(own)
    return postings.select("fp", F.explode(own).alias("k")).select("fp", "k.*")


KEY = ["mask", "halves", "value"]


def tallies(distinct: DataFrame, most: int = MOST) -> DataFrame:
    """(u, v, shared): pairs of distinct fingerprints (column fp) that meet in a list, and how many positional bytes they are
    known to share by all lists that they meet in."""
    postings, met = by_four(distinct), []
    for finer in (by_six, by_half_bytes, None):
        lists = cut(postings.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1"))
        shared = cut(postings.join(lists, KEY))
        short = shared if finer is None else shared.where(F.col("n") <= most)
        met.append(short.withColumnRenamed("fp", "u").join(short.select(*KEY, F.col("fp").alias("v")), KEY).where("u < v").select("u", "v", "mask"))
        if finer is None or (long := shared.where(F.col("n") > most)).isEmpty():
            break
        postings = finer(long)
    return reduce(DataFrame.unionByName, met).groupBy("u", "v").agg(F.bit_count(F.bit_or("mask")).alias("shared"))


def near_links(distinct: DataFrame, most: int = MOST) -> DataFrame:
    """(u, v) of every two distinct fingerprints (column fp) that differ in at most two bits."""
    counted = tallies(distinct, most).where(F.col("shared") >= 8 - BITS)
    return counted.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= BITS).select("u", "v")


def grouped(docs: DataFrame, most: int = MOST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, h (a hash of the text), fp, root (which names the group) and component_id of each row."""
    fps = cut(with_fingerprints(docs, doc_id, text))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    root = roots(near_links(distinct.select("fp"), most))
    rooted = cut(distinct.join(cut(root.withColumnRenamed("node", "fp")), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    component = cut(rooted.join(least, "root").select("fp", "root", "component_id"))
    return fps.join(component, "fp").select("doc_id", "h", "fp", "root", "component_id")


def groups(docs: DataFrame, most: int = MOST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links)."""
    return grouped(docs, most, doc_id, text).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group: of its document with the smallest doc_id. If that has several rows in the group, the text whose
    hash is least stays, of rows with that text the one whose columns hash least. Rows without a doc_id are in nobody's way
    and stay. Column names don't matter."""
    at = {c: position(docs, c) for c in ("doc_id", "text")}
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    doc_id, text = F.col(f"c{at['doc_id']}"), F.col(f"c{at['text']}")
    chosen = grouped(docs).where("doc_id = component_id").groupBy("doc_id", "root").agg(F.min(F.struct(F.col("h").isNotNull(), "h")).alias("t"))
    chosen = chosen.select("doc_id", F.col("t.h").alias("h")).distinct()
    hashed = own.where(doc_id.isNotNull()).withColumn("h", text_hash(text))
    stays = hashed.join(chosen.withColumnRenamed("doc_id", "d"), (doc_id == F.col("d")) & hashed["h"].eqNullSafe(chosen["h"]), "left_semi")
    plain = [c for c, f in zip(own.columns, own.schema) if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    nth = F.row_number().over(Window.partitionBy(doc_id, "h").orderBy(F.xxhash64(*plain)))
    return stays.withColumn("nth", nth).where("nth = 1").select(own.columns).unionByName(own.where(doc_id.isNull())).toDF(*docs.columns)
