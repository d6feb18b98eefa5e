"""Packing by power-of-two decomposition.

Each document's token ids (end id included) are cut into pieces whose lengths are the powers of two in the binary
form of its length, the longest (the sequence limit) first. A piece is a sequence of its own: no sequence crosses
documents, none is padded, and sequences of equal length form one bucket, numbered without gaps.
A null or empty text is the end id alone, a text of any length is packed whole. Repeated rows are packed each; rows with a null
doc_id too. An empty table gives no rows; other columns, whatever their names, don't matter."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import cut, pick, slices

#: Distinct chunks and distinct words that a worker remembers before it starts anew, and the text of one step.
MEMO, BARE, STEP_BYTES = 1_000_000, 1_000_000, 4 << 20
#: Parts whose sums are taken together.
TOGETHER = 1024
#: Words by which a worker finds out whether the vocabulary's merges alone give the ids of plain words.
PROBES = 2000
#: Marks that may close a word; a run of them is one word to the vocabulary.
MARKS = ".,;:!?*$%&#|"


class Ids:
    """Token ids, as little-endian bytes, of texts whose vocabulary drops white space: what stands between two
    white spaces is encoded by itself, the same in each text, so each distinct chunk is encoded once. A chunk of letters
    and closing marks is put together from its lower-case letters and its marks, as the vocabulary does. Words of a to z go
    to the vocabulary's merges at once, if these are found to give the same ids as the whole tokenizer, which has nothing to
    normalise or to split there."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        probes = [t.removesuffix("</w>") for t in sorted(vocabulary) if t.endswith("</w>") and self.plain(t.removesuffix("</w>"))]
        probes = probes[:: max(1, len(probes) // PROBES)]
        added = any(self.plain(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.direct = not added and self.merged(probes) == self.encode(probes)
        self.memo: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def encode(self, chunks: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    @staticmethod
    def plain(piece: str) -> bool:
        return piece.isascii() and piece.isalpha() and piece.islower()

    def merged(self, pieces: list[str]) -> list[bytes]:
        tokenize = self.tokenizer.model.tokenize
        got = [[t.id for t in tokenize(x)] for x in pieces]
        every, at = np.array([i for x in got for i in x], "<u4").tobytes(), [0, *accumulate(4 * len(x) for x in got)]
        return [every[s:e] for s, e in zip(at, at[1:])]

    def encode_bare(self, pieces: list[str]) -> list[bytes]:
        """Of pieces that are one word to the vocabulary each: encoded in a line, cut after each word's last token."""
        got = np.array(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        at = (np.flatnonzero(self.ends[got]) + 1).tolist()
        if len(at) != len(pieces):
            return self.encode(pieces)
        return [got[s:e].tobytes() for s, e in zip([0, *at], at)]

    def learn(self, chunks: set[str]) -> None:
        simple, rest, bare = [], [], self.bare
        for x in chunks:
            stem = x.rstrip(MARKS)
            low = stem.lower()
            # letters before and after: a letter in lower case can be more than letters
            if stem.isalpha() and low.isalpha() and "\u03a3" not in stem and is_normalized("NFC", stem):
                simple.append((x, low, x[len(stem) :]))
            else:
                rest.append(x)
        unseen = list({y for x in simple for y in x[1:] if y and y not in bare})
        if unseen:
            plain = [x for x in unseen if self.plain(x)] if self.direct else []
            bare.update(zip(plain, self.merged(plain)))
            unseen = [x for x in unseen if x not in bare]
        if unseen:
            bare.update(zip(unseen, self.encode_bare(unseen)))
        self.memo.update([(x, bare[stem] + bare[end] if end else bare[stem]) for x, stem, end in simple])
        self.memo.update(zip(rest, self.encode(rest)))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if len(self.memo) > MEMO:
            self.memo = {}
        if len(self.bare) > BARE:
            self.bare = {}
        parts = [(x or "").split() for x in texts]
        unseen: set[str] = set()
        for x in parts:
            unseen.update([w for w in x if w not in self.memo])
        self.learn(unseen)
        # Python, unlike the vocabulary, takes four control characters for white space
        return [self.encode([t])[0] if t and any(c in t for c in "\x1c\x1d\x1e\x1f") else b"".join(map(self.memo.__getitem__, x)) for t, x in zip(texts, parts)]


@lru_cache(maxsize=2)
def ids(path: str) -> Ids:
    return Ids(path)


def binary_lengths(n: int, most: int) -> list[int]:
    """Full sequences first, then the powers of two of the rest, falling."""
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 1, -1, -1) if (n % most) >> k & 1]


def starts(counts: DataFrame) -> DataFrame:
    """(bucket, part, before): how many pieces come before those of a bucket and part; buckets fall, parts rise. Sums of
    buckets, of TOGETHER parts, and of parts among them: no task holds all parts."""
    own = counts.withColumn("many", F.floor(F.col("part") / TOGETHER))
    many = own.groupBy("bucket", "many").agg(F.sum("n").alias("n"))
    most = many.groupBy("bucket").agg(F.sum("n").alias("n"))  # a row for each power of two
    upto = lambda w, name: (F.sum("n").over(w) - F.col("n")).alias(name)
    a = most.select("bucket", upto(Window.orderBy(F.desc("bucket")), "a"))
    b = many.select("bucket", "many", upto(Window.partitionBy("bucket").orderBy("many"), "b"))
    c = own.select("bucket", "many", "part", upto(Window.partitionBy("bucket", "many").orderBy("part"), "c"))
    return c.join(b, ["bucket", "many"]).join(a, "bucket").select("bucket", "part", (F.col("a") + F.col("b") + F.col("c")).alias("before"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, most: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and bucket (log2 of the
    length). Pieces are written once; numbers follow from counts of each written part and bucket."""
    if most < 1 or most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")
    own = pick(docs, doc_id=doc_id, text=text)
    kind = own.schema["doc_id"].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")
    names = ["start", "length", "ids_crc32", "doc_tokens", "bucket", "nth"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = ids(tokenizer), [0] * (most.bit_length() + 1)
        for part in slices(batches, "text", STEP_BYTES):
            row, out = [], [[] for _ in names]
            for i, b in enumerate(encode(part.column("text").to_pylist())):
                b += end
                n, start = len(b) // 4, 0
                for size in binary_lengths(n, most):
                    k = size.bit_length() - 1
                    row.append(i)
                    for to, v in zip(out, (start, size, zlib.crc32(b[4 * start : 4 * (start + size)]), n, k, seen[k])):
                        to.append(v)
                    start += size
                    seen[k] += 1
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in out)], ["doc_id", *names])

    made = cut(own.mapInArrow(pieces, f"doc_id {kind}, " + ", ".join(f"{x} long" for x in names)).withColumn("part", F.spark_partition_id()))
    # a row for each bucket and task at most; Spark broadcasts them if they are few
    before = starts(made.groupBy("bucket", "part").agg(F.count("*").alias("n")))
    return made.join(before, ["bucket", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("bucket").cast("int").alias("bucket"))
