"""Cross-tokenizer alignment: which tokens of two tokenizers stand on the same bytes, and how often they do in the corpus.

A text, with a space before it, is encoded by a byte-level BPE (A) and a piece model with byte fallback (B). Byte offsets where
tokens of both end cut it into groups; a link is a pair of occurrences whose bytes overlap. An id pair's count is how many
links of the whole corpus are of it.

Texts are cut at single spaces between other characters, where no token of either side crosses, and what a chunk has (tokens,
groups, links) is worked out once per worker (a bounded memo). A step of texts gives its links as postings: for each id pair
the documents of the step and how often each has it, sorted, packed and dealt out by B id to BUCKETS. Each task also sums its
pairs. The sums are merged in two levels; then sums and postings meet by bucket in sorted partitions: a bucket's sums first, from
which pair counts and each B id's highest follow, then its postings, which stream by. A bucket whose postings are many is
split by steps (its sums go to each part), so a frequent id is never one task. What each posting gives to a document is added up
by step, next to the step's documents.

Null and empty texts, and those whose tokens don't give the text's bytes back, have no tokens, no links and an empty group
column. Texts of any length are taken whole (a stretch without such a space is one chunk). Repeated rows count each; an empty
table gives no rows; other columns, whatever their names, don't matter."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import cut, partitions, pick, slices

BUCKETS = 64
#: Text of a step, its documents at most (their numbers are 16 bits), pairs that a task sums before it lets go of them.
STEP_BYTES, STEP_ROWS, HELD_PAIRS = 2 << 20, 1 << 16, 1 << 20
#: Packed postings or sums of a task.
PART_BYTES = 8 << 20
#: What a worker remembers: chunks, and characters in them.
MEMO, MEMO_CHARS = 300_000, 32 << 20
#: Chunks that go through the encoders as one text.
TOGETHER = 2000
SAFE = re.compile(r"(?<=\S) (?=\S)")
ID_BITS, DOC_BITS = 20, 16
SUMS, POSTINGS, DOCUMENT = 0, 1, 2
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
U8 = np.int64


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable bytes stand for themselves, the others for the
    characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(others)}


class Aligner:
    """Tokens, groups and links of chunks, each distinct chunk worked out once."""

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        alphabet = byte_alphabet()
        special = {x: t.content for x, t in self.a.get_added_tokens_decoder().items()}
        a_bytes = {i: special[i].encode() if i in special else bytes(alphabet[c] for c in x) for x, i in self.a.get_vocab().items()}
        n = self.b.get_piece_size()
        if max(a_bytes) >= 1 << ID_BITS or n > 1 << ID_BITS:
            raise ValueError(f"ids of over {ID_BITS} bits")
        self.a_bytes = [a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)]
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.a_sizes, self.b_sizes = np.array([len(x) for x in self.a_bytes]), np.array([len(x) for x in self.b_bytes])
        self.digits = [str(i) for i in range(max(len(self.a_bytes), n))]
        self.forget()

    def forget(self, most: int = 0) -> None:
        """Lets go of what is remembered but for the `most` chunks that were needed most often, of those needed twice."""
        if not most:
            self.at: dict[str, int] = {}
            #: By chunk: its counts and whether it has tokens at all; its groups in words; its pairs (B id, A id) one after the
            #: other; how often it was needed.
            self.counts, self.sound, self.lines = np.zeros((0, 4), U8), np.zeros(0, bool), []
            self.first, self.pairs, self.used = np.zeros(1, U8), np.zeros(0, U8), np.zeros(0, U8)
        else:
            low = max(2, int(-np.partition(-self.used, most)[most]) + 1) if len(self.used) > most else 2
            keep = np.flatnonzero(self.used >= low)
            new = np.full(len(self.used), -1)
            new[keep] = np.arange(len(keep))
            to = new.tolist()
            self.at = {x: to[i] for x, i in self.at.items() if to[i] >= 0}
            self.lines = [self.lines[i] for i in keep.tolist()]
            self.pairs = self.pairs[self.places(keep)]
            self.counts, self.sound, self.used = self.counts[keep], self.sound[keep], self.used[keep] // 2
            self.first = np.concatenate([[0], np.cumsum(self.counts[:, 3])])
        self.chars = sum(map(len, self.at))

    def places(self, chunk: np.ndarray) -> np.ndarray:
        """Where the pairs of chunks lie."""
        n = self.counts[chunk, 3]
        return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[chunk], n)

    def encoded(self, chunks: list[str]) -> tuple[list[int], list[int], list[int], list[bool]]:
        """Ids of both sides, one chunk after the other, the bytes that both have of each chunk, and which chunks have tokens at
        all. The chunks that begin and end with no white space go through both encoders as one text; unless its bytes come
        back whole, each chunk goes through them by itself."""
        said = " " + " ".join(chunks)
        left, right = self.a.encode_batch_fast([said], add_special_tokens=False)[0].ids, self.b.encode(said[1:], num_threads=1)
        want = said.encode()
        if b"".join(map(self.a_bytes.__getitem__, left)) == want and b"".join(map(self.b_bytes.__getitem__, right)) == want:
            return left, right, [len(x.encode()) + 1 for x in chunks], [True] * len(chunks)
        if len(chunks) == 1:
            return [], [], [0], [False]
        middle = len(chunks) // 2
        return tuple(x + y for x, y in zip(self.encoded(chunks[:middle]), self.encoded(chunks[middle:])))  # type: ignore[return-value]

    def learn(self, chunks: list[str]) -> None:
        clean = [x for x in chunks if x and not x[0].isspace() and not x[-1].isspace()]
        chunks = clean + [x for x in chunks if not x or x[0].isspace() or x[-1].isspace()]
        a: list[int] = []
        b: list[int] = []
        sizes: list[int] = []
        sound: list[bool] = []
        for group in [clean[i : i + TOGETHER] for i in range(0, len(clean), TOGETHER)] + [[x] for x in chunks[len(clean) :]]:
            for all_, own in zip((a, b, sizes, sound), self.encoded(group)):
                all_ += own
        a_ids, b_ids = np.array(a, U8), np.array(b, U8)
        # all sound chunks lie one after the other, both sides on the same bytes
        a_end, b_end, last = np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b_sizes[b_ids]), np.cumsum(np.array(sizes, U8))
        a_start, b_start = a_end - self.a_sizes[a_ids], b_end - self.b_sizes[b_ids]
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        upto = [np.searchsorted(x, last, side="right") for x in (a_end, b_end, both)]
        low, high = np.searchsorted(b_end, a_start, side="right"), np.searchsorted(b_start, a_end, side="left")
        several = high - low
        left = np.repeat(np.arange(len(a_ids)), several)
        right = np.arange(len(left)) - np.repeat(np.cumsum(several) - several, several) + np.repeat(low, several)
        upto.append(np.concatenate([[0], np.cumsum(several)])[upto[0]])
        counts = np.stack([np.diff(x, prepend=0) for x in upto], 1).astype(U8).reshape(-1, 4)
        a_text, b_text = list(map(self.digits.__getitem__, a)), list(map(self.digits.__getitem__, b))
        a_cut, b_cut = np.searchsorted(a_end, both, side="right").tolist(), np.searchsorted(b_end, both, side="right").tolist()
        groups = [",".join(a_text[i:k]) + "|" + ",".join(b_text[j:m]) for i, k, j, m in zip([0, *a_cut], a_cut, [0, *b_cut], b_cut)]
        ends = upto[2].tolist()
        self.lines += [";".join(groups[i:k]) for i, k in zip([0, *ends], ends)]
        self.at.update(zip(chunks, range(len(self.at), len(self.at) + len(chunks))))
        self.counts, self.sound = np.concatenate([self.counts, counts]), np.concatenate([self.sound, np.array(sound, bool)])
        self.first = np.concatenate([self.first, self.first[-1] + upto[3]])
        self.pairs = np.concatenate([self.pairs, b_ids[right] << ID_BITS | a_ids[left]])
        self.used = np.concatenate([self.used, np.zeros(len(chunks), U8)])
        self.chars += sum(map(len, chunks))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, list[bytes | None], np.ndarray, np.ndarray]:
        """Counts of each text and the digest of its groups; postings (pair and text in one number, sorted) and how often each
        is."""
        if len(self.at) > MEMO or self.chars > MEMO_CHARS:
            self.forget(MEMO // 2 if self.chars <= MEMO_CHARS else 0)
        parts = [SAFE.split(x) if x else [] for x in texts]
        at = self.at
        if new := list(dict.fromkeys(w for x in parts for w in x if w not in at)):
            self.learn(new)
        sizes = np.array([len(x) for x in parts], U8)
        of = [at[w] for x in parts for w in x]
        chunk, doc = np.array(of, U8), np.repeat(np.arange(len(parts)), sizes)
        bad = np.bincount(doc[~self.sound[chunk]], minlength=len(parts)) > 0
        good = ~bad[doc]
        chunk, doc = chunk[good], doc[good]
        ends = np.concatenate([[0], np.cumsum(np.where(bad, 0, sizes))])
        sums = np.concatenate([np.zeros((1, 4), U8), np.cumsum(self.counts[chunk], 0)])
        counts = sums[ends[1:]] - sums[ends[:-1]]
        said, begin = list(map(self.lines.__getitem__, of)), (np.cumsum(sizes) - sizes).tolist()
        digests = [hashlib.sha256(";".join(said[i : i + n]).encode()).digest() if n and not b else None for i, n, b in zip(begin, sizes.tolist(), bad.tolist())]
        self.used += np.bincount(chunk, minlength=len(self.used))
        pairs = dealt_pairs(self.pairs[self.places(chunk)])
        key, times = np.unique(pairs << DOC_BITS | np.repeat(doc, self.counts[chunk, 3]), return_counts=True)
        return counts, digests, key, times


def dealt_pairs(pairs: np.ndarray) -> np.ndarray:
    """Pairs with the bucket of their B id in front."""
    return ((pairs >> ID_BITS) * 40503 >> 4) % BUCKETS << 2 * ID_BITS | pairs


@lru_cache(maxsize=2)
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays, sorted ones first as differences, compressed."""
    return zstandard.compress(np.array([len(arrays), *[len(x) for x in arrays]], "<i8").tobytes() + b"".join(x.astype("<i8").view("u1").reshape(-1, 8).T.tobytes() for x in arrays), 1)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), "u1")
    n = int(raw[:8].view("<i8")[0])
    sizes, at, out = raw[8 : 8 + 8 * n].view("<i8").tolist(), 8 + 8 * n, []
    for size in sizes:
        out.append(np.ascontiguousarray(raw[at : at + 8 * size].reshape(8, size).T).view("<i8").reshape(-1))
        at += 8 * size
    return out


def added_up(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sum of each."""
    key, value = np.concatenate([*keys, np.zeros(0, U8)]), np.concatenate([*sums, np.zeros(0, U8)])
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, U8)
    return key[start], np.add.reduceat(value, start) if len(start) else value


def by_bucket(key: np.ndarray, low: int) -> Iterator[tuple[int, slice]]:
    """The buckets that sorted keys have, whose number stands above `low` bits."""
    ends = np.searchsorted(key, np.arange(BUCKETS + 1) << low)
    for bucket in range(BUCKETS):
        if ends[bucket] < ends[bucket + 1]:
            yield bucket, slice(int(ends[bucket]), int(ends[bucket + 1]))


def delta(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0)


def bearing(kind: str) -> str:
    return f"kind int, bucket int, step long, blob binary, place int, doc_id {kind}, " + ", ".join(f"{x} long" for x in COUNTS) + ", digest binary"


def rows(kind: list[int], bucket: list[int], step: list[int], blob: list[bytes], schema: pa.Schema) -> pa.RecordBatch:
    empty = [pa.nulls(len(kind), x.type) for x in list(schema)[4:]]
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(step, pa.int64()), pa.array(blob, pa.binary()), *empty], schema=schema)


def postings(own: DataFrame, a: str, b: str) -> DataFrame:
    """Of each step its documents and its postings, of each task the sums of its pairs."""
    schema = bearing(own.schema["doc_id"].dataType.simpleString())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, step = aligner(a, b), TaskContext.get().partitionId() << 32
        keys: list[np.ndarray] = []
        sums: list[np.ndarray] = []
        shape = None

        def flush() -> Iterator[pa.RecordBatch]:
            key, n = added_up(keys, sums)
            for bucket, at in by_bucket(key, 2 * ID_BITS):
                yield rows([SUMS], [bucket], [step], [packed(delta(key[at]), n[at])], shape)

        for part in slices(batches, "text", STEP_BYTES):
            for start in range(0, part.num_rows, STEP_ROWS):
                some = part.slice(start, STEP_ROWS)
                counts, digests, key, times = work(some.column("text").to_pylist())
                n, step = some.num_rows, step + 1
                kind, ids = pa.array([DOCUMENT] * n, pa.int32()), some.column("doc_id")
                shape = shape or pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("step", pa.int64()), ("blob", pa.binary()), ("place", pa.int32()), ("doc_id", ids.type), *[(x, pa.int64()) for x in COUNTS], ("digest", pa.binary())])
                yield pa.RecordBatch.from_arrays([kind, pa.nulls(n, pa.int32()), pa.array([step] * n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(range(n), pa.int32()), ids, *[pa.array(counts[:, i]) for i in range(4)], pa.array(digests, pa.binary())], schema=shape)
                pair, doc = key >> DOC_BITS, key & (1 << DOC_BITS) - 1
                for bucket, at in by_bucket(pair, 2 * ID_BITS):
                    each, runs = np.unique(pair[at], return_counts=True)
                    yield rows([POSTINGS], [bucket], [step], [packed(delta(each), runs, doc[at], times[at])], shape)
                each, total = added_up([pair], [times])
                keys.append(each)
                sums.append(total)
                if sum(map(len, keys)) > HELD_PAIRS:
                    merged = added_up(keys, sums)
                    keys, sums = [merged[0]], [merged[1]]
                    if len(merged[0]) > HELD_PAIRS // 2:
                        yield from flush()
                        keys, sums = [], []
        if keys:
            yield from flush()

    return own.mapInArrow(encode, schema)


def merged(sums: DataFrame, *keys: str) -> DataFrame:
    """Sums added up by bucket and what else is named. A task holds the distinct pairs of one bucket."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, n = None, [], []

        def one() -> pa.RecordBatch:
            key, total = added_up(held, n)
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([packed(delta(key), total)], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            for *which, blob in zip(*[batch.column(x).to_pylist() for x in (*keys, "blob")]):
                if held and which != at:
                    yield one()
                    held, n = [], []
                at = which
                key, more = unpacked(blob)
                held.append(np.cumsum(key))
                n.append(more)
                if sum(map(len, held)) > HELD_PAIRS:
                    key, total = added_up(held, n)
                    held, n = [key], [total]
        if held:
            yield one()

    return sums.select(*keys, "blob").repartition(partitions(sums), *keys).sortWithinPartitions(*keys).mapInArrow(add, "bucket int, blob binary")


def parts(found: DataFrame, kind: int) -> Column:
    """In how many parts the rows of a kind go, by bucket."""
    sizes = {r["bucket"]: r["n"] for r in found.where(F.col("kind") == kind).groupBy("bucket").agg(F.sum(F.length("blob")).alias("n")).collect()}
    return F.element_at(F.array(*[F.lit(1 + sizes.get(i, 0) // PART_BYTES) for i in range(BUCKETS)]), F.col("bucket") + 1)


def contributions(found: DataFrame, totals: DataFrame) -> DataFrame:
    """(step, blob): what the postings of a bucket give to the documents of a step."""
    n = parts(found, POSTINGS)
    first = totals.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))).alias("part"), F.lit(SUMS).alias("kind"), F.lit(0).cast("long").alias("step"), "blob")
    then = found.where(F.col("kind") == POSTINGS).select("bucket", F.pmod(F.xxhash64("step"), n).cast("long").alias("part"), "kind", "step", "blob")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, best = (np.zeros(0, U8),) * 3
        for batch in batches:
            steps, blobs = [], []
            for kind, step, blob in zip(*[batch.column(x).to_pylist() for x in ("kind", "step", "blob")]):
                if kind == SUMS:
                    keys, sums = unpacked(blob)
                    keys = np.cumsum(keys)
                    start = np.flatnonzero(np.diff(keys >> ID_BITS, prepend=-1))
                    best = np.repeat(np.maximum.reduceat(sums, start), np.diff([*start, len(keys)]))
                    continue
                each, runs, doc, times = unpacked(blob)
                at = np.repeat(np.searchsorted(keys, np.cumsum(each)), runs)
                own, of = np.unique(doc, return_inverse=True)
                n_best, total = np.zeros(len(own), U8), np.zeros(len(own), U8)
                np.add.at(n_best, of, times * (sums[at] == best[at]))
                np.add.at(total, of, times * sums[at])
                steps.append(step)
                blobs.append(packed(delta(own), n_best, total))
            if steps:
                yield pa.RecordBatch.from_arrays([pa.array(steps, pa.int64()), pa.array(blobs, pa.binary())], ["step", "blob"])

    both = first.union(then).repartition(partitions(found), "bucket", "part").sortWithinPartitions("bucket", "part", "kind")
    return both.mapInArrow(count, "step long, blob binary")


def summed(found: DataFrame, given: DataFrame) -> DataFrame:
    """The documents with all that was given to them."""
    kind = found.schema["doc_id"].dataType.simpleString()
    own = ["place", "doc_id", *COUNTS, "digest"]
    first = given.select("step", F.lit(0).alias("kind"), "blob", *[F.lit(None).cast(found.schema[x].dataType).alias(x) for x in own])
    then = found.where(F.col("kind") == DOCUMENT).select("step", "kind", "blob", *own)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n_best, total = None, np.zeros(STEP_ROWS, U8), np.zeros(STEP_ROWS, U8)
        for batch in batches:
            step, kinds = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("step", "kind"))
            ends = [*(np.flatnonzero(np.diff(step) | np.diff(kinds)) + 1).tolist(), len(step)] if len(step) else []
            for start, end in zip([0, *ends], ends):
                some = batch.slice(start, end - start)
                if step[start] != at:
                    at = step[start]
                    n_best[:], total[:] = 0, 0
                if kinds[start] == 0:
                    for blob in some.column("blob").to_pylist():
                        doc, best, more = unpacked(blob)
                        doc = np.cumsum(doc)
                        n_best[doc] += best
                        total[doc] += more
                else:
                    place = some.column("place").to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([some.column("doc_id"), *[some.column(x) for x in COUNTS], pa.array(n_best[place]), pa.array(total[place]), some.column("digest")], ["doc_id", *COUNTS, "n_best", "count_sum", "digest"])

    both = first.union(then).repartition(partitions(found), "step").sortWithinPartitions("step", "kind")
    out = both.mapInArrow(add, f"doc_id {kind}, " + ", ".join(f"{x} long" for x in [*COUNTS, "n_best", "count_sum"]) + ", digest binary")
    return out.select("doc_id", *COUNTS, "n_best", "count_sum", F.coalesce(F.lower(F.hex("digest")), F.lit("")).alias("groups_sha256"))


def align(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row. a: a file of the byte-level BPE, b:
    of the piece model."""
    found = cut(postings(pick(docs, doc_id=doc_id, text=text), a, b))
    sums = found.where(F.col("kind") == SUMS)
    halfway = merged(sums.withColumn("part", F.pmod(F.xxhash64("step"), parts(found, SUMS)).cast("long")), "bucket", "part")
    totals = cut(merged(halfway, "bucket"))
    return summed(found, contributions(found, totals))


def pair_counts(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(a_id, b_id, n): how many links of the corpus are of each pair of ids."""
    sums = postings(pick(docs, doc_id=doc_id, text=text), a, b).where(F.col("kind") == SUMS)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                key, n = unpacked(blob)
                key = np.cumsum(key) & (1 << 2 * ID_BITS) - 1
                yield pa.RecordBatch.from_arrays([pa.array(key & (1 << ID_BITS) - 1), pa.array(key >> ID_BITS), pa.array(n)], ["a_id", "b_id", "n"])

    return merged(sums, "bucket").mapInArrow(spell, "a_id long, b_id long, n long")
