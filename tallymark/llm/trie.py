"""Conversation prefix trie, by a distributed MSD radix partitioning over dictionary-encoded turns.

Each distinct turn (role and text) gets a number; a conversation is the row of its turns' numbers, 8 bytes a turn, and equal
conversations are one row with a count. A bucket is a prefix that sequences share. In a round the sequences of all open buckets
go as far as they agree (one step, however many turns) and are dealt out by their next turn: every bucket that comes out is a
node, counted by partial sums; those of more than `local` turns in several sequences are open in the next round, the others are
finished in one task each by multikey quicksort, which meets its nodes on the way. Leaves and saved tokens are then added up from the last round to the first. Which sequences
belong to open buckets is looked up in a table of those buckets, the frequent ones by broadcast, so no turn that many
conversations begin with gathers them.

Conversations are ordered by turn (null first), rows of one turn number by role and text, repeated rows count each; null roles
and texts are empty; rows without a conversation are dropped. A conversation that has no turn left ends at the root. The
ids of the conversations that end at a node are hashed in order as a stream: sorted ranges first write them in chunks, which then
pass through one task a node. Texts of any length leave the operator's way once they are numbered. An empty table gives no
nodes; other columns, whatever their names, don't matter."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import SHARES, cut, looked_up, partitions, pick

#: Turns of a bucket that a task finishes.
LOCAL = 1 << 18
CHUNK_BYTES = 1 << 20
NOTHING = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, ids and words (by turn: its number, and how many words it has) of each conversation."""
    own = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text").where(F.col("conv_id").isNotNull())
    own = own.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    told = F.concat_ws("\x00", F.octet_length("role").cast("string"), "role", "text")
    turns = cut(own.select("conv_id", place.alias("place"), F.unhex(F.sha2(told, 256)).alias("turn"), F.size(F.regexp_extract_all("text", F.lit(f"({WORD})"))).alias("words")))
    numbers = cut(turns.groupBy("turn").agg(F.count("*").alias("n"))).withColumn("id", F.monotonically_increasing_id())
    said = looked_up(turns, cut(numbers), "turn").select("conv_id", F.struct("place", "id", "words").alias("said"))
    got = said.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("said"))
    return got.select("conv_id", F.col("said.id").alias("ids"), F.col("said.words").alias("words"))


def regrafted(own: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations (conv_id, ids, words) whose first h turns are those of the conversation conv_id - conv_id % every (all if it
    has fewer, none if it is absent); h is the CRC-32 of the id's digits modulo `most`."""
    heads = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("ids", 1, most - 1).alias("head"), F.slice("words", 1, most - 1).alias("head_words"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    base = (F.col("conv_id") - F.col("conv_id") % every).alias("base")

    def joined(head: str, rest: str) -> Column:
        before = F.coalesce(F.slice(F.col(head), F.lit(1), F.col("h")), F.array().cast("array<long>"))
        return F.concat(before, F.slice(F.col(rest), F.col("h") + 1, F.greatest(F.size(rest), F.lit(1))).cast("array<long>")).alias(rest)

    return own.select("*", base, h.alias("h")).join(heads, "base", "left").select("conv_id", joined("head", "ids"), joined("head_words", "words"))


def hashed(streams: DataFrame) -> DataFrame:
    """(key, sha): SHA-256 of the conv_ids of each key, ascending, with commas between. `streams` has key and conv_id; it is
    read twice."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {"key": [], "first": [], "ids": []}

        def done() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held["key"], pa.binary()), pa.array(held["first"], pa.int64()), pa.array([",".join(x).encode() for x in held["ids"]], pa.binary())], ["key", "first", "ids"])
            for x in held.values():
                x.clear()
            return out

        size = 0
        for batch in batches:
            for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if not held["key"] or held["key"][-1] != key or size > CHUNK_BYTES:
                    if len(held["key"]) >= 4096 or size > CHUNK_BYTES:
                        yield done()
                    held["key"].append(key)
                    held["first"].append(conv)
                    held["ids"].append([])
                    size = 0
                held["ids"][-1].append(str(conv))
                size += len(held["ids"][-1][-1]) + 1
        if held["key"]:
            yield done()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            keys, shas = [], []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if key != at:
                    if state is not None:
                        keys.append(at)
                        shas.append(state.hexdigest())
                    at, state = key, hashlib.sha256(ids)
                else:
                    state.update(b"," + ids)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shas, pa.string())], ["key", "sha"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "sha"])

    n = partitions(streams)
    chunks = streams.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(write, "key binary, first long, ids binary")
    return chunks.repartition(n, "key").sortWithinPartitions("key", "first").mapInArrow(digest, "key binary, sha string")


def distinct(convs: DataFrame) -> DataFrame:
    """Equal conversations as one: ids, words, n, conv (the smallest conv_id) and ends (the digest of all conv_ids)."""
    key = F.unhex(F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256))
    convs = cut(convs.select(key.alias("key"), "conv_id", "ids", "words"))
    own = convs.groupBy("key", "ids", "words").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"))
    return own.join(hashed(convs.select("key", "conv_id")), "key").select("ids", "words", "n", "conv", F.col("sha").alias("ends"))


class Finished:
    """The nodes of a bucket: sequences (distinct, with counts) that share their first `start` turns, put in order by
    multikey quicksort. Columns of nodes, the bucket's own node first, and how far each lies from the start."""

    def __init__(self, ids: list[np.ndarray], words: list[np.ndarray], n: np.ndarray, conv: np.ndarray, ends: list[str], start: int, parent: int | None):
        self.ids, self.words, self.n, self.conv, self.ends = ids, words, n, conv, ends
        self.size = np.array([len(x) for x in ids], "i8")
        self.flat = np.concatenate([*ids, np.zeros(1, "i8")])
        self.at = np.cumsum(self.size) - self.size
        self.out: list[tuple] = []  # conv, depth, parent's conv, n, words of the last turn, ends, parent's number, leaves and saved of a tail
        self.tails: list[tuple] = []
        self.sort(start, parent)

    def turn(self, some: np.ndarray, depth: int) -> np.ndarray:
        """The turn at a depth of each sequence; -1 where it has ended."""
        here = self.size[some] > depth
        return np.where(here, self.flat[np.where(here, self.at[some] + depth, -1)], -1)

    def node(self, some: np.ndarray, depth: int, parent: int | None, up: int) -> tuple[int, int]:
        first = some[int(np.argmin(self.conv[some]))]
        conv = int(self.conv[first])
        words = int(self.words[first][depth - 1]) if depth else 0
        over = some[self.size[some] == depth]
        self.out.append([conv, depth, parent, int(self.n[some].sum()), words, self.ends[over[0]] if len(over) else NOTHING, up])
        return conv, len(self.out) - 1

    def sort(self, start: int, parent: int | None) -> None:
        everything = np.arange(len(self.size))
        stack = [(everything, start, parent, -1, True)]
        while stack:
            some, depth, parent, up, new = stack.pop()
            if new:  # all of `some` share their first `depth` turns
                if len(some) == 1:
                    self.tails.append((int(some[0]), depth, parent, up))
                    continue
                parent, up = self.node(some, depth, parent, up)
                some = some[self.size[some] > depth]
                if len(some):
                    stack.append((some, depth, parent, up, False))
                continue
            key = self.turn(some, depth)
            low, mid, high = sorted((key[0], key[len(key) // 2], key[-1]))
            for part in (some[key < mid], some[key > mid]):
                if len(part):
                    stack.append((part, depth, parent, up, False))
            stack.append((some[key == mid], depth + 1, parent, up, True))

    def columns(self) -> tuple[list[np.ndarray | list], int]:
        """Columns as in NODE, and which row is the bucket's own node."""
        m = len(self.out)
        children, leaves, saved = np.zeros(m, "i8"), np.zeros(m, "i8"), np.zeros(m, "i8")
        rows, top = [], 0
        for i, depth, parent, up in self.tails:
            size, n, conv = int(self.size[i]), int(self.n[i]), int(self.conv[i])
            length = size - depth + 1
            words = np.asarray(self.words[i], "i8")[max(depth - 1, 0) :] if size else np.zeros(0, "i8")
            worth = (n - 1) * (words if depth else np.concatenate([[0], words]))
            sums = np.cumsum(worth[::-1])[::-1]
            if up >= 0:
                children[up] += 1
                leaves[up] += 1
                saved[up] += sums[0]
            rows.append((conv, depth, length, parent, n, sums, self.ends[i]))
        for k in range(m - 1, -1, -1):
            conv, depth, parent, n, words, _, up = self.out[k]
            saved[k] += (n - 1) * words
            leaves[k] += not children[k]
            if up >= 0:
                children[up] += 1
                leaves[up] += leaves[k]
                saved[up] += saved[k]
        own = [[x[i] for x in self.out] for i in range(6)]
        out = [own[0], own[1], own[2], own[3], children.tolist(), leaves.tolist(), saved.tolist(), own[5]]
        for conv, depth, length, parent, n, sums, ends in rows:
            out[0] += [conv] * length
            out[1] += range(depth, depth + length)
            out[2] += [parent] + [conv] * (length - 1)
            out[3] += [n] * length
            out[4] += [1] * (length - 1) + [0]
            out[5] += [1] * length
            out[6] += sums.tolist()
            out[7] += [NOTHING] * (length - 1) + [ends]
        return out, top


def finish(buckets: DataFrame) -> DataFrame:
    """The nodes of small buckets (bucket, top, up, parent and their sequences); `up` is the open bucket above a bucket's own node
    and null for the nodes below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def one() -> list:
            table = pa.Table.from_batches(held)
            lists = [[x.values.to_numpy(zero_copy_only=False) for x in table.column(c)] for c in ("ids", "words")]
            n, conv = (table.column(c).to_numpy() for c in ("n", "conv"))
            start, parent, up = (table.column(c)[0].as_py() for c in ("top", "parent", "up"))
            out, top = Finished(*lists, n, conv, table.column("ends").to_pylist(), start, parent).columns()
            ups = [None] * len(out[0])
            if ups:
                ups[top] = up
            return [*out, ups]

        def batch_of(found: list[list]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.string(), pa.binary()]
            names = [x.split()[0] for x in NODE.split(", ")] + ["up"]
            return pa.RecordBatch.from_arrays([pa.array([v for x in found for v in x[i]], kinds[i]) for i in range(9)], names)

        found, size = [], 0
        for batch in batches:
            keys = batch.column("bucket").to_pylist()
            cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
            for begin, end in zip([0, *cuts], cuts):
                if held and keys[begin] != at:
                    found.append(one())
                    size += len(found[-1][0])
                    held = []
                    if size > 50_000:
                        yield batch_of(found)
                        found, size = [], 0
                at = keys[begin]
                held.append(batch.slice(begin, end - begin))
        if held:
            found.append(one())
        if found:
            yield batch_of(found)

    dealt = buckets.repartition(partitions(buckets), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, f"{NODE}, up binary")


def marked(rows: DataFrame, marks: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose bucket has a mark, with it, and the others. Marks (bucket, seqs and more), n of them, are broadcast if there are
    no more than SHARES; else those that hold one in SHARES of their rows are, and the rest meet in an exchange."""
    facts = marks.drop("seqs")
    if n <= SHARES:
        return rows.join(F.broadcast(facts), "bucket"), rows.join(F.broadcast(facts.select("bucket")), "bucket", "left_anti")
    total = marks.agg(F.sum("seqs")).first()[0]
    hot, cold = F.broadcast(marks.where(F.col("seqs") * SHARES > total).drop("seqs")), marks.where(F.col("seqs") * SHARES <= total).drop("seqs")
    rest = rows.join(hot.select("bucket"), "bucket", "left_anti")
    return rows.join(hot, "bucket").unionByName(rest.join(cold, "bucket")), rest.join(cold.select("bucket"), "bucket", "left_anti")


def opening(rows: DataFrame, large: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Large buckets (bucket, seqs, top and more) with how far all their sequences agree (`at`; the first and the last in order
    tell) and the words of the turns on that way, their rows with `at` and the bucket's smallest conv_id, and the other rows."""
    own, _ = marked(rows, large.select("bucket", "seqs"), n)
    ends = own.groupBy("bucket").agg(F.min(F.struct("ids", "words")).alias("low"), F.max("ids").alias("high"))
    odd = F.array_position(F.zip_with("low.ids", "high", lambda a, b: a.eqNullSafe(b)), False)
    agreed = F.when(odd > 0, odd - 1).otherwise(F.size("low.ids")).cast("int")
    way = F.concat(F.when(F.col("top") == 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), F.slice("low.words", F.greatest("top", F.lit(1)), F.col("at") - F.greatest("top", F.lit(1)) + 1))
    known = cut(large.join(ends.withColumn("at", agreed), "bucket").withColumn("way", way).drop("low", "high"))
    opened, small = marked(rows, known.select("bucket", "seqs", "at", F.col("conv_id").alias("above")), n)
    return known, opened.select("bucket", "at", "above", "ids", "words", "n", "conv", "ends"), small


def build(convs: DataFrame, local: int = LOCAL) -> DataFrame:
    """The nodes (NODE) of conversations (conv_id, ids, words). There are as many rounds as there are places where open
    buckets branch on the longest way, whatever the length of the ways between."""
    own = cut(distinct(convs))
    rows = own.select(F.lit(b"").alias("bucket"), F.lit(0).alias("top"), F.lit(None).cast("binary").alias("up"), F.lit(None).cast("long").alias("parent"), "*")
    levels, over, done = [], [], []
    while True:
        sums = rows.groupBy("bucket", "top", "up", "parent").agg(F.count("*").alias("seqs"), F.sum(F.size("ids") - F.col("top")).alias("load"), F.sum("n").alias("n_convs"), F.min("conv").alias("conv_id"))
        large = cut(sums.where((F.col("seqs") > 1) & (F.col("load") > local)).drop("load"))
        n = large.count()
        if not n:
            done.append(cut(finish(rows)))
            break
        known, opened, small = opening(rows, large, n)
        done.append(cut(finish(small)))
        levels.append(known)
        opened = cut(opened)
        over.append(opened.where(F.size("ids") == F.col("at")).select("bucket", "ends"))
        key = F.unhex(F.sha2(F.concat("bucket", F.col("ids")[F.col("at")].cast("string").cast("binary")), 256))
        rows = cut(opened.where(F.size("ids") > F.col("at")).select(key.alias("bucket"), (F.col("at") + 1).alias("top"), F.col("bucket").alias("up"), F.col("above").alias("parent"), "ids", "words", "n", "conv", "ends"))
    # from the last round up: what stands below an open bucket's node, and the way down to it
    nodes, above = [x.drop("up") for x in done], None
    for i in range(len(levels) - 1, -1, -1):
        below = done[i + 1].where("up IS NOT NULL").select("up", "n_leaves", "saved_tokens")
        below = below if above is None else below.unionByName(above.where("up IS NOT NULL").select("up", "n_leaves", "saved_tokens"))
        sums = below.groupBy(F.col("up").alias("bucket")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        every = levels[i].join(sums, "bucket").join(over[i], "bucket", "left").select("*", F.posexplode("way").alias("place", "said"))
        last, upward = F.col("place") == F.col("at") - F.col("top"), Window.partitionBy("bucket").orderBy(F.col("place").desc())
        saved = F.col("below") + (F.col("n_convs") - 1) * F.sum("said").over(upward)
        above = cut(
            every.select(
                F.when(F.col("place") == 0, F.col("up")).alias("up"), "conv_id", (F.col("top") + F.col("place")).cast("long").alias("depth"), F.when(F.col("place") == 0, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
                "n_convs", F.when(last, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves", saved.alias("saved_tokens"), F.coalesce(F.when(last, F.col("ends")), F.lit(NOTHING)).alias("ends_sha256"),
            )
        )
        nodes.append(above.drop("up"))
    out = nodes[0]
    for x in nodes[1:]:
        out = out.unionByName(x)
    return out


def trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """The prefix trie of a table's conversations as they are."""
    return build(sequences(conversations), local)


def regrafted_trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """The prefix trie of a table's conversations, rebuilt by regrafted()."""
    return build(regrafted(cut(sequences(conversations))), local)
