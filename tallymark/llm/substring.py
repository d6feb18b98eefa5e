"""Substring dedup over a log-structured fingerprint index.

A window is 13 consecutive words of a document; a word is removed if a window over it also starts in a document with a
smaller doc_id. Of every window's eight six-word grams the least hash stands for the window. Consecutive windows with the
same one form a stretch, about two of them for nine words; a stretch's key is that hash (first half) and a hash of all its
windows (second half).

The index is a set of sorted immutable runs, dealt out by key range: each key with the smallest doc_id that has it. Documents
come in batches of rising doc_id. A batch is sorted into a run of its own and merge-joined with the stored runs, which are
read in the order of their keys. A stretch whose whole key a smaller document has is a repeat. Where only the first half is
shared, the smallest document of each such stretch is looked at again: its windows are compared one by one over all
documents, by two independent 64-bit hashes of their words. Then the batch's
run joins the index, and levels of enough runs are compacted into one.

A stretch or window that very many documents share is reduced before any exchange to its smallest doc_id in each step of a
task; the others of that step are known to be repeats already. So no bucket gathers all its bearers. Buckets are as many as
the input's bytes ask for (BUCKET_BYTES of text each).

Null and empty texts have no words; a text of any length is one step at most. Rows without a doc_id have no smaller one and
are nobody's source: nothing is removed. Repeated rows of a doc_id are not a source for one another and lose the same words.
doc_ids must be integers. An empty table gives no rows; other columns, whatever their names, don't matter."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.llm.common import cut, exists, partitions, pick, position, remove, scratch, slices, tidy
from tallymark.llm.runs import Runs
from tallymark.llm.spans import FACTORS, U, Words, grams, layout, scramble

WINDOW, GRAM = 13, 6
STEP_BYTES, BUCKET_BYTES = 2 << 20, 32 << 20
#: Keys in a row of a run: what is held of a stored run at a time.
PART = 1 << 16
#: Rows carry many keys (a) and doc_ids (b, compressed): entries for a key range (run: -1 for the batch, else the stored run's
#: number; part: their place in it), or findings for a group of documents.
ROUTED = "kind int, bucket int, run int, part int, a binary, b binary"
NAMES = ["kind", "bucket", "run", "part", "a", "b"]
#: Findings are second halves of keys: REPEAT, the document loses what has it; PARTLY, its windows are to be compared.
ENTRIES, REPEAT, PARTLY = 0, 1, 2


def window_lanes(words: Words, at: np.ndarray) -> list[np.ndarray]:
    """Two independent hashes of the windows that begin at the words `at`."""
    return [grams(words.hashes(i), WINDOW, i, at) for i in (0, 1)]


class Stretches:
    """All windows of a step's texts, and the stretches that they form."""

    def __init__(self, words: Words):
        self.words, self.at = words, words.windows(WINDOW)
        h = grams(words.hashes(0), GRAM, 0)
        span = WINDOW - GRAM + 1
        while span > 1:  # 8: the least of two, four, eight
            h = np.minimum(h[: len(h) - span // 2], h[span // 2 :]) if len(h) > span // 2 else h[:0]
            span //= 2
        h, self.lanes = h[self.at], window_lanes(words, self.at)
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (self.at[1:] != self.at[:-1] + 1)
        self.first = np.flatnonzero(new)
        self.of = np.cumsum(new) - 1
        self.n = np.diff(np.append(self.first, len(h)))
        self.doc = words.doc[self.at[self.first]]
        place = (np.arange(len(h)) - self.first[self.of]).astype("u8")
        spread = scramble((place + U(1)) * FACTORS[1][0]) | U(1)
        whole = np.add.reduceat(self.lanes[1] * spread, self.first) if len(h) else self.lanes[1]
        # a least hash is small: the scrambled one is spread evenly over the ranges
        self.keys = np.stack([scramble(h[self.first] + FACTORS[0][0]), scramble(whole + self.n.astype("u8"))], 1)


def runs_of(x: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the end."""
    if not len(x):
        return np.zeros(1, "i8")
    new = np.any(x[1:] != x[:-1], axis=1) if x.ndim > 1 else x[1:] != x[:-1]
    return np.concatenate(([0], np.flatnonzero(new) + 1, [len(x)]))


def in_order(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, keys[:, 1], keys[:, 0]))


def behind(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted entries: which are the first of their key, and which have a larger id than that."""
    at = runs_of(keys)
    first = np.zeros(len(keys), bool)
    first[at[:-1]] = True
    return first, ids > np.repeat(ids[at[:-1]], np.diff(at))


def dealt_out(kind: int, bucket: np.ndarray, keys: np.ndarray, ids: np.ndarray, run: int = -1) -> list[tuple]:
    """A row for each bucket that has any, or several; keys in their order."""
    order = np.argsort(bucket, kind="stable")
    keys, ids, bucket = keys[order], ids[order], bucket[order]
    press, out = zstandard.ZstdCompressor(level=1), []
    at = runs_of(bucket)
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        for part, i in enumerate(range(s, e, PART)):
            j = min(i + PART, e)
            out.append((kind, int(bucket[s]), run, part, keys[i:j].tobytes(), press.compress(np.diff(ids[i:j], prepend=0).tobytes())))
    return out


def to_ranges(keys: np.ndarray, ids: np.ndarray, buckets: int, run: int = -1) -> list[tuple]:
    """Entries by key range."""
    return dealt_out(ENTRIES, (((keys[:, 0] >> U(32)) * U(buckets)) >> U(32)).astype("i8"), keys, ids, run)


def to_documents(kind: int, keys: np.ndarray, ids: np.ndarray, buckets: int) -> list[tuple]:
    """Findings by document."""
    order = np.argsort(ids, kind="stable")
    keys, ids = keys[order, 1], ids[order]
    return dealt_out(kind, ((scramble(ids.astype("i8").view("u8")) >> U(32)) % U(buckets)).astype("i8"), keys, ids)


def rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], NAMES)


def unpacked(a: bytes, b: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(a, "<u8")
    return keys.reshape(-1, width) if width > 1 else keys, np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), "<i8"))


class Merged:
    """A bucket: the batch's entries, sorted, and those entries of stored runs that meet them."""

    def __init__(self, bucket: int):
        self.bucket, self.pieces, self.old, self.heads = bucket, [], [], None

    def take(self, run: int, keys: np.ndarray, ids: np.ndarray) -> None:
        if run < 0:
            self.pieces.append((keys, ids))
            return
        if self.heads is None:
            self.heads = np.sort(np.concatenate([k[:, 0] for k, _ in self.pieces])) if self.pieces else np.zeros(0, "u8")
        # the stored part and the batch are sorted: a merge keeps what is in both
        at = np.searchsorted(self.heads, keys[:, 0])
        met = (at < len(self.heads)) & (self.heads[np.minimum(at, len(self.heads) - 1)] == keys[:, 0]) if len(self.heads) else np.zeros(len(keys), bool)
        if met.any():
            self.old.append((keys[met], ids[met]))

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys and ids in order, and which come from stored runs."""
        both = [*self.pieces, *self.old]
        if not both:
            return np.zeros((0, 2), "u8"), np.zeros(0, "i8"), np.zeros(0, bool)
        keys, ids = np.concatenate([k for k, _ in both]), np.concatenate([i for _, i in both])
        old = np.zeros(len(ids), bool)
        old[len(ids) - sum(len(i) for _, i in self.old) :] = True
        order = in_order(keys, ids)
        return keys[order], ids[order], old[order]


def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[Merged | tuple]:
    """Each bucket, whose rows come one after the other (the batch's, then each stored run's in order); rows of findings as
    they are."""
    now: Merged | None = None
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in NAMES]):
            kind, bucket, run, _, a, b = row
            if kind != ENTRIES:
                yield row
                continue
            if now is None or bucket != now.bucket:
                if now is not None:
                    yield now
                now = Merged(bucket)
            now.take(run, *unpacked(a, b, 2))
    if now is not None:
        yield now


def dealt(entries: DataFrame, buckets: int) -> DataFrame:
    """Each bucket in one place, in order."""
    return entries.repartition(buckets, "bucket").sortWithinPartitions("bucket", "run", "part")


def fingerprint_run(docs: DataFrame, buckets: int) -> DataFrame:
    """Entries (key, smallest doc_id of a step) by key range; findings: stretches that a smaller doc_id of the step has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", STEP_BYTES):
            own = Stretches(Words(*layout(part.column("text"))))
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)[own.doc]
            order = in_order(own.keys, ids)
            keys, ids = own.keys[order], ids[order]
            first, later = behind(keys, ids)
            yield rows(to_ranges(keys[first], ids[first], buckets) + to_documents(REPEAT, keys[later], ids[later], buckets))

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(run, ROUTED)


def spread_anew(stored: DataFrame, buckets: int) -> DataFrame:
    """Rows of stored runs, dealt out over so many ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, part, a, b in zip(*[batch.column(c).to_pylist() for c in ("run", "part", "a", "b")]):
                # a row's ranges follow one another, and so do the rows of a run
                made = to_ranges(*unpacked(a, b, 2), buckets, r)
                yield rows([(k, bucket, r, part, *rest) for k, bucket, r, _, *rest in made])

    return stored.select("run", "part", "a", "b").mapInArrow(run, ROUTED)


def merge(batch: DataFrame, stored: DataFrame | None, buckets: int) -> DataFrame:
    """Merge-joins a batch with the stored runs. Entries: the batch's own run, sorted, one for each key. Findings: repeats, and
    stretches that share the first half alone, of the batch and of stored documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_range(batches):
            if isinstance(part, tuple):
                yield rows([part])
                continue
            keys, ids, old = part.entries()
            first, later = behind(keys, ids)
            at = runs_of(keys[first][:, 0])
            several = np.repeat(np.diff(at) > 1, np.diff(at))
            head, head_ids = keys[first][several], ids[first][several]
            again = later & ~old
            new = ~old
            own, own_ids = keys[new], ids[new]
            fresh, _ = behind(own, own_ids)
            yield rows(to_ranges(own[fresh], own_ids[fresh], buckets) + to_documents(REPEAT, keys[again], ids[again], buckets) + to_documents(PARTLY, head, head_ids, buckets))

    both = batch if stored is None else batch.unionByName(spread_anew(stored, buckets))
    return dealt(both, buckets).mapInArrow(run, ROUTED)


def compacted(stored: DataFrame, buckets: int) -> DataFrame:
    """Several runs as one: each key with its smallest doc_id. The runs are sorted; a stable sort merges them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, ids = None, [], []

        def done() -> pa.RecordBatch:
            k, i = np.concatenate(keys), np.concatenate(ids)
            order = in_order(k, i)
            k, i = k[order], i[order]
            first, _ = behind(k, i)
            return rows(to_ranges(k[first], i[first], buckets))

        for batch in batches:
            for bucket, a, b in zip(*[batch.column(c).to_pylist() for c in ("bucket", "a", "b")]):
                if keys and bucket != now:
                    yield done()
                    keys, ids = [], []
                now = bucket
                k, i = unpacked(a, b, 2)
                keys.append(k)
                ids.append(i)
        if keys:
            yield done()

    return dealt(spread_anew(stored, buckets), buckets).mapInArrow(run, ROUTED)


def for_documents(findings: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, found): all that was found for a document, no more halves of keys than it has windows, some a few times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, ids = None, [], []

        def done() -> pa.RecordBatch:
            k, i = np.concatenate(keys), np.concatenate(ids)
            order = np.argsort(i, kind="stable")
            k, i = k[order], i[order]
            at = runs_of(i)
            return pa.RecordBatch.from_arrays([pa.array(i[at[:-1]]), pa.array([k[s:e].tobytes() for s, e in zip(at[:-1], at[1:])], pa.binary())], ["doc_id", "found"])

        for batch in batches:
            for bucket, a, b in zip(*[batch.column(c).to_pylist() for c in ("bucket", "a", "b")]):
                if keys and bucket != now:
                    yield done()
                    keys, ids = [], []
                now = bucket
                k, i = unpacked(a, b, 1)
                keys.append(k)
                ids.append(i)
        if keys:
            yield done()

    return dealt(findings, buckets).mapInArrow(run, "doc_id long, found binary")


def known(doc: np.ndarray, h: np.ndarray, found: list[bytes | None]) -> np.ndarray:
    """Which of the hashes h (of the texts doc) are among what was found for their text. The text's number is folded in."""
    own = [np.frombuffer(x or b"", "<u8") for x in found]
    sizes = [len(x) for x in own]
    if not sum(sizes):
        return np.zeros(len(h), bool)
    fold = lambda n: n.astype("u8") * U(0x9FB21C651E98DF25)
    want = np.unique(np.concatenate(own) ^ fold(np.repeat(np.arange(len(own)), sizes)))
    mine = h ^ fold(doc)
    at = np.minimum(np.searchsorted(want, mine), len(want) - 1)
    return want[at] == mine


def windows_of(docs: DataFrame, partly: DataFrame, buckets: int) -> DataFrame:
    """Of the stretches that share the first half of their key alone. Entries: two hashes of a window and the smallest doc_id
    of the step that has it. Findings: windows that a smaller doc_id of the step has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", STEP_BYTES):
            own = Stretches(Words(*layout(part.column("text"))))
            wanted = known(own.doc, own.keys[:, 1], part.column("found").to_pylist())[own.of]
            keys = np.stack(own.lanes, 1)[wanted]
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)[own.words.doc[own.at[wanted]]]
            order = in_order(keys, ids)
            keys, ids = keys[order], ids[order]
            first, later = behind(keys, ids)
            yield rows(to_ranges(keys[first], ids[first], buckets) + to_documents(REPEAT, keys[later], ids[later], buckets))

    return docs.join(partly, "doc_id").select("doc_id", "text", "found").mapInArrow(run, ROUTED)


def repeated_windows(entries: DataFrame, buckets: int) -> DataFrame:
    """Findings: windows of a document that a smaller doc_id has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_range(batches):
            if isinstance(part, tuple):
                yield rows([part])
                continue
            keys, ids, _ = part.entries()
            _, later = behind(keys, ids)
            yield rows(to_documents(REPEAT, keys[later], ids[later], buckets))

    return dealt(entries, buckets).mapInArrow(run, ROUTED)


def kept_words(text: bytes | None, keep: np.ndarray | None) -> bytes:
    own = (text or b"").split()
    return b" ".join(own if keep is None else compress(own, keep.tolist()))


def removal(docs: DataFrame, schema: T.StructType, make: Callable) -> DataFrame:
    """Applies what was found (column found) of each row's document to its words: stretches and single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", STEP_BYTES):
            words = Words(*layout(part.column("text")))
            found = part.column("found").to_pylist()
            hit = np.zeros(len(words.doc) + 1, "i4")
            if any(found):
                own = Stretches(words)
                wanted = known(own.doc, own.keys[:, 1], found)[own.of] | known(words.doc[own.at], own.lanes[1], found)
                at = own.at[wanted]
                hit[: len(words.doc)] += np.bincount(at, minlength=len(words.doc)).astype("i4")
                hit -= np.bincount(at + WINDOW, minlength=len(hit)).astype("i4")
            gone = np.cumsum(hit)[:-1] > 0
            upto = np.concatenate(([0], np.cumsum(gone)))
            n = upto[words.first[1:]] - upto[words.first[:-1]]
            keep = [~gone[s:e] if k else None for s, e, k in zip(words.first[:-1], words.first[1:], n)]
            kept = [kept_words(t, k) for t, k in zip(part.column("text").to_pylist(), keep)]
            yield make(part, words.n, n, kept)

    return docs.mapInArrow(run, schema)


def digest_rows(part: pa.RecordBatch, n_words: np.ndarray, n_removed: np.ndarray, kept: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words.astype("i8")), pa.array(n_removed.astype("i8")), pa.array([hashlib.sha256(x).hexdigest() for x in kept])], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def text_rows(part: pa.RecordBatch, n_words: np.ndarray, n_removed: np.ndarray, kept: list[bytes]) -> pa.RecordBatch:
    """A text that loses nothing stays as it is, white space included."""
    texts = [k if r else t for t, k, r in zip(part.column("text").to_pylist(), kept, n_removed.tolist())]
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words.astype("i8")), pa.array(n_removed.astype("i8")), pa.array(texts, pa.binary()), part.column("rest")], ["doc_id", "n_words", "n_removed", "text", "rest"])


def measured(docs: DataFrame, batches: int) -> tuple[int, list[int]]:
    """Bytes of text, and doc_ids that cut the documents into so many batches. One scan."""
    shares = F.array(*[F.lit((i + 1) / batches) for i in range(batches - 1)])
    got = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), (F.percentile_approx("doc_id", shares, F.lit(1000)) if batches > 1 else F.lit(None)).alias("at")).first()
    return got["bytes"], sorted(set(got["at"] or []))


def indexed(docs: DataFrame, store: Runs, cuts: list[int], buckets: int, keep: bool, names: list[str]) -> DataFrame:
    """Takes documents into the index in batches of rising doc_id; returns all findings. Only the last batch's run can be left
    out of the index (`keep`). names: takes the batches' folders."""
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        batch = docs if lo is None else docs.where(F.col("doc_id") > lo)
        batch = batch if hi is None else batch.where(F.col("doc_id") <= hi)
        names.append(name := store.new())
        made = merge(fingerprint_run(batch, buckets), store.read(), buckets)
        last = hi is None and not keep
        (made.where(F.col("kind") != ENTRIES) if last else made).write.partitionBy("kind").parquet(f"{store.folder}/{name}")
        if exists(docs.sparkSession, f"{store.folder}/{name}/kind={ENTRIES}"):
            store.add(f"{name}/kind={ENTRIES}", lambda x: compacted(x, buckets))
        tidy(docs.sparkSession)
    found = [docs.sparkSession.read.schema(ROUTED).parquet(f"{store.folder}/{name}").where(F.col("kind") != ENTRIES) for name in names]
    return reduce(DataFrame.unionByName, found)


def deduplicate(docs: DataFrame, batches: int = 2, texts: bool = False, doc_id: str = "doc_id", text: str = "text", index: str | None = None, earlier: DataFrame | None = None, fanout: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row, or with `texts` doc_id, n_words, n_removed, text and rest
    (a struct of the row's other columns).

    index: a folder whose stored runs count as earlier documents, and which takes in these. Their doc_ids must be larger than
    those it has; `earlier` are the documents that it was made of (doc_id, text), from which those that share something with
    the new ones only in part are read again. Without it an index of this call's own is made and removed again."""
    spark, at = docs.sparkSession, (position(docs, doc_id), position(docs, text))
    others = [f"c{i}" for i in range(len(docs.columns)) if i not in at] if texts else []
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).select(F.col(f"c{at[0]}").alias("doc_id"), F.col(f"c{at[1]}").alias("text"), *others)
    kind = named.schema["doc_id"].dataType
    if not isinstance(kind, T.IntegralType):
        raise ValueError(f"doc_ids must be integers, not {kind.simpleString()}")
    content = F.col("text").cast("binary").alias("text")
    own = named.select(F.col("doc_id").cast("long").alias("doc_id"), content, F.struct(F.lit(0).alias("_"), *others).alias("rest"))
    folder = index or scratch(spark, "substring")
    store = Runs(spark, folder, fanout)
    if store.live and earlier is None:
        raise ValueError("an index that has documents needs them as `earlier`")
    keyed = own.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    total, cuts = measured(keyed, batches)
    buckets = max(partitions(own), -(-total // BUCKET_BYTES))
    names: list[str] = []
    try:
        findings = indexed(keyed, store, cuts, buckets, index is not None, names)
        whole = keyed if earlier is None else keyed.unionByName(pick(earlier, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), content))
        partly = for_documents(findings.where(F.col("kind") == PARTLY), buckets)
        windows = repeated_windows(windows_of(whole, partly, buckets), buckets)
        found = cut(for_documents(findings.where(F.col("kind") == REPEAT).unionByName(windows), buckets))
    finally:
        for x in [folder] if index is None else [f"{folder}/{name}/kind={k}" for name in names for k in (REPEAT, PARTLY)]:
            remove(spark, x)
    tidy(spark)
    with_found = own.where(F.col("doc_id").isNotNull()).join(found, "doc_id", "left").select("doc_id", "text", "found", "rest")
    without = own.where(F.col("doc_id").isNull()).select("doc_id", "text", F.lit(None).cast("binary").alias("found"), "rest")
    schema = T._parse_datatype_string("doc_id long, n_words long, n_removed long, " + ("text binary" if texts else "kept_sha256 string"))
    if texts:
        schema = schema.add("rest", own.schema["rest"].dataType)
    make = text_rows if texts else digest_rows
    return removal(with_found, schema, make).unionByName(removal(without, schema, make))


def strip(docs: DataFrame, batches: int = 2) -> DataFrame:
    """`docs` with their texts less the repeated words; documents that lose all words go, others keep their row. n_chars, if
    there, follows. Other columns are kept whatever their names."""
    left = deduplicate(docs, batches, texts=True).where((F.col("n_words") == 0) | (F.col("n_removed") < F.col("n_words")))
    out, at = [], {c: position(docs, c) for c in ("doc_id", "text")} | ({"n_chars": docs.columns.index("n_chars")} if "n_chars" in docs.columns else {})
    text = F.col("text").cast("string")
    for i, field in enumerate(docs.schema.fields):
        if i == at["doc_id"]:
            value = F.col("doc_id")
        elif i == at["text"]:
            value = text
        elif i == at.get("n_chars"):
            value = F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col(f"rest.c{i}"))
        else:
            value = F.col(f"rest.c{i}")
        out.append(value.cast(field.dataType).alias(f"_{i}"))
    return left.select(*out).toDF(*docs.columns)
