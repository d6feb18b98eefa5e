"""Linear models over features.Texts, fitted on a bounded sample of rows, and their calibration.

Samples are drawn in one scan of the documents; their features are made by the tasks that hold the texts, whatever the
texts' lengths, and the driver sees nonzero features alone. Fitting goes over them in mini-batches."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import partitions, pick, slices
from tallymark.llm.features import COLUMNS, STYLE, Texts

#: Labelled rows of each class that a model is fitted on at most.
SAMPLE_ROWS = 1000
#: The text of one step: what is worked out of it stays in a core's cache.
STEP_BYTES = 1 << 18
#: Rows whose crc32(doc_id as text) leaves this remainder modulo FOLDS are held out of all fitting.
FOLDS, HELD_OUT = 5, 0
#: Every so many-th row of a sample is set aside for calibration.
ASIDE = 5
UNLABELLED = 2


def fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def below(mix: F.Column, rows: int, n: int) -> F.Column:
    """Whether a hash (a signed long) is among those that twice `rows` of `n` rows are expected to have; all, if n is small."""
    return mix < F.lit(int(-(1 << 63) + 2 * rows / n * (1 << 64))) if n > 4 * rows else F.lit(True)


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of labels that may be learned from: with an id, of 0 or 1, not held out."""
    own = pick(labels, doc_id="doc_id", y=label).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    return own.where(fold(F.col("doc_id")) != HELD_OUT).select("doc_id", F.col("y").cast("int").alias("y")).distinct()


def sampled_ids(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, kind): of each class at most `rows` ids, those that hash lowest. A document with both labels is in both."""
    own, mix = learnable(labels, label), F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    n = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    kept = own.where(F.when(F.col("y") == 1, below(mix, rows, n.get(1, 0))).otherwise(below(mix, rows, n.get(0, 0))))
    nth = F.row_number().over(Window.partitionBy("y").orderBy(mix))
    return kept.withColumn("nth", nth).where(F.col("nth") <= rows).select("doc_id", F.col("y").alias("kind"))


def drawn(docs: DataFrame, labels: DataFrame, label: str, rows: int, unlabelled: int = 0, longest: int | None = None, least: bool = True) -> DataFrame:
    """(kind, m, text): at most `rows` texts of each class (kinds 0 and 1) and `unlabelled` of all documents (kind 2), those
    whose hashes m are least; equal rows count once. One scan of the documents. longest: the bytes of a labelled text."""
    ids = sampled_ids(labels, label, 3 * rows)  # some ids have no text
    own = pick(docs, doc_id="doc_id", text="text")
    by_id, by_row = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.xxhash64(F.col("doc_id").cast("string"), F.lit("unlabelled"), F.col("text"))
    kinds, fits = F.lit(None).cast("int"), F.col("text").isNotNull()
    if longest is not None:
        fits = fits & (F.octet_length("text") <= longest)
    if unlabelled:
        n = own.count() if least else 0
        kinds = F.when(below(by_row, unlabelled, n), UNLABELLED)
    # at most 6 * rows ids
    got = own.join(F.broadcast(ids.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id"), "left")
    each = F.filter(F.array(F.when(fits, F.col("kind")), kinds), lambda k: k.isNotNull())
    flat = got.where(F.size(each) > 0).select(F.explode(each).alias("kind"), by_id.alias("by_id"), by_row.alias("by_row"), F.col("text").cast("binary").alias("text"))
    flat = flat.select("kind", F.when(F.col("kind") == UNLABELLED, F.col("by_row")).otherwise(F.col("by_id")).alias("m"), "text")
    once = flat.groupBy("kind", "m").agg(F.min("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("kind").orderBy("m"))
    return once.withColumn("nth", nth).where(F.col("nth") <= F.when(F.col("kind") == UNLABELLED, unlabelled).otherwise(rows)).drop("nth")


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, longest: int | None = None) -> list[tuple[bytes, int]]:
    """At most `rows` texts of each class among the rows that may be learned from."""
    got = drawn(docs, labels, label, rows, longest=longest).collect()
    return [(bytes(r["text"]), r["kind"]) for r in sorted(got, key=lambda r: (r["kind"], r["m"]))]


#: Rows of a sample that are worked on at a time.
BLOCK = 250


class Rows:
    """Features of a sample's rows: of each row its nonzero columns, one row after the other."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(parts)
        self.at = np.concatenate([a for a, _ in parts]) if parts else np.zeros(0, "u2")
        self.value = np.concatenate([v for _, v in parts]) if parts else np.zeros(0, "f4")
        self.first = np.concatenate(([0], np.cumsum([len(a) for a, _ in parts]))).astype("i8")

    def __getitem__(self, which: np.ndarray) -> Rows:
        return Rows([(self.at[self.first[i] : self.first[i + 1]], self.value[self.first[i] : self.first[i + 1]]) for i in which])

    def blocks(self) -> Iterator[tuple[int, int, slice]]:
        """Some rows at a time, and where their columns lie: what is worked out of all rows holds no copy of them."""
        for k in range(0, self.n, BLOCK):
            end = min(k + BLOCK, self.n)
            yield k, end, slice(int(self.first[k]), int(self.first[end]))

    def dot(self, w: np.ndarray) -> np.ndarray:
        out, own = np.zeros(self.n), w.astype("f4")
        for k, end, part in self.blocks():
            first = self.first[k : end + 1] - self.first[k]
            some = np.flatnonzero(np.diff(first))
            if len(some):
                out[k + some] = np.add.reduceat(self.value[part] * own[self.at[part]], first[some], dtype="f8")
        return out

    def back(self, d: np.ndarray) -> np.ndarray:
        """The rows' sum with weights d."""
        out = np.zeros(COLUMNS)
        for k, end, part in self.blocks():
            out += np.bincount(self.at[part], weights=self.value[part] * np.repeat(d[k:end].astype("f4"), np.diff(self.first[k : end + 1])), minlength=COLUMNS)
        return out


def packed(row: np.ndarray) -> bytes:
    """A row's nonzero features, compressed: the driver holds all that are drawn at once, several times while it gets them."""
    at = np.flatnonzero(row)
    return zlib.compress(row[at].astype("<f4").tobytes() + np.diff(at, prepend=0).astype("<u2").tobytes(), 1)


def unpacked(features: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The columns and values of packed()."""
    plain = zlib.decompress(features)
    n = len(plain) // 6
    return np.cumsum(np.frombuffer(plain, "<u2", n, 4 * n), dtype="u2"), np.frombuffer(plain, "<f4", n)


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, unlabelled: int = 0) -> dict[int, Rows]:
    """The features of drawn(), by kind, in the order of their hashes. A row has at most COLUMNS of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", STEP_BYTES):
            for i in range(0, len(part), 100):
                own = part.slice(i, 100)
                got = pa.array([packed(x) for x in Texts(own.column("text")).matrix()], pa.binary())
                yield pa.RecordBatch.from_arrays([own.column("kind"), own.column("m"), got], ["kind", "m", "features"])

    def collected(least: bool) -> list:
        return drawn(docs, labels, label, rows, unlabelled, least=least).mapInArrow(run, "kind int, m long, features binary").collect()

    got = collected(True)
    if sum(r["kind"] == UNLABELLED for r in got) < unlabelled:  # few documents, or many equal rows
        got = collected(False)
    got.sort(key=lambda r: (r["kind"], r["m"]))
    return {k: Rows([unpacked(bytes(r["features"])) for r in got if r["kind"] == k]) for k in (0, 1, UNLABELLED)}


def summed(docs: DataFrame, of_step: Callable[[Texts], np.ndarray], size: int) -> np.ndarray:
    """A vector's sum over all documents, long and empty ones too. Each task sends one sum; sums are added in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for part in slices(batches, "text", STEP_BYTES):
            if len(part):
                total += of_step(Texts(part.column("text").cast(pa.binary())))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["task", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((t, s) for b in batches for t, s in zip(b.column("task").to_pylist(), b.column("sums").to_pylist()))
        if rows:
            total = np.zeros(size)
            for _, s in rows:
                total += np.frombuffer(s, "f8")
            yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["task", "sums"])

    kind = "task long, sums binary"
    tasks = pick(docs, text="text").mapInArrow(run, kind).repartition(partitions(docs), "task").mapInArrow(add, kind)
    total = np.zeros(size)
    for r in sorted(tasks.collect(), key=lambda r: r["task"]):
        total += np.frombuffer(bytes(r["sums"]), "f8")
    return total


def softplus(docs: DataFrame, weights: np.ndarray, bias: float) -> tuple[float, np.ndarray, float, np.ndarray]:
    """Means over all documents: log(1 + exp(score)) and its slopes by the weights and the bias; and the scores' histogram."""
    total = summed(docs, lambda texts: texts.softplus(weights, bias, BINS), COLUMNS + 3 + len(BINS) - 1)
    n = max(total[0], 1)
    return float(total[1] / n), total[3 : COLUMNS + 3] / n, float(total[2] / n), total[COLUMNS + 3 :]


#: Bins of a histogram of scores.
BINS = np.linspace(-30, 30, 2401)


def histogram(docs: DataFrame, weights: np.ndarray, bias: float) -> np.ndarray:
    """How many of all documents have their score in each of BINS; scores beyond the ends count at the ends."""
    return summed(docs, lambda texts: np.histogram(np.clip(texts.scores(weights) + bias, BINS[0], BINS[-1]), BINS)[0].astype("f8"), len(BINS) - 1)


def share_of_ones(labels: DataFrame, label: str) -> float:
    """The class prior of a supervised model: the share of ones among all labels that may be learned from."""
    got = learnable(labels, label).agg(F.avg(F.col("y").cast("double"))).first()[0]
    return 0.5 if got is None else min(max(float(got), 0.02), 0.98)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, "f8")))


@dataclass
class Linear:
    weights: np.ndarray
    bias: float
    #: Calibration: the probability is sigmoid(slope * score + offset).
    slope: float = 1.0
    offset: float = 0.0

    def probability(self, texts: Texts) -> np.ndarray:
        return sigmoid(self.slope * (texts.scores(self.weights) + self.bias) + self.offset)


class Scale:
    """Puts columns on one scale, without touching the rows: it is folded into weights, and slopes are unfolded. Columns that
    hardly vary stay small, and none reaches beyond five units."""

    def __init__(self, x: Rows):
        n = max(x.n, 1)
        total, square, most = np.zeros(COLUMNS), np.zeros(COLUMNS), np.zeros(COLUMNS)
        for k in range(0, len(x.at), 1 << 18):  # no second copy of all rows
            at, value = x.at[k : k + (1 << 18)], x.value[k : k + (1 << 18)]
            total += np.bincount(at, weights=value, minlength=COLUMNS)
            square += np.bincount(at, weights=value.astype("f8") ** 2, minlength=COLUMNS)
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.append(True, at[order][1:] != at[order][:-1]))
            own = at[order][first]
            most[own] = np.maximum(most[own], np.maximum.reduceat(value[order], first))
        self.mean = total / n
        self.unit = 1 / (np.sqrt(np.maximum(square / n - self.mean**2, 0)) + np.where(np.arange(COLUMNS) < COLUMNS - STYLE, 2e-4, 1e-2))
        self.unit[: COLUMNS - STYLE] /= np.sqrt(COLUMNS / 16)
        self.unit = np.minimum(self.unit, 5 / np.maximum(np.maximum(most - self.mean, self.mean), 1e-12))

    def fold(self, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        own = w * self.unit
        return own, float(b - (own * self.mean).sum())  # a sum, not a product: no threads for so little

    def slopes(self, by_weight: np.ndarray, by_bias: float) -> np.ndarray:
        """Slopes by folded weights as slopes by one's own."""
        return (by_weight - self.mean * by_bias) * self.unit


def descend(x: Rows, scale: Scale, slope_of, epochs: int = 20, batch: int = 500, rate: float = 0.02, decay: float = 3e-3) -> tuple[np.ndarray, float]:
    """Adam over mini-batches, each a like part of all rows; the mean of the later half of its steps. slope_of(which, scores, w,
    b): the derivative of the mean loss by the score of each of these rows, and what else the slopes by the weights and the
    bias have."""
    w, b = np.zeros(COLUMNS), 0.0
    m, v, mb, vb, total, total_b = np.zeros(COLUMNS), np.zeros(COLUMNS), 0.0, 0.0, np.zeros(COLUMNS), 0.0
    parts = max(1, round(x.n / batch))
    which = [np.arange(k, x.n, parts) for k in range(parts)]
    steps, t = max(epochs * parts, 100), 0
    while t < steps:
        own = which[t % parts]
        part, t = x[own], t + 1
        folded, shift = scale.fold(w, b)
        d, more, more_b = slope_of(own, part.dot(folded) + shift, w, b)
        g, gb = scale.slopes(part.back(d), float(d.sum())) + decay * w + more, float(d.sum()) + more_b
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w = w - rate * (m / c1) / (np.sqrt(v / c2) + 1e-6)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
        if t > steps // 2:
            total, total_b = total + w, total_b + b
    n = steps - steps // 2
    return total / n, total_b / n


def calibrate(scores: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Platt's sigmoid, by Newton steps on weighted rows with softened targets."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, c, s = 1.0, 0.0, scores.astype("f8")
    for _ in range(50):
        p = sigmoid(a * s + c)
        g = weight * (p - target)
        r = weight * p * (1 - p) + 1e-9
        hess = np.array([[(r * s * s).sum() + 1e-6, (r * s).sum()], [(r * s).sum(), r.sum() + 1e-6]])
        step = np.linalg.solve(hess, [(g * s).sum(), g.sum()])
        step *= min(1, 2 / (np.abs(step).max() + 1e-12))
        a, c = a - step[0], c - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return (float(a), float(c)) if a > 0 else (1.0, 0.0)


def logistic(classes: dict[int, Rows], prior: float) -> Linear:
    """Logistic regression on four fifths of the rows, calibrated on the rest; classes weigh as `prior` has them."""
    if not classes[0].n or not classes[1].n:
        return Linear(np.zeros(COLUMNS), 0.0, 1.0, float(np.log(prior / (1 - prior))))
    y = np.repeat([0, 1], [classes[0].n, classes[1].n])
    aside = np.concatenate([np.arange(classes[k].n) % ASIDE == ASIDE - 1 for k in (0, 1)])
    every = joined(classes[0], classes[1])
    x, own = every[np.flatnonzero(~aside)], y[~aside]
    scale = Scale(x)
    even = np.where(own == 1, 0.5 / max((own == 1).mean(), 1e-9), 0.5 / max((own == 0).mean(), 1e-9))
    w, b = scale.fold(*descend(x, scale, lambda i, s, w, b: (even[i] * (sigmoid(s) - own[i]) / len(i), 0.0, 0.0)))
    rest = y[aside]
    weight = np.where(rest == 1, prior / max((rest == 1).mean(), 1e-9), (1 - prior) / max((rest == 0).mean(), 1e-9))
    slope, offset = calibrate(every[np.flatnonzero(aside)].dot(w) + b, rest, weight)
    return Linear(w, b, slope, offset)


def joined(*rows: Rows) -> Rows:
    return Rows([(x.at[s:e], x.value[s:e]) for x in rows for s, e in zip(x.first[:-1], x.first[1:])])
