"""Quality by positive-unlabelled learning.

A linear model on hashed n-grams minimises the non-negative unbiased risk of trusted positives (rows labelled 1) and
unlabelled texts. No row labelled 0 is ever looked at, nor any held-out row. Of the positives, at most models.SAMPLE_ROWS, a
fifth is set aside. The steps:

1. A classifier of positives against texts drawn from all documents orders the documents.
2. The class prior is estimated from that order: the positives set aside say which share q of positives scores above a
   threshold, a histogram over all documents which share u of documents does. Were all those documents positive, the prior
   would be u / q; the threshold is the one with the least such bound, allowing for the chance error of both shares.
3. The risk is minimised. Its unlabelled side is that of all documents: two passes give its value and slopes. The drawn texts
   lend it their curvature.
4. The scores are calibrated: shifted, so that the mean probability of all documents is the prior.

Without positives or documents the score is one half. Null and empty texts are texts without n-grams; texts of any length are
scored whole and enter the risk. Equal texts have equal scores, repeated rows are kept, an empty table gives no rows, other
columns don't matter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.llm import models
from tallymark.llm.common import pick, position, slices
from tallymark.llm.features import COLUMNS, Texts
from tallymark.llm.models import BINS, Linear, Rows, Scale, sigmoid

THRESHOLD = 0.3
#: How weights are fitted: rounds over the rows, steps, and how much they are held back.
FITTING = {"epochs": 40, "rate": 0.05}
DECAY = 3e-4
#: Texts drawn from all documents.
DRAWN = 2000
MIDDLES = (BINS[1:] + BINS[:-1]) / 2


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1, slack: float = 0.01) -> float:
    """The estimated share of positives among documents: `positive` are scores of positives that were not fitted on,
    `unlabelled` counts documents by BINS."""
    n = unlabelled.sum()
    if not len(positive) or not n:
        return 0.5
    u = np.cumsum(unlabelled[::-1])[::-1] / n
    q = 1 - np.searchsorted(np.sort(np.clip(positive, BINS[0], BINS[-1])), BINS[:-1]) / len(positive)
    some = q > 0
    error = sum(np.sqrt(np.log(4 / doubt) / (2 * k)) for k in (len(positive), n))
    bound = (u[some] + (1 + slack) * error) / q[some]
    best = int(np.argmin(bound))
    return float(np.clip(u[some][best] / q[some][best], 0.02, 0.98))


def risk(prior: float, sp: np.ndarray, loss_u: float) -> float:
    """The non-negative unbiased risk with the logistic loss: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))."""
    return prior * np.logaddexp(0, -sp).mean() + max(0.0, loss_u - prior * np.logaddexp(0, sp).mean())


def slopes(prior: float, sp: np.ndarray, su: np.ndarray, shift: float = 0.0) -> tuple[np.ndarray, np.ndarray, float]:
    """The risk's derivatives by the scores of positives and unlabelled rows, R_u(-) being that of these rows plus `shift`; and
    its sign: where the second part falls below zero, that part's slope is turned round."""
    rest = np.logaddexp(0, su).mean() + shift - prior * np.logaddexp(0, sp).mean()
    sign = 1.0 if rest >= 0 else -1.0
    dp = (prior * (sigmoid(sp) - 1) if sign > 0 else 0) / len(sp) - sign * prior * sigmoid(sp) / len(sp)
    return dp, sign * sigmoid(su) / len(su), sign


def calibration(unlabelled: np.ndarray, prior: float) -> float:
    """The offset at which the mean probability of all documents is the prior. (A slope as well would hang on the mean score of
    the few positives that were set aside.)"""
    if not unlabelled.sum():
        return float(np.log(prior / (1 - prior)))
    share, low, high = unlabelled / unlabelled.sum(), -60.0, 60.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (share * sigmoid(MIDDLES + middle)).sum() < prior else (low, middle)
    return (low + high) / 2


def against(positive: Rows, unlabelled: Rows) -> tuple[np.ndarray, float]:
    """Weights that tell positives from drawn texts, both sides weighing the same."""
    x = models.joined(positive, unlabelled)
    is_p, scale = np.arange(x.n) < positive.n, Scale(x)
    even = np.where(is_p, 0.5 / positive.n, 0.5 / unlabelled.n) * x.n
    return scale.fold(*models.descend(x, scale, lambda i, s, w, b: (even[i] * (sigmoid(s) - is_p[i]) / len(i), 0.0, 0.0), decay=DECAY, **FITTING))


def minimise(positive: Rows, unlabelled: Rows, whole: Callable[[np.ndarray, float], tuple], prior: float, decay: float = DECAY) -> tuple[np.ndarray, float, np.ndarray | None]:
    """Weights and bias of the least risk, and the histogram of all documents' scores with them, if it is known. R_u(-) is that of all documents, which `whole` gives with its slopes for any weights.
    Weights fitted on the drawn rows are fitted again with R_u(-) of these rows tilted, so that its value and slopes at the
    first weights are those of all documents. Where the risk of all documents rises instead, the step is shortened to the
    least point of the parabola through both values and the first slope."""
    x, n = models.joined(positive, unlabelled), positive.n
    scale = Scale(x)
    tilt = (0.0, np.zeros(COLUMNS), 0.0)

    def slope_of(i: np.ndarray, s: np.ndarray, w: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray, float]:
        of_p, d = i < n, np.zeros(len(i))
        if of_p.any() and not of_p.all():
            d[of_p], d[~of_p], sign = slopes(prior, s[of_p], s[~of_p], tilt[0] + float((tilt[1] * w).sum()) + tilt[2] * b)
            return d, sign * tilt[1], sign * tilt[2]
        return d, 0.0, 0.0

    def of_all(w: np.ndarray, b: float) -> tuple[float, float, np.ndarray, float, np.ndarray]:
        """The risk and R_u(-) of all documents, the slopes of the latter, and the histogram."""
        folded = scale.fold(w, b)
        loss, by_weight, by_bias, counts = whole(*folded)
        return risk(prior, positive.dot(folded[0]) + folded[1], loss) + decay / 2 * float(w @ w), loss, scale.slopes(by_weight, by_bias), by_bias, counts

    w, b = models.descend(x, scale, slope_of, decay=decay, **FITTING)
    least, loss, by_weight, by_bias, _ = of_all(w, b)
    folded, shift = scale.fold(w, b)
    su = unlabelled.dot(folded) + shift
    d = sigmoid(su) / unlabelled.n
    by_weight, by_bias = by_weight - scale.slopes(unlabelled.back(d), float(d.sum())), by_bias - float(d.sum())
    tilt = (loss - np.logaddexp(0, su).mean() - float(by_weight @ w) - by_bias * b, by_weight, by_bias)
    w1, b1 = models.descend(x, scale, slope_of, decay=decay, **FITTING)
    after, *_, counts = of_all(w1, b1)
    rise = after - least
    if rise > 0:
        d, more, more_b = slope_of(np.arange(x.n), x.dot(folded) + shift, w, b)
        down = float((scale.slopes(x.back(d), float(d.sum())) + decay * w + more) @ (w1 - w)) + (float(d.sum()) + more_b) * (b1 - b)
        part = min(1.0, -down / (2 * (rise - down))) if down < 0 else 0.0
        return *scale.fold(w + part * (w1 - w), b + part * (b1 - b)), None
    return *scale.fold(w1, b1), counts


def fit(docs: DataFrame, labels: DataFrame, rows: int = models.SAMPLE_ROWS, unlabelled: int = DRAWN) -> Linear:
    positives = pick(labels, doc_id="doc_id", quality="quality").where("quality = 1")
    found = models.sample(docs, positives, "quality", rows, unlabelled)
    every, some = found[1], found[models.UNLABELLED]
    if every.n < 2 or not some.n:
        return Linear(np.zeros(COLUMNS), 0.0)
    aside = np.arange(every.n) % models.ASIDE == models.ASIDE - 1
    aside[1] |= not aside.any()
    positive, held = every[np.flatnonzero(~aside)], every[np.flatnonzero(aside)]
    del found, every  # the rows have been copied
    w, b = against(positive, some)
    prior = class_prior(held.dot(w) + b, models.histogram(docs, w, b))
    w, b, counts = minimise(positive, some, lambda w, b: models.softplus(docs, w, b), prior)
    return Linear(w, b, 1.0, calibration(models.histogram(docs, w, b) if counts is None else counts, prior))


def with_score(docs: DataFrame, model: Linear, text: str = "text") -> DataFrame:
    """`docs` with columns c0, c1, ..., and score. One pass, no exchange."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), position(docs, text)
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, f"c{at}", models.STEP_BYTES):
            p = sent.value.probability(Texts(part.column(at).cast(pa.binary())))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], [*part.schema.names, "score"])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, model: Linear, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    scored = with_score(pick(docs, doc_id=doc_id, text=text), model).withColumnRenamed("c0", "doc_id")
    return scored.select("doc_id", (models.fold(F.col("doc_id")) == models.HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Linear) -> DataFrame:
    """The rows of `docs` that the model doesn't reject, whatever their columns are called."""
    return with_score(docs, model).where(F.col("score") >= THRESHOLD).drop("score").toDF(*docs.columns)
