"""Positive-unlabelled learning: its risk over all documents, its slopes, its prior, without a negative label."""

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, awkward_rows
from test_models import LABELS, accuracy, corpus, held_out

from tallymark.llm import models, pu
from tallymark.llm.features import COLUMNS, Texts


def test_means_over_all_documents(spark):
    rng = np.random.default_rng(0)
    weights = rng.normal(size=COLUMNS)
    loss, by_weight, by_bias, counts = models.softplus(awkward(spark).repartition(3), weights, 0.1)
    x = Texts(pa.array([None if r[1] is None else r[1].encode() for r in awkward_rows()], pa.binary())).matrix().astype("f8")
    s = x @ weights + 0.1
    assert np.isclose(loss, np.logaddexp(0, s).mean()) and np.isclose(by_bias, models.sigmoid(s).mean())
    assert np.allclose(by_weight, x.T @ models.sigmoid(s) / len(s), atol=1e-6)
    assert (models.histogram(awkward(spark), weights, 0.1) == np.histogram(np.clip(s, -30, 30), models.BINS)[0]).all() and counts.sum() == len(s)


@pytest.mark.parametrize("prior", [0.3, 0.95])
def test_slopes_by_differences(prior):
    """Where the second part is positive, and where it is below zero and the steps climb out of it."""
    rng = np.random.default_rng(3)
    sp, su = rng.normal(1, 1, 20), rng.normal(1 if prior == 0.3 else -2, 1, 30)
    part = lambda sp, su: np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
    sign = 1 if part(sp, su) >= 0 else -1
    assert sign == (1 if prior == 0.3 else -1)
    loss = lambda sp, su: prior * np.logaddexp(0, -sp).mean() + part(sp, su) if sign > 0 else -part(sp, su)
    dp, du, got = pu.slopes(prior, sp, su)
    assert got == sign
    for k in range(5):
        for which, d in ((0, dp), (1, du)):
            up, down = [sp.copy(), su.copy()], [sp.copy(), su.copy()]
            up[which][k] += 1e-5
            down[which][k] -= 1e-5
            assert np.isclose(d[k], (loss(*up) - loss(*down)) / 2e-5, atol=1e-7)
    assert np.isclose(pu.risk(prior, sp, np.logaddexp(0, su).mean()), prior * np.logaddexp(0, -sp).mean() + max(0, part(sp, su)))


@pytest.mark.parametrize("share", [0.2, 0.6, 0.9])
def test_the_prior_is_estimated_from_unlabelled_scores(share):
    rng = np.random.default_rng(5)
    positive = rng.normal(2, 1, 300)
    every = np.concatenate([rng.normal(2, 1, int(20_000 * share)), rng.normal(-2, 1, int(20_000 * (1 - share)))])
    counts = np.histogram(every, models.BINS)[0].astype("f8")
    assert abs(pu.class_prior(positive, counts) - share) < 0.06
    assert abs(models.sigmoid(4 * every + pu.calibration(np.histogram(4 * every, models.BINS)[0].astype("f8"), share)).mean() - share) < 0.01


def test_no_negative_label_is_looked_at(spark):
    docs, labels = corpus(300)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    plain, without = (spark.createDataFrame(x, LABELS) for x in (labels, [r for r in labels if r[1] == 1 and not held_out(r[0])]))
    a, b = pu.fit(frame, plain), pu.fit(frame, without)
    assert np.array_equal(a.weights, b.weights) and (a.bias, a.slope, a.offset) == (b.bias, b.slope, b.offset)


def test_positive_unlabelled(spark):
    docs, labels = corpus()
    frame, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    model = pu.fit(frame, marks)
    got = pu.score(frame, model).collect()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert accuracy(got, "predicted", lambda i: int(i % 7 != 0)) > 0.93
    assert abs(np.mean([r.score for r in got]) - 6 / 7) < 0.08
    kept = pu.keep_good(frame, model)
    assert kept.columns == frame.columns and kept.count() == sum(r.predicted for r in got)


def test_long_documents_enter_the_risk(spark):
    docs, labels = corpus()
    good = " ".join(t for i, t in docs if i % 7)
    long = [(10_000 + i, " ".join(f"{w} qzx" for w in good[i : i + 40_000].split())) for i in range(300)]
    plain, every, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(docs + long, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    alone = spark.createDataFrame(long, "doc_id long, text string")
    risk = lambda model: models.softplus(alone, model.weights, model.bias)[0]
    assert risk(pu.fit(every, marks)) < risk(pu.fit(plain, marks)) - 0.1


def test_documents_that_are_not_drawn_enter_the_risk(spark):
    docs, labels = corpus()
    few, every, marks = spark.createDataFrame(docs[:200], "doc_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    positive, drawn = models.sample(every, marks, "quality")[1], models.sample(few, marks, "quality", unlabelled=50)[models.UNLABELLED]
    fit = lambda df: pu.minimise(positive, drawn, lambda w, b: models.softplus(df, w, b), 0.8)[0]
    assert not np.allclose(fit(few), fit(every))
