"""Counts, classifiers and the pipeline on small tables; plain versions of kernels and risks; held-out accuracy on made texts."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, awkward_rows, empty, words

from tallymark.llm import models, pu, rules, toxicity
from tallymark.llm.features import COLUMNS, Texts

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=700):
    """Good texts of syllables; bad ones shout or are full of symbols; toxic ones have insults, some of them broken up."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["re", "th", "an", "in", "ou", "er", "ti", "on"]) for _ in range(rng.randrange(1, 5)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(30, 90))]
        bad, toxic = i % 7 == 0, i % 5 == 0
        if bad:
            w = [x.upper() + "!!" for x in w] if i % 2 else [x + "$$$" for x in w]
        if toxic:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(["zegbup", "moklaz", "quivfen"])
        docs.append((i, " ".join(w) + "."))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string").cache(), spark.createDataFrame(labels, LABELS).cache()


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def accuracy(got, field, label):
    rows = [r for r in got if held_out(r.doc_id)]
    return sum(int(r[field]) == label(r.doc_id) for r in rows) / len(rows)


def test_scores_are_the_matrix_times_weights():
    rng = np.random.default_rng(0)
    weights = rng.normal(size=COLUMNS)
    texts = Texts(pa.array([None if r[1] is None else r[1].encode() for r in awkward_rows()], pa.binary()))
    assert np.allclose(texts.scores(weights), texts.matrix().astype("f8") @ weights, atol=1e-4)


def counted(t):
    """The five counts of a text and whether its base fails, the plain way."""
    w, seen = words(t), {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    again = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_rule_counts(spark):
    x, y = thue_morse(1024), thue_morse(1024, "b", "a")
    alike = "p q r s t u v {} p q r s t u v {} " + " ".join(f"z{i}" for i in range(30))
    rows = awkward_rows() + [(200 + i, t, "", 0, 0, 0.0, "") for i, t in enumerate(["x y z w " * 30 + "\nsame line\nsame line\n \nother | $", alike.format(x, y), alike.format(x, x)])]
    df = spark.createDataFrame(rows, awkward(spark).schema)
    model = models.Linear(np.zeros(COLUMNS), 0.0)
    got = sorted((tuple(r)[:7] for r in rules.judge(df, model).collect()), key=str)
    assert got == sorted(((d, *counted(t)) for d, t, *_ in rows), key=str)
    again = {r[0]: r[5] for r in got}
    assert again[202] == 16 and again[201] == 0  # words that polynomial hashes take for one


def test_quality_rules(tables):
    docs, labels = tables
    model = rules.fit(docs, labels)
    got = rules.judge(docs, model).collect()
    assert len(got) == docs.count() and accuracy(got, "kept", lambda i: i % 7 != 0) > 0.95
    # the verdict from a plain matrix, row by row
    x = Texts(pa.array([r.text.encode() for r in docs.collect()], pa.binary())).matrix().astype("f8")
    p = dict(zip([r.doc_id for r in docs.collect()], models.sigmoid(model.slope * (x @ model.weights + model.bias) + model.offset)))
    assert all(abs(r.score - p[r.doc_id]) < 1e-6 and r.kept == (not r.base_failed and r.score >= 0.5) for r in got)


def test_logistic_regression_finds_the_least_loss(tables):
    """No other weights nearby have a smaller loss: differences along many directions."""
    docs, labels = tables
    classes = models.sample(docs, labels, "quality", rows=60)
    x = models.joined(classes[0], classes[1])
    y, scale = np.repeat([0, 1], [classes[0].n, classes[1].n]), models.Scale(models.joined(classes[0], classes[1]))
    loss = lambda w, b: np.logaddexp(0, np.where(y == 1, -1, 1) * (x.dot(scale.fold(w, b)[0]) + scale.fold(w, b)[1])).mean() + 3e-3 / 2 * w @ w
    w, b = models.descend(x, scale, lambda i, s, w, b: ((models.sigmoid(s) - y[i]) / len(i), 0.0, 0.0), epochs=400)
    rng = np.random.default_rng(1)
    for _ in range(10):
        step = rng.normal(size=COLUMNS)
        step *= 0.3 * np.linalg.norm(w) / np.linalg.norm(step)
        assert loss(w, b) < loss(w + step, b) + 1e-3 and loss(w, b) < loss(w * 0.7, b) + 1e-3


def test_samples(spark, tables):
    docs, labels = tables
    got = models.sample(docs, labels, "quality", rows=40, unlabelled=50)
    assert [got[k].n for k in (0, 1, 2)] == [40, 40, 50]
    ids = {r.doc_id for r in models.sampled_ids(labels, "quality", 1000).collect()}
    assert ids == {i for i in range(700) if not held_out(i)}
    texts = models.labelled(docs.union(docs), labels, "toxic", rows=1000)
    plain = {(t.encode(), int(i % 5 == 0)) for i, t in corpus()[0] if not held_out(i)}
    assert len(texts) == len(plain) and set(texts) == plain
    one = spark.createDataFrame([(1, "a b c")] * 300, "doc_id long, text string")
    assert models.sample(one, labels, "quality", rows=5, unlabelled=50)[2].n == 1  # equal rows count once


def test_the_driver_gets_a_sample_compressed(spark, tables, monkeypatch):
    docs, labels = tables
    kind, sizes = type(docs), []
    collect = kind.collect

    def seen(df):
        rows = collect(df)
        sizes.extend(len(v) for r in rows for v in r if isinstance(v, (bytes, bytearray)))
        return rows

    monkeypatch.setattr(kind, "collect", seen)
    got = models.sample(docs, labels, "quality", rows=100, unlabelled=200)
    monkeypatch.undo()
    assert len(sizes) == sum(x.n for x in got.values()) > 300
    assert 0 < sum(sizes) < 0.5 * sum(x.at.nbytes + x.value.nbytes for x in got.values())
    # whole: the same features as of the texts themselves
    x = Texts(pa.array([t for t, _ in models.labelled(docs, labels, "quality", rows=100)], pa.binary())).matrix()
    for k in (0, 1):
        for i in range(got[k].n):
            own, row = got[k][np.array([i])], np.zeros(COLUMNS, "f4")
            row[own.at] = own.value
            assert np.array_equal(row, x[k * got[0].n + i])
    assert [len(v) for v in models.unpacked(models.packed(np.zeros(COLUMNS, "f4")))] == [0, 0]


def test_only_repeated_windows_are_put_in_order(monkeypatch):
    """Sorting all windows with their places was a large part of each pass over the documents."""
    texts, sizes, argsort = [t.encode() for _, t in corpus(200)[0]], [], np.argsort
    texts[7] += b" " + texts[7]
    monkeypatch.setattr(np, "argsort", lambda x, **more: sizes.append(len(x)) or argsort(x, **more))
    got = Texts(pa.array(texts, pa.binary()))
    monkeypatch.undo()
    assert sum(sizes) < 0.2 * len(got.h)
    w = [t.decode().split() for t in texts]
    assert [int(got.repeated[s:e].sum()) for s, e in zip(got.words.first[:-1], got.words.first[1:])] == [counted(" ".join(x))[4] for x in w]
    assert got.repeated.sum() > 40


def test_toxicity(spark, tables):
    docs, labels = tables
    machine = toxicity.fit(docs, labels)
    got = toxicity.score(docs, machine).collect()
    assert accuracy(got, "predicted", lambda i: int(i % 5 == 0)) > 0.95
    clean = docs.where("doc_id = 1").first().text
    near, far = ["zegbup", "Zegbup!", "z e g b u p", "z.e.g.b.u.p", "zeg-bup", "zegxbup", "zegbp"], ["zegxxxbup", "egbup", "zegbap", "zxexgxbxuxp"]
    cases = [clean, *(clean + f" {x} and so on" for x in near + far)]
    score = [r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string"), machine).orderBy("doc_id").collect()]
    assert score[0] < 0.5 and min(score[1 : 1 + len(near)]) > 0.5, dict(zip(cases, score))
    assert min(score[1 + len(near) :]) > score[0], list(zip(near + far, score[1:]))


def plain_kernel(s, t, decay=toxicity.DECAY):
    """Every pair of places of common subsequences of three characters."""
    total = 0.0
    for a in itertools.combinations(range(len(s)), 3):
        for b in itertools.combinations(range(len(t)), 3):
            if all(s[i] == t[j] for i, j in zip(a, b)):
                total += decay ** (a[-1] - a[0] + 1) * decay ** (b[-1] - b[0] + 1)
    return total


def plain_near(s, t):
    places = lambda x: [(x[i], x[i + a], x[i + b]) for a, b in toxicity.STRETCHES for i in range(len(x) - b)]
    return sum(p in set(places(t)) for p in places(s)) >= 2


def test_coordinates_are_the_plain_kernel():
    marks = [b" zegbup ", b" moklaz", b" quivfen ", b" an "]
    machine = toxicity.Machine(marks, 0.5)
    texts = ["We zegbp and. Zegxxxbup! egbup", "m.o.k.l.a.z so\nmok-laz q u i v f e n", "An an, ban; the zegbupmoklaz", "", "$$", None, "aaaaaaaaa" * 5 + "zegbup"]
    got, of = machine.sentences(pa.array([t and t.encode() for t in texts], pa.binary()))
    want = []
    for d, t in enumerate(texts):
        for sentence in re.split(r"(?<=[.!?])\s+|\n", t or ""):
            if not words(sentence):
                continue
            units, letters = [], []
            for w in [*words(sentence.lower()), ""]:
                pieces = [x for x in re.split(r"[^a-z0-9]+", w) if x]
                if len("".join(pieces)) == 1:
                    letters += pieces
                else:
                    units += ["".join(letters)] if len(letters) > 2 else []
                    letters = []
                units += ["".join(pieces), *(x for x in pieces if len(x) > 1)] if pieces else []
            units = [x.encode() for u in units if u for x in [f" {u} "]]
            units = [v for u in units for v in ([u] if len(u) <= 24 else [u[i : i + 24] for i in range(0, len(u) - 12, 12)])]
            units += [u[:k] for u in units for k in (6, 7, 8) if k < len(u)]  # " moklaz" is a beginning
            norm = lambda u, m: plain_kernel(u, m) / max(plain_kernel(u, u) * plain_kernel(m, m), 1e-12) ** 0.5
            want.append((d, [max([norm(u, m) for u in units if plain_near(u, m)] or [0.0]) for m in marks]))
    assert of.tolist() == [d for d, _ in want]
    assert np.allclose(got, [x for _, x in want], atol=1e-4)
    assert got[0][0] == pytest.approx(0.755, abs=2e-3)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    for labels in (spark.createDataFrame([], LABELS), spark.createDataFrame([(1, 1, 0), (7, None, None), (None, 0, 1)], LABELS)):
        for got in (pu.score(docs, pu.fit(docs, labels)), toxicity.score(docs, toxicity.fit(docs, labels)), rules.judge(docs, rules.fit(docs, labels))):
            assert got.count() == 2


def test_awkward_rows(spark, tables):
    docs, labels = tables
    model, machine = pu.fit(docs, labels), toxicity.fit(docs, labels)
    for build in (lambda d: pu.score(d, model), lambda d: toxicity.score(d, machine), lambda d: rules.judge(d, model)):
        assert build(awkward(spark)).count() == len(awkward_rows())
        assert build(empty(spark)).count() == 0
    clashing = awkward(spark).toDF("doc_id", "text", "DOC_ID", "c1", "score", "_score", "TEXT")
    kept = pu.keep_good(clashing, model)
    assert kept.columns == clashing.columns and kept.count() == pu.score(clashing, model).where("predicted = 1").count()
