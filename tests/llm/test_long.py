"""Texts of megabytes and words of hundreds of thousands of bytes, whole, beside ordinary ones."""

import hashlib

import numpy as np
import pytest
import xxhash
from helpers import LOWER, PLAIN, words
from test_models import counted
from test_texts import contaminated, stripped

from tallymark.llm import decontam, models, rules, shards, simhash, substring, toxicity
from tallymark.llm.features import COLUMNS

LONG = " ".join(f"w{i * i % 9973}" for i in range(400_000))
ROWS = [(1, LONG), (2, "x" * 300_000), (3, "x" * 300_000 + " y"), (4, LONG[500_000:520_000]), (5, "a b c"), (6, "z" * 40 + " " + LONG[:200])]
BENCH = [(1, LONG[1_000_000:1_000_200]), (2, "x" * 300_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").cache()


def test_fingerprints(docs):
    def plain(t):
        w = words(t.translate(LOWER))
        lines = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
        bits = np.unpackbits(np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in lines], "<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
        return f"{sum(1 << i for i, n in enumerate(bits.sum(0).tolist()) if 2 * n > len(lines)):016x}"

    assert {r.doc_id: r.fingerprint for r in simhash.groups(docs).collect()} == {d: plain(t) for d, t in ROWS}


def test_substrings(docs):
    assert sorted(map(tuple, substring.deduplicate(docs).collect()), key=str) == stripped(ROWS)


def test_decontamination(spark, docs):
    got = decontam.decontaminate(docs, spark.createDataFrame(BENCH, "item_id long, text string")).collect()
    spans = {tuple(words(t.translate(LOWER), PLAIN)[i : i + 10]) for _, t in BENCH for i in range(max(len(words(t, PLAIN)) - 9, 1))}
    assert len(spans) > 10
    small = [r for r in ROWS if r[0] != 1]
    assert sorted((tuple(r) for r in got if r.doc_id != 1), key=str) == contaminated(BENCH, small)
    one = next(r for r in got if r.doc_id == 1)
    assert one.n_words == 400_000 and one.n_hit >= len(words(BENCH[0][1])) - 2 and one.items_sha256 == hashlib.sha256(b"1").hexdigest()


def test_rules_toxicity_and_shards(docs):
    got = {r.doc_id: r for r in rules.judge(docs, models.Linear(np.zeros(COLUMNS), 0.0)).collect()}
    assert all(tuple(got[d])[1:7] == counted(t) for d, t in ROWS)
    machine = toxicity.Machine([b" zegbup "], 0.5, np.eye(1), np.ones(1), -0.5)
    assert all(0 < r.score < 1 for r in toxicity.score(docs, machine).collect())
    assert sum(r["size"] for r in shards.shard(docs, 2).collect()) == sum(len(t) + 8 for _, t in ROWS)
