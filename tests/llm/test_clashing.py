"""Tables whose other columns have the operators' own names in other cases, and texts of a megabyte and of one huge word."""

import numpy as np
import public_tokenizers

from tallymark.llm import decontam, models, packing, pu, rules, shards, tokens, toxicity

BYTES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
CLASHING = "doc_id long, text string, DOC_ID string, TEXT long, Score double, n_words string, size int, shard int"


def clashing(spark):
    rows = [(i, t, "x", 1, 0.5, "w", 2, 3) for i, t in enumerate([None, "", "one two three", "a b c d e f g h i j k l", "a b c d e f g h i j k l"])]
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        return spark.createDataFrame(rows, CLASHING)
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_names_that_clash(spark):
    docs, items = clashing(spark), spark.createDataFrame([(1, "b c d e f g h i j k", "z")], "item_id int, text string, gram string")
    plain = models.Linear(np.zeros(models.COLUMNS), 0.0)
    ids = list(range(5))
    assert sorted(r.doc_id for r in tokens.count_tokens(docs, BYTES).collect()) == ids
    assert sorted(r.doc_id for r in rules.judge(docs, plain).collect()) == ids
    assert sorted(r.doc_id for r in toxicity.score(docs, toxicity.Machine([], 0.1)).collect()) == ids
    assert sorted(r.doc_id for r in shards.shard(docs, shards=2).collect()) == ids
    assert sorted(r.doc_id for r in pu.score(docs, plain).collect()) == ids
    got = {r.doc_id: (r.n_hit, r.contaminated) for r in decontam.decontaminate(docs, items).collect()}
    assert got == {0: (0, False), 1: (0, False), 2: (0, False), 3: (10, True), 4: (10, True)}


def test_megabytes_and_one_huge_word(spark):
    texts = ["word " * 250_000, "x" * 300_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_bytes for r in tokens.count_tokens(docs, BYTES).collect()} == {0: 1_250_000, 1: 300_000}
    pieces = packing.pack(docs, WORDS).collect()
    assert {i: sum(r.length for r in pieces if r.doc_id == i) for i in (0, 1)} == {r.doc_id: r.doc_tokens for r in pieces}
    scores = pu.score(docs, models.Linear(np.zeros(models.COLUMNS), 0.0)).collect()
    assert [r.score for r in scores] == [0.5, 0.5]
