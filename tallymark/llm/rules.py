"""Quality rules: plain counts with fixed limits, and a logistic regression on hashed n-grams.

The counts are exact over whole texts. A text fails the base with fewer than 20 words, or with more than 30 of 100 words in
eight-word windows that it has twice. What passes is kept if the calibrated probability of label 1 reaches `threshold`.
The model is fitted on a bounded sample of labelled rows (models.SAMPLE_ROWS of each class), never on held-out ones. With
labels of one class alone, or none, the probability is the class prior. Null and empty texts have no words and fail; texts of
any length are counted and scored whole. Equal texts have equal results, repeated rows are kept, an empty table gives no rows,
other columns don't matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallymark.llm import models
from tallymark.llm.common import pick, slices
from tallymark.llm.features import SYMBOLS, Texts, counts

STEP_BYTES = 1 << 20
LEAST_WORDS, MOST_REPEATED = 20, 30


def repeated_lines(text: bytes | None) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in (text or b"").split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def measures(texts: Texts, raw: list[bytes | None]) -> dict[str, np.ndarray]:
    w = texts.words
    starts_character = (w.data & 0xC0) != 0x80
    upto = np.zeros(len(w.data) + 1, "i8")
    np.cumsum(starts_character, out=upto[1:])
    lengths = upto[w.end] - upto[w.begin]
    total = np.zeros(len(lengths) + 1, "i8")
    np.cumsum(lengths, out=total[1:])
    return {
        "n_words": w.n.astype("i8"), "word_chars": total[w.first[1:]] - total[w.first[:-1]], "n_symbols": counts(SYMBOLS[w.data], w.at),
        "n_dup_lines": np.array([repeated_lines(t) for t in raw], "i8"), "n_repeat_words": counts(texts.repeated, w.first),
    }


def fit(docs: DataFrame, labels: DataFrame) -> models.Linear:
    return models.logistic(models.sample(docs, labels, "quality"), models.share_of_ones(labels, "quality"))


def judge(docs: DataFrame, model: models.Linear, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the five counts, score, base_failed and kept of each row. One pass, no exchange."""
    own = pick(docs, doc_id=doc_id, text=text)
    kind = own.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", STEP_BYTES):
            texts = part.column("text").cast(pa.binary())
            own = Texts(texts)
            found = measures(own, texts.to_pylist())
            failed = (found["n_words"] < LEAST_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED * found["n_words"])
            p = sent.value.probability(own)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(found[x]) for x in names), pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)], ["doc_id", *names, "base_failed", "kept", "score"])

    return own.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{x} long" for x in names) + ", base_failed boolean, kept boolean, score double")
