"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at boundaries that no token of the vocabulary can cross, each distinct chunk is encoded once
per worker (a bounded memo), and a document's count is the sum over its chunks. Batches are bounded by bytes,
not by rows. Null and empty texts have no tokens; texts of any length are counted whole (a stretch without such a boundary is
one chunk); rows are kept one for one, repeated rows included. An empty table gives no rows; other columns, whatever their
names, don't matter."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tallymark.llm.common import pick, slices

#: Distinct chunks that a worker remembers before it starts anew, and the text of one step.
MEMO, STEP_BYTES, CALL_BYTES = 400_000, 4 << 20, 1 << 20


def safe_chunks(text: str) -> list[str]:
    """Cuts a text before each single space between two characters that aren't white space. The pre-tokenizer
    of a byte-level BPE never looks across such a place: a token has a space at its start only, and its look-ahead
    concerns runs of white space alone. So counts of the chunks add up to the count of the text."""
    out: list[str] = []
    for i, part in enumerate(text.split(" ")):
        if i and part and not part[0].isspace() and out[-1] and not out[-1][-1].isspace():
            out.append(" " + part)
        elif i:
            out[-1] += " " + part
        else:
            out.append(part)
    return out


class Lengths:
    """Token counts of texts, each distinct chunk encoded once. `spaced`: the vocabulary is a byte-level BPE,
    whose texts can be cut by safe_chunks; else each text is one chunk."""

    UNSAFE = -(1 << 50)

    def __init__(self, path: str, spaced: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            self.encode = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.spaced = spaced
        #: Counts of chunks as they stand, and of words after a space.
        self.whole: dict[str, int] = {}
        self.word: dict[str, int] = {}

    def learn(self, memo: dict[str, int], keys: Iterable[str], before: str) -> None:
        group, size = [], 0
        for key in keys:
            if before and (not key or key[0].isspace() or key[-1].isspace()):
                memo[key] = self.UNSAFE
                continue
            group.append(key)
            size += len(key) + 1
            if size >= CALL_BYTES:
                memo.update(zip(group, self.encode([before + x for x in group])))
                group, size = [], 0
        if group:
            memo.update(zip(group, self.encode([before + x for x in group])))

    def __call__(self, texts: list[str | None]) -> list[int]:
        texts = [x or "" for x in texts]
        if not self.spaced:
            memo: dict[str, int] = {"": 0}
            self.learn(memo, {x for x in texts if x}, "")
            return [memo[x] for x in texts]
        if len(self.word) + len(self.whole) > MEMO:
            self.word, self.whole = {}, {}
        word, whole = self.word, self.whole
        parts = [x.split(" ") for x in texts]
        unseen: set[str] = set()
        for x in parts:
            unseen.update([w for w in x if w not in word])
        self.learn(word, unseen, " ")
        odd: dict[int, list[str]] = {}
        for i, x in enumerate(parts):
            first = x[0]
            if word[first] < 0 or len(x) > 1 and sum(map(word.__getitem__, x)) < 0:
                odd[i] = safe_chunks(texts[i]) if texts[i] else []
        self.learn(whole, {w for x in odd.values() for w in x if w not in whole} | {x[0] for i, x in enumerate(parts) if i not in odd and x[0] not in whole}, "")
        return [sum(map(whole.__getitem__, odd[i])) if i in odd else whole[x[0]] + sum(map(word.__getitem__, x)) - word[x[0]] for i, x in enumerate(parts)]


@lru_cache(maxsize=4)
def lengths(path: str, spaced: bool) -> Lengths:
    return Lengths(path, spaced)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, spaced: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row. One pass, no exchange."""
    own = pick(docs, doc_id=doc_id, text=text)
    kind = own.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = lengths(tokenizer, spaced)
        for part in slices(batches, "text", STEP_BYTES):
            texts = part.column("text")
            n = counter(texts.to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return own.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
