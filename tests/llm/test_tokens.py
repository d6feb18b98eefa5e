"""Token counts, packing, sharding and chat formatting against the library and plain versions."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward, awkward_rows, empty
from tokenizers import Tokenizer

from tallymark.llm import chat, packing, shards, tokens

BYTES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PIECES = ["a", "B", "é", "É", "Σ", "ς", "ß", "İ", "'s", "'", "5", "٣", "!", "...", "\x1c", " ", " ", "  ", "\n", " ", "<|endoftext|>", "<|startoftext|>", "é", "日本", "ﬁ", "_", "😀", "​", "\u0085"]


def mixtures(n):
    rng = random.Random(5)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_lengths_of_mixtures():
    plain, own = Tokenizer.from_file(BYTES), tokens.Lengths(BYTES, True)
    texts = mixtures(1500)
    assert own(texts) == [len(plain.encode(t, add_special_tokens=False).ids) for t in texts]


def test_sentence_pieces():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert tokens.Lengths(path, False)(["a b", None, "a b"]) == [len(model.encode("a b")), 0, len(model.encode("a b"))]


def test_ids_of_mixtures():
    plain, own = Tokenizer.from_file(WORDS), packing.Ids(WORDS)
    for t in mixtures(1500):
        assert own([t])[0] == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_plain_words_go_to_the_merges_at_once(tmp_path):
    """The ids are the library's, and words of a to z don't pass through all of its steps."""

    class Seen:
        model = Tokenizer.from_file(WORDS).model

        def encode_batch_fast(self, chunks, add_special_tokens):
            seen.extend(chunks)
            return plain.encode_batch_fast(chunks, add_special_tokens=add_special_tokens)

    rng, seen, plain, own = random.Random(8), [], Tokenizer.from_file(WORDS), packing.Ids(WORDS)
    own.tokenizer = Seen()
    made = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    texts = [" ".join(made), " ".join(x.title() + rng.choice([",", "$$$", ""]) for x in made), "été ÉTÉ, straße"]
    assert own(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert not {w for chunk in seen for w in chunk.split()} & set(made)
    plain.add_tokens(["hello"])
    plain.save(str(tmp_path / "more.json"))
    assert own.direct and not packing.Ids(str(tmp_path / "more.json")).direct


def test_counts_of_awkward_rows(spark):
    plain = Tokenizer.from_file(BYTES)
    got = tokens.count_tokens(awkward(spark), BYTES, limit=12).collect()
    want = [(r[0], len((r[1] or "").encode()), len(plain.encode(r[1] or "", add_special_tokens=False).ids)) for r in awkward_rows()]
    assert sorted(map(tuple, got), key=str) == sorted([(*x, x[2] > 12) for x in want], key=str)
    assert tokens.count_tokens(empty(spark), BYTES).count() == 0


def test_pack_round_trip(spark):
    plain = Tokenizer.from_file(WORDS)
    got = packing.pack(awkward(spark), WORDS, most=64).collect()
    assert len({r.sequence_id for r in got}) == len(got) == max(r.sequence_id for r in got) + 1
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 64 for r in got)
    want = []
    for r in awkward_rows():
        ids = np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for n in packing.binary_lengths(len(ids), 64):
            want.append((r[0], at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)))
            at += n
        assert at == len(ids)
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert packing.pack(empty(spark), WORDS).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(empty(spark), WORDS, most=100)


def test_binary_lengths():
    assert packing.binary_lengths(13, 4) == [4, 4, 4, 1]
    assert all(sum(packing.binary_lengths(n, 64)) == n for n in range(1, 300))


def check_shards(rows, got, n, slack):
    want = sorted(((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == want
    total, per = sum(w[1] for w in want), dict.fromkeys(range(n), 0)
    slots = {}
    for r in got:
        per[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
        assert (r.law, r.grown_shard) == ("bytes", None)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(per.values()) <= total / n * (1 + slack) + max((w[1] for w in want), default=0)


def test_shards(spark):
    rng = random.Random(1)
    rows = [(i, "same text of many" if i % 3 == 0 else "x" * rng.randrange(400)) for i in range(3000)]
    check_shards(rows, shards.shard(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect(), 6, 0.05)
    check_shards(awkward_rows(), shards.shard(awkward(spark), 3).collect(), 3, 10)
    assert shards.shard(empty(spark), 3).count() == 0


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    """A sample that sees next to nothing leaves ranges overfull; they are cut anew, and shards come out even."""
    draws, draw = [], shards.draw
    monkeypatch.setattr(shards, "draw", lambda *x: draws.append(1) or draw(*x))
    rng = random.Random(7)
    rows = [(i, "copies of one text " * 5 if i % 3 == 0 else "y" * rng.randrange(300)) for i in range(4000)]
    got = shards.shard(spark.createDataFrame(rows, "doc_id long, text string"), 5, ranges_per_shard=16, samples_per_range=1).collect()
    assert len(draws) == 2
    check_shards(rows, got, 5, 0.1)


def plain_pairs(rows):
    """The same records, conversation by conversation."""
    talks = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            talks.setdefault(c, []).append((-1 if turn is None else turn, role or "unknown", text or ""))
    answers = {c: max([x for x in t if x[1] == "assistant"], default=None, key=lambda x: (x[0], x[2])) for c, t in talks.items()}
    return plain_records({c: (chosen := [x for x in sorted(t) if not answers[c] or (x[0], x[1], x[2]) <= answers[c]], [*chosen[:-1], (*answers[c][:2], (answers.get(c ^ 1) or (0, 0, ""))[2])] if answers[c] else chosen) for c, t in talks.items()})


def plain_records(pairs):
    out = []
    for pair, (chosen, rejected) in pairs.items():
        n = next((i for i, (a, b) in enumerate(zip(chosen, rejected)) if a != b), min(len(chosen), len(rejected)))
        for part, said in (("prompt", chosen[:n]), ("chosen", chosen[n:]), ("rejected", rejected[n:])):
            nth, groups = Counter(), {}
            for turn, role, text in (chosen[:n] if part != "prompt" else []):
                nth[turn] += 1
            for turn, role, text in said:
                groups.setdefault((turn // 32, nth[turn] // 32), []).append((role, text))
                nth[turn] += 1
            for (chunk, over), own in groups.items():
                text, spans = "", []
                for role, words in own:
                    start = len(text) + len(f"<|im_start|>{role}\n")
                    text += f"<|im_start|>{role}\n{words}<|im_end|>\n"
                    spans += [f"{start}-{len(text)}"] if role == "assistant" and part != "prompt" else []
                out.append((pair, part, chunk, over, len(own), text, ",".join(spans)))
    return sorted(out, key=str)


def formatted(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string").toDF("conv_id", "turn", "role", "text", "CONV_ID")
    return sorted((tuple(r) for r in chat.format_preferences(chat.answer_swaps(df)).collect()), key=str)


def test_chat(spark):
    rows = [(4, 0, "user", "q", ""), (4, 1, "assistant", "a", ""), (4, 2, "user", "later", ""), (5, 0, "assistant", "b", ""), (8, 0, "user", "only", ""), (None, 0, "user", "lost", ""), (12, None, None, None, ""), (12, 1, "assistant", "\u00e9", "")]
    assert formatted(spark, rows) == plain_pairs(rows) and len(plain_pairs(rows)) == 9
    assert ("4", "chosen", "0", "0", "1", "<|im_start|>assistant\na<|im_end|>\n", "22-34") in [tuple(map(str, r)) for r in formatted(spark, rows)]
    assert formatted(spark, []) == []


def test_chats_of_any_length(spark):
    """Many turns, repeated turns, ties, equal answers of both sides, negative and missing numbers, long texts."""
    rng = random.Random(3)
    rows = [(c, rng.choice([None, -5, *range(n)]), rng.choice(["user", "assistant", "system", None]), rng.choice(["x", "yy", "", None, "z" * 50_000 if c == 7 else "w"]), "") for c, n in ((2, 3), (3, 100), (6, 1), (7, 9), (20, 40), (21, 2)) for _ in range(90)]
    rows += [(30, 0, "user", "same", "")] * 100 + [(30, 1, "assistant", "y", "")] * 3 + [(31, 4, "assistant", "y", "")]
    assert formatted(spark, rows) == plain_pairs(rows)


def test_sides_of_different_length(spark):
    rows = [(1, s, t, "assistant", f"{t}") for s, n in (("chosen", 3), ("rejected", 50)) for t in range(n)]
    got = chat.format_preferences(chat.sides(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string"))).collect()
    want = plain_records({1: ([(t, "assistant", f"{t}") for t in range(3)], [(t, "assistant", f"{t}") for t in range(50)])})
    assert sorted(map(tuple, got), key=str) == want and [(r[1], r[2]) for r in want] == [("prompt", 0), ("rejected", 0), ("rejected", 1)]


def test_sums_of_parts(spark):
    rng = random.Random(4)
    rows = [(b, p, rng.randrange(1, 9)) for b in (0, 3, 12) for p in range(0, 3000, 7)]
    got = {(r.bucket, r.part): r.before for r in packing.starts(spark.createDataFrame(rows, "bucket long, part int, n long")).collect()}
    want, total = {}, 0
    for b, p, n in sorted(rows, key=lambda r: (-r[0], r[1])):
        want[b, p], total = total, total + n
    assert got == want
