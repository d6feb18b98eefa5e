"""Prefix trie, cross-tokenizer alignment and exact dedup against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from helpers import SPACED, awkward, awkward_rows, empty, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallymark.llm import align, exact, trie

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# exact dedup


def plain_dedup(rows):
    """rows: (doc_id, text). The kept row of repeated ones is the first."""
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, i))
    out = [None] * len(rows)
    for key, own in groups.items():
        best = min(own)
        for x in own:
            out[x[3]] = (rows[x[3]][0], rows[best[3]][0], len(own), x == best, sha(key))
    return out


def test_exact_dedup_of_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in awkward_rows()] + [(50, "o ne"), (51, "o\tn\x0be"), (52, "日本é"), (53, "\x1c日"), (60, " o n e"), (61, " o n e")]
    docs = spark.createDataFrame([(a, b, "x", 5) for a, b in rows], "doc_id long, text string, DOC_ID2 string, n long")
    got = [tuple(r) for r in exact.deduplicate(docs).collect()]
    assert sorted(got, key=str) == sorted(plain_dedup(rows), key=str)
    assert exact.deduplicate(empty(spark)).count() == 0


def test_exact_dedup_of_clashing_names_and_a_hot_text(spark):
    rows = [(i, "the same" if i % 3 else f"own {i % 500}") for i in range(4000)]
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id int, text string, TEXT2 string, DIGEST int")
    got = [tuple(r) for r in exact.deduplicate(docs).collect()]
    assert sorted(got) == sorted(plain_dedup(rows))


def test_index_over_batches(spark, tmp_path):
    rng, folder, seen = random.Random(3), str(tmp_path / "index"), []
    for batch in range(3):
        rows = [(batch * 1000 + i, rng.choice(["a", "a b", " a  b ", "c", f"d{rng.randrange(400)}"])) for i in range(500)]
        seen += rows
        got = {r.doc_id: r for r in exact.deduplicate_batch(spark.createDataFrame(rows, "doc_id long, text string"), folder).collect()}
        want = {x[0]: x for x in plain_dedup(seen)}
        assert len(got) == len(rows)
        for i, _ in rows:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == want[i][1:4]
    assert exact.generations(spark, folder) == ["gen-000000003"]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 256, (5000, 32), dtype="u1")
    hashed = exact.PerfectHash.over(keys)
    assert sorted(hashed.slots(keys)) == list(range(5000))
    again = exact.PerfectHash.unpack(hashed.pack())
    strangers = rng.integers(0, 256, (5000, 32), dtype="u1")
    assert (again.slots(keys) == hashed.slots(keys)).all() and again.slots(strangers).max() < 5000
    assert (again.slots(strangers) >= 0).any()  # what the bytes in the slots are compared for


# alignment


def plain_tokens(texts):
    import sentencepiece

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    alphabet = align.byte_alphabet()
    out = []
    for text in texts:
        left, right = (a.encode(" " + text, add_special_tokens=False), b.encode(text)) if text else (None, [])
        if left is None:
            out.append(([], []))
            continue
        own = [(i, bytes(alphabet[c] for c in t)) for i, t in zip(left.ids, left.tokens)]
        pieces = [b.id_to_piece(i) for i in right]
        other = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()) for i, p in zip(right, pieces)]
        same = all(b"".join(x for _, x in side) == (" " + text).encode() for side in (own, other))
        out.append((own, other) if same else ([], []))
    return out


def spans(side):
    at = 0
    for i, x in side:
        yield i, at, at + len(x)
        at += len(x)


def plain_align(texts):
    every, links, counts = plain_tokens(texts), [], Counter()
    for own, other in every:
        right = list(spans(other))
        found = [(i, j) for i, s, e in spans(own) for j, f, g in right if f < e and s < g]
        links.append(found)
        counts.update(found)
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    out = []
    for (own, other), found in zip(every, links):
        ends = sorted({e for _, _, e in spans(own)} & {e for _, _, e in spans(other)})
        groups = [",".join(str(i) for i, _, e in spans(own) if s < e <= t) + "|" + ",".join(str(i) for i, _, e in spans(other) if s < e <= t) for s, t in zip([0, *ends], ends)]
        out.append((len(own), len(other), len(groups), len(found), sum(counts[x] == best[x[1]] for x in found), sum(counts[x] for x in found), sha(";".join(groups)) if own else ""))
    return out


BITS = ["a", "Bar", " ", " ", "  ", "\n", "\t", "é", "日本", "▁", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x41>", "😀", "'s", "naïve", "unbelievable", "2024", "...", "\x1c", " ", "\u0085", "​", "ﬁ", "٣"]


def test_alignment_of_mixtures(spark):
    rng = random.Random(8)
    texts = [None, "", " ", "x ", " x", *["".join(rng.choice(BITS) for _ in range(rng.randrange(1, 25))) for _ in range(700)]]
    got = align.align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), A, B).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == plain_align(texts)
    assert any(r.n_groups < min(r.n_a, r.n_b) for r in got) and any(t and not r.n_a for t, r in zip(texts, sorted(got)))


def test_alignment_of_awkward_rows(spark, monkeypatch):
    docs = awkward(spark)
    rows = [r for r in awkward_rows() if len(r[1] or "") < 1000]
    short = spark.createDataFrame(rows, docs.schema)
    got = [tuple(r) for r in align.align(short, A, B).collect()]
    assert sorted(got, key=str) == sorted([(r[0], *x) for r, x in zip(rows, plain_align([r[1] for r in rows]))], key=str)
    assert align.align(docs, A, B).count() == docs.count()
    assert align.align(empty(spark), A, B).count() == 0


def test_alignment_in_many_steps_and_parts(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").withColumn("text", F.substring("text", 1, 300))
    want = {r["doc_id"]: x for r, x in zip(docs.collect(), plain_align([r["text"] for r in docs.collect()]))}
    whole = {r[0]: tuple(r)[1:] for r in align.align(docs, A, B).collect()}
    monkeypatch.setattr(align, "PART_BYTES", 400)  # read on the driver: how many parts a bucket has
    parted = {r[0]: tuple(r)[1:] for r in align.align(docs.repartition(5), A, B).collect()}
    assert whole == want and parted == want


def test_one_huge_word(spark):
    text = "ab" * 200_000
    got = align.align(spark.createDataFrame([(1, text), (2, "ab")], "doc_id long, text string"), A, B).collect()
    assert {r.doc_id for r in got} == {1, 2} and max(r.n_a for r in got) == len(Tokenizer.from_file(A).encode(" " + text).ids)


def test_small_memo(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "of", "a▁b", f"w{rng.randrange(300)}", "naïve\nx"]) for _ in range(20)) for _ in range(60)]
    once = align.Aligner(A, B)
    want = [once([x]) for x in texts]
    monkeypatch.setattr(align, "MEMO", 30)
    small = align.Aligner(A, B)
    for x, (counts, digests, key, times) in zip(texts, want):
        got = small([x])
        assert (got[0] == counts).all() and got[1] == digests and (got[2] == key).all() and (got[3] == times).all()
    assert len(small.at) < 60 < len(once.at)


def test_pair_counts(spark):
    texts = ["a naïve word", "a word", None]
    counts = Counter()
    for own, other in plain_tokens(texts):
        counts.update((i, j) for i, s, e in spans(own) for j, f, g in spans(other) if f < e and s < g)
    got = align.pair_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), A, B).collect()
    assert {(r.a_id, r.b_id): r.n for r in got} == dict(counts)


# trie


def plain_trie(convs):
    """convs: conv_id to its turns, (role, text) each."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(x[:-1] for x in members if x)
    leaves, saved = Counter(), Counter()
    for x, own in members.items():
        for d in range(len(x) + 1):
            leaves[x[:d]] += not kids[x]
            saved[x[:d]] += (len(own) - 1) * len(re.findall(SPACED, x[-1][1])) if x else 0
    return sorted(
        (min(own), len(x), min(members[x[:-1]]) if x else None, len(own), kids[x], leaves[x], saved[x], sha(",".join(str(c) for c in sorted(own) if len(convs[c]) == len(x))))
        for x, own in members.items()
    )


def plain_turns(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(own)] for c, own in convs.items()}


def plain_rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def test_trie_of_the_table(spark, data):
    table = spark.read.parquet(f"{data}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    want = plain_trie(plain_rebuilt(plain_turns(rows)))
    for local in (trie.LOCAL, 5, 0):
        assert sorted(map(tuple, trie.regrafted_trie(table, local).collect())) == want


def test_trie_of_random_turns(spark):
    rng = random.Random(2)
    rows = []
    for c in rng.sample(range(400), 150):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([t, t, t, None, 1]), rng.choice(["u", "a", None]), rng.choice(["x", "x y", " ", None, "z  z\tz"])))
    rows += [(None, 1, "u", "x"), (401, None, None, None), (401, None, None, None)]
    table = spark.createDataFrame([(*r, 7, "i", 0) for r in rows], "conv_id long, turn long, role string, text string, n_convs int, ID string, words int")
    convs = plain_turns(rows)
    assert sorted(map(tuple, trie.regrafted_trie(table, 12).collect())) == plain_trie(plain_rebuilt(convs))
    assert sorted(map(tuple, trie.trie(table, 30).collect())) == plain_trie(convs)
    assert [len(words(x)) for x in ("z  z\tz", None)] == [3, 0]


def test_trie_of_many_open_buckets(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARES", 3)
    rows = [(i, t, "u", f"{i % (3 + t * 4)}") for i in range(600) for t in range(4)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, trie.trie(table, 8).collect())) == plain_trie(plain_turns(rows))


def test_trie_of_copies_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_BYTES", 50)  # read where the function is made
    rows = [(i, 0, "u", "same") for i in range(300)] + [(1000 + k, t, "u", f"w{t}") for k in range(3) for t in range(2000 + k)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = sorted(map(tuple, trie.trie(table, 50).collect()))
    convs = plain_turns(rows)
    assert len(got) == 1 + 1 + 2002 and got[0][:7] == (0, 0, None, 303, 2, 2, got[0][6])
    assert got[1] == (0, 1, 0, 300, 0, 1, 299, sha(",".join(map(str, range(300)))))
    assert got[0][6] == 299 + 2 * 2000 + 1 and len(convs) == 303


def test_empty_and_textless(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.regrafted_trie(spark.createDataFrame([], schema)).count() == 0
    c = next(c for c in range(21, 200) if zlib.crc32(str(c).encode()) % 4 and c % 20)
    got = trie.regrafted_trie(spark.createDataFrame([(c, 0, "u", "x")], schema)).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, sha(str(c)))]
