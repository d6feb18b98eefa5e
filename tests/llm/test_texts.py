"""Near-duplicates, decontamination, substring dedup against brute force; nulls, long texts, ties, empty tables, clashing names."""

import hashlib
import random

import pytest
import xxhash
from helpers import LOWER, PLAIN, awkward, awkward_rows, empty, words
from support import same

from tallymark.llm import components, decontam, entry, runs, simhash, substring


def fingerprint(text):
    w = words((text or "").translate(LOWER))
    lines = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in lines]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def groups(fps, bits=2):
    """{node: smallest node reachable} of {node: fingerprint}."""
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(fps):
        for b in sorted(fps):
            if a < b and (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in fps}


def test_fingerprints_of_awkward_texts():
    texts = [r[1] for r in awkward_rows()]
    got = simhash.fingerprints([None if t is None else t.encode() for t in texts])
    assert [int(x) for x in got] == [fingerprint(t) for t in texts]


@pytest.mark.parametrize("most", [32, 2])
def test_simhash_groups(spark, most):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(50)) for _ in range(300)) for _ in range(6)]
    rows = []
    for i in range(60):
        w = rng.choice(base).split()
        if i % 2:
            w[rng.randrange(300)] = "changed"
        rows.append((i, " ".join(w)))
    got = simhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), most=most).collect()
    fps = {i: fingerprint(t) for i, t in rows}
    want = groups(fps)
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {i: (fps[i], want[i]) for i in fps}


@pytest.mark.parametrize("most", [32, 3, 1])
def test_links_of_chains(spark, most):
    rng, fps = random.Random(3), set()
    for _ in range(10):
        v = rng.getrandbits(64)
        for _ in range(30):
            fps.add(v)
            for _ in range(rng.choice([0, 1, 2])):
                v ^= 1 << rng.randrange(64)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(v),) for v in fps], "fp long")
    got = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in components.roots(simhash.near_links(df, most)).collect()}
    want = groups({v: v for v in fps})
    assert {frozenset(x for x in fps if got.get(x, x) == g) for g in {got.get(x, x) for x in fps}} == {frozenset(x for x in fps if want[x] == g) for g in set(want.values())}


@pytest.mark.parametrize("most", [32, 2])
def test_the_count_filter_takes_the_pairs_with_six_bytes(spark, most):
    """Against all pairs: whoever shares six bytes is kept with its tally, others that meet are dropped by it."""
    rng, center = random.Random(6), random.Random(7).getrandbits(64)
    fps = sorted({center} | {center ^ sum((1 << rng.randrange(8)) << 8 * b for b in rng.sample(range(8), rng.choice([1, 2, 3, 4]))) for _ in range(60)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {frozenset((r.u & (1 << 64) - 1, r.v & (1 << 64) - 1)): r.shared for r in simhash.tallies(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), most).collect()}
    share = {frozenset((a, b)): sum((a ^ b) >> 8 * i & 255 == 0 for i in range(8)) for a in fps for b in fps if a < b}
    kept, links = {k: n for k, n in got.items() if n >= 6}, {k for k in share if (min(k) ^ max(k)).bit_count() <= 2}
    assert all(share[k] == n for k, n in kept.items()) and links <= set(kept) and links
    if most == 32:  # no list is taken apart
        assert kept == {k: n for k, n in share.items() if n >= 6} and any(n < 6 for n in got.values())


def test_a_family_of_any_size_emits_no_square(spark):
    """Fingerprints that differ in two bytes only: lists of 600 members, yet few pairs a member, and every link."""
    rng = random.Random(9)
    fps = sorted({rng.getrandbits(16) for _ in range(600)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {(r.u, r.v) for r in simhash.near_links(df).collect()}
    assert got == {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    assert simhash.tallies(df).count() < 100 * len(fps)


def test_an_id_with_two_texts_keeps_each_group(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, a, "p"), (1, a, "q"), (1, b, "r"), (2, a, "s"), (3, b, "t"), (None, a, "u")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, h string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("1", a), ("1", b), ("None", a)])


def test_simhash_of_awkward_rows(spark):
    got = [(r.doc_id, r.component_id) for r in simhash.groups(awkward(spark)).collect()]
    assert len(got) == len(awkward_rows())
    assert dict(x for x in got if x[0] in (0, 1, 2, 6, 7, 8, 9)) == {0: 0, 1: 0, 2: 0, 6: 6, 7: 6, 8: 8, 9: 8}
    assert sorted((x for x in got if x[0] is None), key=str) == [(None, 0), (None, 8)]
    assert simhash.groups(empty(spark)).count() == 0
    clashing = awkward(spark).toDF("doc_id", "text", "DOC_ID", "TEXT", "nth", "h", "fp")
    assert simhash.keep_one(clashing).columns == clashing.columns and simhash.keep_one(clashing).count() == simhash.keep_one(awkward(spark)).count()
    kept = simhash.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 3, 4, 5, 6, 8, 10, 11, 12]


def contaminated(bench, docs):
    found = {}
    for k, t in bench:
        w = words((t or "").translate(LOWER), PLAIN)
        n = min(10, len(w))
        for i in range(len(w) - n + 1):
            if n:
                found.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = []
    for d, t in docs:
        w, hit, items = words((t or "").translate(LOWER), PLAIN), set(), set()
        for n in {len(x) for x in found}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in found:
                    hit.update(range(i, i + n))
                    items |= found[tuple(w[i : i + n])]
        names = ",".join(sorted(str(x) for x in items if x is not None))
        out.append((d, len(w), len(hit), len([x for x in items if x is not None]), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [decontam.FILTER_BITS, 64])
def test_decontamination(spark, bits, monkeypatch):
    """With a filter that lets nearly everything pass too."""
    monkeypatch.setattr(decontam, "FILTER_BITS", bits)
    rng = random.Random(5)
    text = lambda n, v: " ".join(rng.choice("xyzw") * 2 + str(rng.randrange(v)) for _ in range(n))
    bench = [(i, text(rng.choice([1, 3, 9, 10, 11, 30]), rng.choice([1, 40]))) for i in range(12)] + [(3, text(12, 40)), (None, text(15, 40)), (50, None), (51, "..")]
    docs = [(i, text(40, 40) + " ! " + " ".join((bench[i % 14][1]).split()[:13]).upper() + ", " + text(20, 2)) for i in range(30)] + [(30, None), (31, "")] + [(5, "aa bb")] * 2
    got = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == contaminated(bench, docs)


def test_decontamination_of_awkward_rows(spark):
    bench = spark.createDataFrame([(1, "A B C D E F G H I J", "x")], "item_id long, text string, doc_id string")
    got = decontam.decontaminate(awkward(spark), bench)
    assert sorted((r.doc_id for r in got.where("contaminated").collect()), key=str) == [8, 8, 8, 9, None]
    assert got.count() == len(awkward_rows())
    assert decontam.decontaminate(awkward(spark), bench.limit(0)).where("contaminated").count() == 0
    assert decontam.decontaminate(empty(spark), bench).count() == 0
    clashing = awkward(spark).toDF("doc_id", "text", "DOC_ID", "k0", "TEXT", "n_words", "c0")
    for df in (awkward(spark), clashing):
        clean = decontam.clean(df, bench)
        assert clean.columns == df.columns and clean.count() == len(awkward_rows()) - 5
    assert decontam.clean(empty(spark), bench).count() == 0


def stripped(rows):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 12):
            if d is not None:
                k = tuple(w[i : i + 13])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = {j for i in range(len(w) - 12) if d is not None and first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("vocabulary", "batches"), [(2, 1), (3, 3), (40, 2)])
def test_substring_dedup(spark, vocabulary, batches):
    rng = random.Random(vocabulary)
    text = lambda n: " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
    base = [text(60) for _ in range(3)]
    rows = [(i, text(rng.choice([0, 5, 12, 13, 40])) + " " + (rng.choice(base)[rng.randrange(30) :] if rng.random() < 0.5 else "")) for i in range(50)]
    rows += [(3, base[0]), (3, base[0]), (None, base[0]), (None, None), (100, None), (102, "é b " * 20), (103, "é b " * 20)]
    rng.shuffle(rows)
    got = substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), batches=batches).collect()
    assert sorted(map(tuple, got), key=str) == stripped(rows)


def test_substring_of_awkward_rows(spark):
    got = substring.deduplicate(awkward(spark)).collect()
    assert sorted(map(tuple, got), key=str) == stripped([r[:2] for r in awkward_rows()])
    assert substring.deduplicate(empty(spark)).count() == 0
    left = substring.strip(awkward(spark))
    assert left.columns == awkward(spark).columns
    assert 7 not in [r.doc_id for r in left.collect()] and left.where("doc_id = 6").count() == 1


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_polynomials_cannot_tell_apart(spark):
    x = thue_morse(1024)
    y = x.translate(str.maketrans("ab", "ba"))
    rows = [(i + 1, " ".join([f"w{j}" for j in range(6)] + [w] + [f"v{j}" for j in range(6)])) for i, w in enumerate((x, y))]
    got = substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == stripped(rows) and not any(r.n_removed for r in got)


def test_a_later_session_adds_to_stored_runs(spark, tmp_path):
    rng, folder = random.Random(8), str(tmp_path / "index")
    base = [" ".join(f"w{rng.randrange(30)}" for _ in range(60)) for _ in range(4)]
    rows = [(i, " ".join(f"u{rng.randrange(9)}" for _ in range(14)) + " " + rng.choice(base)[rng.randrange(90) :]) for i in range(80)]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    got, start = [], 0
    for end in (30, 50, 60, 80):  # fanout 2: runs are compacted on the way, over several levels
        got += substring.deduplicate(frame(rows[start:end]), batches=1, index=folder, earlier=frame(rows[:start])).collect()
        start = end
    assert sorted(map(tuple, got), key=str) == stripped(rows)
    store = runs.Runs(spark, folder)
    assert [level for level, _ in store.live] == [2] and {p.name.split("-")[0] for p in (tmp_path / "index").iterdir()} == {"batch", "manifests"}
    with pytest.raises(ValueError):
        substring.deduplicate(frame(rows[:1]), index=folder)


def test_stored_runs_are_sorted_and_met_in_any_number_of_ranges(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i % 3) * 100 + j}" for j in range(30))) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    store = runs.Runs(spark, str(tmp_path), 2)
    substring.indexed(docs.where("doc_id < 3"), store, [], 4, True, [])
    parts = [substring.unpacked(r.a, r.b, 2)[0][:, 0] for r in store.read().orderBy("bucket", "part").collect()]
    assert all((x[1:] >= x[:-1]).all() for x in parts) and len({r.bucket for r in store.read().collect()}) > 1
    later = substring.merge(substring.fingerprint_run(docs.where("doc_id >= 3"), 7), store.read(), 7)
    assert sorted(r.doc_id for r in substring.for_documents(later.where("kind = 1"), 4).collect()) == [3, 4, 5]


def test_substring_of_other_names_and_types(spark):
    df = spark.createDataFrame([(1, "a " * 20, 3, "x"), (2, "a " * 20, 4, None), (3, None, 5, "y")], "doc_id int, text string, TEXT2 int, found string").toDF("doc_id", "text", "TEXT", "found")
    left = substring.strip(df)
    assert left.columns == df.columns and [tuple(r) for r in left.collect()] == [(1, "a " * 20, 3, "x"), (3, None, 5, "y")]
    with pytest.raises(ValueError):
        substring.deduplicate(df.selectExpr("cast(doc_id as string) doc_id", "found as text"))


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_sql(name, spark, data, duck):
    assert same(entry.QUERIES[name](spark, data), duck, entry.ORACLES[name]) > 0
