"""Likeness joins and kept statistics against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tallymark.operators import kept, likeness, stats
from tallymark.sources import facade


def brute(rows, threshold):
    sets = {}
    for i, text in sorted(rows):
        if words := frozenset((text or "").lower().split()):
            sets.setdefault(words, i)
    out = set()
    for x, a in sets.items():
        for y, b in sets.items():
            if a < b and len(x & y) >= threshold * len(x | y) - 1e-9:
                out.add((a, b, round(len(x & y) / len(x | y), 9)))
    return sets, out


@pytest.mark.parametrize(("seed", "threshold", "many"), [(1, 0.8, 64), (2, 0.8, 2), (3, 0.5, 3), (4, 0.6, 1), (5, 1.0, 2)])
def test_likeness_is_brute_force(spark, monkeypatch, seed, threshold, many):
    monkeypatch.setattr(likeness, "MANY", many)
    rng = random.Random(seed)
    # few words, some in nearly every row, and near copies of some rows
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(260):
        own = set(rng.choices(words, weights=[1 / (k + 1) for k in range(30)], k=rng.randrange(0, 14)))
        if i % 3 == 0 and rows:
            own = set((rows[-1][1] or "").split()) ^ set(rng.choices(words, k=rng.randrange(3)))
        rows.append((i, " ".join(own) if rng.random() < 0.97 else None))
    df = spark.createDataFrame(rows, "id long, t string")
    sets, want = brute(rows, threshold)
    members, found = likeness.classes(df, "id", F.col("t"))
    got = {(r.a, r.b, round(r.likeness, 9)) for r in likeness.pairs(found, threshold).collect()}
    assert got == want
    assert {r.id: r.class_id for r in members.collect()} == {i: sets[frozenset((t or "").lower().split())] for i, t in rows if (t or "").split()}
    if seed == 1:
        links = {r.id: r.links for r in likeness.alike(df, "id", F.col("t"), threshold).collect()}
        ends = [x for a, b, _ in want for x in (a, b)]
        assert all(n == ends.count(sets[frozenset(t.split())]) for i, t in rows if t and (n := links[i]) is not None)


def test_no_plan_meets_all_pairs(spark):
    rows = [(i, f"the of measure {i} {i // 2} x{i % 7}") for i in range(3000)]
    _, found = likeness.classes(spark.createDataFrame(rows, "id long, t string"), "id", F.col("t"))
    got = likeness.pairs(found, 0.8)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert got.count() == 0 and likeness.pairs(found.limit(0)).count() == 0
    with pytest.raises(ValueError, match="threshold"):
        likeness.pairs(found, 0.3)


def test_kept_statistics_are_a_recount(spark, data):
    m = facade.measures(spark, data)
    old = m.where("id % 3 <> 0")
    now = old.withColumns({  # changed, marked as duplicates, taken away, come back
        "percent_yes": F.when(F.col("id") % 5 == 0, F.lit(12.5)).otherwise(F.col("percent_yes")), "has_summary": (F.col("id") % 4 == 1), "is_duplicate": F.col("id") % 7 == 0, "topic_primary": F.when(F.col("id") % 9 == 0, F.lit(None)).otherwise(F.col("topic_primary")),
    }).where("id % 11 <> 1").unionByName(m.where("id % 3 = 0 AND id < 4000"))
    state = kept.changed(kept.state_of(old.where("id % 2 = 0")), old.where("id < 0"), old.where("id % 2 = 1"))  # states of parts add up
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(state, kept.added(kept.state_of(old)))
    state = kept.changed(state, old, now)
    assert same(kept.overall(state), stats.overall(now))
    for c in ("year", "county", "data_source", "topic_primary"):
        assert same(kept.count_by(state, c), stats.count_by(now, c))
    want = {r.year: r for r in stats.yearly(now).collect()}
    for r in kept.yearly(state).collect():
        assert abs((r.avg_percent_yes or 0) - (want[r.year].avg_percent_yes or 0)) < 0.11
        assert [v for k, v in r.asDict().items() if k != "avg_percent_yes"] == [v for k, v in want[r.year].asDict().items() if k != "avg_percent_yes"]
    assert kept.changed(state, now, now.limit(0)).count() == 0
    assert kept.overall(kept.state_of(m.limit(0))).first().total_measures == 0
