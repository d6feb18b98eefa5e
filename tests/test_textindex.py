"""Search expressions and the stored index against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tallymark.operators import match, search
from tallymark.operators.textindex import Conflict, TextIndex
from tallymark.sources import files

COLUMNS = ["title", "note"]
SCHEMA = "id long, title string, note string"


def said(text):
    return [x for x in re.split(r"[\W_]+", match.fold(text or "")) if x]


def places(row, p):
    """Where a phrase stands in a row: (column, start)."""
    for c in COLUMNS:
        words = said(row[c])
        for i in range(len(words) - len(p.terms) + 1):
            part = words[i : i + len(p.terms)]
            fits = part == p.terms or p.prefix and part[:-1] == p.terms[:-1] and part[-1].startswith(p.terms[-1])
            if p.terms and fits and (p.columns is None or c in p.columns) and (not p.first or i == 0):
                yield c, i


def plain(rows, query):
    node, phrases = match.parsed(query, COLUMNS)
    found = [[list(places(r, p)) for p in phrases] for r in rows]
    average = sum(len(said(r[c])) for r in rows for c in COLUMNS) / max(len(rows), 1)

    def near(x, at):
        first, *rest = x.parts

        def go(field, chosen, left):
            if not left:
                begin = min(s for _, s in chosen)
                end = next(s + len(phrases[i].terms) for i, s in reversed(chosen) if s == begin)
                return max(s for _, s in chosen) - end <= x.within
            return any(go(field, [*chosen, (left[0], s)], left[1:]) for f, s in at[left[0]] if f == field)

        return any(go(f, [(first, s)], rest) for f, s in at[first])

    def holds(x, at):
        if x.kind == "phrase":
            return bool(at[x.parts[0]])
        if x.kind == "near":
            return near(x, at)
        parts = [holds(y, at) for y in x.parts]
        return any(parts) if x.kind == "or" else all(parts) if x.kind == "and" else parts[0] and not any(parts[1:])

    out = {}
    for r, at in zip(rows, found):
        if holds(node, at):
            score, dl = 0.0, sum(len(said(r[c])) for c in COLUMNS)
            for i in range(len(phrases)):
                df, tf = sum(bool(f[i]) for f in found), len(at[i])
                score += math.log((len(rows) - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average))
            out[r["id"]] = math.floor(score * 1e6 + 0.5) / 1e6
    return out


def rows_of(seed, n, start=0):
    rng = random.Random(seed)
    words = ["Año", "ano", "tax", "taxes", "Income", "income", "bond", "água", "x1", "the", "THE", "of", "é"]
    make = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(9))) if rng.random() < 0.9 else None
    return [{"id": start + i, "title": make(), "note": make()} for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(r["id"], r["title"], r["note"]) for r in rows], SCHEMA)


QUERIES = [
    "tax", "ano", '"income tax"', "tax*", "inc* NOT bond", "tax OR bond AND the", "(tax OR bond) the", "title : ano", "{title note} : tax", "- title : bond", '^"the"', "title : ^income + tax*", "NEAR(tax bond, 1)",
    'NEAR("the of" tax income, 3)', "NEAR(tax tax, 2)", "agua AND note : (the OR of)", "nothing", '"AND"',
]


def test_expressions(spark):
    rows = rows_of(1, 120)
    df = frame(spark, rows)
    for q in QUERIES:
        got = {r.doc: r.score for r in match.matching(df, "id", COLUMNS, q).collect()}
        want = plain(rows, q)
        assert got.keys() == want.keys(), q
        assert all(abs(got[i] - want[i]) < 2e-6 for i in want), q


@pytest.mark.parametrize("query", ["", "  ", "(", "a)", "a AND", "NOT a", "OR", '"a', "a:b:c", "other : a", "NEAR(a, b)", "NEAR()", "a ^", "*", "a.b", "{title : a", "-"])
def test_malformed(query):
    with pytest.raises(match.Malformed):
        match.parsed(query, COLUMNS)


def test_fallback(spark):
    df = frame(spark, [{"id": 1, "title": "a(b", "note": None}, {"id": 2, "title": "a b", "note": "c"}]).withColumns({"description": F.col("note"), "ballot_question": F.col("note"), "is_active": F.lit(True), "is_duplicate": F.lit(False), "year": F.lit(2000)})
    assert [r.id for r in search.search_measures(df, "a(").collect()] == [1]
    assert [r.id for r in search.search_measures(df, "a b").collect()] == [2, 1] or [r.id for r in search.search_measures(df, "a b").collect()] == [1, 2]
    assert [r.id for r in search.search_measures(df, "c").collect()] == [2]


def test_index_life(spark, tmp_path):
    folder = str(tmp_path / "index")
    rows = {r["id"]: r for r in rows_of(2, 60)}
    index = TextIndex(spark, folder, COLUMNS)
    with pytest.raises(ValueError, match="empty"):
        index.search("tax")
    index.add(frame(spark, rows.values()).unionByName(frame(spark, [{"id": None, "title": "tax", "note": ""}])))

    def same():
        for q in ("tax", '"income tax"', "ta* NOT bond", "NEAR(tax bond, 2)"):
            got = {r.doc: r.score for r in TextIndex(spark, folder, COLUMNS).search(q).collect()}
            want = plain(list(rows.values()), q)
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in want)

    same()
    more = {r["id"]: r for r in rows_of(3, 40, start=40)}  # twenty of them are there already
    index.add(frame(spark, more.values()))
    rows |= more
    same()
    index.delete(frame(spark, [r for i, r in rows.items() if i % 4 == 0]).select(F.col("id").alias("doc")))
    rows = {i: r for i, r in rows.items() if i % 4}
    same()
    back = rows_of(4, 1, start=4)
    index.add(frame(spark, back))  # a deleted one comes again
    rows[4] = back[0]
    same()
    index.merge()
    assert len([x for x in files.listed(spark, folder) if x.startswith("segment-")]) == 1 and not [x for x in files.listed(spark, folder) if x.startswith("tomb")]
    same()
    assert (index.state["n"], index.state["total"]) == (len(rows), sum(len(said(r[c])) for r in rows.values() for c in COLUMNS))


def test_two_writers(spark, tmp_path):
    first, second = (TextIndex(spark, str(tmp_path / "index"), COLUMNS) for _ in range(2))
    first.add(frame(spark, rows_of(5, 5)))
    with pytest.raises(Conflict):
        second.add(frame(spark, rows_of(6, 5)))
    assert TextIndex(spark, str(tmp_path / "index"), COLUMNS).state["n"] == 5


def test_a_search_opens_its_ranges_alone(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index"), COLUMNS)
    index.add(frame(spark, [{"id": i, "title": f"w{i} common", "note": ""} for i in range(3000)]))
    assert len(index.state["splits"]) > 20
    _, phrases = match.parsed("w7", COLUMNS)
    assert len(index.ranges(phrases)) == 1 and len(index.ranges(match.parsed("w1*", COLUMNS)[1])) < len(index.state["splits"])
    plan = index.places(phrases)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*range#\d+", plan) and "PushedFilters: [EqualTo(term,w7)]" in plan.replace("In(term, [w7])", "EqualTo(term,w7)") or "term" in plan
    assert [r.doc for r in index.search("w7").collect()] == [7]
