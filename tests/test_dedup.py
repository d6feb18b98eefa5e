"""Masters, merges, upserts and searches on small tables, and properties that must hold on any."""

import random

import pytest
from pyspark.sql import functions as F

from tallymark.functions import values
from tallymark.operators import dedup, filters, search, stats, upsert
from tallymark.sources import facade
from tallymark.streaming.batches import upsert_stream

SCHEMA = "id long, measure_fingerprint string, fingerprint string, content_hash string, data_source string, title string, description string, ballot_question string, pdf_url string, yes_votes long, no_votes long, passed int, has_summary boolean, is_active boolean, is_duplicate boolean, duplicate_type string, master_id long, updated_at timestamp_ntz, update_count int"


def table(spark, rows):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    base = dict.fromkeys(names) | {"has_summary": False, "is_active": True, "is_duplicate": False, "update_count": 0}
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], SCHEMA)


def test_master_and_merge(spark):
    df = table(spark, [
        {"id": 1, "measure_fingerprint": "a", "data_source": "CEDA", "yes_votes": 60, "no_votes": 40, "description": ""},
        {"id": 2, "measure_fingerprint": "a", "data_source": "CA_SOS", "description": "d2", "pdf_url": "#"},
        {"id": 3, "measure_fingerprint": "a", "data_source": "Other", "has_summary": True, "passed": 0},
        {"id": 4, "measure_fingerprint": "b", "data_source": "Other"},
    ])
    got = {r.id: (r.score, r.master_id) for r in dedup.with_master(df, "2020-01-01").collect()}
    assert got == {1: (80, 3), 2: (70, 3), 3: (100, 3), 4: (0, 4)}
    [m] = dedup.merge_fields(df, "2020-01-01").collect()
    assert (m.master_id, m.merged_from, m.description, m.yes_votes, m.total_votes, m.percent_yes, m.passed, m.pass_fail, m.has_summary) == (3, [1, 2], "d2", 60, 100, 60.0, 1, "Pass", True)
    once = dedup.dedupe_cross_source(df, "2020-01-01")
    assert sorted((r.id, r.master_id) for r in once.where("is_duplicate").collect()) == [(1, 3), (2, 3)]
    twice = dedup.dedupe_cross_source(once, "2020-01-01")
    assert sorted((r.id, r.is_duplicate, r.master_id) for r in twice.collect()) == sorted((r.id, r.is_duplicate, r.master_id) for r in once.collect())


def test_upsert(spark):
    old = table(spark, [{"id": 1, "fingerprint": "f1", "content_hash": "c1", "measure_fingerprint": "m1", "title": "a"}, {"id": 2, "fingerprint": "f2", "content_hash": "c2", "measure_fingerprint": "m2"}])
    new = table(spark, [
        {"id": 11, "fingerprint": "f1", "content_hash": "c1", "measure_fingerprint": "m1", "title": "b", "yes_votes": 5},
        {"id": 12, "fingerprint": "f3", "content_hash": "c2", "measure_fingerprint": "m3"},
        {"id": 13, "fingerprint": "f4", "content_hash": "c4", "measure_fingerprint": "m2"},
        {"id": 14, "fingerprint": "f5", "content_hash": "c5", "measure_fingerprint": "m5"},
        {"id": 15, "fingerprint": "f6", "content_hash": "c5", "measure_fingerprint": "m6"},
        {"id": 16, "fingerprint": "f5", "content_hash": "c9", "measure_fingerprint": "m5"},
    ])
    got = {r.id: r for r in upsert.upsert(old, new, "2020-01-01").collect()}
    assert sorted(got) == [1, 2, 12, 13, 14, 15]
    assert (got[1].title, got[1].yes_votes, got[1].update_count, got[2].update_count) == ("b", 5, 1, 0)
    assert {i: (got[i].duplicate_type, got[i].master_id) for i in (12, 13, 14, 15)} == {12: ("content", 2), 13: ("cross_source", 2), 14: (None, None), 15: ("content", 14)}
    assert upsert.upsert_counts(old, new).first().asDict() == {"inserted": 1, "updated": 1, "duplicates": 3, "repeated": 1}


def in_order(old, new):
    """The batch row by row: what becomes of each, and the counts."""
    table = {r["id"]: r for r in old}
    prints, fates, seen = {r["fingerprint"]: r["id"] for r in old if r["fingerprint"]}, {}, set()
    for r in sorted(new, key=lambda r: r["id"]):
        if r["fingerprint"] in seen:
            fates[r["id"]] = ("repeated", None)
            continue
        seen.add(r["fingerprint"])
        if r["fingerprint"] in prints:
            fates[r["id"]] = ("exact", prints[r["fingerprint"]])
            continue
        live = [t for i, t in sorted(table.items()) if not t.get("is_duplicate")]
        kind, master = None, None
        for name, key in (("content", "content_hash"), ("cross_source", "measure_fingerprint")):
            found = next((t["id"] for t in live if r[key] and t[key] == r[key]), None)
            if found is not None:
                kind, master = name, found
                break
        fates[r["id"]] = (kind, master)
        table[r["id"]] = r | {"is_duplicate": kind is not None}
    return fates


@pytest.mark.parametrize("seed", range(3))
def test_batches_go_by_their_order(spark, seed):
    rng = random.Random(seed)
    make = lambda i, many: {"id": i, "fingerprint": f"f{rng.randrange(300)}" if i < 100 else f"f{i - rng.choice([0, 0, 0, 1])}", "content_hash": rng.choice([None, "", *[f"c{rng.randrange(many)}"] * 8]), "measure_fingerprint": rng.choice([None, *[f"m{rng.randrange(many)}"] * 8])}
    prints = set()
    old = [r | {"is_duplicate": rng.random() < 0.3} for r in (make(i, 90) for i in range(60)) if not (r["fingerprint"] in prints or prints.add(r["fingerprint"]))]
    new = [make(i, 90) for i in range(100, 250)] + [make(i, 90) | {"fingerprint": rng.choice(old)["fingerprint"]} for i in range(300, 310)]
    want = in_order(old, new)
    got = upsert.sorted_in(table(spark, old), table(spark, new))
    assert {r.id: ("exact", r.matched_id) if r.fate == "updated" else (r.kind, r.master) for r in got.collect()} == {i: x for i, x in want.items() if x[0] != "repeated"}
    kinds = [x[0] for x in want.values()]
    counts = {"inserted": kinds.count(None), "updated": kinds.count("exact"), "duplicates": kinds.count("content") + kinds.count("cross_source"), "repeated": kinds.count("repeated")}
    assert upsert.upsert_counts(table(spark, old), table(spark, new)).first().asDict() == counts
    assert min(counts.values()) > 0


def test_a_duplicate_is_no_master(spark):
    """The third row has the content of the second, which is itself a duplicate of the first."""
    new = [{"id": 1, "fingerprint": "a", "content_hash": "c1", "measure_fingerprint": "m"}, {"id": 2, "fingerprint": "b", "content_hash": "c2", "measure_fingerprint": "m"}, {"id": 3, "fingerprint": "c", "content_hash": "c2", "measure_fingerprint": "n"}]
    got = {r.id: (r.duplicate_type, r.master_id) for r in upsert.upsert(table(spark, []), table(spark, new), "2020-01-01").collect()}
    assert got == {1: (None, None), 2: ("cross_source", 1), 3: (None, None)}


def test_a_long_chain_of_rounds(spark):
    new = [{"id": i, "fingerprint": f"f{i}", "content_hash": f"c{i // 2}", "measure_fingerprint": f"m{(i + 1) // 2}"} for i in range(12)]
    want = in_order([], new)
    assert {r.id: (r.kind, r.master) for r in upsert.sorted_in(table(spark, []), table(spark, new)).collect()} == want


def test_merged_master(spark):
    df = table(spark, [
        {"id": 1, "measure_fingerprint": "a", "data_source": "CEDA", "yes_votes": 60, "no_votes": 40, "passed": 0},
        {"id": 2, "measure_fingerprint": "a", "data_source": "CA_SOS", "description": "d2", "pdf_url": "#"},
        {"id": 3, "measure_fingerprint": "a", "data_source": "Other", "has_summary": True},
        {"id": 4, "measure_fingerprint": "b", "data_source": "Other", "yes_votes": 5},
        {"id": 5, "measure_fingerprint": "a", "is_duplicate": True, "duplicate_type": "content", "master_id": 1},
    ])
    got = {r.id: r for r in dedup.dedupe_cross_source(df, "2020-01-01").collect()}
    assert (got[3].description, got[3].yes_votes, got[3].passed, got[3].merged_from, got[3].update_count, str(got[3].updated_at)) == ("d2", 60, 1, "[1, 2]", 2, "2020-01-01 00:00:00")
    assert {i: (r.is_duplicate, r.master_id, r.update_count) for i, r in got.items() if i != 3} == {1: (True, 3, 1), 2: (True, 3, 1), 4: (False, None, 0), 5: (True, 1, 0)}
    assert got[1].merged_from is None and got[4].updated_at is None
    parts = {(r.part, r.name): r.n for r in dedup.report(df).collect()}
    assert parts == {("total", None): 1, ("by_type", "content"): 1, ("by_source", None): 1, ("cross_source_groups", None): 1}


def test_numbers_as_they_are(spark):
    raw = spark.createDataFrame([("1,234",), (" 5.5 ",), ("nan",), ("1d",), ("2e3",), (None,), ("",)], "x string")
    got = raw.select(values.number(F.col("x")), values.first_number(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [(None, 1234.0), (5.5, 5.5), (None, None), (None, None), (2000.0, 2000.0), (None, None), (None, None)]


def test_properties(spark, data):
    m = facade.keyed(spark, data).withColumns({"update_count": F.lit(0), "master_id": F.lit(None).cast("long")})
    old, new = m.where("id % 3 <> 0"), m.where("id % 3 = 0")
    assert upsert.classify(old, new).count() == new.count()
    live = filters.active(m).count()
    assert sum(r.n for r in stats.count_by(m, "data_source").collect()) == live
    assert sum(filters.faceted(m, filters.Facets(statuses={s})).count() for s in ("passed", "failed", "pending")) == m.count()
    with pytest.raises(ValueError, match="limit"):
        filters.page(m, 0)
    with pytest.raises(ValueError, match="limit"):
        search.search(m, search.SearchRequest(limit=2000))


def test_search(spark):
    df = spark.createDataFrame([(1, "red red fish"), (2, "Red, blue!"), (3, None), (4, "blue")], "id long, t string")
    assert [r.doc for r in search.ranked(df, "id", F.col("t"), "red").collect()] == [1, 2]
    assert [r.doc for r in search.ranked(df, "id", F.col("t"), "RED blue").collect()] == [2]
    assert search.ranked(df, "id", F.col("t"), "?!").count() == 0
    assert search.ranked(df.limit(0), "id", F.col("t"), "red").count() == 0


def test_stream(spark, tmp_path):
    old = table(spark, [{"id": 1, "fingerprint": "f1", "content_hash": "c1", "measure_fingerprint": "m1", "title": "a"}])
    old.write.parquet(str(tmp_path / "v-1"))
    state = {"at": str(tmp_path / "v-1")}
    table(spark, [{"id": 5, "fingerprint": "f1", "content_hash": "c1", "measure_fingerprint": "m1", "title": "z"}]).write.parquet(str(tmp_path / "in"))

    def save(df, number):
        df.write.mode("overwrite").parquet(str(tmp_path / f"v{number}"))
        state["at"] = str(tmp_path / f"v{number}")

    incoming = spark.readStream.schema(old.schema).parquet(str(tmp_path / "in"))
    upsert_stream(incoming, lambda: spark.read.parquet(state["at"]), save, "2020-01-01", str(tmp_path / "cp")).awaitTermination(120)
    assert [(r.id, r.title, r.update_count) for r in spark.read.parquet(state["at"]).collect()] == [(1, "z", 1)]
