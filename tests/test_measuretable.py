"""The stored measures table: what steps touch, what fails whole, and what comes back."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_dedup import in_order, table

from tallymark.sources import measuretable, sinks
from tallymark.sources.measuretable import Conflict, MeasureTable, NotUnique


def rows(n, start=0, **more):
    return [{"id": start + i, "fingerprint": f"f{start + i}", "content_hash": f"c{start + i}", "measure_fingerprint": f"m{start + i}", "title": "t"} | more for i in range(n)]


def made(spark, tmp_path, n=400):
    return MeasureTable.create(spark, str(tmp_path / "t"), table(spark, rows(n)), 32)


def test_an_upsert_rewrites_its_buckets_alone(spark, tmp_path):
    it = made(spark, tmp_path)
    before = dict(it.state["buckets"])
    batch = [rows(1, 7, id=1007, title="new")[0], rows(1, 9, id=1009, yes_votes=5)[0], *rows(2, 500), rows(1, 600, content_hash="c3")[0]]
    found = it.upsert(table(spark, batch), "2020-01-01")
    assert sorted((r.id, r.fate) for r in found.collect()) == [(500, "inserted"), (501, "inserted"), (600, "duplicate"), (1007, "updated"), (1009, "updated")]
    after = it.state["buckets"]
    rewritten = [b for b in before if after[b][: len(before[b])] != before[b]]
    longer = [b for b in after if b not in rewritten and after[b] != before.get(b)]
    assert 1 <= len(rewritten) <= 2 and len(longer) <= 3 and len(before) > 20
    got = {r.id: r for r in MeasureTable(spark, str(tmp_path / "t")).read().collect()}
    assert len(got) == 403 and (got[7].title, got[7].update_count, got[9].yes_votes, got[600].master_id, got[8].update_count) == ("new", 1, 5, 3, 0)
    assert in_order(rows(400), batch)[600] == ("content", 3)
    assert it.read(1).count() == 400 and it.read(buckets=[]).count() == 0


def test_a_step_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    it = made(spark, tmp_path, 50)
    with pytest.raises(NotUnique):
        it.commit("bad", it.written(table(spark, rows(1, 3, id=99))))
    monkeypatch.setattr(measuretable, "write_once", lambda *a: (_ for _ in ()).throw(OSError("no room")))
    with pytest.raises(OSError, match="no room"):
        it.insert(table(spark, rows(1, 100)))
    monkeypatch.undo()
    again = MeasureTable(spark, str(tmp_path / "t"))
    assert again.versions() == [1] and again.read().count() == 50
    with pytest.raises(Conflict):
        MeasureTable.create(spark, str(tmp_path / "t"), table(spark, []))
    first, second = (MeasureTable(spark, str(tmp_path / "t")) for _ in range(2))
    first.insert(table(spark, rows(1, 100)))
    with pytest.raises(Conflict):
        second.insert(table(spark, rows(1, 101)))
    assert sorted(r.id for r in MeasureTable(spark, str(tmp_path / "t")).read().where("id >= 50").collect()) == [100]


def test_life(spark, tmp_path):
    it = made(spark, tmp_path, 60)
    conflicts = it.insert(table(spark, [*rows(2, 59, id=159), *rows(1, 70)]))  # one fingerprint is there, one id is repeated
    assert [r.fingerprint for r in conflicts.collect()] in (["f59", "f60"], ["f59"], ["f60", "f59"])
    it.add_column("seen", "int", 0)
    with pytest.raises(ValueError, match="there is a column"):
        it.add_column("seen", "int")
    it.update(spark.createDataFrame([(5, "x", 7)], "id long, title string, seen int"), "2020-01-01")
    assert {r.id: (r.title, r.seen, r.update_count) for r in it.read().where("id IN (5, 6)").collect()} == {5: ("x", 7, 1), 6: ("t", 0, 0)}
    last = it.versions()[-1]
    it.update(it.read().select("id", F.lit("gone").alias("title")), "2020-01-02")
    assert it.read().where("title <> 'gone'").count() == 0
    it.restore(last)
    assert it.read().where("title = 'x'").count() == 1 and it.read().where("title = 'gone'").count() == 0
    it.clean()
    assert len(it.versions()) == 1 and MeasureTable(spark, str(tmp_path / "t")).read().where("title = 'x'").count() == 1
    it.upsert(table(spark, []), "2020-01-03")
    empty = MeasureTable.create(spark, str(tmp_path / "e"), table(spark, []))
    assert empty.read().count() == 0
    empty.upsert(table(spark, rows(3)), "2020-01-01")
    assert empty.read().count() == 3


def test_a_logged_run_and_its_audit(spark, tmp_path):
    it, log = made(spark, tmp_path, 20), str(tmp_path / "log")
    more = lambda df: df.withColumn("year", F.when(F.col("id") != 102, 2000))
    batch = more(table(spark, [*rows(1, 3, id=103, data_source="CEDA", yes_votes=9, description="d"), *rows(1, 102, data_source="CEDA"), *rows(1, 104), *rows(1, 105, data_source="CEDA"), *rows(1, 106, content_hash="c1", data_source="X")]))
    it.add_column("year", "int")
    got = sinks.update_run(it, batch, log, "r", "2020-01-01", datetime(2024, 1, 1))
    assert got == {"inserted": 1, "updated": 1, "duplicates": 1, "errors": 2}
    assert sorted((r.measure_id, r.field_name, r.old_value, r.new_value, r.update_source) for r in it.audit().collect()) == [(3, "description", None, "d", "CEDA"), (3, "yes_votes", None, "9", "CEDA")]
    last = sinks.last_state(spark.read.parquet(log)).first()
    assert (last.status, last.measures_checked, last.new_measures, last.duplicates_found, last.completed_at) == ("completed_with_errors", 5, 1, 1, None)
    with pytest.raises(Exception, match="fingerprint"):
        sinks.update_run(it, batch.drop("fingerprint"), log, "s", "2020-01-01", datetime(2024, 1, 2))
    assert {r.run_id: r.status for r in sinks.last_state(spark.read.parquet(log)).collect()} == {"r": "completed_with_errors", "s": "failed"}
    it.upsert(more(table(spark, rows(1, 4, id=204, yes_votes=1, data_source="X"))), "2020-01-02")
    assert MeasureTable(spark, str(tmp_path / "t")).audit().count() == 3
