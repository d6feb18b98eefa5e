"""Many files in few scans, and workbooks."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tallymark.sources import files, sinks, tables, workbook


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_a_thousand_files_in_a_scan_for_each_layout(spark, tmp_path):
    heads = ["MeasID,BALQUEST,LTR,YES,NO,CNTYNAME", "CNTYNAME,LTR,BALQUEST,NO,YES,MeasID", "CAND#,YES,NO"]
    for i in range(1000):
        order = [str(i), f"Q{i}", "A", "1", "2", f"C{i}"] if i % 3 == 0 else [f"C{i}", "A", f"Q{i}", "2", "1", str(i)] if i % 3 == 1 else ["x", "1", "2"]
        (tmp_path / f"f{i}_{2000 + i % 20}.csv").write_text(heads[i % 3] + "\n" + ",".join(order) + "\n")
    got, jobs = jobs_of(spark, "many", lambda: tables.read_ceda(spark, str(tmp_path / "*.csv")))
    assert jobs <= 12
    rows = {r.measure_id: (r.year, r.county, r.yes_votes) for r in got.collect()}
    assert rows == {str(i): (2000 + i % 20, f"C{i}", 1) for i in range(1000) if i % 3 < 2}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("csv") <= 4


def test_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("﻿x,y\r\n1,2\r\n")
    (tmp_path / "c.csv").write_text('x,y\n"1\n1",2\n')
    (tmp_path / "d.csv").write_bytes("año,y\n1,2\n".encode("latin-1"))
    (tmp_path / "e.csv").write_bytes("aõo,y\n1,2\n".encode("latin-1"))
    (tmp_path / "f.csv").write_text("")
    got = sorted((len(v), k.encoding, k.multiline) for k, v in tables.layouts(spark, str(tmp_path)).items())
    assert got == [(1, "ISO-8859-1", False), (1, "ISO-8859-1", False), (1, "UTF-8", True), (2, "UTF-8", False)]


def test_split_files_keep_their_order(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        (tmp_path / "a_2001.csv").write_text("MeasID,BALQUEST,LTR,YES,NO,CNTYNAME\n" + "".join(f"{i},Q,B,1,1,C{i % 50}\n" for i in range(2000)))
        got = tables.read_ceda(spark, str(tmp_path))
        assert sorted(int(r.measure_id) for r in got.collect()) == list(range(50))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_text_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"é{i}") for i in range(100)], "n long, t string")
    names = sinks.text_files(df, lambda i: str(tmp_path / f"out{i}.csv"), 3, "n", "ISO-8859-1")
    assert 1 < len(names) <= 3 and sorted(files.listed(spark, str(tmp_path))) == [f"out{i}.csv" for i in range(len(names))]
    text = "".join(open(x, encoding="latin-1").read() for x in names)
    assert [x for x in text.split("\n") if x and x != "n,t"] == [f"{i},é{i}" for i in range(100)]
    with pytest.raises(OSError, match="can't become"):
        files.rename(spark, str(tmp_path / "none"), str(tmp_path / "x"))


def test_workbook_round_trip():
    rows = [["a", "b & <c>", None, "é"], [1, 2.5, True, None], [None, None, None, " x "]]
    book = workbook.Workbook(workbook.written({"One": [["x"]], 'T "2" & more': rows}))
    assert list(book.sheets) == ["One", 'T "2" & more']
    assert list(book.rows('T "2" & more')) == [["a", "b & <c>", None, "é"], ["1", "2.5", "TRUE"], [None, None, None, " x "]]
    assert [workbook.column_name(workbook.column_number(x)) for x in ("A1", "Z9", "AA3", "ZZ1", "AAA7")] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_cells_of_all_kinds(tmp_path):
    content = workbook.written({"S": [["x"]]})
    sheet = f'<worksheet xmlns="{workbook.MAIN[1:-1]}"><sheetData><row r="1"/><row r="4"><c r="B4" t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r><rPh><t>no</t></rPh></is></c><c r="C4" t="str"><v>formula</v></c><c r="E4" t="e"><v>#N/A</v></c><c r="F4" t="s"><v>0</v></c></row></sheetData></worksheet>'
    path = tmp_path / "b.xlsx"
    path.write_bytes(content)
    with zipfile.ZipFile(path) as old, zipfile.ZipFile(tmp_path / "c.xlsx", "w") as new:
        for x in old.namelist():
            new.writestr(x, sheet if x.endswith("sheet1.xml") else old.read(x))
    assert list(workbook.Workbook((tmp_path / "c.xlsx").read_bytes()).rows("S")) == [[None, "inline", "formula", None, None, "x"]]


def test_workbooks_of_a_folder(spark, tmp_path):
    head = ["MeasID", "BALQUEST", "LTR", " YES ", " NO ", "CNTYNAME"]
    (tmp_path / "ceda_2016.xlsx").write_bytes(workbook.written({"Notes": [["n"]], "Measures 2016": [head, [1, "Q1", "A", 60, 40, "KERN"], [2, "Q2", "B", "n/a", 1, "NAPA"]]}))
    (tmp_path / "ceda_2017.xlsx").write_bytes(workbook.written({"measures2017": [head[::-1], ["KERN", 1, 2, "A", "Q3", 3]]}))
    (tmp_path / "ceda_2018.xlsx").write_bytes(workbook.written({"Measures 2018": [["CAND#", "YES", "NO"], ["x", 1, 2]]}))
    (tmp_path / "ceda_2019.xlsx").write_bytes(workbook.written({"Other": [head, [9, "Q", "A", 1, 1, "X"]]}))
    (tmp_path / "ceda_2020.xlsx").write_bytes(b"no workbook")
    got = tables.read_workbooks(spark, str(tmp_path / "*.xlsx")).orderBy("measure_id").collect()
    assert [(r.measure_id, r.year, r.title, r.yes_votes, r.percent_yes) for r in got] == [("1", 2016, "KERN Measure A", 60, 60.0), ("2", 2016, "NAPA Measure B", None, None), ("3", 2017, "KERN Measure A", 2, 66.67)]
    assert tables.read_workbooks(spark, str(tmp_path / "ceda_2018.xlsx")).count() == 0
    books = spark.createDataFrame([("a", None), ("b", bytearray(b""))], "file_path string, content binary")
    assert workbook.sheet_rows(books, lambda names, path: names[0]).count() == 0 and workbook.by_layout(workbook.sheet_rows(books, lambda names, path: names[0])) == []


def test_through_a_folder(spark):
    seen = []

    def make(folder):
        seen.append(folder)
        spark.range(5).write.parquet(folder)
        return spark.read.parquet(folder)

    got = files.through_folder(spark, make)
    assert not files.exists(spark, seen[0]) and got.agg(F.sum("id")).first()[0] == 10
