"""A folder of CEDA files with different headers: each file is read by its own."""

from tallymark.sources import tables


def test_mixed_headers_and_candidates(spark, tmp_path):
    (tmp_path / "ceda_data_2014.csv").write_text("CAND#,FIRST,LAST,YES,NO\n1,Ann,Lee,2,3\n")
    (tmp_path / "ceda_data_2016.csv").write_text("MeasID,BALQUEST,LTR,YES,NO,TOTAL,CNTYNAME,PASSFAIL\n1,Q1,A,60,40,100,KERN,Pass\n")
    (tmp_path / "ceda_data_2018.csv").write_text("PASSFAIL,CNTYNAME,NO,YES,LTR,BALQUEST,MeasID\nFAIL,NAPA,30,10,B,Q2,9\nPass,NAPA,1,2,B,Q2,1\n")
    (tmp_path / "ceda_data_2019.csv").write_text("Candidate,Party,YES,NO\nx,y,2,3\n")
    (tmp_path / "ceda_data_2020.csv").write_text("BALQUEST,LTR,YES,NO,JUR\nQ3,C,1,3,City\n")
    got = tables.reader("ceda")(spark, str(tmp_path / "ceda_data_*.csv")).orderBy("year").collect()
    assert [(r.year, r.measure_id, r.county, r.total_votes, r.percent_yes, r.pass_fail, r.jurisdiction) for r in got] == [
        (2016, "1", "KERN", 100, 60.0, "Pass", None), (2018, "9", "NAPA", 40, 25.0, "FAIL", None), (2020, None, "Unknown", 4, 25.0, None, "City"),
    ]


def test_first_by_place_stays(spark, tmp_path):
    (tmp_path / "ceda_data_2018.csv").write_text("MeasID,BALQUEST,LTR,YES,NO,CNTYNAME\n9,Q,B,10,30,KERN\n5,Q,B,1,1,KERN\n")
    assert [r.measure_id for r in tables.read_ceda(spark, str(tmp_path)).collect()] == ["9"]


def test_only_candidates(spark, tmp_path):
    (tmp_path / "ceda_data_2014.csv").write_text("CAND#,YES,NO\n1,2,3\n")
    got = tables.read_ceda(spark, str(tmp_path))
    assert got.count() == 0 and {"fingerprint", "measure_id", "title", "year"} <= set(got.columns)
