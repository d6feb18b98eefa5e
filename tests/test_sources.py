"""Files of each layout, written here, read as measures; sinks; drift."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallymark import schema
from tallymark.sources import pages, sinks, tables


def test_ceda_files(spark, tmp_path):
    (tmp_path / "ceda_data_2016.csv").write_text('MeasID,BALQUEST,LTR, YES , NO , TOTAL ,CNTYNAME,PASSFAIL\n1,"Shall\nwe?",A,"1,200",800,2000,KERN,Pass\n2,,,5,5,10,KERN,Fail\n3,Long text,,10,30,40,NAPA,PassT\n')
    (tmp_path / "ceda_data_2018.csv").write_text("MeasID,BALQUEST,LTR,YES,NO,CNTYNAME,PASSFAIL\n4,Q,B,n/a,30,KERN,FAIL\n5,Q,B,1,1,KERN,Fail\n")
    rows = {r.measure_id: r for r in tables.read_ceda(spark, str(tmp_path / "ceda_data_2016.csv")).collect()}
    assert set(rows) == {"1", "3"}
    assert (rows["1"].title, rows["1"].year, rows["1"].yes_votes, rows["1"].percent_yes, rows["1"].passed) == ("KERN Measure A", 2016, None, None, 1)
    assert (rows["3"].yes_votes, rows["3"].percent_yes) == (10, 25.0)
    assert rows["1"].ballot_question == "Shall\nwe?"
    assert (rows["3"].title, rows["3"].passed) == ("Long text", None)
    later = tables.read_ceda(spark, str(tmp_path / "ceda_data_2018.csv")).collect()
    assert [(r.measure_id, r.total_votes, r.percent_yes) for r in later] == [("4", 30, None)]


def test_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("t\nañb\n".encode("latin-1"))
    assert tables.read_text_table(spark, str(tmp_path / "a.csv")).first().t == "añb"
    (tmp_path / "b.csv").write_text("t\nañb\n")
    assert tables.read_text_table(spark, str(tmp_path / "b.csv")).first().t == "añb"


def test_icpsr(spark, tmp_path):
    (tmp_path / "i.csv").write_text("State,year,Title,status,YES,NO\nCalifornia,2016.0,A,,60,40\nCALIFORNIA,1899,B,Passed,,\nNevada,2000,C,,1,1\ncalifornia,2000,nan,Defeated,0,0\ncalifornia,2001,D,x,5,5\n")
    got = [(r.year, r.title, r.total_votes, r.percent_yes, r.passed) for r in tables.read_icpsr(spark, str(tmp_path / "i.csv")).orderBy("year").collect()]
    assert got == [(2000, None, None, None, 0), (2001, "D", 10, 50.0, 0), (2016, "A", 100, 60.0, 1)]


def test_ncsl(spark, tmp_path):
    (tmp_path / "n.csv").write_text("StateName,Year,ID,Title,Summary,IRTypeDefinition,TOPICDESCRIPTION,IRStatusDefinition,ElectionType,PercentageVote\nCalifornia,2016,1,T,,I,x,,G,50.5\nCalifornia,2013,2,T,,I,x,,G,\ncalifornia,2016,3,T,,I,x,,G,1\n")
    assert [(r.measure_id, r.description, r.passed) for r in tables.read_ncsl(spark, str(tmp_path / "n.csv")).collect()] == [("1", None, 1)]


def test_envelope_and_scrape(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"source": "CA SOS", "measures": [{"measure_text": "ACA 13 x", "year": "2026", "pdf_url": "u"}, {"measure_text": "y", "year": "Unknown"}]}')
    got = tables.scraped(tables.read_envelope(spark, str(tmp_path / "e.json"))).collect()
    assert [(r.title, r.measure_id, r.year, r.year_raw, r.data_source) for r in got] == [("ACA 13 x", "ACA_13", 2026, "2026", "CA_SOS"), ("y", None, None, "Unknown", "CA_SOS")]


def test_choices():
    assert tables.choose_sheet(["x", "measures2015"], "2015") == "measures2015"
    assert tables.choose_sheet(["Notes", "All Measures"], "2000") == "All Measures"
    assert tables.choose_sheet(["x"], "2000") is None
    assert tables.is_candidate_sheet(["Cand#", "YES", "NO"]) and tables.is_candidate_sheet(["A", "YES"]) and not tables.is_candidate_sheet(["LTR", "YES"]) and not tables.is_candidate_sheet([])
    assert tables.resolve(["NOTES", " NO "], [" NO ", "NO"]) == " NO "
    with pytest.raises(ValueError, match="no source"):
        tables.reader("x")


def test_pages(spark):
    html = '<a href="/x.pdf">early</a><h2>General Election, November 3, 2020</h2><a href="a.PDF"><b>ACA 1</b> (PDF)</a><h3></h3><a href="b.pdf">  </a><a href="c.pdf">SCA 2 in 2024</a><a href="d.html">no</a>'
    got = pages.election_measures(spark.createDataFrame([(1, html)], "page_id long, html string"), "https://h.org/p/i.html").orderBy("pos").collect()
    assert [(r.measure_text, r.election_date, r.election_type, r.year, r.pdf_url) for r in got] == [
        ("early", None, None, "2026", "https://h.org/x.pdf"),
        ("ACA 1", "November 3, 2020", "General", "2020", "https://h.org/p/a.PDF"),
        ("SCA 2 in 2024", "November 3, 2020", "General", "2020", "https://h.org/p/c.pdf"),
    ]
    html = "".join(f'<li><a href="/repo/ca_ballot_props/{i}">Proposition {i} ({1990 + i})</a></li>' for i in range(4)) + '<a href="/ca_ballot_props/9">x</a>'
    got = pages.repository_measures(spark.createDataFrame([(1, html)], "page_id long, html string"), "https://h.org", least_slashes=3, most=3).orderBy("nth").collect()
    assert [(r.year, r.measure_text) for r in got] == [(str(1990 + i), f"Proposition {i}: Proposition {i} ({1990 + i})") for i in range(3)]
    # what a link stands in directly says its year and number, the first of them for all links in it
    html = '<p>Proposition 7 <a href="/repo/ca_ballot_props/a">Rent</a> (1978) <a href="/repo/ca_ballot_props/b">Tax (1980)</a></p><a href="/repo/ca_ballot_props/c"><b>Gas</b></a>'
    assert said(spark, html) == [("1978", "Proposition 7: Rent"), ("1978", "Proposition 7: Tax (1980)"), ("1978", "Proposition 7: Gas")]
    # an inline parent, and what lies outside it
    assert said(spark, '<p>(1978) Proposition 1 <b>(1980) <a href="/repo/ca_ballot_props/a">x</a></b></p>') == [("1980", "x")]


def said(spark, html, **more):
    got = pages.repository_measures(spark.createDataFrame([(1, html)], "page_id long, html string"), "https://h.org", least_slashes=3, **more).orderBy("nth").collect()
    return [(r.year, r.measure_text) for r in got]


def test_blocks_inside_links(spark):
    html = '<li>Proposition 5 (1990) <a href="/repo/ca_ballot_props/a">x</a></li>'
    other = '<a href="/repo/ca_ballot_props/b"><div>d <i> e</i></div></a>'
    assert said(spark, html) == [("1990", "Proposition 5: x")]
    assert said(spark, html + f"<div>{other}</div>") == [("1990", "Proposition 5: x"), ("Unknown", "de")]


def test_nesting_as_it_is_written(spark):
    link = '<a href="/repo/ca_ballot_props/{}">{}</a>'.format
    # items that are never closed stand in one another; end tags of nothing do nothing; a void element holds nothing
    html = f"<ul><li>(1990) {link(1, 'a')}<li>(1991)</b> {link(2, 'b')}<br>(1992)</ul>(1993) {link(3, 'c')}<!-- (1994) --><script>(1995)</script>"
    assert said(spark, html) == [("1990", "a"), ("1991", "b"), ("1990", "c")]
    # a link within a link, an entity, a text without strings, one without a path
    html = f'<p>Proposition&nbsp;12&lt;{link(1, "o" + link(2, "i"))}</p>{link(3, " ")}<a href>z</a><a>y</a>'
    assert said(spark, html) == [("Unknown", "Proposition 12: oi"), ("Unknown", "i")]
    # a number that goes on in the next element
    assert said(spark, f"<p><i>Proposition 1{link(4, 'q')}</i>6</p>") == [("Unknown", "Proposition 1: q")] and said(spark, "") == said(spark, "<<a <b") == []


def test_a_page_of_many_links(spark):
    import time
    import tracemalloc

    from tallymark.sources.nesting import repository_links

    html = "".join(f'<li>Proposition {i} (19{i % 100:02d}) <a href="/repo/ca_ballot_props/{i}">x{i}</a>' for i in range(50_000))
    tracemalloc.start()
    start = time.perf_counter()
    got = repository_links(html, "/ca_ballot_props/", 3, 10**9)
    peak, took = tracemalloc.get_traced_memory()[1], time.perf_counter() - start
    tracemalloc.stop()
    assert len(got) == 50_000 and got[7][3:] == ("x7", "1907", "7") and peak < 30 * len(html) and took < 60
    assert len(said(spark, html)) == 50


def test_each_file_has_its_own_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("state,year,title\nCalifornia,1990,Caf\u00e9\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("title,state,year\nCaf\u00e9,California,1991\n".encode())
    got = tables.read_icpsr(spark, str(tmp_path / "*.csv")).orderBy("year").collect()
    assert [(r.year, r.title) for r in got] == [(1990, "Caf\u00e9"), (1991, "Caf\u00e9")]


def test_schema(spark):
    df = spark.createDataFrame([("t", "S", "2020", "x")], "measure_text string, source string, year string, junk string")
    got = schema.conform(df)
    assert got.dtypes == [(f.name, f.dataType.simpleString()) for f in schema.MEASURE]
    row = got.first()
    assert (row.title, row.data_source, row.year, row.county, row.is_active, row.update_count) == ("t", "S", 2020, "Statewide", True, 0)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2020, 'a "q"', [1, 2])], "id long, year int, title string, merged_from array<long>")
    sinks.csv(df, str(tmp_path / "c"))
    back = spark.read.csv(str(tmp_path / "c"), header=True, escape='"').first()
    assert (back.title, back.merged_from) == ('a "q"', "[1,2]")
    sinks.export(df, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    sinks.json_with_summary(df, df.agg(F.count("*").alias("n")), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s/summary")).first().n == 1
    path = sinks.backup(df, str(tmp_path), datetime(2020, 1, 2, 3, 4, 5))
    assert spark.read.parquet(path).count() == 1
    log = str(tmp_path / "log")
    sinks.log_run(spark, log, "r1", "x", datetime(2020, 1, 1), "running")
    sinks.log_run(spark, log, "r1", "x", datetime(2020, 1, 1), "failed", datetime(2020, 1, 2), "no page", new_measures=3, other=1)
    last = sinks.last_state(spark.read.parquet(log)).collect()
    assert [(r.status, r.new_measures, r.completed_at, r.error_message) for r in last] == [("failed", 3, datetime(2020, 1, 2), "no page")]
    assert sinks.is_stale(datetime(2020, 1, 2), datetime(2020, 1, 1)) and not sinks.is_stale(datetime(2020, 1, 1), datetime(2020, 1, 2))
