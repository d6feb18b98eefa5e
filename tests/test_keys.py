"""Identifiers, keys and values against hand-made expectations."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallymark.functions import keys, values

TEXTS = [
    ("ACA 13 (Ward) Voting thresholds. (Res. Ch. 176, 2023)", "ACA_13"),
    ("SCA 1 (Newman) Elections: recall of state officers. (Res. Ch. 204, 2024)", "SCA_1"),
    ("CaliforniaProposition16 (2020)", "PROP_16"),
    ("Alameda Measure A", "MEASURE_A"),
    ("Ballot Measures of 2020", "MEASURE_S"),
    ("Sets effective date for ballot measures. Prop. 1A", "PROP_1A"),
    ("prop 8", "PROP_8"),
    ("sb 9 (relates)", "SB_9"),
]


def keyed(spark, rows):
    schema = "title string, ballot_question string, description string, measure_id string, measure_letter string, year int, county string, data_source string"
    return keys.with_keys(spark.createDataFrame(rows, schema)).collect()


def test_identifiers(spark):
    got = keyed(spark, [(t, None, None, None, None, 2020, "X", "CEDA") for t, _ in TEXTS])
    assert [r.identifier for r in got] == [i for _, i in TEXTS]


def test_fallbacks(spark):
    text = "Assembly Bill 440, Chapter 82, Statutes of 2024"
    digest = hashlib.md5(f"{text}||".lower().encode()).hexdigest()[:16]
    got = keyed(spark, [(text, None, None, None, None, 2024, "X", "S"), (text, None, None, "77", "B", 2024, "X", "S"), (text, None, None, None, "B", 2024, "X", "S"), (None, "", None, "77", None, None, None, None)])
    assert [r.identifier for r in got] == [f"HASH_{digest[:8]}", "ID_77", "MEASURE_B", "UNKNOWN"]
    assert got[0].content_hash == digest
    assert got[3].fingerprint == "None|UNKNOWN|None|None" and got[3].measure_fingerprint == "None|UNKNOWN|None"
    assert (got[0].decade, got[0].century, got[3].decade) == (2020, 21, None)


def test_century_of_round_years(spark):
    got = spark.createDataFrame([(2000,), (2001,), (1900,)], "y int").select(keys.century(F.col("y")).alias("c")).collect()
    assert [r.c for r in got] == [20, 21, 19]


@pytest.mark.parametrize(("text", "key"), [("On ACA  13.", "ACA  13"), ("Proposition 13a", "Prop 13A"), ("Prop 13", "PROP 13"), ("XACA 13", None), ("", None)])
def test_summary_key(spark, text, key):
    assert spark.createDataFrame([(text,)], "t string").select(keys.summary_key(F.col("t")).alias("k")).first().k == key


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("r")).first().r


def test_values(spark):
    assert one(spark, "1,234", values.number) is None and one(spark, "1,234", values.first_number) == 1234.0
    assert one(spark, "n/a", values.number) is None
    assert one(spark, "2016.0", lambda c: values.year_within(c, 1900, 2030)) == 2016
    assert one(spark, "1899", lambda c: values.year_within(c, 1900, 2030)) is None
    assert one(spark, "Was Approved", values.outcome_of_status) == 1
    assert one(spark, "passed, then rejected", values.outcome_of_status) == 1
    assert one(spark, "Defeated", values.outcome_of_status) == 0
    assert one(spark, 50.0, values.outcome_of_share, "double") == 0
    assert one(spark, 1.005, lambda c: values.rounded(c, 2), "double") == 1.0
    assert one(spark, "x (pdf) ", values.without_pdf_note) == "x"
    assert one(spark, "<b>a</b>&amp;  b", values.tag_text) == "a & b"
    assert str(one(spark, "General Election, November 5, 2024", values.election_date)) == "2024-11-05"
    assert one(spark, "Primary and general", values.election_type) == "General"


def test_times(spark):
    assert one(spark, "2020-01-02T03:04:05", lambda c: values.iso(values.from_iso(c))) == "2020-01-02T03:04:05"
    assert one(spark, "soon", values.from_iso) is None
    assert one(spark, 1234567, values.with_commas, "long") == "1,234,567"


@pytest.mark.parametrize(("href", "url"), [("https://a/x", "https://a/x"), ("//b/x", "https://b/x"), ("/c", "https://h.org/c"), ("d.pdf", "https://h.org/p/d.pdf"), ("mailto:x", "mailto:x")])
def test_links(spark, href, url):
    assert one(spark, href, lambda c: values.absolute_url(c, "https://h.org/p/i.html")) == url
