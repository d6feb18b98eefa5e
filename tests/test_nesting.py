"""Pages of plain tags by their layout: the same links as by the library's parser, many pages at once, dealt out evenly."""

import random

import pyarrow as pa
import pytest

from tallymark.plans import catalog
from tallymark.sources import nesting, pages

PATH = "/r/ca_ballot_props/"
PLAIN = (
    "<ul>|</ul>|<li>|</LI >|<p>|</p\n>|<B >|</b>|<br>|<br/>|<img src='x' />|<i></i>|<h2>|</h2>|<h3 class='q'>|</h3>|</br>|</title>|</a>|</a>|</a>|<a name='n'>|<a href=''>|<a data-href='no'>|"
    "(1990)|(19|92)|Proposition 5|Proposition|  16 | |x|\xe9|&amp;|&nbsp;|&|&copy|Proposition&nbsp;7|&#40;1993)|a > b|\"|"
    "<a href='{p}1'>|<a href=\"{p}2\">|<A HREF='{p}3'>|<a id='x'\n href=\"{p}4\">|<a href='no' href='{p}5'>|<a title=\" href='x'\" href='{p}6'/>|<a title='a>b' href='{p}7'>"
).replace("{p}", PATH).split("|")
ODD = (
    "<!-- (1994) -->|<!--|-->|<!DOCTYPE html>|<?pi?>|<script>var a='</p>';(1995)</script>|<script>|<title>(1970)</title>|<template>(1960) <b>|</template>|<textarea>|<|<<|< b|</ p>|</>|"
    "<a href={p}8>|<a href='{p}9?a=1&amp;b=2'>|<a href>|<a href = '{p}10'>|<a href='{p}11'id='z'>|<a <b|</p x='y'>|</a/>|<b|<a href='{p}12|<my-tag>|<a\x0chref='{p}13'>|<br / >|<p\x00>"
).replace("{p}", PATH).split("|")


def test_plain_pages_by_their_layout_and_by_the_parser(monkeypatch):
    rnd, plain = random.Random(4), 0
    for i in range(4_000):
        html = "".join(rnd.choices(PLAIN if i % 2 else PLAIN * 4 + ODD, k=rnd.randint(0, 40)))
        got, want = nesting.plain_links(html), nesting.nested_links(html)
        assert got in (None, want), html
        plain += got is not None
        monkeypatch.setattr(nesting, "FEW_LINKS", 0)
        looked_up = nesting.repository_links(html, "/", 1, 50)
        monkeypatch.setattr(nesting, "FEW_LINKS", 50)
        assert nesting.repository_links(html, "/", 1, 50) == looked_up, html
    assert plain > 1_000


@pytest.mark.parametrize("html", ["", "(1990)", "a < b", "<!-- x --><p></p>", "<p><script></p></script>", '<a href="/x?a&b">y</a>', "<p", '<a href="x>y</a>'])
def test_other_pages_are_left_to_the_parser(html):
    assert nesting.plain_links(html) is None


def test_equal_layouts_are_worked_out_once():
    nesting.kept_layout.cache_clear()
    for i in range(100):
        assert nesting.repository_links(f'<p>Proposition {i} ({1900 + i}) <a href="{PATH}{i}"><b>t{i}</b></a></p>', "/", 1, 50) == [(0, 1, f"{PATH}{i}", f"t{i}", str(1900 + i), str(i))]
    assert nesting.kept_layout.cache_info()[:2] == (99, 1)
    # long pages are not kept, and say the same
    html = "<p>" * nesting.KEPT_TAGS + f'(1990)<a href="{PATH}">x</a>'
    assert nesting.plain_links(html) == nesting.nested_links(html) and nesting.kept_layout.cache_info().currsize == 1
    assert nesting.plain_links(html + "<p>" * nesting.MOST_TAGS) is None  # a page in many pieces is read as a stream


def test_links_of_many_pages_leave_together(monkeypatch):
    htmls = [None, "", "<p>no</p>", *[f'<p>({1000 + i})<a href="{PATH}{i}">a</a><a href="{PATH}b">b</a></p>' for i in range(1_000)]]
    batch = pa.RecordBatch.from_pydict({"page": [f"p{i}" for i in range(len(htmls))], "html": htmls})
    rows = [(f"p{i + 3}", pos, pos + 1, f"{PATH}{[i, 'b'][pos]}", "ab"[pos], str(1000 + i), None) for i in range(1_000) for pos in (0, 1)]
    got = list(pages.link_batches(iter([batch, batch.slice(0, 3)]), PATH, 1, 50))
    assert len(got) == 1 and list(zip(*got[0].to_pydict().values())) == rows
    monkeypatch.setattr(pages, "LINKS_AT_ONCE", 601)
    got = list(pages.link_batches(iter([batch]), PATH, 1, 50))
    assert [x.num_rows for x in got] == [602, 602, 602, 194] and [r for x in got for r in zip(*x.to_pydict().values())] == rows


def test_measures_of_one_part_are_dealt_out(spark, data):
    tasks = catalog.queries()["repository_context"](spark, data).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) and min(tasks) > sum(tasks) / len(tasks) / 2
