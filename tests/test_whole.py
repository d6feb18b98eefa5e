"""Queries that leave no row out, in their order."""

import pytest

from tallymark.plans import catalog


@pytest.mark.parametrize("name", ["sort_votes_all", "sort_title_all", "sort_title_locale"])
def test_sorts_return_every_row_in_order(name, spark, data, duck):
    got = [r.id for r in catalog.queries()[name](spark, data).collect()]
    assert got == [r[0] for r in duck.sql(catalog.oracles()[name]).fetchall()]
    assert len(got) == duck.sql("SELECT count(*) FROM orders").fetchall()[0][0] > 40


def test_every_link_of_a_page(spark, data, duck):
    got = catalog.queries()["repository_links_all"](spark, data)
    most = got.groupBy("page").count().agg({"count": "max"}).first()[0]
    assert 3 < most < 50  # no page reaches the operator's own stop
    assert got.count() == duck.sql(catalog.oracles()["repository_links_all"].replace("nth <= 50", "TRUE")).to_arrow_table().num_rows


def test_every_measure_is_in_the_union(spark, data, duck):
    got = sorted(r.id for r in catalog.queries()["union_by_name_all"](spark, data).collect())
    assert got == [r[0] for r in duck.sql("SELECT o_orderkey FROM orders ORDER BY 1").fetchall()]
