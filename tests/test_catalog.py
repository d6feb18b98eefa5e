"""Every query of the catalogue gives the rows that its SQL gives in DuckDB."""

import pytest
from support import same

from tallymark.plans import catalog

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def test_each_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracles())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_same_rows(name, spark, data, duck):
    df = catalog.queries()[name](spark, data)
    same(df, duck, catalog.oracles()[name])
    kinds = {r[0]: r[1] for r in duck.sql("DESCRIBE " + catalog.oracles()[name]).fetchall()}
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == kinds


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
