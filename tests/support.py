"""Comparing frames with SQL."""


def plain(v):
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


def rows_of(table):
    names = sorted(table.column_names)
    return names, sorted(tuple(plain(r[c]) for c in names) for r in table.to_pylist())


def same(df, con, sql):
    got, want = rows_of(df.toArrow()), rows_of(con.sql(sql).to_arrow_table())
    assert got[0] == want[0]
    assert got[1] == want[1]
    return len(got[1])
