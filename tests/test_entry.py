from __future__ import annotations

import glob
import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_queries_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    wrong = []
    for name, text in sql.items():
        df = queries[name](spark, DATA)
        columns = sorted(df.columns)
        ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
        result = con.execute(text)
        names = [d[0] for d in result.description]
        theirs = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in result.fetchall()), key=repr)
        if sorted(names) != columns or ours != theirs:
            wrong.append(name)
    assert not wrong
