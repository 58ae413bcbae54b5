"""The driver contract: every query runs over the smallest tables and agrees with its SQL."""

import glob
import os
from collections import Counter

import duckdb

import __spark_entry__ as E


def shown(v):
    return repr(round(v, 6) if isinstance(v, float) else v)


def test_flagship(spark, data):
    assert E.entry(spark).count() > 0


def test_sql_of_every_query(spark, data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view \"{os.path.basename(path)[:-8]}\" as select * from '{path}'")
    queries, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(queries)
    for name, text in sql.items():
        df = queries[name](spark, data)
        columns = sorted(df.columns)
        got = Counter(tuple(shown(r[c]) for c in columns) for r in df.collect())
        ran = con.execute(text)
        names = [c[0] for c in ran.description]
        assert sorted(names) == columns, name
        expected = Counter(tuple(shown(r[names.index(c)]) for c in columns) for r in ran.fetchall())
        assert got == expected, name
