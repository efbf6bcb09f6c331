import os

import duckdb
import pytest

from docloom.llm import entries

AT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(entries.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(AT):
        con.execute(f"create view {f.split('.')[0]} as select * from '{AT}/{f}'")
    got = entries.queries()[name](spark, AT)
    cols = sorted(got.columns)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({entries.oracle_sql()[name]}) q").fetchall())
