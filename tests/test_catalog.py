import os

import duckdb
import pytest

import __spark_entry__
from docloom.operators import vectors
from docloom.plans import catalog

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for f in os.listdir(AT):
        c.execute(f"create view {f.split('.')[0]} as select * from '{AT}/{f}'")
    return c


def plain(rows):
    return sorted(repr(tuple("" if x is None else f"{float(x):.5f}" if not isinstance(x, (str, bool, list)) else str(x) for x in r)) for r in rows)


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_same_as_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, AT)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLES[name]}) q").fetchall()
    assert plain(got.select(cols).collect()) == plain(want)


def test_approximate_index_finds_nine_of_ten(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    exact = {(r.query_id, r.vec_id) for r in vectors.topk(v, v.where("vec_id % 20 = 0")).collect()}
    near = {(r.query_id, r.vec_id) for r in catalog.QUERIES["approximate_nearest"](spark, "/root/testdata/sf0.1").collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_queries_without_sql():
    """The sequence matcher has no SQL form: test_sequences.py holds these queries against loops over rows."""
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"approximate_nearest", "aligned_names", "longest_first"}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
