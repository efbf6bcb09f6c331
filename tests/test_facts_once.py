"""Names are read once for all corpora, and facts of odd documents equal their SQL."""

import re

import duckdb
from pyspark.sql import functions as F

from docloom.functions import texts
from docloom.operators import facts, measures


def test_facts_of_odd_documents_equal_their_sql(spark, tmp_path):
    rows = [(1, "Anna Berg met Bob Stone. Anna Berg left.\n| a | b |\n# T", "en", "web"), (2, "Bob Stone met  Anna Berg " + "x " * 800 + "Cora Dahl and Bob Stone", None, "web"), (3, "", "en", None), (4, None, "de", "web"), (5, "|x|\n\n \nCora Dahl saw Anna Berg; Cora Dahl", "de", None), (6, "#\n\x0bno names here", "de", "book")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = measures.measured_facts(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({measures.ORACLES['measured_facts']}) q").fetchall()
    key = lambda rows: sorted(repr(tuple(f"{x:.5f}" if isinstance(x, float) else str(x) for x in r)) for r in rows)
    assert key(map(tuple, got.collect())) == key(want)


def test_mentions_are_read_once(spark, monkeypatch):
    calls = []
    real = texts.canonical_mention
    monkeypatch.setattr(texts, "canonical_mention", lambda c: calls.append(1) or real(c))
    assert measures.measured_facts(spark, "/root/testdata/sf0.001").count() > 0 and len(calls) == 1


def test_the_short_form_of_mentions(spark):
    words = ["Anna", "SA", "Page", "Société", "Group", "École", "ÀB", "Total", "İl", "Ǆo", "Mayence", "Groupe"]
    found = [*words, *(f"{a} {b}" for a in words for b in words), *(f"{a} {b} {c} {a}" for a in words for b in words for c in words)]
    assert all(re.fullmatch(r"[^\W\d_]{2,}(?: [^\W\d_]{2,}){0,3}", f) for f in found)
    n = spark.createDataFrame([(f,) for f in found], "name string").where(F.col("name").rlike(f"^{facts.MENTION}$"))
    rows = n.select("name", texts.canonical_mention(F.col("name")).alias("a"), texts.canonical(F.col("name")).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and {r.a is None for r in rows} == {True, False} and len(rows) > 1500
