"""Queries over whole texts and tables against loops over rows."""

import collections
import re

import numpy as np
from pyspark.sql import functions as F

from docloom.operators import chunks, numbering
from docloom.plans import catalog


def test_excerpts_stand_at_every_stride(spark, tmp_path):
    rows = [(n, "".join(chr(97 + (i * i + n) % 23) for i in range(n))) for n in (0, 1799, 1800, 1801, 3600, 3601, 10_801, 12_345, 33_047)] + [(-1, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalog.QUERIES["question_excerpts_all"](spark, str(tmp_path)).collect()}
    assert got == {(i, a, t[a : a + 1800]) for i, t in rows if t for a in range(0, len(t) - 1800, max(1800, len(t) // 6))}


def test_entity_pairs_in_passages_of_documents(spark, tmp_path):
    rng = np.random.default_rng(3)
    some = ["Anna", "Bert", "Cora", "Dora", "Emil", "low", "x", "Über"]
    rows = [(i, " ".join(str(rng.choice(some)) for _ in range(n))) for i, n in enumerate((1, 20, 300, 900, 1200))]
    rows += [(9, "x" * 1493 + " Gustav low Hanna"), (10, "x" * 1499 + " Gustav Hanna"), (11, None), (12, "y Once only"), (13, "y" * 1500 + " Anna Zeno"), (14, "Zeno Zeno")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [(i, m.start(1) // 1500, m[1]) for i, t in rows if t for m in re.finditer(r" ([A-ZÀ-Þ][a-zà-ÿ][a-zà-ÿ]+)", t)]
    count = collections.Counter(n for _, _, n in found)
    kept = {n for n in count if count[n] >= 2}
    passages = collections.defaultdict(set)
    for i, k, n in found:
        passages[i, k] |= {n} & kept
    want = collections.Counter((a, b) for ns in passages.values() for a in ns for b in ns if a < b)
    got = {(r.a, r.b): r.passages for r in catalog.QUERIES["entity_cooccurrence"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) > 10
    (one,) = catalog.QUERIES["entity_degree"](spark, str(tmp_path)).collect()
    assert (one.entities, one.pairs, one.avg_degree) == (len(kept), len(want), round(2 * len(want) / len(kept), 2))


def test_excerpts_are_counted(spark, tmp_path):
    rows = [(n, "é" * n) for n in (0, 1800, 1801, 3601, 12_345)] + [(-1, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.excerpts, r.chars) for r in catalog.QUERIES["question_excerpts"](spark, str(tmp_path)).collect()}
    parts = {i: [t[a : a + 1800] for a in range(0, len(t) - 1800, max(1800, len(t) // 6))] for i, t in rows if t}
    assert got == {i: (len(p), sum(map(len, p))) for i, p in parts.items() if p}


def test_places_by_any_key(spark):
    rng = np.random.default_rng(5)
    rows = [(str(rng.choice(list("abc"))), int(rng.integers(0, 50))) for _ in range(400)]
    got = numbering.placed(spark.createDataFrame(rows, "s string, place long"), "s", "place", name="k").collect()
    assert [(r.s, r.place) for r in sorted(got, key=lambda r: r.k)] == sorted(rows) and {r.k for r in got} == set(range(400))
    assert numbering.placed(spark.createDataFrame([], "s string"), "s").count() == 0


def test_the_sentence_in_the_middle(spark):
    eight = "a b c d e f g"
    rows = [(0, f"Title. {eight} one. {eight} two! Short one. {eight} three?"), (1, f"{eight} only."), (2, "None here."), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "i int, t string").select("i", chunks.middle_sentence(F.col("t")).alias("q"))
    assert {r.i: r.q for r in df.collect()} == {0: f"{eight} two!", 1: f"{eight} only.", 2: None, 3: None, 4: None}
