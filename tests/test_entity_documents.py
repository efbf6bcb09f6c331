"""Words that are no name are not shuffled, and ids may stand twice."""

import re
from collections import Counter, defaultdict

from docloom.plans import catalog


def test_words_of_documents_that_share_an_id(spark, tmp_path):
    rows = [(1, "x Anna Bert"), (1, "x Anna and Anna"), (None, "a Bert"), (None, "Bert too"), (2, "Anna, ann"), (3, None), (4, "no Once")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    stands, mentions = defaultdict(set), Counter(n for _, t in rows if t for n in re.findall(" ([A-ZÀ-Þ][a-zà-ÿ][a-zà-ÿ]+)", t))
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            stands[w].add(i)
    got = catalog.QUERIES["entity_documents"](spark, str(tmp_path))
    assert {r["name"]: r.docs for r in got.collect()} == {n: len(stands[n]) for n in mentions if mentions[n] >= 2} == {"Anna": 2, "Bert": 2}


def test_words_are_not_shuffled_with_ids(spark):
    plan = catalog.QUERIES["entity_documents"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(doc_id", plan) and "LeftSemi" in plan and "BroadcastHashJoin" in plan
