from pyspark.sql import functions as F

from docloom.operators import retrieval, vectors


def test_lists_that_are_read_whole_give_the_exact_answer(spark, monkeypatch):
    """the lists are read by blocks of queries; a query's row says which of them."""
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("embedding is not null")
    q = v.where(F.col("vec_id") % 20 == 0)
    exact = sorted(map(tuple, vectors.topk(v, q, 5).drop("label").collect()))
    few = sorted(retrieval.approximate_topk(v, q, 5, 0.5).collect())
    assert len({r[:2] for r in few} & {r[:2] for r in exact}) >= 0.4 * len(exact)
    monkeypatch.setattr(retrieval, "enough_probes", lambda *_: 1 << 30)
    for block, scores in ((vectors.BLOCK, vectors.SCORES), (7, 60)):
        monkeypatch.setattr(vectors, "BLOCK", block)
        monkeypatch.setattr(vectors, "SCORES", scores)
        assert sorted(map(tuple, retrieval.approximate_topk(v, q, 5).select("query_id", "vec_id", "score", "place").collect())) == exact


def test_pairs_of_an_index_stay_in_their_tasks(spark):
    """the pairs of a list's queries and vectors were rows of a join."""
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("embedding is not null")
    assert "Join" not in retrieval.approximate_topk(v, v.where("vec_id % 20 = 0"))._jdf.queryExecution().optimizedPlan().toString()
