"""Exact vector search by blocks of queries, and ranking metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.tables import spread, written

#: Queries asked at once, and scores that a task holds at once.
BLOCK, SCORES = 8192, 2_000_000


def topk(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k highest cosines of each query, itself left out; ties by id. Queries go out in blocks of at most BLOCK rows; where
    there are several, each block's answer is written before the next is asked, so the plan stays one pass long."""
    return asked(spread(vectors).select("vec_id", "embedding", "label"), queries, k, lambda q: None)


def asked(vectors: DataFrame, queries: DataFrame, k: int, reads) -> DataFrame:
    """(query_id, vec_id, label, score, place) of the k highest cosines of each query among the vectors (vec_id, embedding, label, ...) that
    it reads: all, or those whose column cell is true in its row of reads(queries), a matrix.

    A task holds SCORES scores and the k best so far of each query; what is below a query's k-th is left out before it is rounded.
    """
    spark, parts, block = vectors.sparkSession, [], []
    placed = lambda near: near.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k)
    scores, kind = SCORES, "query_id long, vec_id long, label int, score double"

    def one(rows):
        ids = np.array([r[0] for r in rows])
        q = np.array([r[1] for r in rows], float)
        shipped = spark.sparkContext.broadcast((ids, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300), reads(q)))

        def best(batches):
            ids, q, cells = shipped.value
            n, step = len(ids), max(1, scores // len(ids))
            order = np.argsort(ids, kind="stable")
            floor = np.full(n, -np.inf)  # a query's k-th score, less what rounding may add
            top = (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))  # query, vector, label, score
            for pdf in batches:
                for at in range(0, len(pdf), step):
                    part = pdf.iloc[at : at + step]
                    x, vec, label = np.stack(part["embedding"]).astype(float), part["vec_id"].to_numpy(), part["label"].to_numpy(float)
                    sub = np.arange(n) if cells is None else np.nonzero(cells[:, np.unique(part["cell"])].any(1))[0]
                    s = q[sub] @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T
                    if cells is not None:
                        s[~cells[sub[:, None], part["cell"].to_numpy()]] = -2
                    own = np.searchsorted(ids, vec, sorter=order), np.searchsorted(ids, vec, "right", sorter=order)
                    for j in np.nonzero(own[0] < own[1])[0]:
                        s[np.isin(sub, order[own[0][j] : own[1][j]]), j] = -2
                    least = np.maximum(floor[sub], -1.5)
                    if s.shape[1] > k and (floor[sub] == -np.inf).any():
                        least = np.maximum(least, -np.partition(-s, k - 1, axis=1)[:, k - 1] - 1e-6)
                    i, j = np.nonzero(s >= least[:, None])  # scores that are no numbers are left out
                    i, s = sub[i], s[i, j]
                    new = i, vec[j], label[j], np.round(s, 6)
                    i, v, c, r = (np.concatenate(p) for p in zip(top, new))
                    o = np.lexsort((v, -r, i))
                    first = np.searchsorted(i[o], np.arange(n + 1))
                    o = o[np.arange(len(o)) - first[i[o]] < k]
                    top = i[o], v[o], c[o], r[o]
                    last = np.searchsorted(top[0], np.arange(n), "right") - 1
                    full = np.bincount(top[0], minlength=n) >= k
                    floor[full] = top[3][last[full]] - 1e-6
            for at in range(0, len(top[0]), 100_000):
                i, v, c, r = (p[at : at + 100_000] for p in top)
                yield pd.DataFrame({"query_id": ids[i], "vec_id": v, "label": pd.array(c, dtype="Int32"), "score": r})

        return vectors.mapInPandas(best, kind)

    for r in queries.select("vec_id", "embedding").toLocalIterator():
        block.append(r)
        if len(block) == BLOCK:
            parts.append(written(placed(one(block)), "nearest"))
            block = []
    if not parts:
        return placed(one(block) if block else spark.createDataFrame([], kind))
    if block:
        parts.append(written(placed(one(block)), "nearest"))
    return spark.read.schema(parts[0].schema).parquet(*(f for p in parts for f in p.inputFiles()))


def _both(spark, at):
    v = spark.read.parquet(f"{at}/embeddings.parquet").where("embedding is not null")
    return v, v.where("vec_id % 20 = 0")


def vector_topk(spark, at):
    return topk(*_both(spark, at)).select("query_id", "vec_id", "score", "place")


def _ranks(spark, at):
    v, q = _both(spark, at)
    own = q.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    return topk(v, q, 20).join(own, "query_id").groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("own"), F.col("place"))).alias("r"))


def rank_metrics(spark, at):
    r = F.col("r")
    hit = lambda k: F.round(F.avg((F.coalesce(r, F.lit(99)) <= k).cast("double")), 6)
    return _ranks(spark, at).agg(F.count("*").alias("n"), hit(1).alias("hit1"), hit(5).alias("hit5"), hit(10).alias("hit10"), F.round(F.avg(F.coalesce(1 / r, F.lit(0.0))), 6).alias("mrr"))


def centroid_coherence(spark, at):
    """Mean cosine of vectors to the centroid of their label."""
    v = spark.read.parquet(f"{at}/embeddings.parquet").where("embedding is not null")
    c = v.select("label", F.posexplode("embedding").alias("p", "x")).groupBy("label", "p").agg(F.avg(F.col("x").cast("double")).alias("c"))
    c = c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "c"))), lambda s: s["c"]).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    e = F.col("embedding").cast("array<double>")
    cos = dot(e, F.col("c")) / F.sqrt(dot(e, e) * dot(F.col("c"), F.col("c")))
    return v.join(c, "label").groupBy("label").agg(F.round(F.avg(cos), 6).alias("coherence"), F.count("*").alias("n"))


_COS = "round(list_cosine_similarity(cast(q.embedding AS double[]), cast(v.embedding AS double[])), 6)"
_TOP = f"SELECT q.vec_id AS query_id, v.vec_id, q.label AS own, v.label, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) AS place FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0"
_RANK = f"SELECT query_id, min(CASE WHEN label = own THEN place END) AS r FROM ({_TOP}) t WHERE place <= 20 GROUP BY query_id"
_HIT = "round(avg(CASE WHEN coalesce(r, 99) <= {0} THEN 1.0 ELSE 0.0 END), 6) AS hit{0}".format
QUERIES = {"vector_topk": vector_topk, "rank_metrics": rank_metrics, "centroid_coherence": centroid_coherence}
ORACLES = {
    "vector_topk": f"SELECT query_id, vec_id, score, cast(place AS int) AS place FROM ({_TOP}) t WHERE place <= 10",
    "rank_metrics": f"SELECT count(*) AS n, {_HIT(1)}, {_HIT(5)}, {_HIT(10)}, round(avg(coalesce(1.0 / r, 0.0)), 6) AS mrr FROM ({_RANK}) r",
    "centroid_coherence": """SELECT v.label, round(avg(list_cosine_similarity(cast(v.embedding AS double[]), c.c)), 6) AS coherence, count(*) AS n FROM embeddings v JOIN (
        SELECT label, list(m ORDER BY p) AS c FROM (SELECT label, p, avg(cast(embedding[p] AS double)) AS m FROM embeddings, range(1, 65) AS r(p) GROUP BY label, p) a GROUP BY label) c ON v.label = c.label GROUP BY v.label""",
}
