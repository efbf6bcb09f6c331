"""Retrieval over vectors: several queries of one need, reranking, recall, the choice of cuts, and an index by nearest centroids.

A need is a label: its queries are the vectors whose id 20 divides, and vectors of its label are what they should find. The cosine of
a vector's second half stands for a reranking model, that of its first half for a second embedding model.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.tables import spread, written
from docloom.operators.vectors import asked, topk

CUTS, STEPS, DRAWS, SEED = (3, 5, 10), (1, 3, 5, 10, 20), 2000, "12345"
SCORED = 500  # vectors that are set against all centroids at once


def _vectors(spark, at) -> DataFrame:
    return spark.read.parquet(f"{at}/embeddings.parquet").where("embedding is not null")


def _asked(v: DataFrame) -> DataFrame:
    return v.where("vec_id % 20 = 0")


def _found(spark, at, k: int, part: slice | None = None) -> DataFrame:
    """(query_id, own, vec_id, label, score, place) of the k nearest of each query."""
    v = _vectors(spark, at)
    if part:
        v = v.withColumn("embedding", F.slice("embedding", part.start + 1, part.stop - part.start))
    own = _asked(v).select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    return topk(v, _asked(v), k).join(own, "query_id")


def _cosine(a, b):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    return F.round(dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)), 6)


def need_passages(spark, at):
    """Of the ten nearest of each query the best score of every vector, and the ten best of each need as P1 to P10."""
    best = _found(spark, at, 10).groupBy("own", "vec_id").agg(F.max("score").alias("score"), F.count("*").alias("queries"))
    place = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("k", place).where("k <= 10").select("own", F.concat(F.lit("P"), F.col("k").cast("string")).alias("name"), "vec_id", "score", "queries")


def _reranked(spark, at) -> DataFrame:
    v = _vectors(spark, at).select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 33, 32).alias("e"))
    near = _found(spark, at, 20).join(v, "vec_id").join(v.select(F.col("vec_id").alias("query_id"), F.col("e").alias("q")), "query_id")
    return near.withColumn("again", _cosine(F.col("q"), F.col("e"))).withColumn("new_place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("again"), "vec_id")))


def reranked(spark, at):
    """Twenty candidates of each query, put in order again and cut to five."""
    return _reranked(spark, at).where("new_place <= 5").select("query_id", "vec_id", "place", "new_place", "again")


def rerank_report(spark, at):
    """Recall at each cut without and with reranking; the cut of the highest gain, the least of equals, and whether it is useful."""
    hit = lambda c, k: F.max(((F.col(c) <= k) & (F.col("label") == F.col("own"))).cast("double")).alias(f"{c}_{k}")
    q = _reranked(spark, at).groupBy("query_id").agg(*(hit(c, k) for k in CUTS for c in ("place", "new_place")))
    one = q.agg(*(F.round(F.avg(c), 3).alias(c) for c in q.columns[1:]))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("cut"), F.col(f"place_{k}").alias("without"), F.col(f"new_place_{k}").alias("with_it")) for k in CUTS))).alias("r")).select("r.*")
    rows = rows.withColumn("gain", F.round(F.col("with_it") - F.col("without"), 3))
    best = F.row_number().over(Window.orderBy(F.desc("gain"), "cut")) == 1
    return rows.withColumn("chosen", best).withColumn("useful", F.col("chosen") & (F.col("gain") >= 0.03))


def _first_hits(near: DataFrame) -> DataFrame:
    return near.groupBy("query_id").agg(F.coalesce(F.min(F.when(F.col("label") == F.col("own"), F.col("place"))), F.lit(21)).alias("r"))


def rank_summary(spark, at):
    """Hits, mean reciprocal rank (0 beyond twenty) and the upper median of ranks."""
    r = _first_hits(_found(spark, at, 20)).groupBy("r").agg(F.count("*").alias("m"))  # 21 rows at most
    r = r.withColumn("upto", F.sum("m").over(Window.orderBy("r"))).withColumn("n", F.sum("m").over(Window.partitionBy(F.lit(1))))
    mean = lambda x: F.round(F.sum(x * F.col("m")) / F.max("n"), 6)
    hit = lambda k: mean((F.col("r") <= k).cast("double")).alias(f"hit{k}")
    return r.agg(F.max("n").alias("n"), hit(1), hit(5), mean(F.when(F.col("r") <= 20, 1 / F.col("r")).otherwise(0.0)).alias("mrr"), F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("r"))).alias("median_rank"))


def recall_curve(spark, at):
    """Recall at each k; chosen is the least k after which no step gains 0.02, and twice as many are retrieved."""
    r = _first_hits(_found(spark, at, 20)).agg(*(F.round(F.avg((F.col("r") <= k).cast("double")), 3).alias(f"k{k}") for k in STEPS))
    rows = r.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("recall")) for k in STEPS))).alias("x")).select("x.*")
    step = F.coalesce(F.lead("recall").over(Window.orderBy("k")) - F.col("recall"), F.lit(0.0))
    rows = rows.withColumn("next_gain", F.round(step, 3)).withColumn("later", F.max("next_gain").over(Window.orderBy("k").rowsBetween(0, Window.unboundedFollowing)))
    chosen = F.min(F.when(F.col("later") < 0.02, F.col("k"))).over(Window.partitionBy(F.lit(1)))
    return rows.withColumn("chosen", F.col("k") == chosen).withColumn("retrieve", F.when(F.col("chosen"), F.col("k") * 2)).drop("later")


def embedding_choice(spark, at):
    """X14, SA4: paired resamples of the difference of reciprocal ranks of two models, drawn by md5; the second, faster model stays
    unless the interval of the middle 95 % leaves out 0."""
    a, b = _first_hits(_found(spark, at, 20)), _first_hits(_found(spark, at, 20, slice(0, 32)))
    inv = lambda c: F.when(F.col(c) <= 20, 1 / F.col(c)).otherwise(0.0)
    d = a.join(b.withColumnRenamed("r", "s"), "query_id").select("query_id", (inv("r") - inv("s")).alias("d"))
    d = d.withColumn("i", F.row_number().over(Window.orderBy("query_id")) - 1)
    n = d.agg(F.count("*").alias("n"))
    pick = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(SEED), F.col("draw").cast("string"), F.col("slot").cast("string"))), 1, 8), 16, 10).cast("long")
    draws = spark.range(DRAWS).select(F.col("id").alias("draw")).join(F.broadcast(n)).select("draw", "n", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("slot")).withColumn("i", (pick % F.col("n")).cast("int"))
    means = draws.join(F.broadcast(d.select("i", "d")), "i").groupBy("draw").agg(F.round(F.avg("d"), 9).alias("m"))
    bounds = means.agg(F.array_sort(F.collect_list("m")).alias("m")).select(F.round(F.element_at("m", int(0.025 * DRAWS) + 1), 6).alias("low"), F.round(F.element_at("m", int(0.975 * DRAWS) + 1), 6).alias("high"))
    gap = d.agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("gap"))
    sure = (F.col("low") > 0) | (F.col("high") < 0)
    return gap.join(F.broadcast(bounds)).select("n", "gap", "low", "high", sure.alias("sure"), F.when(sure & (F.col("gap") > 0), "whole").otherwise("half").alias("chosen"))


def centroid_index(v: DataFrame, least: int = 16, most: int = 4096, rounds: int = 8, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids, about the square root of the vectors and `most` at most, and the sample of 5,000 unit vectors or 16 for each list,
    taken by a hash of the id, that they are fitted on."""
    lists = min(most, max(least, int(np.ceil(v.count() ** 0.5))))
    sample = max(5_000, 16 * lists)
    rows = v.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    x = np.stack(rows["embedding"]).astype(float) if len(rows) else np.zeros((1, 1))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    c = x[np.random.default_rng(seed).permutation(len(x))[:lists]]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = np.stack([x[near == k].sum(0) if (near == k).any() else c[k] for k in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
    return c, x


def enough_probes(x: np.ndarray, c: np.ndarray, k: int, recall: float) -> int:
    """The least number of lists that hold `recall` of the k nearest of up to 200 rows of a sample, within that sample."""
    q = x[:200]
    near = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, 1 : k + 1]
    rank = np.argsort(np.argsort(-(q @ c.T), axis=1, kind="stable"), axis=1)
    cell = (x @ c.T).argmax(1)
    needed = np.sort(np.take_along_axis(rank, cell[near], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1 if len(needed) else 1


def approximate_topk(v: DataFrame, queries: DataFrame, k: int = 10, recall: float = 0.95) -> DataFrame:
    """T4: every vector stands in the list of its nearest centroid; a query reads as many lists as gave `recall` on the sample that
    the centroids are fitted on. Ties by id."""
    fitted, x = centroid_index(v)
    probes = enough_probes(x, fitted, k, recall)
    c = v.sparkSession.sparkContext.broadcast(fitted)

    def listed(batches):
        for pdf in batches:
            for at in range(0, len(pdf), SCORED):
                part = pdf.iloc[at : at + SCORED]
                yield part.assign(cell=(np.stack(part["embedding"]).astype(float) @ c.value.T).argmax(1))

    def reads(q):
        read = np.zeros((len(q), len(fitted)), bool)
        for at in range(0, len(q), SCORED):
            np.put_along_axis(read[at : at + SCORED], np.argsort(-(q[at : at + SCORED] @ fitted.T), axis=1, kind="stable")[:, :probes], True, 1)
        return read

    base = spread(v).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>"), F.col("label").cast("int")).mapInPandas(listed, "vec_id long, embedding array<float>, label int, cell int")
    base = base.repartitionByRange(v.sparkSession.sparkContext.defaultParallelism, "cell", "vec_id").sortWithinPartitions("cell")
    return asked(written(base, "lists"), queries, k, reads).drop("label")


def approximate_nearest(spark, at):
    v = _vectors(spark, at)
    return approximate_topk(v, _asked(v))


_SIM = "round(list_cosine_similarity(cast({0} AS double[]), cast({1} AS double[])), 6)"


def _top(part: str = "") -> str:
    s = _SIM.format(f"q.embedding{part}", f"v.embedding{part}")
    return f"(SELECT * FROM (SELECT q.vec_id AS query_id, q.label AS own, q.embedding AS qe, v.embedding AS ve, v.vec_id, v.label, {s} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {s} DESC, v.vec_id) AS place FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) t WHERE place <= 20)"


_AGAIN = f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY again DESC, vec_id) AS new_place FROM (SELECT *, {_SIM.format('qe[33:64]', 've[33:64]')} AS again FROM {_top()} t) a)"
_HITS = "(SELECT query_id, coalesce(min(CASE WHEN label = own THEN place END), 21) AS r FROM {0} t GROUP BY query_id)"
_CURVE = f"(SELECT k, round(avg(CASE WHEN r <= k THEN 1.0 ELSE 0.0 END), 3) AS recall FROM {_HITS.format(_top())} h, (SELECT unnest([1, 3, 5, 10, 20]) AS k) ks GROUP BY k)"
_INV = "CASE WHEN {0} <= 20 THEN 1.0 / {0} ELSE 0.0 END"
_GAPS = f"(SELECT a.query_id, {_INV.format('a.r')} - {_INV.format('b.r')} AS d, row_number() OVER (ORDER BY a.query_id) - 1 AS i FROM {_HITS.format(_top())} a JOIN {_HITS.format(_top('[1:32]'))} b ON a.query_id = b.query_id)"
QUERIES = {f.__name__: f for f in (need_passages, reranked, rerank_report, rank_summary, recall_curve, embedding_choice, approximate_nearest)}
ORACLES = {
    "need_passages": f"SELECT own, 'P' || k AS name, vec_id, score, queries FROM (SELECT own, vec_id, max(score) AS score, count(*) AS queries, row_number() OVER (PARTITION BY own ORDER BY max(score) DESC, vec_id) AS k FROM {_top()} t WHERE place <= 10 GROUP BY own, vec_id) g WHERE k <= 10",
    "reranked": f"SELECT query_id, vec_id, cast(place AS int) AS place, cast(new_place AS int) AS new_place, again FROM {_AGAIN} a WHERE new_place <= 5",
    "rerank_report": f"""SELECT cut, without, with_it, gain, chosen, chosen AND gain >= 0.03 AS useful FROM (SELECT *, row_number() OVER (ORDER BY gain DESC, cut) = 1 AS chosen FROM (SELECT cut, round(avg(a), 3) AS without, round(avg(b), 3) AS with_it, round(round(avg(b), 3) - round(avg(a), 3), 3) AS gain
        FROM (SELECT cut, query_id, max(CASE WHEN place <= cut AND label = own THEN 1.0 ELSE 0.0 END) AS a, max(CASE WHEN new_place <= cut AND label = own THEN 1.0 ELSE 0.0 END) AS b FROM {_AGAIN} x, (SELECT unnest([3, 5, 10]) AS cut) c GROUP BY cut, query_id) y GROUP BY cut) z) w""",
    "rank_summary": f"SELECT count(*) AS n, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit1, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit5, round(avg({_INV.format('r')}), 6) AS mrr, cast(list_sort(list(r))[count(*) // 2 + 1] AS int) AS median_rank FROM {_HITS.format(_top())} h",
    "recall_curve": f"""SELECT k, recall, next_gain, k = (SELECT min(c.k) FROM {_CURVE} c WHERE NOT EXISTS (SELECT 1 FROM (SELECT k, round(coalesce(lead(recall) OVER (ORDER BY k) - recall, 0), 3) AS g FROM {_CURVE} e) s WHERE s.k >= c.k AND s.g >= 0.02)) AS chosen,
        CASE WHEN k = (SELECT min(c.k) FROM {_CURVE} c WHERE NOT EXISTS (SELECT 1 FROM (SELECT k, round(coalesce(lead(recall) OVER (ORDER BY k) - recall, 0), 3) AS g FROM {_CURVE} e) s WHERE s.k >= c.k AND s.g >= 0.02)) THEN k * 2 END AS retrieve FROM (SELECT k, recall, round(coalesce(lead(recall) OVER (ORDER BY k) - recall, 0), 3) AS next_gain FROM {_CURVE} c) q""",
    "embedding_choice": f"""SELECT n, gap, low, high, low > 0 OR high < 0 AS sure, CASE WHEN (low > 0 OR high < 0) AND gap > 0 THEN 'whole' ELSE 'half' END AS chosen FROM (SELECT n, gap, round(m[{int(0.025 * DRAWS) + 1}], 6) AS low, round(m[{int(0.975 * DRAWS) + 1}], 6) AS high FROM (SELECT count(*) AS n, round(avg(d), 6) AS gap FROM {_GAPS} g) a,
        (SELECT list_sort(list(m)) AS m FROM (SELECT draw, round(avg(d), 9) AS m FROM (SELECT draw, cast('0x' || substring(md5('{SEED}/' || draw || '/' || slot), 1, 8) AS bigint) % n AS i FROM (SELECT count(*) AS n FROM {_GAPS} g) c, range({DRAWS}) AS r(draw), (SELECT unnest(range(10000)) AS slot) s WHERE slot < n) p JOIN {_GAPS} g ON g.i = p.i GROUP BY draw) q) b) z""",
}
