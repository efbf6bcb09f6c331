"""Embedding near-dedup by sorted projection passes.

Equal vectors of a label are one class with a count. In each pass every class gets the concatenated signs of 32 random
projections; classes are sorted by (label, bits), each is compared with the next WIDTH by cosine in double precision, also over
the edges of partitions, and verified pairs of all passes are united. The number of passes follows the largest label, so that a
pair at the limit is expected to be found with probability RECALL (see passes). What windows may miss within a dense group is
recovered exactly by comparing all members of each component found, block against block, in separate tasks.

Null labels, and vectors that are null, zero, of another length or hold null or non-finite components link with nothing. Every
row comes back once: rows that repeat an id are vectors of their own, and a row without an id links like any other, is no
component's smallest id and is kept only where no row of its component has one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import components, forest, written

LEAST_PASSES, WIDTH, BITS, SIDE, RECALL = 12, 24, 32, 512, 0.98


def passes(largest: int, least: float, width: int = WIDTH) -> int:
    """Passes after which a pair of cosine `least` in a label of `largest` vectors has met within the window with probability RECALL.

    Two vectors at an angle a share a sign with probability 1 - a / pi, and about log2(largest / width) leading signs must agree.
    """
    bits = max(0.0, math.log2(max(largest, 1) / width))
    meet = (1 - math.acos(min(1.0, max(-1.0, least))) / math.pi) ** bits
    return max(LEAST_PASSES, math.ceil(math.log(1 - RECALL) / math.log(1 - meet))) if meet < 1 else LEAST_PASSES


def unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _near(x: np.ndarray, tags: np.ndarray, places: np.ndarray, least: float):
    """Pairs of rows of one tag at most WIDTH places apart with cosine `least`; rows are in order of tag and place."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, min(WIDTH, len(x) - 1) + 1):
        near = (tags[:-d] == tags[d:]) & (places[d:] - places[:-d] <= WIDTH)
        j = np.flatnonzero(near)
        j = j[(x[j] * x[j + d]).sum(1) >= least]
        left.append(j)
        right.append(j + d)
    return np.concatenate(left), np.concatenate(right)


def near_duplicates(vectors: DataFrame, id_col="vec_id", vec_col="embedding", label_col="label", least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    from pyspark import TaskContext

    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("v"), F.col(label_col).cast("string").alias("label"))
    fine = "coalesce(label is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0), false)"
    good = rows.where(fine).withColumn("label", F.concat(F.size("v").cast("string"), F.lit(":"), "label"))
    same = good.groupBy("label", "v").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    same = written(same.withColumn("c", F.monotonically_increasing_id()), "classes")
    largest = same.groupBy("label").agg(F.count("*").alias("m")).agg(F.max("m")).first()[0] or 0
    times = passes(largest, least)

    def keys(batches):
        for pdf in batches:
            for _, part in pdf.groupby("label"):
                x = unit(part["v"])
                out = []
                for p in range(times):
                    r = np.random.default_rng(1000 + p).normal(size=(x.shape[1], BITS))
                    out.append(part.assign(p=p, k=((x @ r > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)))))
                yield pd.concat(out)

    def slide(batches):
        """Links as a forest of each stretch, then the first and last WIDTH rows of the partition with their places."""
        tail, head, at, part = None, None, 0, TaskContext.get().partitionId()
        none = dict(a=None, b=None)
        for pdf in batches:
            pdf = pdf.assign(place=np.arange(at, at + len(pdf)))
            at += len(pdf)
            head = pdf.head(WIDTH) if head is None else pd.concat([head, pdf.head(WIDTH - len(head))])
            pdf = pdf if tail is None else pd.concat([tail, pdf], ignore_index=True)
            tail = pdf.tail(WIDTH)
            tag = (pdf["p"].astype(str) + "/" + pdf["label"]).to_numpy()
            ids = pdf["c"].to_numpy()
            for g in pd.unique(tag):
                i = np.flatnonzero(tag == g)
                x, y = forest(*_near(unit(pdf["v"].iloc[i]), np.zeros(len(i)), np.arange(len(i)), least), len(i))
                yield pd.DataFrame({"a": ids[i[x]], "b": ids[i[y]], "part": None, "place": None, "tag": None, "v": None, "size": None})
        if head is not None:
            edge = pd.concat([head, tail]).drop_duplicates("place")
            yield pd.DataFrame({"a": edge["c"], "b": None, "part": part, "place": edge["place"], "tag": edge["p"].astype(str) + "/" + edge["label"], "v": edge["v"], "size": at})

    def over_edges(pdf):
        """Links between partitions in one pass over a label, from their first and last rows: as many as partitions, not vectors, allow."""
        size = pdf.groupby("part")["size"].first().sort_index()
        before = size.cumsum() - size
        pdf = pdf.assign(at=pdf["place"] + pdf["part"].map(before)).sort_values("at")
        ids, x, y = pdf["a"].to_numpy(), *_near(unit(pdf["v"]), np.zeros(len(pdf)), pdf["at"].to_numpy(), least)
        return pd.DataFrame({"a": ids[x], "b": ids[y]})

    dealt = same.select("c", "label", "v").mapInPandas(keys, f"c long, label string, v {kind}, p int, k long").repartitionByRange(parts, "p", "label", "k").sortWithinPartitions("p", "label", "k", "c")
    found = written(dealt.mapInPandas(slide, f"a long, b long, part int, place long, tag string, v {kind}, size long"), "windows")
    edges = found.where("part is not null").groupBy("tag").applyInPandas(over_edges, "a long, b long")
    comp = components(found.where("part is null").select("a", "b").unionAll(edges))
    member = same.join(comp.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    sizes = member.groupBy("component").agg(F.count("*").alias("m")).where("m > 1")
    dense = written(member.join(sizes, "component").withColumn("sides", F.ceil(F.col("m") / SIDE)).withColumn("side", F.pmod(F.xxhash64("c"), "sides")), "dense")
    meet = dense.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1))).select("component", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "side", "c", "n", "v")

    def count(pdf):
        left, right = pdf[pdf["side"] == pdf["i"]], pdf[pdf["side"] == pdf["j"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"c": [], "links": []})
        ok = unit(left["v"]) @ unit(right["v"]).T >= least
        ok &= left["c"].to_numpy()[:, None] != right["c"].to_numpy()[None]
        out = [pd.DataFrame({"c": left["c"], "links": ok @ right["n"].to_numpy()})]
        if pdf["i"].iloc[0] != pdf["j"].iloc[0]:
            out.append(pd.DataFrame({"c": right["c"], "links": ok.T @ left["n"].to_numpy()}))
        return pd.concat(out)

    links = meet.groupBy("component", "i", "j").applyInPandas(count, "c long, links long").groupBy("c").agg(F.sum("links").alias("links"))
    low = member.groupBy("component").agg(F.min("low").alias("component_id"))
    label = member.join(links, "c", "left").join(low, "component").select("label", "v", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    known = good.join(label, ["label", "v"]).select("id", "n_links", "component_id")
    out = known.unionAll(rows.where(f"not {fine}").select("id", F.lit(0).cast("long"), "id"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
