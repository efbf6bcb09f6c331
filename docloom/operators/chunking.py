"""Sentence and chunk operators, as folds of array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sentences(text: Column) -> Column:
    """C1, first step: split after . ! ? followed by white space."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


def pack(parts: Column, target: int = 1400) -> Column:
    """Greedy groups; a sentence joins while the group's size stays within target. Gives the groups' sizes."""
    empty = F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("size"))
    n = lambda s: F.length(s)

    def step(a, s):
        fits = (a["size"] == 0) | (a["size"] + n(s) + 1 <= target)
        return F.struct(F.when(fits, a["done"]).otherwise(F.concat(a["done"], F.array(a["size"]))).alias("done"), F.when(a["size"] == 0, n(s)).when(fits, a["size"] + n(s) + 1).otherwise(n(s)).alias("size"))

    return F.aggregate(parts, empty, step, lambda a: F.when(a["size"] > 0, F.concat(a["done"], F.array(a["size"]))).otherwise(a["done"]))


def chunk_fixed(spark, at) -> DataFrame:
    docs = spark.read.parquet(f"{at}/documents.parquet")
    return docs.select("doc_id", F.posexplode(pack(sentences(F.col("text")))).alias("chunk", "n_chars"))


def chunk_stats(spark, at) -> DataFrame:
    c = chunk_fixed(spark, at)
    return c.agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("docs"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"), F.round(F.avg("n_chars"), 4).alias("mean"), F.round(F.avg((F.col("n_chars") < 300).cast("double")), 6).alias("tiny"))


def sentence_counts(spark, at) -> DataFrame:
    docs = spark.read.parquet(f"{at}/documents.parquet")
    s = sentences(F.col("text"))
    words = F.filter(s, lambda x: F.size(F.regexp_extract_all(x, F.lit("[^ ]+"), F.lit(0))) >= 8)
    return docs.select("doc_id", F.size(s).cast("long").alias("n"), F.get(words, (F.size(words) / 2).cast("int")).alias("middle"))


_SPLIT = "list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
_PACKED = f"""SELECT doc_id, unnest(g).i AS chunk, unnest(g).n AS n_chars FROM (SELECT doc_id, list_transform(range(1, len(z) + 1), lambda i: {{'i': cast(i - 1 AS int), 'n': cast(z[i] AS int)}}) AS g FROM (
    SELECT doc_id, list_reduce(list_transform({_SPLIT}, lambda s: [cast(length(s) AS bigint)]), lambda a, s: CASE WHEN len(a) = 0 THEN s WHEN a[-1] + s[1] + 1 <= 1400 THEN list_concat(a[1:len(a) - 1], [a[-1] + s[1] + 1]) ELSE list_concat(a, s) END) AS z
    FROM documents WHERE len({_SPLIT}) > 0) p) q"""
QUERIES = {"chunk_fixed": chunk_fixed, "chunk_stats": chunk_stats, "sentence_counts": sentence_counts}
ORACLES = {
    "chunk_fixed": _PACKED,
    "chunk_stats": f"SELECT count(*) AS chunks, count(DISTINCT doc_id) AS docs, min(n_chars) AS low, max(n_chars) AS high, round(avg(n_chars), 4) AS mean, round(avg(CASE WHEN n_chars < 300 THEN 1.0 ELSE 0.0 END), 6) AS tiny FROM ({_PACKED}) c",
    "sentence_counts": f"SELECT doc_id, len(s) AS n, w[len(w) // 2 + 1] AS middle FROM (SELECT doc_id, s, list_filter(s, lambda x: len(regexp_extract_all(x, '[^ ]+', 0)) >= 8) AS w FROM (SELECT doc_id, {_SPLIT} AS s FROM documents) a) b",
}
