"""Places in a total order without one task that sorts the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.tables import written


def numbered(df: DataFrame, key: str, name: str = "place") -> DataFrame:
    """df with each row's place from 0 in the order of key, a numeric column; rows of null keys are left out.

    The table is cut at quantiles, as many as there are shuffle partitions; rows are numbered within a cut and moved by the
    rows of the cuts before it. The driver sees the quantiles only; the offsets are one row per cut.
    """
    own = lambda n: n + "_" * max(map(len, df.columns))  # noqa: E731  names that no column has
    c_cut, c_k, c_offset = own("_cut"), own("_k"), own("_offset")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.select(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    lows = F.array(*(F.lit(c) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    cut = df.where(F.col(key).isNotNull()).withColumn(c_cut, F.size(F.filter(lows, lambda c: c < F.col(key))))
    before = Window.orderBy(c_cut).rowsBetween(Window.unboundedPreceding, -1)
    offset = cut.groupBy(c_cut).agg(F.count("*").alias("n")).select(c_cut, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(c_offset))
    inside = F.row_number().over(Window.partitionBy(c_cut).orderBy(key))
    return cut.withColumn(c_k, inside).join(F.broadcast(offset), c_cut).withColumn(name, F.col(c_offset) + F.col(c_k) - 1).drop(c_cut, c_k, c_offset)


def placed(df: DataFrame, *keys, name: str = "place") -> DataFrame:
    """df with each row's place from 0 in the order of keys of any ordered types, by ranges of them.

    Rows are counted within a range, and moved by the rows of the ranges before it; the offsets are one row per range.
    """
    own = lambda n: n + "_" * max(map(len, df.columns))
    c_at, c_part, c_offset = own("_at"), own("_part"), own("_offset")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn(c_at, F.monotonically_increasing_id()).withColumn(c_part, F.shiftright(c_at, 33)), "placed")
    before = Window.orderBy(c_part).rowsBetween(Window.unboundedPreceding, -1)
    offset = rows.groupBy(c_part).agg(F.count("*").alias("n")).select(c_part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(c_offset))
    return rows.join(F.broadcast(offset), c_part).withColumn(name, F.col(c_offset) + F.col(c_at) - F.shiftleft(c_part, 33)).drop(c_at, c_part, c_offset)


def even_sample(spark, at) -> DataFrame:
    """SA1: element floor(i * n / m) for each i below m."""
    docs, items = spark.read.parquet(f"{at}/documents.parquet").select("doc_id"), spark.read.parquet(f"{at}/benchmark.parquet")
    size = docs.agg(F.count("*").alias("n")).crossJoin(items.agg(F.count("*").alias("m")))
    wanted = items.select(F.col("item_id").alias("i")).distinct().join(F.broadcast(size)).where("i < m").withColumn("place", F.expr("cast(floor(i * n / m) as bigint)"))
    return numbered(docs, "doc_id").join(wanted, "place").select("i", "doc_id")


def triple_groups(spark, at) -> DataFrame:
    """Groups of 25 in order, labelled G1, G2, ..."""
    rows = numbered(spark.read.parquet(f"{at}/events.parquet").select("event_id"), "event_id").withColumn("g", F.expr("cast(floor(place / 25) as int)"))
    return rows.groupBy("g").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")).select(F.concat(F.lit("G"), (F.col("g") + 1).cast("string")).alias("label"), "n", "first_id", "last_id")


QUERIES = {"even_sample": even_sample, "triple_groups": triple_groups}
