"""Written tables in the cluster's shared folder, connected components, and texts changed in place."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only on one machine where it is unset, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="docloom")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet to the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of steps whose results are written; else they stay until the driver collects garbage."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def with_texts(docs: DataFrame, change, text_col: str = "text", extra: bool = False) -> DataFrame:
    """docs with texts changed or rows dropped; all other columns pass as Arrow, so that no null or 64-bit integer is altered.

    change(texts) gives (new texts, or None to leave them; a list of booleans that keep a row, or None). With `extra` the last
    column is given to change beside the texts, and goes.
    """
    at, schema = docs.columns.index(text_col), StructType(docs.schema.fields[:-1]) if extra else docs.schema

    def run(batches):
        for b in batches:
            new, keep = change(b.column(at).to_pylist(), *([b.column(b.num_columns - 1).to_pylist()] if extra else []))
            if extra:
                b = pa.RecordBatch.from_arrays(b.columns[:-1], schema=pa.schema(list(b.schema)[:-1]))
            if new is not None:
                columns = b.columns
                columns[at] = pa.array(new, b.schema.field(at).type)
                b = pa.RecordBatch.from_arrays(columns, schema=b.schema)
            yield b if keep is None else b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) of a spanning forest of the links a-b among nodes 0..n-1; a root is its tree's smallest node."""
    low = np.arange(n)
    while len(a):
        x, y = low[a], low[b]
        if (x == y).all():
            break
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]
    node = np.flatnonzero(low != np.arange(n))
    return node, low[node]


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for undirected edges (a, b) of longs; component is the smallest node reachable.

    Alternates large-star and small-star steps on tables in the shared folder until no edge changes.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        new = written(small, "edges")
        before = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        after = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        e = new
        if before == after:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
