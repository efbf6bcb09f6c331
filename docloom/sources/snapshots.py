"""Tables that change in whole versions: a reader sees the old one or the new one, whatever step a writer is killed at.

A version is a folder of Parquet under `data`, and counts once an empty file of its name stands under `done`; that file is made in one
step after the data are whole. The name holds the version's number and the batch that it came from. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path


def versions(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(number, batch) of the versions that count, oldest first; a handful, as older ones are removed."""
    fs, at = _files(spark, path)
    done = at(f"{path}/done")
    names = [s.getPath().getName() for s in fs.listStatus(done)] if fs.exists(done) else []
    return sorted(tuple(map(int, n.split("_"))) for n in names)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version, or None."""
    v = versions(spark, path)
    return spark.read.parquet(f"{path}/data/{v[-1][0]}_{v[-1][1]}") if v else None


def replace(spark: SparkSession, path: str, change: Callable[[DataFrame | None], DataFrame], batch: int = -1, keep: int = 2) -> bool:
    """Write change(current) as the next version; a batch that a version has already seen is left out (False).

    Batches that are numbered must come in rising order, as those of a stream do. The newest `keep` versions stay, so that readers
    of the one before are not cut off.
    """
    fs, at = _files(spark, path)
    old = versions(spark, path)
    if batch >= 0 and any(b >= batch for _, b in old):
        return False
    name = f"{old[-1][0] + 1 if old else 0}_{max([batch, *(b for _, b in old)])}"
    change(current(spark, path)).write.mode("overwrite").parquet(f"{path}/data/{name}")
    fs.mkdirs(at(f"{path}/done"))
    fs.create(at(f"{path}/done/{name}"), False).close()
    for number, seen in versions(spark, path)[:-keep]:
        fs.delete(at(f"{path}/done/{number}_{seen}"), False)
        fs.delete(at(f"{path}/data/{number}_{seen}"), True)
    return True
