"""A live corpus as a stream: fresh texts, counts, and chunks and a graph that follow it (an extension, survey 2.14)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.tables import shared_folder, written
from docloom.operators import chunks, facts
from docloom.operators.chunks import fixed
from docloom.sources import snapshots


def new_texts(stream: DataFrame, time_col: str, text_col: str = "text", late: str = "1 hour") -> DataFrame:
    """Texts not seen within the watermark."""
    return stream.withColumn("sha", F.sha1(text_col)).withWatermark(time_col, late).dropDuplicatesWithinWatermark(["sha"])


def event_counts(stream: DataFrame, time_col: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, width), "event_type").agg(F.count("*").alias("n"))


def latest(batch: DataFrame, order: str | None = None) -> DataFrame:
    """One row a document of a batch: the last by `order`, ties and no order by the text's hash; nulls come first."""
    keys = ([order] if order else []) + ["sha"]
    best = F.max_by(F.struct("text", "sha"), F.struct(*keys))
    return batch.where("doc_id is not null").withColumn("sha", F.sha1(F.coalesce("text", F.lit("")))).groupBy("doc_id").agg(best.alias("x")).select("doc_id", "x.*")


def merge_chunks(batch: DataFrame, path: str, number: int = -1, order: str | None = None) -> bool:
    """C4, C7 on a live corpus: the chunks (doc_id, sha, chunk, body) at a path after a batch of documents (doc_id, text).

    Only documents whose text has changed are cut again and lose their earlier chunks. A document without chunks keeps one row with a
    null chunk, so that it is known. A batch seen before changes nothing.
    """
    spark = batch.sparkSession

    def change(old: DataFrame | None) -> DataFrame:
        new = latest(batch, order)
        if old is not None:
            new = new.join(old.select("doc_id", "sha").distinct(), ["doc_id", "sha"], "left_anti")
        new = written(new, "changed")
        cut = new.select("doc_id", "sha", F.posexplode_outer(fixed(F.coalesce("text", F.lit("")))).alias("chunk", "g")).select("doc_id", "sha", "chunk", F.col("g.body").alias("body"))
        return cut if old is None else old.join(new.select("doc_id"), "doc_id", "left_anti").select("doc_id", "sha", "chunk", "body").unionAll(cut)

    return snapshots.replace(spark, path, change, number)


def merge_graph(edges: DataFrame, path: str, number: int = -1) -> bool:
    """SK3 on a live graph: edges (s, p, o, source) merged into the one at a path; an edge gets the sources that it lacks."""

    def change(old: DataFrame | None) -> DataFrame:
        new = edges.select("s", "p", "o", "source").distinct()
        return new if old is None else old.unionAll(new).distinct()

    return snapshots.replace(edges.sparkSession, path, change, number)


def graph(spark: SparkSession, path: str) -> DataFrame | None:
    """The edges of a live graph with the sources of each, sorted."""
    rows = snapshots.current(spark, path)
    return None if rows is None else rows.groupBy("s", "p", "o").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def follow(stream: DataFrame, merge, path: str):
    """Every batch of a stream merged into the versions at a path, until nothing new is there; a restart begins where the last ended."""
    return stream.writeStream.foreachBatch(lambda batch, number: merge(batch, path, number)).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def _followed(spark, at, merge, name: str) -> str:
    documents = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text")
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    one_or_many = f"{at}/documents.parque[t]"  # a stream takes a single file only by a pattern
    follow(spark.readStream.schema(documents.schema).parquet(one_or_many), merge, path).awaitTermination()
    return path


def live_chunks(spark, at):
    """2.14, C4: the documents as a stream of files, cut as they come."""
    return snapshots.current(spark, _followed(spark, at, merge_chunks, "live-chunks")).where("chunk is not null").select("doc_id", "chunk", "body")


def live_graph(spark, at):
    """2.14, SK3: the relations of the documents as a stream of files, merged as they come."""

    def merge(batch, path, number):
        kept = facts.checked(facts.relations(batch.where("text is not null"))).where("reason = 'kept'")
        return merge_graph(kept.select("s", "p", "o", F.col("doc").alias("source")), path, number)

    return graph(spark, _followed(spark, at, merge, "live-graph"))


QUERIES = {"live_chunks": live_chunks, "live_graph": live_graph}
ORACLES = {
    "live_chunks": f"SELECT cast(doc AS bigint) AS doc_id, chunk, body FROM ({chunks.ORACLES['fixed_chunks']}) f",
    "live_graph": f"SELECT s, p, o, list_sort(list(DISTINCT doc)) AS sources FROM {facts.FOUND_CHECKED} c WHERE reason = 'kept' GROUP BY s, p, o",
}
