"""Texts that hold other texts as they stand, in one pass per bounded block of the texts sought."""

from __future__ import annotations

from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 4_000_000


def _blocks(items: DataFrame, id_col: str, text_col: str):
    block, size = {}, 0
    for r in items.select(F.col(id_col).cast("string"), text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        if block and size + len(r[1]) > BLOCK_CHARS:
            yield block
            block, size = {}, 0
        block.setdefault(r[1], []).append(r[0])
        size += len(r[1])
    yield block


def containing(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text") -> DataFrame:
    """(item_id, doc_id) for every row of items whose text stands in a row of docs; an empty one stands in every text.

    One Aho-Corasick automaton per block of at most BLOCK_CHARS characters reads each text once, instead of a nested loop.
    """
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType, items.schema[item_id].dataType

    def one(block):
        every = block.pop("", [])
        auto = ahocorasick.Automaton()
        for text, ids in block.items():
            auto.add_word(text, ids)
        auto.make_automaton()
        sent = spark.sparkContext.broadcast((auto, every))

        def run(batches):
            auto, every = sent.value
            for pdf in batches:
                rows = []
                for d, t in zip(pdf["d"], pdf["t"]):
                    found = {id(v): v for _, v in auto.iter(t)} if len(auto) else {}
                    rows += [(i, d) for i in [*every, *(i for ids in found.values() for i in ids)]]
                yield pd.DataFrame(rows, columns=["i", "d"], dtype=object)

        texts = docs.select(F.col(id_col).cast("string").alias("d"), F.col(text_col).alias("t")).where("t is not null")
        return texts.mapInPandas(run, "i string, d string")

    found = reduce(DataFrame.unionAll, [one(b) for b in _blocks(items, item_id, item_text)])
    return found.select(F.col("i").cast(item_type).alias(item_id), F.col("d").cast(id_type).alias(id_col))


def answer_documents(spark, at) -> DataFrame:
    return containing(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/benchmark.parquet"))


QUERIES = {"answer_documents": answer_documents}
