"""The corpus pipeline: quality, near-duplicates, benchmark decontamination, PII, packing.

Stages take (spark, docs, sf_dir); all but the last return the columns of documents. A document goes when the classifier scores
it under 0.5, when it is not the first of its SimHash component (by id, then text), or when benchmark words cover over half of it;
benchmark passages and personal data are replaced in the texts of the others. Near-duplicates are judged on five-word shingles: 48
of the 256 bits of a fingerprint may differ, where the angle between the shingle counts of two texts has a cosine of about 0.83.
Null texts stay null, and their score decides like any other's; all texts without words are copies of each other. SQL can express
no stage in full.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from docloom.llm import decontam, packing, quality, shared, simhash, surrogates


def _quality(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, labels)


def _near_duplicates(spark, docs, sf_dir):
    return simhash.one_of_each(docs, shingle=5, words=4, most=48, shared=3, lead=1)


def _decontaminate(spark, docs, sf_dir):
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _pii(spark, docs, sf_dir):
    new = surrogates.replaced(docs, surrogates.session_key(spark))
    return new.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def _pack(spark, docs, sf_dir):
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality classifier", _quality), ("simhash near-dedup", _near_duplicates), ("benchmark decontamination", _decontaminate), ("pii surrogates", _pii), ("best-fit packing", _pack)]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
