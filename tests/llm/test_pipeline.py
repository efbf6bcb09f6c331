import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import decontam, packing, quality, simhash, surrogates

AT = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    cols, stages = docs.columns, dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{AT}/labels.parquet")
    good = {r.doc_id for r in quality.scores(docs, labels).collect() if r.score >= 0.5}

    def step(name, df, k):
        stages[name](spark, df, AT).write.parquet(f"{tmp_path}/{k}")
        return spark.read.parquet(f"{tmp_path}/{k}")

    one = step("quality classifier", docs, 1)
    rows = {r.doc_id: r for r in one.collect()}
    assert one.columns == cols and set(rows) == good

    two = step("simhash near-dedup", one, 2)
    ids = sorted(rows)
    f = simhash.long_fingerprints([rows[i].text for i in ids], 5, 4)
    b = f.astype(">u8").view(np.uint8).reshape(len(f), 4, 8)
    near = (np.bitwise_count(f[:, None] ^ f[None]).sum(2) <= 48) & ((b[:, None] == b[None]).sum(3) >= 3).any(2)
    dropped = {ids[k] for k in simhash.forest(*np.nonzero(np.triu(near, 1)), len(ids))[0]}
    assert two.columns == cols and {r.doc_id for r in two.collect()} == set(ids) - dropped

    three = step("benchmark decontamination", two, 3)
    items = [(r.item_id, decontam.item_words(r.text)) for r in spark.read.parquet(f"{AT}/benchmark.parquet").collect()]
    auto = decontam.Automaton(items)
    before, after = {r.doc_id: r for r in two.collect()}, {r.doc_id: r for r in three.collect()}
    for i, (n, hit, *_), (m, left, *_) in zip(before, decontam.scan_texts(auto, [r.text for r in before.values()]), decontam.scan_texts(auto, [after[i].text if i in after else None for i in before])):
        assert (i in after) == (hit <= 0.5 * n)
        if i in after:
            assert (m, left) == (n - hit, 0) and after[i].n_chars == len(after[i].text) and (hit or after[i] == before[i])

    four = step("pii surrogates", three, 4)
    for r in four.collect():
        assert r.text == surrogates.replace(after[r.doc_id].text, surrogates.session_key(spark))[0]

    five = collections.Counter(r.sequence_id for r in step("best-fit packing", four, 5).collect())
    total = {r.sequence_id: 0 for r in spark.read.parquet(f"{tmp_path}/5").collect()}
    for r in spark.read.parquet(f"{tmp_path}/5").collect():
        total[r.sequence_id] += r.length
    assert max(total.values()) <= packing.CAPACITY and sum(five.values())


@pytest.mark.parametrize("k", [1, 3])
def test_null_texts_pass(spark, k):
    docs = spark.createDataFrame([(1, None, "en", "s", None), (2, "plain words of a text", None, None, 3)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.STAGES[k][1](spark, docs, AT)
    assert out.columns == docs.columns and out.where("text is null").count() == 1


def test_rows_without_id_and_repeated_ids(spark):
    big = (1 << 62) + 1
    text, other = "plain words of a text that says one thing after another", "something else that no other row has to say in any way"
    rows = [(big, text, "en", "s", 55, 1), (big, text, "en", "s", 55, 1), (big + 1, text, None, None, 55, 2), (None, text, "en", "s", 55, 3), (big + 1, other, None, None, 55, 2), (None, other + " at all, ever, anywhere", "en", "s", 55, 4)]
    rows += [(None, None, None, None, None, None), (None, "", "en", "s", 0, 5), (4, " ", "en", "s", 1, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id int")
    out = corpus_pipeline.STAGES[1][1](spark, docs, AT)
    assert out.columns == docs.columns and sorted(map(repr, out.collect())) == sorted(map(repr, docs.where("component_id is not null and component_id <> 5 and component_id <> 3").distinct().where("doc_id is null or doc_id <> 4611686018427387906 or text like 'some%'").collect()))
    new = docs.withColumn("n_chars", F.length("text").cast("long"))
    assert {tuple(r) for r in corpus_pipeline.STAGES[3][1](spark, docs, AT).collect()} == {tuple(r) for r in new.collect()}
