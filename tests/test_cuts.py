"""Cuts of texts in one pass each: at odd signs, without a second evaluation, and at a few microseconds a sentence."""

import time

from pyspark.sql import functions as F

from docloom.functions import cuts
from docloom.operators import chunks


def test_white_space_and_signs_beyond_ascii():
    nbsp = " "
    assert cuts.sentences(f"  One fine day, it was said, he left.{nbsp}Two \t words\x0bMore…\n\nEnd ") == [f"One fine day, it was said, he left.{nbsp}Two words\x0bMore…", "End"]
    assert cuts.sentences(f"A long enough start stands here{nbsp}Dr. Next one here.") == [f"A long enough start stands here{nbsp}Dr.", "Next one here."]
    assert cuts.sentences("A long enough start stands here (cf. Next one here.") == ["A long enough start stands here (cf. Next one here."]
    assert cuts.sentences("") == cuts.sentences(" \n") == [] and cuts.words(f"a{nbsp}b\x1cc d e") == 2
    assert cuts.tokens("Élan ÉLAN naïve Ÿves İx ω2b x the 漢a1字 a-bc") == {b"elan", b"naive", b"yves", b"2b", b"a1", b"bc"}
    assert cuts.sections("x\n #\nb\n## T \n") == [(None, "x"), ("", "b"), ("T", "")]


def test_each_text_is_cut_once(spark, capsys):
    for name, most in (("middle_queries", 2), ("structural_chunks", 1), ("chunk_report", 2), ("candidate_report", 6)):
        chunks.QUERIES[name](spark, "/root/testdata/sf0.001").explain()
        assert 0 < capsys.readouterr().out.count("ArrowEvalPython") <= most, name


def test_a_sentence_takes_microseconds(spark):
    text = " ".join(f"The engineer Béla wrote report {i} on pump {i % 97} and its valve. It failed twice, and nobody of the crew {i % 89} knew why!" for i in range(60_000))
    df = spark.createDataFrame([(text,)], "t string").cache()
    for rule in (chunks.fixed, chunks.semantic):
        df.select(F.size(rule(F.substring("t", 1, 1000)))).collect()
        start = time.time()
        assert df.select(F.size(rule(F.col("t")))).first()[0] > 5_000
        assert time.time() - start < 4


def test_children_of_parents_numbered_over_the_corpus(spark, tmp_path):
    """F1 of round 5: the query named a function that its module no longer had."""
    texts = {10: "Ten words or so. " * 300, 9: "Nine is short.", -3: " ", 2**40: "A far number, and a longer text beside it. " * 90, 7: None}
    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    parents = [f"{d}\n\n{body}" for d in sorted(texts) if texts[d] for body, _ in chunks._cut(texts[d], chunks.OVERLAP)]
    want = {(i, k, child) for i, p in enumerate(parents) for k, child in enumerate(cuts.pieces(p, 552, 110))}
    assert {tuple(r) for r in chunks.measured_children(spark, str(tmp_path)).collect()} == want and len(parents) > 6 and len(want) > 12
