"""Words that differ in a pattern of bytes stay apart, in both tables and in the operators that compare words by hash."""

import random

import numpy as np
import pytest

from docloom.llm import decontam, repeats
from docloom.llm import words as W

EVEN = [bin(i).count("1") % 2 for i in range(1024)]
ONE, TWO = ("".join("ab"[b ^ flip] for b in EVEN) for flip in (0, 1))


@pytest.mark.parametrize("table", [0, 1])
def test_digests_stay_apart(table):
    rng = random.Random(table)
    words = {ONE, TWO, "a", "a\0", "\0", "\0\0", "ab" * 4, "ab" * 8, "ba" * 8, "a" * 8, "a" * 16, "a" * 15}
    words |= {"".join(rng.choice("ab\0") for _ in range(rng.randrange(1, 40))) for _ in range(20_000)}
    words = sorted(words)
    data, bounds = W.joined([w.encode() for w in words])
    h = W.digests(data, bounds[:-1], bounds[1:], table)
    assert len(set(h.tolist())) == len(words)
    alone = [W.digests(*(lambda d, b: (d, b[:-1], b[1:]))(*W.joined([w.encode()])), table)[0] for w in words[:300]]
    assert alone == h[:300].tolist()  # a word's hash does not depend on what stands beside it
    assert not (np.unpackbits(h[:4096].view(np.uint8)).reshape(-1, 64).mean(0) < 0.4).any()


def test_no_repeat_where_one_word_differs(spark):
    same = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{same} {ONE}"), (2, f"{same} {TWO}"), (3, f"{same} {ONE}")]
    got = {r.doc_id: r.n_removed for r in repeats.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_no_hit_where_one_word_differs(spark):
    same = " ".join(f"w{i}" for i in range(7))
    docs = spark.createDataFrame([(1, f"{same} {ONE}"), (2, f"{same} {TWO}")], "doc_id long, text string")
    items = spark.createDataFrame([("a", f"{same} {TWO}")], "item_id string, text string")
    assert {r.doc_id: (r.n_hit, r.n_items) for r in decontam.contamination(docs, items).collect()} == {1: (0, 0), 2: (8, 1)}
