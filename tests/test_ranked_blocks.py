"""Search by words in blocks of queries: sums stay in their tasks, and odd blocks, ids and words change nothing (F16)."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import cuts
from docloom.operators import ranked

from test_ranked import found, loop


def texts_of(r, n, k=60):
    vocabulary = [f"w{i}" for i in range(k)]
    return [(i, " ".join(r.choices(vocabulary, [1 / (j + 1) for j in range(k)], k=r.randint(1, 40)))) for i in range(n)]


def test_sums_and_words_of_texts_make_no_rows(spark, monkeypatch):
    """Each word of a text and each pair of a query and a text with a common word were rows, written or shuffled."""
    r, rows, put = random.Random(3), [], ranked.written

    def counted(df, name):
        rows.append(put(df, name))
        return rows[-1]

    monkeypatch.setattr(ranked, "written", counted)
    docs = [(i, f"{t} all") for i, t in texts_of(r, 400)]
    queries = [(i, f"all w{i} w{i + 1}") for i in range(30)]
    assert found(spark, docs, queries, 3) == loop(docs, queries, 3)
    assert sum(df.count() for df in rows) <= len(docs) + 4 * 3 * len(queries)  # four tasks


def test_only_texts_found_are_cut_into_runs(spark):
    plan = ranked.passages_reranked(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


@pytest.mark.parametrize("sizes", [{"BLOCK": 4, "SCORES": 9, "TEXTS": 5, "ADDED": 6}, {"WORDS": 10, "TEXTS": 1, "ADDED": 1}])
def test_blocks_of_any_size_equal_the_loop(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(ranked, name, value)
    r = random.Random(8)
    docs = texts_of(r, 120)
    docs += [(500 + i, docs[3][1]) for i in range(30)] + [(900, None), (901, ""), (902, "…")]
    queries = [(i, " ".join(f"w{r.randrange(60)}" for _ in range(r.randint(1, 9)))) for i in range(9)] + [(90, docs[3][1]), (91, "nowhere"), (92, None)]
    for k in (1, 7, 200):
        assert found(spark, docs, queries, k) == loop(docs, queries, k)


def test_rows_of_one_id_are_summed(spark):
    docs = [(i, f"a x{i}") for i in range(40)] + [(7, "a b c"), (7, "a b"), (50, "b"), (None, "a d d"), (None, "d e f")]
    apart = [(1000 + i, t) for i, (_, t) in enumerate(docs)]
    of = {1000 + i: d for i, (d, _) in enumerate(docs)}
    sums = {}
    for (_, _), (d, s) in loop(apart, [(1, "a b d")], 99).items():
        sums[of[d]] = sums.get(of[d], 0) + s
    want = sorted(sums.items(), key=lambda x: (-x[1], x[0] is not None, x[0]))
    for k in (1, 2, 99):
        assert found(spark, docs, [(1, "a b d")], k) == {(1, p): x for p, x in enumerate(want[:k], 1)}


def test_words_of_one_query_count_once(spark):
    """An item in two rows asks for each word once, as in its SQL."""
    docs = texts_of(random.Random(2), 50)
    assert found(spark, docs, [(1, "w1 w2"), (1, "w2 w5 w5")], 9) == found(spark, docs, [(1, "w1 w2 w5")], 9)


def test_a_word_that_adds_nothing_still_finds(spark):
    docs = [(i, "a") for i in range(2000)] + [(5000, "a " + "b " * 200_000)]
    got = found(spark, docs, [(1, "a")], 3000)
    assert got == loop(docs, [(1, "a")], 3000) and got[1, 2001] == (5000, 0)


def test_words_are_the_same_in_tasks_and_columns(spark):
    signs = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    rows = [(f"x{s}y Z{s}",) for s in signs]
    for t, w in spark.createDataFrame(rows, "t string").select("t", ranked.words(F.col("t"))).collect():
        assert sorted(cuts.counted(t).elements()) == sorted(w), ascii(t)
