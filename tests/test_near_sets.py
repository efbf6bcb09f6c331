import random

from docloom.operators import fusion


def _jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0


def _written(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_near_sets_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(fusion, "BLOCK_TOKENS", 300)
    rng = random.Random(8)
    rows = [(i, rng.sample("abcdefghijklmnopqrst", rng.randrange(1, 19))) for i in range(150)]
    for least in (0.35, 0.6, 1.0):
        want = {(i, j): _jaccard(a, b) for i, a in rows for j, b in rows if i < j and _jaccard(a, b) >= least}
        got = {(r.a, r.b): r.score for r in fusion.jaccard_pairs(spark.createDataFrame(rows, "c long, toks array<string>"), least).collect()}
        assert got == want
    refs, preds = [r for r in rows if r[0] % 3], [r for r in rows if r[0] % 3 == 0] + [(999, rows[1][1][::-1])]
    refs, preds = [(i, sorted(t)) for i, t in refs], [(i, sorted(t)) for i, t in preds]
    want = {i: max(_jaccard(a, b) for _, b in preds) for i, a in refs}
    got = fusion.best_matches(spark.createDataFrame(refs, "r long, toks array<string>"), spark.createDataFrame(preds, "p long, toks array<string>"), 0.35).collect()
    assert {r.r: r.score for r in got} == {i: s for i, s in want.items() if s >= 0.35} and want[1] == 1


def test_sets_that_share_words_only_move_no_pairs(spark):
    """1,200 sets of common words, of which no two reach the limit, once met as several hundred thousand rows."""
    rng = random.Random(9)
    rows = [(i, rng.sample([f"w{k}" for k in range(60)], 20)) for i in range(1200)]
    sets = fusion.written(spark.createDataFrame(rows, "c long, toks array<string>").repartition(4), "sets")
    before = _written(spark)
    fusion.jaccard_pairs(sets, 0.9).collect()
    assert _written(spark) - before < 1_500_000
