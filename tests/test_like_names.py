import difflib
import random
import time

import numpy as np

from docloom.operators import sequences


def _keys(n, seed, low=0, high=9):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(["th", "an", "er", "in", "a", "o", " "]) for _ in range(rng.randrange(low, high))) for _ in range(n)})


def _like(x, y, least):
    return max(difflib.SequenceMatcher(None, x, y).ratio(), difflib.SequenceMatcher(None, y, x).ratio()) >= least


def test_like_names_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(sequences, "BLOCK_CHARS", 500)
    keys = _keys(260, 3)
    for least in (0.8, 0.88):
        want = {(i, j) for i, x in enumerate(keys) for j, y in enumerate(keys) if i < j and _like(x, y, least)}
        got = [(r.a, r.b) for r in sequences.alike(spark.createDataFrame(list(enumerate(keys)), "id long, key string"), least).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 5


def test_candidates_of_names_are_not_shuffled(spark):
    """names that share pairs of characters once met as rows of joins on them."""
    keys = _keys(2500, 4, 3, 7)
    rows = sequences.written(spark.createDataFrame(list(enumerate(keys)), "id long, key string").repartition(4), "names")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    assert sequences.alike(rows, 0.8).count() > 2 * len(keys)
    assert written() - before < 2_000_000


def test_short_names_meet_by_what_is_left_of_them():
    """F2 of round 5: all pairs of names were counted, where those alike are few."""
    rng = random.Random(5)
    names = np.array(sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyzé𝒳") for _ in range(rng.randrange(7, 13))) for _ in range(12_000)}), dtype=object)
    twins = np.array([n[:3] + "ß" + n[4:] for n in names[::4]], dtype=object)
    start = time.time()
    found = {(int(i), int(j)): (s, b) for i, j, s, b in ((*x,) for f in sequences._near_short(names, twins, 0.8, False) for x in zip(*f))}
    assert time.time() - start < 4
    assert all((4 * k, k) in found for k in range(len(twins)))
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    assert all((ratio(names[i], twins[j]), ratio(twins[j], names[i])) == f for (i, j), f in found.items())


def test_short_keys_against_a_loop():
    for least, top in ((0.8, 15), (0.88, 15), (0.7, 7)):
        assert sequences._short(least) == top
        keys = np.array(sorted({k[:top] for k in _keys(400, 6)}), dtype=object)
        ratio = lambda i, j: difflib.SequenceMatcher(None, keys[i], keys[j]).ratio()
        got = [(int(i), int(j), s, b) for f in sequences._near_short(keys, keys, least, True) for i, j, s, b in zip(*f)]
        assert len({frozenset(x[:2]) for x in got}) == len(got) > 20
        assert {frozenset(x[:2]) for x in got} == {frozenset((i, j)) for i in range(len(keys)) for j in range(i) if max(ratio(i, j), ratio(j, i)) >= least}
        assert all((ratio(i, j), ratio(j, i)) == (s, b) for i, j, s, b in got)


def test_a_name_need_not_wait_for_all_before_it():
    def slow(earlier):
        return not any(x[3] for x in sorted((x for x in earlier if x[0] == 1), key=lambda x: (-x[1], -x[2]))[:5])

    rng = random.Random(6)
    early = 0
    for _ in range(2000):
        rows = [(rng.choice([1, 1, 1, 0, -1]), rng.choice([0.8, 0.85, 0.9]), rank, rng.random() < 0.3) for rank in range(rng.randrange(12))]
        said, free = sequences._follows_shape(rows), [k for k, x in enumerate(rows) if x[0] == 0]
        if said is None:
            assert free
            continue
        early += bool(free)
        for _ in range(20):
            to = {k: rng.choice([1, -1]) for k in free}
            assert slow([(to.get(k, x[0]), *x[1:]) for k, x in enumerate(rows)]) == said
    assert early > 100
