import itertools

import numpy as np
import pandas as pd

from docloom.operators import vectors


def test_best_of_many_slices_with_ties_and_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (400, 4)).astype(float)  # many equal scores
    x[7], x[11, 2] = 0, np.nan
    rows = [(i, v.tolist(), None if i % 9 == 0 else i % 5) for i, v in enumerate(x)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    want = {}
    for q in range(0, 400, 20):
        s = np.round(unit[q] @ unit.T, 6)
        order = sorted((i for i in range(400) if i not in (q, 11)), key=lambda i: (-s[i], i))[:5]
        want[q] = [(i, rows[i][2], s[i]) for i in order]
    for block, scores in ((vectors.BLOCK, vectors.SCORES), (7, 60)):
        monkeypatch.setattr(vectors, "BLOCK", block)
        monkeypatch.setattr(vectors, "SCORES", scores)
        got = vectors.topk(v, v.where("vec_id % 20 = 0"), 5).orderBy("query_id", "place").collect()
        assert {q: [(r.vec_id, r.label, r.score) for r in found] for q, found in itertools.groupby(got, lambda r: r.query_id)} == want


def test_a_task_holds_few_scores(spark):
    """2,000 queries of a batch of 10,000 vectors once were a matrix of 160 MB and its copies."""
    import tracemalloc

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"vec_id": np.arange(10_000), "embedding": list(rng.normal(size=(10_000, 16))), "label": np.arange(10_000) % 10})
    v = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(pdf["embedding"][:2000])], "vec_id long, embedding array<double>, label int")
    run = []

    class Seen:
        sparkSession = spark

        def mapInPandas(self, f, kind):
            run.append(f)
            return spark.createDataFrame([], kind)

    vectors.asked(Seen(), v, 20, lambda q: None)
    tracemalloc.start()
    assert sum(map(len, run[0](iter([pdf])))) == 2000 * 20
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()
