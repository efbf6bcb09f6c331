import random

from pyspark.sql import functions as F

from docloom.operators import chunks, fusion, numbering, substring, vectors


def test_texts_within_texts(spark, monkeypatch):
    docs = [(1, "abcabc"), (1, "abcabc"), (2, "xbcx"), (3, None), (None, "zabc"), (4, "")]
    items = [("a", "abc"), ("b", "bc"), ("b", "bc"), ("c", ""), ("d", None), (None, "xb")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    want = sorted(((a, b) for a, x in items for b, y in docs if x is not None and y is not None and x in y), key=str)
    for most in (substring.BLOCK_CHARS, 3):
        monkeypatch.setattr(substring, "BLOCK_CHARS", most)
        assert sorted((tuple(r) for r in substring.containing(d, i).collect()), key=str) == want
    assert substring.containing(d, i.limit(0)).count() == substring.containing(d.limit(0), i).count() == 0


def test_vectors_in_several_blocks(spark, monkeypatch):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    one = sorted(map(tuple, vectors.topk(v, v.where("vec_id % 20 = 0"), 3).collect()))
    monkeypatch.setattr(vectors, "BLOCK", 7)
    assert sorted(map(tuple, vectors.topk(v, v.where("vec_id % 20 = 0"), 3).collect())) == one and len(one) == 75
    assert vectors.topk(v, v.limit(0), 3).count() == 0


def test_fusion_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(i, sorted(rng.sample("abcdefghijkl", rng.randrange(0, 8)))) for i in range(120)]
    lead = {}
    sim = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0
    kept = []
    for i, s in rows:
        near = [(-sim(s, rows[k][1]), k) for k in kept if sim(s, rows[k][1]) >= 0.6]
        lead[i] = min(near)[1] if near else i
        kept += [] if near else [i]
    got = {r.pos: r.leader for r in fusion.fused(spark.createDataFrame(rows, "pos long, toks array<string>"), 0.6).collect()}
    assert got == lead and 10 < len(kept) < 110


def test_pieces_against_a_loop(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice(["ab", "c d", ". ", "\n", "\n\n", "e", "  "]) for _ in range(n))
    rows = [(i, text(n)) for i, n in enumerate([0, 1, 30, 31, 200, 900, 2000])] + [(7, "x" * 500), (8, None)]
    out = spark.createDataFrame(rows, "i int, t string").select("i", chunks.split_pieces(F.col("t"), 60, 12).alias("p"), chunks.sentences(F.col("t")).alias("s")).collect()
    for r in out:
        t = (rows[r.i][1] or "").strip()
        want, at = [], 0
        while t and at < len(t):  # the greedy rule, position by position
            end = min(len(t), at + 60)
            if end < len(t):
                ends = [max((e for e in range(end - 15 + len(m), end + 1) if t[e - len(m) : e] == m), default=None) for m in ("\n\n", "\n", ". ", " ")]
                end = next((e for e in ends if e), end)
            want += [t[at:end].strip()] if t[at:end].strip() else []
            at = len(t) if end >= len(t) else max(at + 1, end - 12)
        assert (r.p or []) == want and all(len(x) <= 60 for x in want)
        assert rows[r.i][1] is None or "".join("".join(r.s).split()) == "".join(t.split())


def test_numbering_with_a_hot_key(spark):
    keys = [7] * 300 + [(1 << 62) + k for k in range(50)] + list(range(550)) + [None]
    random.Random(1).shuffle(keys)
    got = numbering.numbered(spark.createDataFrame([(k,) for k in keys], "k long"), "k").collect()
    assert sorted(r.place for r in got) == list(range(900))
    assert [r.k for r in sorted(got, key=lambda r: r.place)] == sorted(k for k in keys if k is not None)
    assert numbering.numbered(spark.createDataFrame([], "k long"), "k").count() == 0
