"""Language identification, hard negatives and the prefix trie against loops over rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import langid, negatives, tries

AT = "/root/testdata/sf0.01"


def trie_of(rows, graft=20):
    found = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            found[c].append(((t is not None, t or 0), r or "", x or ""))
    found = {c: [(r, x) for _, r, x in sorted(v)] for c, v in found.items()}
    nodes, new = collections.defaultdict(list), {}
    for c, v in found.items():
        h = zlib.crc32(str(c).encode()) % 4 if graft else 0
        new[c] = found.get(c - int(math.fmod(c, graft or 1)), [])[:h] + v[h:]
        for d in range(len(new[c]) + 1):
            nodes[tuple(new[c][:d])].append(c)
    kids = collections.defaultdict(list)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    out, up = set(), {}
    for k in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        up[k] = sum(up[x][0] for x in kids[k]) or 1, own + sum(up[x][1] for x in kids[k])
        ends = ",".join(map(str, sorted(c for c in nodes[k] if len(new[c]) == len(k))))
        out.add((min(nodes[k]), len(k), min(nodes[k[:-1]]) if k else None, len(nodes[k]), len(kids[k]), *up[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie(spark, rows, graft=20):
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, size int")
    got = [tuple(r) for r in tries.prefix_trie(*tries.placed(df, graft=graft)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_trie_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(tries, "HEAVY", 4)  # both ways of joining
    rng = random.Random(1)
    rows = [(rng.choice([c, c, c, None]), rng.choice([None, 0, 1, 2]), rng.choice(["u", "a", None]), rng.choice(["x y", None, "z"])) for c in range(-25, 60) for _ in range(rng.randrange(1, 6))]
    rows += [(100 + i, k, "u", f"w {k}") for i in range(12) for k in range(6)] + [(7, 1, "u", "long " * 50_000)] * 2
    assert trie(spark, rows) == trie_of(rows)
    assert trie(spark, rows, graft=0) == trie_of(rows, 0)


def test_trie_of_no_and_of_one_conversation(spark):
    assert trie(spark, []) == set()
    assert trie(spark, [(None, 1, "u", "x")]) == set()
    one = [(1, k, "u", None) for k in range(3)]
    assert trie(spark, one) == trie_of(one)
    left = [(c, 1, "u", "x") for c in range(1, 20)]  # bases are absent: those whose head takes all have no turn
    assert trie(spark, left) == trie_of(left) and any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in trie_of(left))


def test_ends_of_one_node_over_many_partitions(spark):
    rows = [(c, 0, "u", "hello") for c in range(30_000)]
    got = trie(spark, rows, graft=0)
    want = hashlib.sha256(",".join(map(str, range(30_000))).encode()).hexdigest()
    assert {r[7] for r in got if r[1] == 1} == {want} and len(got) == 2


def mined_of(rows):
    good = {}
    for i, v, k in rows:
        if i is not None and k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i, (k + 1) % 10 if i % 7 == 0 else k, tuple(v)] = [math.floor(256 * x) for x in v]
    out, clip = [], lambda x: max(-(2**63), min(2**63 - 1, x))
    for (i, k, _), q in good.items():
        if i % 100 == 0:
            near = sorted((-sum(a * b for a, b in zip(q, w)), j, m) for (j, m, _), w in good.items() if j != i)
            for p, j, m in [x for x in near if x[2] == k][:5]:
                for r, (n, o) in enumerate([(n, o) for n, o, m in near if m != k and 30 * -p <= 100 * -n <= 90 * -p][:10]):
                    out.append((i, j, r + 1, o, clip(-p), clip(-n)))
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, score int")
    return sorted(map(tuple, negatives.mined(df, shift=(7, 10)).collect()))


def test_negatives_against_a_loop(spark, monkeypatch):
    for name, n in (("BUCKET", 16), ("BLOCK", 3), ("STRIPE", 100), ("AT_ONCE", 2)):
        monkeypatch.setattr(negatives, name, n)
    rng = random.Random(2)

    def vector():
        if rng.random() < 0.1:
            return rng.choice([None, [], [1.0], [float("nan"), 1.0], [None, 2.0], [float("inf")]])
        return [rng.random() * rng.choice([1, 3, 0.01]) - 0.1 for _ in range(4)]

    rows = [(rng.choice([rng.randrange(700), 100 * rng.randrange(7), None]), vector(), rng.choice([None, 0, 1, 2, 9])) for _ in range(500)]
    rows += rows[:50] + [(1000 + i, [0.5, 0.5], 3) for i in range(40)] + [(2000, [0.5, 0.5], 4), (2100, [1.0, 1.0], 3)]
    assert mined(spark, rows) == mined_of(rows) and len(mined_of(rows)) > 500


def test_negatives_beyond_doubles(spark):
    rng = random.Random(3)
    rows = [(i * 10, [rng.choice([1e12, 1e13, -1e9, 0.3]) for _ in range(3)], i % 3) for i in range(60)]
    assert mined(spark, rows) == mined_of(rows)


def test_negatives_of_few_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(100, [1.0], 1)]) == [] and mined(spark, [(100, [1.0], 1), (1, [1.0], 2)]) == []


def test_buckets_are_left_out_by_norm():
    seen = []
    w = negatives._Windows([0], np.array([50.0]), np.array([90.0]), 2)
    w.meet = lambda *a: seen.append(a)
    anchor = {"x": np.array([[10.0, 0.0]]), "norm": np.array([10.0]), "ids": np.array([1]), "labels": np.array([0]), "keys": np.array([0]), "first": np.array([0]), "windows": w}
    row = collections.namedtuple("Row", "norm rows kind matrix ids labels ties")
    bucket = lambda norm: row(norm, 1, "<f8", np.array([[norm, 0.0]]).tobytes(), [2], [1], [0])
    negatives._bucket(anchor, bucket(4.0), False)
    assert not seen
    negatives._bucket(anchor, bucket(6.0), False)
    assert len(seen) == 1
    w.kth[0] = 80.0
    negatives._bucket(anchor, bucket(6.0), False)
    assert len(seen) == 1


def guessed(spark, rows, **how):
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    return langid.predictions(df, **how).collect()


def test_language_id_against_all_counts(spark, monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 7)  # every text in many pieces
    rng = random.Random(4)
    some = {"a": "the and ing Str. ", "b": "der und ß é1", "c": "αβγ Σος "}
    rows = [(i, "".join(rng.choice(some[k]) for _ in range(rng.randrange(40))), k) for i in range(40) for k in [rng.choice("abc")]]
    rows += [(None, "the", "a"), (50, None, "a"), (51, "12 !!", None), (52, "", "b"), (2, "the", None), (2, "the", None)]
    got = guessed(spark, rows)
    buckets = langid.size(3)

    def counts(t):
        out = collections.Counter()
        for held in langid.pieces([t]):
            for ids, _ in langid.grams(held, buckets):
                out.update(ids.tolist())
        return out

    plain = lambda t: re.sub(r"[^\w]+|[\d_]+", " ", f" {t} ").replace("  ", " ")
    monkeypatch.setattr(langid, "PIECE", 1 << 18)
    for _, t, _ in rows:
        if t:
            low = re.sub(" +", " ", plain(t.lower().replace("ς", "σ")))
            n = sum(max(len(low) - k + 1, 0) for k in range(1, 5)) - low.count(" ")
            assert sum(counts(t).values()) == n
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    learnt = collections.defaultdict(collections.Counter)
    docs = collections.Counter()
    for i, t, k in rows:
        if not held(i) and t is not None and k:
            learnt[k].update(counts(t))
            docs[k] += 1
    want = []
    for i, t, _ in rows:
        if not t or not re.search(r"[^\W\d_]", t):
            want.append((str(i), held(i), "und", 0.0))
            continue
        z = {k: math.log(docs[k] / docs.total()) + sum(n * math.log((learnt[k][g] + 0.5) / (learnt[k].total() + 0.5 * buckets)) for g, n in counts(t).items()) for k in sorted(docs)}
        best = max(z, key=z.get)
        want.append((str(i), held(i), best, round(1 / sum(math.exp(x - z[best]) for x in z.values()), 6)))
    assert sorted((str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 6)) for r in got) == sorted(want)


def test_language_id_held_out(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    got = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_language_id_of_odd_tables(spark):
    assert guessed(spark, []) == []
    assert [(r.lang_pred, r.score) for r in guessed(spark, [(1, "words", None)])] == [("und", 0.0)]
    got = guessed(spark, [(1, "the word " * 200_000, "x"), (3, "퟿" + chr(0x10FFFF), "y"), (4, "a", "z"), (5, "a", "q")])
    assert len(got) == 4 and {r.lang_pred for r in got if r.doc_id == 1} == {"x"} and all(0 <= r.score <= 1 for r in got)
    with pytest.raises(ValueError):
        langid.size(langid.CELLS + 1)
