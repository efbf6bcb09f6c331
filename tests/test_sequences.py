"""Leaders in range folds, sequence matching and aliases against loops over rows."""

import difflib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from docloom.operators import fusion, sequences


def test_a_chain_settles_in_few_rounds(spark, monkeypatch):
    rounds = []
    keep = fusion.written
    monkeypatch.setattr(fusion, "written", lambda df, name: rounds.append(name) or keep(df, name))
    n = 100_000
    got = {r.node for r in fusion.leaders(spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))).collect()}
    assert got == set(range(0, n, 2)) and rounds.count("settled") <= 30


@pytest.mark.parametrize("most", [2, 2_000_000])
def test_leaders_against_a_loop(spark, monkeypatch, most):
    monkeypatch.setattr(fusion, "RANGE_PAIRS", most if most > 2 else 40)
    rng = random.Random(most)
    edges = {tuple(sorted(rng.sample(range(150), 2))) for _ in range(400)} | {(200, 201), (201, 202)}
    lead = set()
    for n in sorted({x for e in edges for x in e}):
        if not any((a, n) in edges for a in lead):
            lead.add(n)
    rows = [(a, b) for a, b in edges] + [(7, 7), (9, 3)] * 2 + list(edges)[:5]
    assert {r.node for r in fusion.leaders(spark.createDataFrame(rows, "a long, b long")).collect()} == lead
    assert fusion.leaders(spark.createDataFrame([], "a long, b long")).count() == 0


def fold(t):
    t = "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").lower()
    return re.sub(" +", " ", re.sub("[^a-z0-9 ]", " ", t)).strip()


def varied(rng, words, n, edits):
    """Texts of the words, and copies of them with some characters changed."""
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            t = list(rng.choice(out))
            for _ in range(rng.randrange(edits)):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.randrange(2)] = rng.choice(["", rng.choice("abcé ")])
            out.append("".join(t))
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))))
    return out


WORDS = "the bidder must provide certified network engineers on two sites within four hours société".split()


@pytest.mark.parametrize("least", [0.8, 0.88])
def test_the_count_filter_loses_no_pair(spark, least):
    rng = random.Random(7)
    keys = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 8))) for _ in range(150)} | set(map(fold, varied(rng, WORDS, 120, 12))) - {""})
    got = {(r.a, r.b): (r.score, r.back) for r in sequences.alike(spark.createDataFrame(list(enumerate(keys)), "id long, key string"), least).collect()}
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    want = {(i, j): (ratio(x, y), ratio(y, x)) for i, x in enumerate(keys) for j, y in enumerate(keys) if i < j and max(ratio(x, y), ratio(y, x)) >= least}
    assert got == want and len(want) > 100


def test_longest_of_alike_against_a_loop(spark):
    rng = random.Random(8)
    rows = list(enumerate(varied(rng, WORDS, 150, 10))) + [(900, "!!"), (901, None), (902, ""), (903, "Two sites."), (904, "two SITES")]
    kept, want = [], {}
    for i, t in sorted(((i, t) for i, t in rows if t is not None), key=lambda x: (-len(x[1]), x[0])):
        if key := fold(t):
            near = next((k for k, other in kept if key == other or difflib.SequenceMatcher(None, key, other).ratio() >= sequences.SAME), None)
            want[i] = i if near is None else near
            kept += [(i, key)] if near is None else []
    got = {r.pos: r.leader for r in sequences.longest_of_alike(spark.createDataFrame(rows, "pos long, text string")).collect()}
    assert got == want and 20 < len(kept) < 140


def stripped(name):
    parts = name.split(" ")
    while len(parts) > 1 and parts[-1].strip(".") in sequences.LEGAL_ENDS:
        parts.pop()
    return " ".join(parts)


def test_aligned_against_a_loop(spark):
    rng = random.Random(9)
    names = {re.sub(" +", " ", t).strip() for t in varied(rng, ["acme", "global", "network", "bank", "union", "sa", "group", "inc."], 200, 4)} - {""}
    names |= {"group", "sa group", "acme sa group"}
    canonical, want = [], {}
    for name in sorted(names, key=lambda x: (len(x), x)):
        probe = stripped(name)
        near = difflib.get_close_matches(probe, canonical, n=5, cutoff=sequences.ALIGNED)
        want[name] = next((m for m in near if len(m.split()) == len(probe.split())), None) or probe
        canonical += [probe] if not any(len(m.split()) == len(probe.split()) for m in near) else []
    got = {r.name: r.aligned for r in sequences.aligned(spark.createDataFrame([(x,) for x in names] * 2 + [(None,)], "name string")).collect()}
    assert got == want and 30 < len(set(want.values())) < len(names)


def test_aliases_against_a_loop(spark):
    rng = random.Random(10)
    names = {" ".join(rng.choice(["acme", "global", "networks", "bank", "ab", "of", "union"]) for _ in range(rng.randrange(1, 4))): rng.randrange(1, 5) for _ in range(150)}
    lead, want = [], {}
    for name in sorted(names, key=lambda x: (-names[x], len(x), x)):
        toks = set(name.split())
        to = next((r for r in lead if (toks <= set(r.split()) or set(r.split()) <= toks) and any(len(w) >= 4 for w in toks & set(r.split()))), None)
        want[name] = to or name
        lead += [] if to else [name]
    got = {r.name: r.alias for r in sequences.aliases(spark.createDataFrame([*names.items(), (None, 1)], "name string, n long")).collect()}
    assert got == want and len(lead) > 5


def test_no_rows(spark):
    assert sequences.aliases(spark.createDataFrame([], "name string, n long")).count() == 0
    assert sequences.aligned(spark.createDataFrame([], "name string")).count() == 0
    assert sequences.longest_of_alike(spark.createDataFrame([], "pos long, text string")).count() == 0
