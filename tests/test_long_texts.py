"""Chunks of one text of ten million characters, against loops, in time that grows with the text."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from docloom.operators import chunks

RULES = {"pieces": lambda t: chunks.split_pieces(t, 552, 110), "sentences": chunks.sentences, "fixed": chunks.fixed}


def loop_sentences(text):
    parts = [p for p in (x.strip() for x in re.split(r"(?<=[.!?…])\s+", re.sub(r"[ \t]+", " ", text))) if p]
    out = []
    for p in parts:
        if out:
            word = re.search(r"([^\s(]*)$", re.sub(r"\.+$", "", out[-1][-1]))[1].lower()
            size = sum(map(len, out[-1])) + len(out[-1]) - 1
            if word in chunks.ABBREVIATIONS or re.fullmatch("[a-z]", word) or (size < 25 and out[-1][-1][-1] not in ":?!"):
                out[-1].append(p)
                continue
        out.append([p])
    return [" ".join(x) for x in out]


def loop_fixed(sentences):
    groups = []
    for s in sentences:
        if groups and len(" ".join(groups[-1])) + len(s) + 2 <= chunks.TARGET:
            groups[-1].append(s)
        else:
            groups.append([s])
    merged = []
    for g in groups:
        if merged and len(" ".join(g)) < chunks.LEAST:
            merged[-1] += g
        else:
            merged.append(g)
    if len(merged) > 1 and len(" ".join(merged[0])) < chunks.LEAST:
        merged[:2] = [merged[0] + merged[1]]
    return [" ".join(([merged[i - 1][-1]] if i and len(merged[i - 1][-1]) <= chunks.OVERLAP else []) + g) for i, g in enumerate(merged)]


def loop_pieces(t, size, overlap):
    out, at, zone = [], 0, size // 4
    while at < len(t):
        end = min(len(t), at + size)
        if end < len(t):
            last = t[end - zone : end]
            found = next((k for k in (last.rfind(m) + len(m) if m in last else 0 for m in ("\n\n", "\n", ". ", " ")) if k), None)
            end = end - zone + found if found else end
        piece = t[at:end].strip()
        out += [piece] if piece else []
        at = len(t) if end >= len(t) else max(at + 1, end - overlap)
    return out


@pytest.fixture(scope="module")
def base():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghié") for _ in range(rng.randrange(1, 9)))
    return " ".join(" ".join(word() for _ in range(rng.randrange(3, 20))) + rng.choice([".", "!", "?", ". A.", ". etc.", ".\n\n"]) for _ in range(12_000))


def test_ten_million_characters(spark, base):
    text = (" ".join([base] * 14)).strip()
    assert len(text) > 10_000_000
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(*(f(F.col("t")).alias(k) for k, f in RULES.items())).first()
    want = loop_sentences(text)
    assert got["sentences"] == want and len(want) > 100_000
    assert [g.body for g in got["fixed"]] == loop_fixed(want)
    assert got["pieces"] == loop_pieces(text, 552, 110)


def test_a_chain_of_initials(spark):
    text = "A. " * 300_000
    (got,) = spark.createDataFrame([(text,)], "t string").select(chunks.sentences(F.col("t"))).first()
    assert got == [text.strip()]


def test_twice_the_text_takes_twice_the_time(spark, base):
    took = {}
    for n in (3, 6, 12):  # the first is for warming up
        df = spark.createDataFrame([(" ".join([base] * n),)], "t string").cache()
        df.count()
        for k, f in RULES.items():
            start = time.time()
            df.select(F.size(f(F.col("t"))).alias("n")).collect()
            took[k, n] = time.time() - start
    for k in RULES:
        assert took[k, 12] < 2.2 * took[k, 6] + 1, (k, took)
