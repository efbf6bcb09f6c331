import hashlib
import random
import re
from pathlib import Path

import psutil
import pytest

from docloom.llm import repeats


def brute(rows, n=13):
    """(id, n_words, n_removed, hash) of every row, sorted."""
    rows = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in rows:
        for k in range(len(w) - n + 1):
            if i is not None:
                first[tuple(w[k : k + n])] = min(first.get(tuple(w[k : k + n]), i), i)
    out = []
    for i, w in rows:
        gone = set()
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone |= set(range(k, k + n))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in repeats.removed(df).collect()), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("a bé c d e f".split()) + str(rng.randrange(40))
    passages = [[word() for _ in range(rng.randrange(10, 60))] for _ in range(12)]
    rows = [(0, None), (1, ""), (2, " \n "), (3, "x " * 40)]
    for i in range(4, 120):
        w = [word() for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(0, 8)
            w[rng.randrange(0, len(w) + 1) : 0] = p[a:]
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[10][1]) for i in range(5)]
    df = spark.createDataFrame([(i, t, "kept") for i, t in rows], "doc_id long, text string, kept string")
    assert found(df) == brute(rows)


@pytest.mark.parametrize("size", [200, repeats.GROUP_BYTES])
def test_repeated_and_missing_ids(spark, monkeypatch, size):
    monkeypatch.setattr(repeats, "GROUP_BYTES", size)
    rng = random.Random(4)
    passages = [[f"p{k}_{j}" for j in range(30)] for k in range(6)]
    rows = [(2, " ".join(passages[0] + passages[1] + ["x"] * 10)), (2, "short"), (2, " ".join(["y"] * 20 + passages[1])), (2, None)]
    for i in range(120):
        w = [f"n{rng.randrange(9999)}" for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 3)):
            w += rng.choice(passages)[rng.randrange(0, 10) :]
        rows.append((rng.choice([None, *range(1, 40)]), " ".join(w)))
    rows += rows[3:30]
    assert found(spark.createDataFrame([(*r, 0, "g") for r in rows], "doc_id long, text string, n_words int, g string")) == brute(rows)


def test_empty_table(spark):
    assert repeats.removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hits_go_to_few_files(spark, monkeypatch):
    paths, written = [], repeats.written

    def kept(df, name):
        out = written(df, name)
        paths.append(out.inputFiles())
        return out

    monkeypatch.setattr(repeats, "written", kept)
    conf = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = [(i, " ".join(f"w{i % 50}_{j}" for j in range(30))) for i in range(150)]
        assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [0 < len(x) <= 4 for x in paths] == [True, True]


def test_hashes_in_pieces(monkeypatch):
    text = " ".join(["wörd", "x" * 50, "y", "a b  c", "z" * 9] * 20).encode()
    data, s, e, _ = repeats._tokens([text, b"", b"end"])
    monkeypatch.setattr(repeats, "PIECE", 16)
    for table in (0, 1):
        assert repeats._hashes(data, s, e, table).tolist() == repeats.W.digests(data, s, e, table).tolist()
    assert len(repeats._hashes(*repeats._tokens([b" "])[:3])) == len(repeats._hashes(*repeats._tokens([b""])[:3])) == 0


def workers(what):
    """MB of each Python worker by a line of its status."""
    for p in psutil.Process().children(recursive=True):
        if "pyspark.daemon" in " ".join(p.cmdline()):
            yield int(re.search(rf"{what}:\s+(\d+)", Path(f"/proc/{p.pid}/status").read_text())[1]) >> 10


def test_workers_hold_little_beside_a_long_text(spark):
    """16 MB of text: hashing it at once took eight bytes a byte of it, five times over, and the workers kept much of that."""
    rng = random.Random(5)
    long = [f"{rng.getrandbits(240):060x}" for _ in range(260_000)]
    rows = [(1, " ".join(long)), (2, " ".join(["a"] * 20 + long[1000:1040] + ["b"] * 5)), (3, " ".join(long[-13:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    df.mapInPandas(lambda it: it, df.schema).count()
    for p in psutil.Process().children(recursive=True):
        if "pyspark.daemon" in " ".join(p.cmdline()):
            Path(f"/proc/{p.pid}/clear_refs").write_text("5")  # the peak starts anew
    assert [r[2] for r in found(df)] == [0, 40, 13]
    assert max(workers("VmHWM")) < 400
    assert max(workers("RssAnon")) < 250
