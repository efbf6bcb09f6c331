"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is one or several words of 8 positional bytes. Two words that differ in at most 3 bits share at least 5 of their 8
bytes, the guaranteed minimum. Any pair that shares `shared` bytes of a word shares its first `lead` of them, so a fingerprint is
posted under the values of every such choice of `lead` positions (10 postings for 5 shared and 2 leading bytes), and each list is
refined by the values at every choice of later positions until `shared` equal bytes are counted. Pairs that reach the count are
verified by their differing bits. A list of any length gives a spanning forest of its links, found by growing trees: each member
is compared only with those that no tree holds yet, so a group of copies costs about its length, not its square.

Nulls and empty texts have fingerprint zero. A row without an id gets its component like any other and is never its smallest id;
where all rows of one have none, it is null. Repeated rows come back each.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import words as W
from docloom.llm.shared import components, forest, written

BITS, SHARED, LEAD, SHORT, TASK_ROWS = 3, 5, 2, 64, 1_000_000
_SALTS = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1) for k in range(16)]


def fingerprints(texts: list, shingle: int = 3) -> np.ndarray:
    """The unsigned fingerprints of whole texts by XXH64 with seed 42."""
    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, t in enumerate(texts):
        w = (t or "").encode().translate(lower).split()
        if w:
            grams = [b" ".join(w)] if len(w) < shingle else [b" ".join(x) for x in zip(*(w[k:] for k in range(shingle)))]
            out[i] = _majority([np.array([digest(g, 42) for g in grams], "<u8")])[0]
    return out


def _majority(hashes: list[np.ndarray]) -> np.ndarray:
    """A word for each array of hashes: the bits set in over half of them."""
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    out = np.zeros(len(hashes), np.uint64)
    for k, h in enumerate(hashes):
        total = np.zeros(64, np.int64)
        for s in range(0, len(h), 20000):
            total += np.unpackbits(h[s : s + 20000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = weights[total * 2 > len(h)].sum(dtype=np.uint64)
    return out


def long_fingerprints(texts: list, shingle: int = 5, words: int = 4) -> np.ndarray:
    """Fingerprints of `words` words each, from rolling hashes of the lower-cased texts' shingles."""
    out = np.zeros((len(texts), words), np.uint64)
    for first, parts in W.slices(texts):
        data, bounds = W.joined(parts)
        data = W.LOWER[data]
        s, e, t = W.spans(data, bounds, W.WHITE == 0)
        h = W.hashes(data, s, e)
        edge = np.searchsorted(t, np.arange(len(parts) + 1))
        grams = W.rolling(h, shingle)
        for k in range(len(parts)):
            a, b = int(edge[k]), int(edge[k + 1])
            if b > a:
                own = grams[a : b - shingle + 1] if b - a >= shingle else W.rolling(h[a:b], b - a)
                out[first + k] = _majority([W.mix(own ^ x) for x in _SALTS[:words]])
    return out


def _tree(f: np.ndarray, most: int):
    """A spanning forest of the links within one list, by growing trees."""
    left, queue, out = np.arange(1, len(f)), np.zeros(1, np.int64), []
    while len(left):
        if not len(queue):
            queue, left = left[:1], left[1:]
            continue
        n = max(1, 1_000_000 // (len(left) * f.shape[1] + 1))
        some, queue = queue[:n], queue[n:]
        near = np.bitwise_count(f[some][:, None] ^ f[left][None]).sum(2) <= most
        hit = near.any(0)
        out.append(np.stack([left[hit], some[near[:, hit].argmax(0)]]))
        queue, left = np.concatenate([queue, left[hit]]), left[~hit]
    return np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)


def _links(f: np.ndarray, key: np.ndarray, most: int):
    """Links among rows of one key: short lists compare all, long ones grow trees."""
    o = np.argsort(key, kind="stable")
    k = key[o]
    run = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff([*run, len(k)])
    short = np.repeat(size <= SHORT, size)
    out = [np.zeros((2, 0), np.int64)]
    for d in range(1, SHORT):
        i = np.flatnonzero((k[d:] == k[:-d]) & short[:-d])
        if not len(i):
            break
        i = i[np.bitwise_count(f[o[i]] ^ f[o[i + d]]).sum(1) <= most]
        out.append(np.stack([o[i], o[i + d]]))
    for a, n in zip(run[size > SHORT].tolist(), size[size > SHORT].tolist()):
        out.append(o[a : a + n][_tree(f[o[a : a + n]], most)])
    return np.concatenate(out, 1)


def _choices(shared: int, lead: int) -> list[tuple]:
    """The leading positions of any `shared` of a word's 8."""
    return [c for c in combinations(range(8), lead) if c[-1] <= 7 - (shared - lead)]


def _refined(names: np.ndarray, group: np.ndarray, f: np.ndarray, shared: int, lead: int, most: int):
    """Links among postings (list name, number of the list, fingerprint) that share `shared` bytes of a word."""
    b = np.ascontiguousarray(f.astype(">u8")).view(np.uint8).reshape(len(f), 8 * f.shape[1])
    choices, out = _choices(shared, lead), [np.zeros((2, 0), np.int64)]
    for name in np.unique(names).tolist():
        word, first = divmod(name, len(choices))
        at = np.flatnonzero(names == name)
        for rest in combinations(range(choices[first][-1] + 1, 8), shared - lead):
            key = group[at].astype(np.int64)
            for p in rest:
                key = key << 8 | b[at, 8 * word + p]
            out.append(at[_links(f[at], key, most)])
        x, y = forest(*np.concatenate(out, 1), len(f))
        out = [np.stack([x, y])]
    return out[0]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, words: int = 1, most: int = BITS, shared: int = SHARED, lead: int = LEAD) -> DataFrame:
    """(doc_id, fingerprint, component_id, text_hash) for every row; equal fingerprints link; ids are compared as longs.

    One word is XXH64's; several words are those of long_fingerprints, and `most` counts the differing bits of all of them.
    """
    spark = docs.sparkSession

    def score(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            f = fingerprints(texts, shingle)[:, None] if words == 1 else long_fingerprints(texts, shingle, words)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in f.astype(">u8")], pa.binary()), b.column(2)], names=["doc_id", "f", "text_hash"])

    base = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("x"))
    fps = written(base.mapInArrow(score, "doc_id long, f binary, text_hash long"), "fps")
    one = written(fps.groupBy("f").agg(F.min("doc_id").alias("low")).withColumn("c", F.monotonically_increasing_id()), "classes")
    keys = []
    for n, (w, c) in enumerate((w, c) for w in range(words) for c in _choices(shared, lead)):
        keys.append(F.concat(F.lit(bytearray([n])), *(F.substring("f", 8 * w + p + 1, 1) for p in c)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), one.count() * len(keys) // TASK_ROWS)
    lists = one.repartition(parts).select(F.explode(F.array(*keys)).alias("k"), "c", "f").repartition(parts, "k").sortWithinPartitions("k")

    def edges(batches):
        have, last, rows = [], None, 0

        def flush(pdf):
            k = pdf["k"].to_numpy()
            number = np.cumsum(np.concatenate([[False], k[1:] != k[:-1]]))
            lone = np.bincount(number)[number] > 1
            pdf, number = pdf[lone], number[lone]
            f = np.frombuffer(b"".join(pdf["f"]), ">u8").astype(np.uint64).reshape(-1, words)
            x, y = _refined(np.array([v[0] for v in pdf["k"]], np.int64), number, f, shared, lead, most)
            c = pdf["c"].to_numpy()
            return pd.DataFrame({"a": c[x], "b": c[y]})

        for pdf in batches:
            k = pdf["k"].to_numpy()
            if rows > 50_000 and k[0] != last:
                yield flush(pd.concat(have, ignore_index=True))
                have, rows = [], 0
            elif rows > 50_000 and (other := np.flatnonzero(k != last)).size:
                yield flush(pd.concat([*have, pdf.iloc[: other[0]]], ignore_index=True))
                have, rows, pdf = [], 0, pdf.iloc[other[0] :]
            have.append(pdf)
            rows += len(pdf)
            last = k[-1]
        if have:
            yield flush(pd.concat(have, ignore_index=True))

    trees = components(lists.mapInPandas(edges, "a long, b long"))
    named = one.join(trees.withColumnRenamed("node", "c"), "c", "left").withColumn("part", F.coalesce("component", "c"))
    low = named.groupBy("part").agg(F.min("low").alias("component_id"))
    label = named.join(low, "part").select("f", "part", "component_id")
    return fps.join(label, "f").select("doc_id", F.lower(F.hex("f")).alias("fingerprint"), "component_id", "text_hash", "part")


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """One row of docs for each component: that of the smallest id (rows without id come last), then of the smallest text hash.

    Rows that repeat an id with a text of another component stay beside it; of rows with one id and text the least stays.
    """
    found = written(near_duplicates(docs, **settings).groupBy("part", "doc_id", "text_hash").agg(F.count("*").alias("n")), "members")
    best = found.groupBy("part").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_hash")).alias("best"))
    rows = found.join(best, "part").select("doc_id", "text_hash", "n", (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))).alias("stays"))
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("x"))
    same = lambda t: named["i"].eqNullSafe(t["doc_id"]) & (named["x"] == t["text_hash"])
    off, many = rows.where("not stays or n > 1"), rows.where("stays and n > 1")
    once = named.join(off, same(off), "left_anti").select("row")
    again = named.join(many, same(many), "left_semi").groupBy("i", "x").agg(F.min("row").alias("row")).select("row")
    return once.unionAll(again).select("row.*")
