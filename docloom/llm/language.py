"""Language-model scoring: a log-bilinear neural model trained in numpy by noise-contrastive estimation.

Counts of tokens are taken over all training texts. The commonest tokens, more of them as the corpus grows, are classes; all others
are one class. The model scores a token by the product of its predecessor's and its own vectors plus a bias. NCE passes over all
neighbours of all training texts, in each partition by itself; the weights are then averaged, each row by how often it was
moved. Matrix products over all predecessors, dealt out in blocks, give the normalisers, so token
probabilities are exact. A token of the rest has the probability of its class times its share of the unigram mass there,
unseen tokens together counting as one. Texts end with one end token, which predicts itself nothing beyond. Nulls are empty.

Counts of about the TOP commonest tokens (a bound; ties at it are cut by hash) travel to all tasks; those of all others are joined
in hash buckets, one for each BUCKET_BYTES of text at least. A token is known by a 64-bit hash. Every row comes back once, also
repeated or without an id; a row without an id is learnt from, as its remainder is not 1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import words as W
from docloom.llm.shared import written

LEAST, RANK, TOP, END, BUCKET_BYTES = 8000, 24, 400_000, np.uint64(1), 16 << 20
BATCH, NOISE, RATE, BLOCK = 8192, 64, 0.1, 1024


def tokens(parts: list[bytes]):
    """Token hashes of texts in order, each text's end after its words, and their text numbers."""
    data, bounds = W.joined(parts)
    data = W.LOWER[data] if len(data) else data
    s, e, t = W.spans(data, bounds, W.WHITE == 0)
    h = W.hashes(data, s, e)
    text = np.concatenate([t, np.arange(len(parts))])
    o = np.argsort(text, kind="stable")
    return np.concatenate([h, np.full(len(parts), END)])[o], text[o]


def _classes(h: np.ndarray, top: np.ndarray) -> np.ndarray:
    """1.. for the commonest (sorted hashes), 0 for the rest."""
    if not len(top):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(top, h), len(top) - 1)
    return np.where(top[at] == h, at + 1, 0)


def _neighbours(h: np.ndarray, t: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of tokens and of their predecessors; the class after the last is a text's start."""
    c = _classes(h, top)
    before = np.concatenate([[len(top) + 1], c[:-1]])[: len(c)]
    before[np.concatenate([[True], t[1:] != t[:-1]])[: len(c)]] = len(top) + 1
    return c, before


def level(n: np.ndarray) -> np.ndarray:
    """Counts in order, by themselves up to 2^20 and in steps of a thousandth beyond, so that there are few levels at any size."""
    high = (1 << 20) + (np.log2(np.maximum(n, 1) / float(1 << 20)) * 1024).astype(np.int64)
    return np.where(n < 1 << 20, n, high)


def cut(levels: list[tuple[int, int]], most: int) -> tuple[int, int, int]:
    """(least, tied, below): of (level, tokens) from the highest, levels from least on are in whole, and of the level tied those
    tokens whose hash is under `below`, so that about `most` tokens are in."""
    least, seen = 1 << 62, 0
    for at, m in levels:
        if seen + m > most:
            return least, at, int((1 << 64) * ((most - seen) / m))
        least, seen = at, seen + m
    return least, -1, 0


def classes(total: int) -> int:
    """Tokens that the model knows by themselves: as their square grows with the corpus, so do the normalisers' steps."""
    return max(LEAST, int(4 * total**0.5))


def _summed(at: np.ndarray, g: np.ndarray):
    """Distinct rows in at, and the sums of their gradients."""
    o = np.argsort(at, kind="stable")
    u, first = np.unique(at[o], return_index=True)
    return u, np.add.reduceat(g[o], first, axis=0)


def start(n: np.ndarray, seed: int = 5) -> dict:
    """The model before training, from the counts of the classes; row K of c is a text's start."""
    k, rng = len(n), np.random.default_rng(seed)
    draw = lambda rows: rng.normal(0, 0.1, (rows, RANK)).astype(np.float32)
    return {"c": draw(k + 1), "r": draw(k), "b": np.log((n + 0.5) / (n.sum() + 0.5 * k)).astype(np.float32)}


def train(m: dict, chunks, passes: int = 1, seed: int = 5):
    """NCE over every neighbour (arrays of predecessors and tokens); changes m, and gives how often each row of c and r was moved."""
    k, rng = len(m["b"]), np.random.default_rng(seed)
    unigram = np.exp(m["b"].astype(float))
    logq, cumq = m["b"] + np.float32(np.log(NOISE)), np.cumsum(unigram / unigram.sum())
    g2 = {x: np.ones_like(v) for x, v in m.items()}
    moved = {"c": np.zeros(k + 1), "r": np.zeros(k)}

    def move(name, at, g):
        at, g = _summed(at, g)
        g2[name][at] += g**2
        m[name][at] -= np.float32(RATE) * g / np.sqrt(g2[name][at])

    def run(ctxs, toks):
        o = rng.permutation(len(toks))
        for a in range(0, len(o), BATCH):
            ctx, tok = ctxs[o[a : a + BATCH]], toks[o[a : a + BATCH]]
            neg = np.minimum(np.searchsorted(cumq, rng.random(NOISE)), k - 1)
            c, r, rn = m["c"][ctx], m["r"][tok], m["r"][neg]
            pos = 1 / (1 + np.exp(np.clip((c * r).sum(1) + m["b"][tok] - logq[tok], -30, 30)))
            bad = 1 / (1 + np.exp(-np.clip(c @ rn.T + (m["b"][neg] - logq[neg]), -30, 30)))
            move("c", ctx, bad @ rn - pos[:, None] * r)
            move("r", np.concatenate([tok, neg]), np.concatenate([-pos[:, None] * c, bad.T @ c]))
            move("b", np.concatenate([tok, neg]), np.concatenate([-pos, bad.sum(0)]))
            moved["c"] += np.bincount(ctx, minlength=k + 1)
            moved["r"] += np.bincount(tok, minlength=k) + np.bincount(neg, minlength=k) * (len(tok) / NOISE)

    again = []
    for x in chunks:
        run(*x)
        again += [x] if passes > 1 else []
    for _ in range(passes - 1):
        for x in again:
            run(*x)
    return moved


def normalisers(m: dict, c: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over all tokens for rows of predecessors."""
    out = np.empty(len(c), np.float32)
    for a in range(0, len(c), 256):
        part = [c[a : a + 256] @ m["r"][i : i + 8192].T + m["b"][i : i + 8192] for i in range(0, len(m["b"]), 8192)]
        peak = np.max([x.max(1) for x in part], axis=0)
        out[a : a + 256] = peak + np.log(sum(np.exp(x - peak[:, None]).sum(1) for x in part))
    return out


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    from pyspark import TaskContext

    spark = docs.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(4 * shuffles, size // BUCKET_BYTES)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False)).alias("held_out"))
    learn = base.where("not held_out").select("text")

    def count(batches):
        have, size = [], 0

        def flush():
            h = np.concatenate(have)
            u, n = np.unique(h, return_counts=True)
            b = (u % np.uint64(buckets)).astype(np.int64)
            o = np.argsort(b, kind="stable")
            cuts = np.searchsorted(b[o], np.arange(buckets + 1))
            return pd.DataFrame([(k, u[i].tobytes(), n[i].astype(np.int64).tobytes()) for k in np.flatnonzero(np.diff(cuts)).tolist() for i in [o[cuts[k] : cuts[k + 1]]]], columns=["b", "h", "n"])

        for pdf in batches:
            for _, p in W.slices(pdf["text"].tolist()):
                have.append(tokens(p)[0])
                size += len(have[-1])
                if size > 2_000_000:
                    yield flush()
                    have, size = [], 0
        if have:
            yield flush()

    def add(pdf):
        h, n = (np.concatenate([np.frombuffer(x, k) for x in pdf[c]]) for c, k in (("h", "u8"), ("n", "i8")))
        u, at = np.unique(h, return_inverse=True)
        c = np.zeros(len(u), np.int64)
        np.add.at(c, at, n)
        at, many = np.unique(level(c), return_counts=True)
        return pd.DataFrame({"b": pdf["b"].iloc[:1], "h": [u.tobytes()], "n": [c.tobytes()], "size": [len(u)], "total": [int(c.sum())], "at": [at.tolist()], "many": [many.tolist()]})

    kind = "b long, h binary, n binary"
    table = written(learn.mapInPandas(count, kind).groupBy("b").applyInPandas(add, kind + ", size long, total long, at array<long>, many array<long>"), "counts")
    v, total = table.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    hist = table.select(F.explode(F.arrays_zip("at", "many")).alias("x")).groupBy("x.at").agg(F.sum("x.many").alias("m")).orderBy(F.desc("at")).limit(TOP).collect()
    least, tied, below = cut([(r.at, r.m) for r in hist], TOP)

    def common(batches):
        for pdf in batches:
            for h, n in zip(pdf["h"], pdf["n"]):
                h, n = np.frombuffer(h, "u8"), np.frombuffer(n, "i8")
                of = level(n)
                i = (of >= least) | ((of == tied) & (W.mix(h) < np.uint64(min(below, (1 << 64) - 1))))
                yield pd.DataFrame({"h": [h[i].tobytes()], "n": [n[i].tobytes()]})

    got = table.select("h", "n").mapInPandas(common, "h binary, n binary").collect()
    th, tn = (np.concatenate([np.frombuffer(r[c], k) for r in got] or [np.zeros(0, k)]) for c, k in ((0, "u8"), (1, "i8")))
    o = np.argsort(th)
    th, tn = th[o], tn[o]
    best = np.sort(np.lexsort([th, -tn])[: classes(total)])
    top, k = th[best], len(best) + 1
    m = start(np.concatenate([[max(total - tn[best].sum(), 0)], tn[best]]))
    passes = int(np.clip(-(-2_000_000 // max(total, 1)), 1, 20))
    given = spark.sparkContext.broadcast((top, m))

    def fit(batches):
        """Neighbours of a partition's texts, all of them; sums of moved rows in blocks, weighted by how often each was moved."""
        top, begun = given.value
        m = {x: y.copy() for x, y in begun.items()}

        def chunks():
            for pdf in batches:
                for _, p in W.slices(pdf["text"].tolist()):
                    c, before = _neighbours(*tokens(p), top)
                    yield before, c

        moved = train(m, chunks(), passes)
        for name, w, x in (("c", moved["c"], m["c"] - begun["c"]), ("r", moved["r"], np.column_stack([m["r"] - begun["r"], m["b"] - begun["b"]]))):
            at = np.flatnonzero(w)
            for q in np.unique(at // BLOCK).tolist():
                i = at[at // BLOCK == q]
                yield pd.DataFrame({"name": [name], "q": [q], "at": [i.astype("i8").tobytes()], "w": [w[i].tobytes()], "x": [x[i].astype("f4").tobytes()]})

    def merge(pdf):
        width = RANK + (pdf["name"].iloc[0] == "r")
        base = int(pdf["q"].iloc[0]) * BLOCK
        w, x = np.zeros(BLOCK), np.zeros((BLOCK, width))
        for a, b, y in zip(pdf["at"], pdf["w"], pdf["x"]):
            i, n = np.frombuffer(a, "i8") - base, np.frombuffer(b)
            w[i] += n
            x[i] += n[:, None] * np.frombuffer(y, "f4").reshape(-1, width)
        i = np.flatnonzero(w)
        return pdf[["name", "q"]].iloc[:1].assign(at=[(i + base).astype("i8").tobytes()], w=[b""], x=[(x[i] / w[i, None]).astype("f4").tobytes()])

    rows = "name string, q long, at binary, w binary, x binary"
    for r in learn.mapInPandas(fit, rows).groupBy("name", "q").applyInPandas(merge, rows).collect():
        at = np.frombuffer(r.at, "i8")
        x = np.frombuffer(r.x, "f4").reshape(len(at), -1)
        m[r.name][at] += x[:, :RANK]
        if r.name == "r":
            m["b"][at] += x[:, RANK]
    fitted = spark.sparkContext.broadcast(m)

    def norm(batches):
        for pdf in batches:
            for q in pdf["id"].tolist():
                yield pd.DataFrame({"q": [q], "z": [normalisers(fitted.value, fitted.value["c"][q * BLOCK : (q + 1) * BLOCK]).tobytes()]})

    n = -(-(k + 1) // BLOCK)
    m["z"] = np.concatenate([np.frombuffer(r.z, "f4") for r in sorted(spark.range(0, n, 1, min(n, 4 * shuffles)).mapInPandas(norm, "q long, z binary").collect(), key=lambda r: r.q)])
    lb = np.log10(total + 0.5 * (v + 1))
    rest = np.log10(max(total + 0.5 * (v + 1) - (tn[best] + 0.5).sum(), 0.5))
    sent = spark.sparkContext.broadcast((th, tn, top, m))

    def score(batches):
        th, tn, top, m = sent.value
        key = TaskContext.get().partitionId() << 40  # a row's own number: one attempt of a task writes all of its rows
        for pdf in batches:
            ids, rows = np.arange(key, key + len(pdf)), []
            key += len(pdf)
            given = pdf["doc_id"].tolist()
            for first, p in W.slices(pdf["text"].tolist()):
                h, t = tokens(p)
                n = len(p)
                c, before = _neighbours(h, t, top)
                lp = np.concatenate([((m["c"][before[a : a + 100_000]] * m["r"][c[a : a + 100_000]]).sum(1) + m["b"][c[a : a + 100_000]] - m["z"][before[a : a + 100_000]]).astype(float) for a in range(0, len(c), 100_000)]) / np.log(10)
                at = np.minimum(np.searchsorted(th, h), max(len(th) - 1, 0))
                known = th[at] == h if len(th) else np.zeros(len(h), bool)
                lc = np.where(known, np.log10((tn[at] if len(th) else np.zeros(len(h))) + 0.5), 0.0)
                basis, full = np.bincount(t, lc - lb, n), np.bincount(t, lp + np.where(c == 0, lc - rest, 0), n)
                yes, many = np.bincount(t, known, n).astype(np.int64), np.bincount(t, minlength=n)
                rows += [(k, i, a, b, x, y, -1, b"", b"") for k, i, a, b, x, y in zip(ids[first : first + n].tolist(), given[first : first + n], many.tolist(), yes.tolist(), basis.tolist(), full.tolist())]
                rh, rt = h[~known], t[~known]
                b = (rh % np.uint64(buckets)).astype(np.int64)
                o = np.argsort(b, kind="stable")
                cuts = np.searchsorted(b[o], np.arange(buckets + 1))
                for q in np.flatnonzero(np.diff(cuts)).tolist():
                    i = o[cuts[q] : cuts[q + 1]]
                    rows.append((None, None, 0, 0, 0.0, 0.0, q, rh[i].tobytes(), ids[first + rt[i]].astype(np.int64).tobytes()))
            yield pd.DataFrame(rows, columns=["key", "doc_id", "n_tokens", "n_known", "base", "full", "b", "h", "ids"]).astype({"key": "Int64"})

    first = base.select(F.col("doc_id").cast("string"), "text").mapInPandas(score, "key long, doc_id string, n_tokens long, n_known long, base double, full double, b long, h binary, ids binary")
    first = written(first, "scores")

    def rare(_, left, right):
        if not len(left):
            return pd.DataFrame({"key": [], "n_tokens": [], "n_known": [], "base": [], "full": []})
        h, i = (np.concatenate([np.frombuffer(x, q) for x in left[c]]) for c, q in (("h", "u8"), ("ids", "i8")))
        u = np.concatenate([np.frombuffer(x, "u8") for x in right["h"]] or [np.zeros(0, "u8")])
        n = np.concatenate([np.frombuffer(x, "i8") for x in right["n"]] or [np.zeros(0, "i8")])
        at = np.minimum(np.searchsorted(u, h), max(len(u) - 1, 0))
        c = np.where(u[at] == h, n[at], 0) if len(u) else np.zeros(len(h), np.int64)
        x = pd.DataFrame({"key": i, "n_tokens": 0, "n_known": (c > 0).astype(np.int64), "base": np.log10(c + 0.5)})
        return x.assign(full=x["base"]).groupby("key", as_index=False).sum()[["key", "n_tokens", "n_known", "base", "full"]]

    wide = "key long, n_tokens long, n_known long, base double, full double"
    more = first.where("b >= 0").select("b", "h", "ids").groupBy("b").cogroup(table.select("b", "h", "n").groupBy("b")).applyInPandas(lambda key, a, b: rare(key, a, b), wide)
    out = first.where("b < 0").select("key", "doc_id", "n_tokens", "n_known", "base", "full").unionByName(more, allowMissingColumns=True)
    out = out.groupBy("key").agg(F.max("doc_id").cast("long").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "full")))
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("full").alias("score"))
