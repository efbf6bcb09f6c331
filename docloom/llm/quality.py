"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata of the text itself.

score = sigmoid(w0 + x.w + 1/2 sum_f ((x.V)_f^2 - (x^2).(V^2)_f)), linear in the number of features. Structure statistics are
shares of kinds of characters, distinct and repeated words and line ends; metadata are the numbers of words and of bytes a word.
It is fitted on at most `sample` labelled documents, taken by a hash of the id; null labels are left out, null texts are empty.
Of several labels of one id the highest counts; of several texts of one id the least in order is learnt from. Without labels:
0.5. Rows without an id are scored like any other and held out from learning; repeated rows are scored each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import words as W
from docloom.llm.shared import with_texts

DIM, RANK, SAMPLE = 1024, 6, 6000
_UPPER, _DIGIT, _ALPHA, _MARK = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True
_MARK[[33, 35, 36, 37, 38, 42, 124]] = True
N_STATS = 12


def features(texts: list) -> np.ndarray:
    out = []
    for _, parts in W.slices(texts):
        data, bounds = W.joined(parts)
        s, e, t = W.spans(data, bounds, W.WHITE == 0)
        h = W.hashes(data, s, e)
        n, size = len(parts), np.maximum(np.diff(bounds), 1)
        words = np.maximum(np.bincount(t, minlength=n), 1)
        x = np.bincount(t * DIM + (h % np.uint64(DIM)).astype(np.int64), minlength=n * DIM).reshape(n, DIM).astype(np.float32)
        x = np.log1p(x)
        x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)

        def share(mask, bounds=bounds, data=data, size=size):
            c = np.concatenate([[0], np.cumsum(mask[data])])
            return (c[bounds[1:]] - c[bounds[:-1]]) / size

        key = np.sort((t.astype(np.uint64) << np.uint64(40)) ^ (h >> np.uint64(24)))
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n)[:n] / words
        again = np.bincount(t[1:][(h[1:] == h[:-1]) & (t[1:] == t[:-1])], minlength=n) / words
        line = np.zeros(256, bool)
        line[10] = True
        ends = np.bincount(t, weights=_MARK[data[e - 1]], minlength=n) / words if len(e) else np.zeros(n)
        length = np.bincount(t, weights=e - s, minlength=n) / words
        stats = [share(_UPPER), share(_DIGIT), share(_ALPHA), share(_MARK) * 3, distinct, again, ends, np.minimum(length / 10, 3), np.log1p(words) / 8, np.minimum(share(line) * 20, 2), (distinct < 0.3) * 1.0, (ends > 0.3) * 1.0]
        out.append(np.hstack([x, np.stack(stats, 1).astype(np.float32)]))
    return np.vstack(out) if out else np.zeros((0, DIM + N_STATS), np.float32)


def machine(x: np.ndarray, m: dict) -> np.ndarray:
    z = m["w0"] + x @ m["w"] + 0.5 * (((x @ m["v"]) ** 2) - (x * x) @ (m["v"] ** 2)).sum(1)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 0.05) -> dict:
    """AdaGrad on the log loss."""
    rng = np.random.default_rng(7)
    d = x.shape[1]
    m = {"w0": np.zeros(1), "w": np.zeros(d, np.float32), "v": rng.normal(0, 0.05, (d, RANK)).astype(np.float32)}
    g2 = {k: np.full_like(v, 1e-6) for k, v in m.items()}
    for _ in range(epochs if len(x) else 0):
        for b in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            xb = x[b]
            err = ((machine(xb, m) - y[b]) / len(b)).astype(np.float32)
            xv = xb @ m["v"]
            g = {"w0": err.sum(keepdims=True), "w": xb.T @ err + 1e-5 * m["w"], "v": xb.T @ (xv * err[:, None]) - m["v"] * ((xb * xb).T @ err)[:, None] + 1e-4 * m["v"]}
            for k in m:
                g2[k] += g[k] ** 2
                m[k] = m[k] - rate * g[k] / np.sqrt(g2[k])
    return m


def _held():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The machine fitted to docs joined to labels that are not held out."""
    held = _held()
    picked = labels.where(F.col("quality").isin(0, 1) & ~held).groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def numbers(batches):
        for pdf in batches:
            yield pd.DataFrame({"x": [r.tobytes() for r in features(pdf["text"].tolist()).astype(np.float16)], "y": pdf["quality"]})

    # one text of an id: what is collected is bounded by the sample
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = texts.select("text", "quality").mapInPandas(numbers, "x binary, y int").collect()
    x = np.array([np.frombuffer(r.x, np.float16) for r in rows], np.float32).reshape(-1, DIM + N_STATS)
    return fit(x, np.array([r.y for r in rows], np.float32))


def _scored(texts: list, model: dict) -> np.ndarray:
    return np.concatenate([machine(features(texts[k : k + 500]), model) for k in range(0, max(len(texts), 1), 500)]).astype(float)


def scores(docs: DataFrame, labels: DataFrame, source: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of docs; learns from `source` (docs)."""
    model = learned(source if source is not None else docs, labels, sample)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": _scored(pdf["text"].tolist(), model)})

    out = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, "doc_id string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))
    return out.select("doc_id", F.coalesce(_held(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that score at least `least`, in one pass without a shuffle."""
    model = learned(docs, labels, sample)
    return with_texts(docs, lambda texts: (None, (_scored(texts, model) >= least).tolist()))
