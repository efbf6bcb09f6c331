"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased; each run of characters that are neither letters nor marks is one space, and the text stands between spaces.
Its n-grams of 1 to ORDER characters, but for the lone space, are hashed into buckets. Counts per language and bucket are summed by
Spark, key by key; the matrix of log probabilities (add-ALPHA smoothing) is broadcast, and texts are scored batch by batch with
one gather and one sum over each text's n-grams. Texts are read whole, a long one in pieces of PIECE characters, none lost between.

The matrix has at most CELLS cells: the number of buckets is the largest power of two up to BUCKETS for which all languages fit, so
that what is collected and broadcast is bounded; over CELLS distinct languages are refused. The score is the posterior of the
language predicted, with the languages' shares of the documents as prior. Ties go to the first language in order.

A null text, a text without a letter, and any text where no language was learnt is `und` with a score of 0. Rows with a null lang or
null text teach nothing; rows without an id teach, as their remainder is not 2. Every row comes back once, also repeated ones.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER, BUCKETS, CELLS, ALPHA, PIECE = 4, 1 << 16, 1 << 22, 0.5, 1 << 18
UNKNOWN = "und"
_KIND: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """2 for letters, 1 for marks, 0 for all other code points."""
    if not _KIND:
        _KIND.append(np.array([2 if c[0] == "L" else c[0] == "M" for c in map(unicodedata.category, map(chr, range(0x110000)))], np.uint8))
    return _KIND[0]


def pieces(texts: list):
    """Lists of (text number, folded code points, how many of them were there before) of at most about PIECE characters.

    A text is lower-cased part by part and stands between spaces; runs of others than letters and marks are one space, also over the
    edges of parts. Each part but a text's first begins with the last ORDER - 1 points of the one before.
    """
    held, size = [], 0
    for i, t in enumerate(texts):
        t, last, space = t or "", np.zeros(0, np.uint32), False
        for a in range(0, max(len(t), 1), PIECE):
            raw = (" " if not a else "") + t[a : a + PIECE].lower() + (" " if a + PIECE >= len(t) else "")
            c = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
            inside = kinds()[c] > 0
            c = np.where(inside, c, 32)[inside | np.append(not space, inside[:-1])]
            space = not inside[-1]
            if held and size + len(c) > PIECE:
                yield held
                held, size = [], 0
            held.append((i, np.concatenate([last, c]), len(last)))
            size += len(c)
            last = held[-1][1][1 - ORDER :]
    if held:
        yield held


def grams(held: list, buckets: int):
    """For each n the buckets of the n-grams of pieces and their text numbers, in order of text; those of points that were there
    before are left out."""
    c = np.concatenate([p for _, p, _ in held]).astype(np.uint64)
    size = [len(p) for _, p, _ in held]
    of, new = np.repeat(np.arange(len(held)), size), np.ones(len(c), bool)
    for at, (_, _, lead) in zip(np.cumsum([0, *size]).tolist(), held):
        new[at : at + lead] = False
    text, h = np.array([i for i, _, _ in held])[of], np.zeros(len(c), np.uint64)
    for n in range(1, ORDER + 1):
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] * np.uint64(0x100000001B3)) ^ (c[n - 1 :] + np.uint64(1))
        ok = (of[: len(h)] == of[n - 1 :]) & new[n - 1 :]
        if n == 1:
            ok &= c != 32
        x = (h[ok] ^ np.uint64(n << 60)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        yield (x >> np.uint64(40)).astype(np.int64) & (buckets - 1), text[: len(h)][ok]


def letters(held: list, n: int) -> np.ndarray:
    """Which of n texts have a letter in these pieces."""
    out = np.zeros(n, bool)
    for i, c, _ in held:
        out[i] |= bool((kinds()[c] == 2).any())
    return out


def size(languages: int) -> int:
    """Buckets for so many languages."""
    if languages > CELLS:
        raise ValueError(f"{languages} distinct languages; at most {CELLS} can be told apart")
    return min(BUCKETS, 1 << int(np.log2(CELLS // max(languages, 1))))


def sums(held: list, w: np.ndarray, n: int) -> np.ndarray:
    """Sums of w (languages x buckets) over the n-grams of each of n texts."""
    out = np.zeros((n, len(w)))
    for ids, text in grams(held, w.shape[1]):
        if len(ids):
            at = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            for k in range(len(w)):
                out[text[at], k] += np.add.reduceat(w[k].take(ids), at)
    return out


def fitted(learn: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, their log priors, and the log probabilities (languages x buckets), of rows (text, lang)."""
    spark = learn.sparkSession
    found = learn.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(CELLS + 1).collect()
    names, buckets = sorted(r.lang for r in found), size(len(found))
    if not names:
        return [], np.zeros(0), np.zeros((0, buckets))
    number = spark.sparkContext.broadcast({x: i for i, x in enumerate(names)})

    def count(batches):
        n = np.zeros(len(number.value) * buckets, np.int64)
        for pdf in batches:
            of = np.array([number.value[x] for x in pdf["lang"]], np.int64)
            for held in pieces(pdf["text"].tolist()):
                for ids, text in grams(held, buckets):
                    np.add.at(n, of[text] * buckets + ids, 1)
        at = np.flatnonzero(n)
        for a in range(0, len(at), 100_000):
            yield pd.DataFrame({"cell": at[a : a + 100_000], "n": n[at[a : a + 100_000]]})

    cells = learn.select("text", "lang").mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(len(names) * buckets)
    n[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    n = n.reshape(len(names), buckets) + ALPHA
    docs = {r.lang: r.n for r in found}
    prior = np.log(np.array([docs[x] for x in names], float) / sum(docs.values()))
    return names, prior, np.log(n) - np.log(n.sum(1, keepdims=True))


def predictions(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; rows whose crc32 of the decimal id has the remainder `held` teach nothing."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == held, F.lit(False)).alias("held_out"))
    model = spark.sparkContext.broadcast(fitted(base.where("not held_out and lang is not null and text is not null")))

    def run(batches):
        names, prior, w = model.value
        for pdf in batches:
            n = len(pdf)
            total, told = np.tile(prior, (n, 1)), np.zeros(n, bool)
            for part in pieces(pdf["text"].tolist()) if names else ():
                told |= letters(part, n)
                total += sums(part, w, n)
            pred, score = np.full(n, UNKNOWN, object), np.zeros(n)
            if told.any():
                z = np.exp(total[told] - total[told].max(1, keepdims=True))
                pred[told], score[told] = np.array(names, object)[z.argmax(1)], z.max(1) / z.sum(1)
            yield pdf[["doc_id", "held_out"]].assign(lang_pred=pred, score=score)

    kind = base.schema["doc_id"].dataType.simpleString()
    ids = base.select(F.col("doc_id").cast("string"), "text", "held_out")
    out = ids.mapInPandas(run, "doc_id string, held_out boolean, lang_pred string, score double")
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "lang_pred", "score")
