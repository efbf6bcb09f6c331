"""Hard-negative mining by norm-bucketed search, exact in integers.

Candidates are sorted by the norm of their integer vectors, highest first, and cut into buckets of BUCKET rows with the bucket's
largest norm. Anchors stand in blocks. Buckets are dealt to stripes, and one cell of the grid block x stripe reads its buckets in
falling order of norm, holding the best k of each window so far: by Cauchy-Schwarz no score in a bucket exceeds the product of the
anchor's norm and the bucket's, so an anchor leaves a bucket out when that is under its windows' lower limits or their running kth
scores. A task holds one block and one bucket at a time. The first search finds each anchor's positives (a window without limits
among rows of its label), the second the negatives in the window that each positive opens among rows of other labels.

Components become floor(scale * x) of the double x. Scores are sums in doubles where those are exact, otherwise in whole
numbers of Python; the columns returned are clipped to 64 bits. A shorter vector counts as padded with zeros. Rows with a null id, label or vector, or any null or
non-finite component take no part. Rows equal in id, label and vector count once; other rows of one id are rows of their own, but
never an anchor's partners where the anchor has that id. Rows that tie in score and id stand in order of label and vector.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.shared import written

BUCKET, BLOCK, STRIPE, STRIPES, AT_ONCE = 2048, 4096, 8192, 256, 512
_LOW = float("-inf")


def _whole(vectors, scale: int) -> np.ndarray:
    """floor(scale * x), padded to one width; floats that hold whole numbers."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(out * scale)


def _packed(x: np.ndarray) -> tuple[str, bytes]:
    kind = "<i2" if np.abs(x).max(initial=0) < 1 << 15 else "<f8"
    return kind, x.astype(kind).tobytes()


def _matrix(kind: str, blob: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(blob, kind).reshape(rows, -1).astype(np.float64)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows: doubles where no sum can reach 2^53, Python integers beyond."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(width, 1) < 2.0**53:
        return a @ b.T
    to = np.frompyfunc(int, 1, 1)
    return to(a).astype(object) @ to(b).astype(object).T


def _limits(s: int) -> tuple[int, int]:
    """Scores n with 30 * s <= 100 * n <= 90 * s, as whole numbers from and up to."""
    return -(-30 * s // 100), 90 * s // 100


class _Windows:
    """The best k rows of each window of a block of anchors; a window is (anchor's row, low, high)."""

    def __init__(self, of, low, high, k):
        self.of, self.low, self.high, self.k = np.asarray(of, np.int64), low, high, k
        self.kth = np.full(len(self.of), _LOW, low.dtype)
        self.best = None

    def least(self) -> np.ndarray:
        return np.maximum(self.low, self.kth)

    def meet(self, rows: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, tie: np.ndarray):
        """Scores (rows of windows x a bucket's rows) that are allowed, within the limits and not under the kth so far."""
        ok = allowed & (scores >= self.least()[rows, None]) & (scores <= self.high[rows, None])
        many = np.flatnonzero(ok.sum(1) > 4 * self.k)
        if len(many) and scores.dtype == np.float64:
            part = np.where(ok[many], scores[many], _LOW)
            ok[many] &= scores[many] >= np.partition(part, -self.k, axis=1)[:, -self.k, None]
        w, c = np.nonzero(ok)
        if not len(w):
            return
        new = rows[w], scores[w, c], ids[c], tie[c]
        touched = np.unique(new[0])
        if self.best is not None:
            old = np.isin(self.best[0], touched)
            kept, held = [x[~old] for x in self.best], [x[old] for x in self.best]
            new = [np.concatenate([x, y]) for x, y in zip(held, new)]
        o = np.lexsort([new[3], new[2], -new[1], new[0]])
        w = new[0][o]
        start = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        place = np.arange(len(w)) - np.repeat(start, np.diff(np.append(start, len(w))))
        last = o[place == self.k - 1]
        self.kth[new[0][last]] = new[1][last]
        new = [x[o[place < self.k]] for x in new]
        self.best = new if self.best is None else [np.concatenate([x, y]) for x, y in zip(kept, new)]


_CELL = "block long, stripe long, norm double, place long, rows int, kind string, matrix binary, ids array<long>, labels array<long>, ties array<long>, keys array<long>, wof array<int>, wlow array<decimal(38,0)>, whigh array<decimal(38,0)>"


def _search(anchors: DataFrame, buckets: DataFrame, blocks: int, stripes: int, k: int, same: bool) -> DataFrame:
    """(key, window, id, tie, score): in each cell the best k of every window among rows of the same label, or of other labels."""
    spark = anchors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def look(batches):
        now = anchor = None

        def done():
            if anchor is not None and anchor["windows"].best is not None:
                w, s, i, t = anchor["windows"].best
                yield pd.DataFrame({"key": anchor["keys"][anchor["windows"].of[w]], "window": w - anchor["first"][anchor["windows"].of[w]], "id": i, "tie": t, "score": [_decimal(x) for x in s]})

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if (r.block, r.stripe) != now:
                    yield from done()
                    now, anchor = (r.block, r.stripe), None
                if r.place < 0:
                    anchor = _opened(r, k)
                elif anchor is not None:
                    _bucket(anchor, r, same)
        yield from done()

    grid = anchors.withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))))
    rows = buckets.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).withColumn("stripe", F.pmod(F.xxhash64("place"), F.lit(stripes)))
    cells = grid.unionByName(rows, allowMissingColumns=True).repartition(parts, "block", "stripe").sortWithinPartitions("block", "stripe", F.desc("norm"), "place")
    names = [c.strip().split(" ")[0] for c in _CELL.split(", ")]
    return cells.select(*names).mapInPandas(look, "key long, window int, id long, tie long, score decimal(38,0)")


def _decimal(x):
    import decimal

    return decimal.Decimal(int(x))


def _opened(r, k: int) -> dict:
    x = _matrix(r.kind, r.matrix, r.rows)
    of = np.asarray(r.wof, np.int64)
    exact = lambda v: np.array([_LOW if a is None else int(a) for a in v], object)
    low, high = exact(r.wlow), np.array([float("inf") if a is None else int(a) for a in r.whigh], object)
    if all(abs(a) < 2**53 for a in [*low, *high] if abs(a) != float("inf")):
        low, high = low.astype(float), high.astype(float)
    first = np.searchsorted(of, np.arange(r.rows))
    return {"x": x, "norm": np.sqrt((x * x).sum(1)), "ids": np.asarray(r.ids), "labels": np.asarray(r.labels), "keys": np.asarray(r.keys), "first": first, "windows": _Windows(of, low, high, k)}


def _bucket(anchor: dict, r, same: bool) -> None:
    """One bucket met by those windows whose bound it can reach."""
    w = anchor["windows"]
    bound = anchor["norm"] * r.norm * (1 + 1e-9) + 1
    live = np.flatnonzero(bound[w.of] >= np.asarray(w.least(), float))
    if not len(live):
        return
    c, ids, labels, tie = _matrix(r.kind, r.matrix, r.rows), np.asarray(r.ids), np.asarray(r.labels), np.asarray(r.ties)
    used = np.unique(w.of[live])
    for a in range(0, len(used), AT_ONCE):
        some = used[a : a + AT_ONCE]
        s = dots(anchor["x"][some], c)
        if s.dtype == object or w.low.dtype == object:
            s, w.low, w.high, w.kth = s.astype(object), w.low.astype(object), w.high.astype(object), w.kth.astype(object)
        equal = anchor["labels"][some][:, None] == labels[None]
        fit = (equal if same else ~equal) & (anchor["ids"][some][:, None] != ids[None])
        rows = live[(w.of[live] >= some[0]) & (w.of[live] <= some[-1])]
        at = np.searchsorted(some, w.of[rows])
        for b in range(0, len(rows), AT_ONCE):
            i = at[b : b + AT_ONCE]
            w.meet(rows[b : b + AT_ONCE], s[i], fit[i], ids, tie)


def mined(vectors: DataFrame, id_col="vec_id", vec_col="embedding", label_col="label", every: int = 100, positives: int = 5, negatives: int = 10, scale: int = 256, shift: tuple[int, int] | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id `every` divides. With shift (m, n) the label of a row whose id m divides becomes (label + 1) % n.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast(kind).alias("v"))
    rows = rows.where("coalesce(id is not null and label is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')), false)")
    if shift:
        rows = rows.withColumn("label", F.when(F.col("id") % shift[0] == 0, (F.col("label") + 1) % shift[1]).otherwise(F.col("label")))
    rows = written(rows.distinct().withColumn("tie", F.xxhash64("label", "v")), "vectors")
    count, asked = rows.agg(F.count("*"), F.coalesce(F.sum((F.col("id") % every == 0).cast("long")), F.lit(0))).first()
    blocks, stripes = max(1, -(-asked // BLOCK)), max(1, min(STRIPES, -(-count // STRIPE)))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.floor(x.cast("double") * scale).cast("double") * F.floor(x.cast("double") * scale).cast("double")))

    def cut(batches):
        """Buckets of rows that come in falling order of norm; the norm is the largest in the bucket."""
        held = None

        def bucket(pdf):
            x = _whole(pdf["v"].tolist(), scale)
            kind, blob = _packed(x)
            return pd.DataFrame({"norm": [float(np.sqrt((x * x).sum(1)).max())], "rows": len(pdf), "kind": kind, "matrix": [blob], "ids": [pdf["id"].to_numpy()], "labels": [pdf["label"].to_numpy()], "ties": [pdf["tie"].to_numpy()]})

        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            while len(held) >= BUCKET:
                yield bucket(held.iloc[:BUCKET])
                held = held.iloc[BUCKET:]
        if held is not None and len(held):
            yield bucket(held)

    sized = rows.withColumn("norm", norm)
    dealt = sized.repartitionByRange(max(1, min(parts, -(-count // BUCKET))), F.desc("norm"), "id", "tie").sortWithinPartitions(F.desc("norm"), "id", "tie")
    buckets = dealt.select("id", "label", "v", "tie").mapInPandas(cut, "norm double, rows int, kind string, matrix binary, ids array<long>, labels array<long>, ties array<long>")
    buckets = written(buckets.withColumn("place", F.monotonically_increasing_id()), "buckets")
    anchors = rows.where(F.col("id") % every == 0).withColumn("key", F.monotonically_increasing_id()).withColumn("block", F.pmod(F.xxhash64("id", "tie"), F.lit(blocks)))
    anchors = written(anchors, "anchors")

    def block(pdf):
        """An anchor's windows stand one after another; limits are null in a window without limits."""
        pdf = pdf.sort_values("key")
        x = _whole(pdf["v"].tolist(), scale)
        kind, blob = _packed(x)
        scores = [[None] if s is None else [int(y) for y in s] for s in pdf["scores"]]
        of = [i for i, s in enumerate(scores) for _ in s]
        low, high = zip(*((None, None) if y is None else tuple(map(_decimal, _limits(y))) for s in scores for y in s))
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "place": -1, "norm": float("inf"), "rows": len(pdf), "kind": kind, "matrix": [blob], "ids": [pdf["id"].to_numpy()], "labels": [pdf["label"].to_numpy()], "keys": [pdf["key"].to_numpy()], "wof": [of], "wlow": [list(low)], "whigh": [list(high)]})

    form = "block long, place long, norm double, rows int, kind string, matrix binary, ids array<long>, labels array<long>, keys array<long>, wof array<int>, wlow array<decimal(38,0)>, whigh array<decimal(38,0)>"
    order = [F.desc("score"), "id", "tie"]
    ranked = lambda found, by, k: found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    open_to_all = anchors.withColumn("scores", F.lit(None).cast("array<decimal(38,0)>")).groupBy("block").applyInPandas(block, form)
    near = written(ranked(_search(open_to_all, buckets, blocks, stripes, positives, True), ["key"], positives), "positives")
    chosen = near.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    limited = anchors.join(chosen.select("key", F.transform("p", lambda p: p["score"]).alias("scores")), "key").groupBy("block").applyInPandas(block, form)
    found = ranked(_search(limited, buckets, blocks, stripes, negatives, False), ["key", "window"], negatives)
    pairs = near.select("key", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    clip = lambda c: F.least(F.greatest(F.col(c), -most - 1), most).cast("long").alias(c)
    return pairs.join(found.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}), ["key", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", clip("positive_score"), clip("negative_score"))
