"""Substring dedup with fixed-block anchors.

Any 13-word window holds a whole aligned 7-word block of the text it stands in. Texts index their aligned blocks and probe with
every rolling 7-word window. Per batch and hash only one entry goes to the hash's bucket (smallest block owner, largest prober),
so a passage of a third of all texts costs a few bytes a batch; anchors found in two texts of one batch are hits at once.
Windows around hits are then compared whole by 96-bit hashes, again one entry per batch and hash: the smallest text that starts
it. Every covered word goes, and touching windows together form the maximal repeats. Judged on the input; the smallest doc_id
keeps its words; repeats within one text stay. Texts of fewer than 13 words keep all. Nulls have no words.

Every row comes back once. Rows that repeat an id are parts of one document: windows don't cross them, and what goes from one goes
from the others. A row without an id has no smaller one beside it: it keeps its words, and takes none from others. Texts are dealt
into groups of about GROUP_BYTES, counted beforehand, so that a group fits a worker at any size of the corpus. Words are hashed in
pieces, and a worker gives free memory back after each slice or group: beside it the executor's heap may be full. Hits go to few
files: on local folders an executor starts three processes (chmod) for each file, and each counts as large as its JVM at first.
"""

from __future__ import annotations

import ctypes
import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import words as W
from docloom.llm.shared import released, written

WINDOW, GROUP_BYTES, SLICE = 13, 64 << 20, 2 << 20
#: Bytes of text whose words are hashed at once: arrays of eight bytes for each byte of a text are held for no more than this.
PIECE = 1 << 18


def _tokens(parts):
    data, bounds = W.joined(parts)
    s, e, t = W.spans(data, bounds, W.WHITE == 0)
    return data, s, e, t


def _hashes(data, s, e, table: int = 0) -> np.ndarray:
    """W.digests, in pieces of whole words."""
    out = np.empty(len(s), np.uint64)
    cuts = np.unique(np.append(np.searchsorted(s, np.arange(0, len(data), PIECE)), len(s))).tolist()
    for a, b in zip(cuts, cuts[1:]):
        x, y = s[a], e[b - 1]
        out[a:b] = W.digests(data[x:y], s[a:b] - x, e[a:b] - x, table)
    return out


def _lean(out):
    """out, after Arrow and the C library gave what they hold unused back to the system: workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
    return out


def _grams(h, t, n):
    """Window hashes, their starts, and texts, for windows within one text."""
    g = W.rolling(h, n)
    at = np.flatnonzero(t[: len(g)] == t[n - 1 :]) if len(g) else np.zeros(0, np.int64)
    return g[at], at, t[at]


def _pack(a: np.ndarray, delta: bool = False) -> bytes:
    """Bytes of an array, bytes of like rank together, compressed."""
    a = np.diff(a, prepend=a.dtype.type(0)) if delta else a
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes(), 1)


def _unpack(blobs, kind: str, delta: bool = False) -> np.ndarray:
    out = []
    for x in blobs:
        if x:
            a = np.frombuffer(zstandard.decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1).T
            a = np.ascontiguousarray(a).view(kind).ravel()
            out.append(np.cumsum(a, dtype=kind) if delta else a)
    return np.concatenate(out) if out else np.zeros(0, kind)


def _deal(h, cols: list, buckets: int):
    """Rows of one bucket each, columns as packed arrays; the last two columns by difference."""
    b = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint32)
    o = np.argsort(b, kind="stable")
    cuts = np.searchsorted(b[o], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        i = o[cuts[k] : cuts[k + 1]]
        yield [k, *(_pack(c[i], n >= len(cols) - 2) for n, c in enumerate(cols))]


def _groups(key):
    """Order by key, the starts of equal runs, and each run's number by row."""
    o = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[o][1:] != key[o][:-1]]) if len(o) else np.zeros(0, bool)
    return o, np.flatnonzero(new), np.cumsum(new) - 1


def _group(doc: int, groups: int) -> int:
    """What Spark has as pmod(crc32(doc as text), groups)."""
    return zlib.crc32(str(doc).encode()) % groups


def _hits(own, pos, groups):
    """Rows (group, packed texts, packed places), one per group of texts."""
    if not len(own):
        return
    o = np.lexsort([pos, own])
    own, pos = own[o].astype(np.int64), pos[o].astype(np.int32)
    new = np.concatenate([[True], own[1:] != own[:-1]])
    g = np.array([_group(d, groups) for d in own[new].tolist()])[np.cumsum(new) - 1]
    o = np.argsort(g, kind="stable")
    cuts = np.searchsorted(g[o], np.arange(groups + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        i = o[cuts[k] : cuts[k + 1]]
        yield k, _pack(own[i], True), _pack(pos[i], True)


def _parts(ids: np.ndarray, texts: list) -> list[tuple[int, int, bytes]]:
    """(id, words of the id's rows before, bytes) of distinct rows, in an order that is the same wherever an id's rows meet."""
    rows = sorted({(d, t.encode() if t else b"") for d, t in zip(ids.tolist(), texts)})
    out = [(d, 0, b) for d, b in rows]
    for k in range(1, len(out)):
        d, n, b = out[k - 1]
        if out[k][0] == d:
            out[k] = d, n + len(b.split()), out[k][2]
    return out


def _places(pdf) -> dict:
    """Places by text, of rows of hits."""
    own, pos = _unpack(pdf["docs"], "i8", True), _unpack(pdf["at"], "i4", True)
    o = np.argsort(own, kind="stable")
    own, pos = own[o], pos[o]
    run = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else []
    return dict(zip(own[run].tolist(), np.split(pos, run[1:]))) if len(own) else {}


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (text) for every row."""
    spark = docs.sparkSession
    block = (window + 1) // 2
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = rows.where("doc_id is not null")
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // GROUP_BYTES))
    buckets, files = 2 * groups, -(-groups // 16)
    slice_bytes = min(max(SLICE, SLICE * groups // 512), 8 * SLICE)

    def entries(ids, first, p):
        """Rows of a slice of texts: anchors found in it, and one entry a hash for the buckets."""
        data, s, e, t = _tokens(p)
        h, at, own = _grams(_hashes(data, s, e), t, block)
        edge = np.searchsorted(t, np.arange(len(p) + 1))
        aligned = (at - edge[own]) % block == 0
        doc = ids[first + own]
        o, run, num = _groups(h)
        if not len(o):
            return []
        dd = doc[o]
        low, high = np.minimum.reduceat(dd, run), np.maximum.reduceat(dd, run)
        none = np.iinfo(np.int64).max
        owner = np.minimum.reduceat(np.where(aligned[o], dd, none), run)
        pos = (at - edge[own])[o]
        shared = (low != high)[num]
        rows = [[x[0] % buckets, b"", b"", b"", *x] for x in _hits(dd[shared], pos[shared], groups)]
        # an entry's code: twice its place, plus one if a block; -1: only its prober, -2: only its owner
        only, two = low == high, (low != high) & (owner != none)
        code = np.where(only, pos[run] * 2 + (owner != none), -1).astype(np.int32)
        hh, d, c = np.concatenate([h[o][run], h[o][run][two]]), np.concatenate([high, owner[two]]), np.concatenate([code, np.full(two.sum(), -2, np.int32)])
        near = np.concatenate([o[run], o[run][two]]).argsort(kind="stable")
        hh, d, c = hh[near], d[near].astype(np.int64), c[near]
        return rows + [[*x, None, None, None] for x in _deal(hh, [hh.astype(np.uint32), d, c], buckets)]

    def probe(batches):
        form = pa.schema([(n, pa.int64() if n in ("b", "g") else pa.binary()) for n in ("b", "h", "doc", "code", "g", "docs", "at")])
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for first, p in W.slices((x.as_py() for x in batch.column("text")), slice_bytes):
                rows = entries(ids, first, p)
                if rows:
                    yield _lean(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), form)], schema=form))

    def passed(pdf, hits):
        sure = pdf[pdf["g"].notna()]
        return pd.DataFrame([*zip(sure["g"].astype("int64"), sure["docs"], sure["at"]), *hits], columns=["g", "docs", "at"])

    def meet(pdf):
        h, doc, code = _unpack(pdf["h"], "u4"), _unpack(pdf["doc"], "i8", True), _unpack(pdf["code"], "i4", True)
        o, run, _ = _groups(h)
        if not len(o):
            return passed(pdf, [])
        d, c = doc[o], code[o]
        block, probes, size = (c == -2) | ((c >= 0) & (c % 2 == 1)), c != -2, np.diff([*run, len(o)])
        low = np.repeat(np.minimum.reduceat(np.where(block, d, np.iinfo(np.int64).max), run), size)
        top = np.repeat(np.maximum.reduceat(np.where(probes, d, np.iinfo(np.int64).min), run), size)
        hit = (c >= 0) & ((low < d) | (block & (d < top)))
        return passed(pdf, _hits(d[hit], c[hit] // 2, groups))

    packed = "b long, h binary, doc binary, code binary, g long, docs binary, at binary"
    anchors = written(base.mapInArrow(probe, packed).groupBy("b").applyInPandas(lambda pdf: _lean(meet(pdf)), "g long, docs binary, at binary").repartition(files), "anchors")
    released(spark)
    dealt = base.withColumn("g", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(groups)))

    def windows(_, left, right):
        rows, at = [], _places(right)
        left = left[left["doc_id"].isin(list(at))]
        own_parts = _parts(left["doc_id"].to_numpy(), left["text"].tolist())
        ids, before = np.array([d for d, *_ in own_parts], np.int64), np.array([n for _, n, _ in own_parts], np.int64)
        several = set(ids[1:][ids[1:] == ids[:-1]].tolist())
        seen_of: dict[int, list] = {d: [] for d in several}
        for d, _, b in own_parts:
            if d in several:  # an anchor of one row marks all rows of its id
                data, s, e, t = _tokens([b])
                h7 = _grams(_hashes(data, s, e), t, block)[0]
                q = at[d]
                seen_of[d].append(h7[q[q < len(h7)]])
        for first, p in W.slices([b for *_, b in own_parts], slice_bytes):
            data, s, e, t = _tokens(p)
            wh = _hashes(data, s, e)
            h7, at7, own7 = _grams(wh, t, block)
            edge = np.searchsorted(t, np.arange(len(p) + 1))
            mark = np.zeros(len(wh) + 1, bool)
            for k in range(len(p)):
                a, b = np.searchsorted(at7, edge[k]), np.searchsorted(at7, edge[k + 1])
                seen, d = h7[a:b], int(ids[first + k])
                q = at[d]
                if len(seen):
                    mark[at7[a:b][np.isin(seen, np.concatenate(seen_of[d]) if d in several else seen[q[q < len(seen)]])]] = True
            h, w, own = _grams(wh, t, window)
            h2 = _grams(_hashes(data, s, e, 1), t, window)[0]
            total = np.concatenate([[0], np.cumsum(mark)])
            take = total[w + window - block + 1] > total[w] if len(w) else np.zeros(0, bool)
            h, h2, w, own = h[take], h2[take], w[take], own[take]
            o, run, num = _groups(h ^ W.mix(h2))
            if not len(o):
                continue
            dd, pp = ids[first + own][o], (w - edge[own] + before[first + own])[o]
            low = np.minimum.reduceat(dd, run)
            sure = dd > low[num]
            rows += [[x[0] % buckets, b"", b"", b"", b"", *x] for x in _hits(dd[sure], pp[sure], groups)]
            lead = np.minimum.reduceat(np.where(sure, np.iinfo(np.int64).max, pp), run)
            near = o[run].argsort(kind="stable")
            hh, hh2, low, lead = h[o][run][near], h2[o][run][near], low.astype(np.int64)[near], lead.astype(np.int32)[near]
            rows += [[*x, None, None, None] for x in _deal(hh, [hh, hh2.astype(np.uint32), low, lead], buckets)]
        return pd.DataFrame(rows, columns=["b", "h", "h2", "low", "pos", "g", "docs", "at"]).astype({"g": "Int64"})

    def decide(pdf):
        h, h2, low, pos = _unpack(pdf["h"], "u8"), _unpack(pdf["h2"], "u4"), _unpack(pdf["low"], "i8", True), _unpack(pdf["pos"], "i4", True)
        o = np.lexsort([h2, h])
        if not len(o):
            return passed(pdf, [])
        new = np.concatenate([[True], (h[o][1:] != h[o][:-1]) | (h2[o][1:] != h2[o][:-1])])
        least = np.minimum.reduceat(low[o], np.flatnonzero(new))[np.cumsum(new) - 1]
        hit = low[o] > least
        return passed(pdf, _hits(low[o][hit], pos[o][hit], groups))

    wide = "b long, h binary, h2 binary, low binary, pos binary, g long, docs binary, at binary"
    second = dealt.groupBy("g").cogroup(anchors.groupBy("g")).applyInPandas(lambda k, a, b: _lean(windows(k, a, b)), wide)
    covered = written(second.groupBy("b").applyInPandas(lambda pdf: _lean(decide(pdf)), "g long, docs binary, at binary").repartition(files), "covered")
    released(spark)

    def keep(_, left, right):
        """Windows of an id's rows whose hashes stand at the places found; their words go from each of the rows."""
        at, out = _places(right), []
        gone: dict[int, list] = {}
        for d, before, b in _parts(left["doc_id"].to_numpy(), left["text"].tolist()):
            if d in at:
                data, s, e, t = _tokens([b])
                h = W.rolling(_hashes(data, s, e), window)
                q = at[d] - before
                gone.setdefault(d, []).append(h[q[(q >= 0) & (q < len(h))]])
        for d, text in zip(left["doc_id"].tolist(), left["text"].tolist()):
            b = (text or "").encode()
            ws, n_gone = b.split(), 0
            n = len(ws)
            if d in gone:
                data, s, e, t = _tokens([b])
                starts = np.flatnonzero(np.isin(W.rolling(_hashes(data, s, e), window), np.concatenate(gone[d])))
                mark = np.zeros(n + 1, np.int64)
                np.add.at(mark, starts, 1)
                np.add.at(mark, starts + window, -1)
                cover = np.cumsum(mark)[:-1] > 0
                n_gone = int(cover.sum())
                ws = [w for w, c in zip(ws, cover.tolist()) if not c]
            out.append((d, n, n_gone, hashlib.sha256(b" ".join(ws)).hexdigest(), b" ".join(ws).decode()))
        return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    def whole(batches):
        for pdf in batches:
            kept = [(t or "").encode().split() for t in pdf["text"]]
            yield pd.DataFrame([(len(w), hashlib.sha256(b" ".join(w)).hexdigest(), b" ".join(w).decode()) for w in kept], columns=["n_words", "kept_sha256", "kept"])

    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    named = dealt.groupBy("g").cogroup(covered.groupBy("g")).applyInPandas(lambda k, a, b: _lean(keep(k, a, b)), kind)
    unnamed = rows.where("doc_id is null").mapInPandas(whole, "n_words long, kept_sha256 string, kept string")
    return named.unionAll(unnamed.select(F.lit(None).cast("long"), "n_words", F.lit(0).cast("long"), "kept_sha256", "kept"))
