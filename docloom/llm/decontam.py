"""Benchmark decontamination with a generalised suffix automaton over the words of the items.

Texts are lower-cased (A-Z); words are runs of digits, a-z and characters beyond ASCII. The automaton streams a text's words
and tracks the longest match ending at each; where it reaches the window, the last words are hit and the state names the items.
Only runs in which every pair of neighbours is a pair of some item are streamed: elsewhere no match of two words exists.
Items are taken in blocks of at most BLOCK_WORDS words, each its own automaton, built one at a time. A pass over the texts takes
automata of at most PASS_WORDS words together; where the items need more passes, each writes the hits it found by the hash of the
text, and what was shipped for it is freed before the next. So neither the driver nor a worker ever holds all items.

Null and empty texts have no words and are never contaminated. Items of one id are one item. The words of an item without id are
hit like any other's, but it is not among the items counted and named. Where windows of several items end at one word, all are
named. Repeated rows and rows without id come back each.
"""

from __future__ import annotations

import itertools
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import words as W
from docloom.llm.shared import with_texts, written

WINDOW, BLOCK_WORDS, PASS_WORDS = 8, 500_000, 2_000_000


def item_words(text: str | None) -> list[int]:
    data, bounds = W.joined([(text or "").encode()])
    data = W.LOWER[data]
    s, e, _ = W.spans(data, bounds, W.ALNUM)
    return W.digests(data, s, e).tolist()


class Automaton:
    """Generalised suffix automaton of word sequences, with the items of each state's window-long suffix."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.window = window
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]
        items = [(i, w) for i, w in items if w]
        for _, ws in items:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self._compact()
        self.of: dict[int, set] = {}
        self.short: dict[tuple[int, int], set] = {}
        self.sizes = sorted({len(w) for _, w in items if len(w) < window})
        for i, ws in items:
            if len(ws) < window:
                s = 0
                for w in ws:
                    s = self._way(s, w)
                self.short.setdefault((s, len(ws)), set()).add(i)
                continue
            s = n = 0
            for w in ws:
                s, n = self.step(s, n, w)
                if n >= window:
                    self.of.setdefault(self.at(s, window), set()).add(i)
        self.least = min([window, *self.sizes])
        self.words = np.array(sorted({w for _, ws in items for w in ws}), np.uint64)
        pairs = [W.rolling(np.array(ws, np.uint64), 2) for _, ws in items]
        self.pairs = np.unique(np.concatenate([*pairs, np.zeros(0, np.uint64)]))

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, w, q)
        cur = self._new(self.len[last] + 1, {})
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p == -1:
            self.link[cur] = 0
        else:
            q = self.next[p][w]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, w, q)
        return cur

    def _new(self, n: int, to: dict) -> int:
        self.next.append(to)
        self.len.append(n)
        self.link.append(0)
        return len(self.len) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._new(self.len[p] + 1, dict(self.next[q]))
        self.link[c] = self.link[q]
        self.link[q] = c
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _compact(self):
        """Most states have one way on: two arrays hold it, and a table holds the ways of the others."""
        lone = [next(iter(x.items())) if len(x) == 1 else (0, -1) for x in self.next]
        self.word, self.to = array("Q", (w for w, _ in lone)), array("i", (t for _, t in lone))
        self.more = {s: x for s, x in enumerate(self.next) if len(x) > 1}
        self.link, self.len = array("i", self.link), array("i", self.len)
        del self.next

    def _way(self, s: int, w: int) -> int:
        to = self.to[s]
        if to >= 0:
            return to if self.word[s] == w else -1
        return self.more[s].get(w, -1) if s in self.more else -1

    def step(self, s: int, n: int, w: int) -> tuple[int, int]:
        to = self._way(s, w)
        while to < 0 and s:
            s = self.link[s]
            n = self.len[s]
            to = self._way(s, w)
        return (to, n + 1) if to >= 0 else (0, 0)

    def at(self, s: int, n: int) -> int:
        """The state of the last n words of what s has read."""
        while self.len[self.link[s]] >= n:
            s = self.link[s]
        return s

    def scan(self, ws: list[int], base: int, hit: np.ndarray, found: set) -> int:
        s = n = longest = 0
        for i, w in enumerate(ws):
            s, n = self.step(s, n, w)
            if n >= self.window:
                longest = max(longest, n)
                hit[base + i + 1 - self.window : base + i + 1] = True
                found |= self.of.get(self.at(s, self.window), frozenset())
            for k in self.sizes:
                if k <= n and (x := self.short.get((self.at(s, k), k))):
                    longest = max(longest, k)
                    hit[base + i + 1 - k : base + i + 1] = True
                    found |= x
        return longest


def _member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of) or not len(x):
        return np.zeros(len(x), bool)
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x


def scan_texts(auto: Automaton, texts: list):
    """For each text: n_words, n_hit, item ids, length of the longest match that hits, and the byte spans of its hit words."""
    for _, parts in W.slices(texts):
        data, bounds = W.joined(parts)
        data = W.LOWER[data]
        s, e, text = W.spans(data, bounds, W.ALNUM)
        h = W.digests(data, s, e)
        known = _member(h, auto.words)
        pair = np.zeros(len(h) + 1, bool)
        if len(h) > 1:
            c = np.flatnonzero(known[:-1] & known[1:] & (text[:-1] == text[1:]))
            pair[c + 1] = _member(W.mix(W.mix(h[c]) + W.mix(h[c + 1]) * W.powers(2)[1]), auto.pairs)
        cut = np.flatnonzero(known & ~pair[:-1])
        stop = np.flatnonzero(known & ~pair[1:]) + 1
        long = stop - cut >= auto.least
        hit, edge = np.zeros(len(h), bool), np.searchsorted(text, np.arange(len(parts) + 1))
        found: dict[int, set] = {}
        best: dict[int, int] = {}
        for a, b in zip(cut[long].tolist(), stop[long].tolist()):
            t = int(text[a])
            best[t] = max(best.get(t, 0), auto.scan(h[a:b].tolist(), a, hit, found.setdefault(t, set())))
        for t in range(len(parts)):
            own = hit[edge[t] : edge[t + 1]]
            at = np.flatnonzero(own) + edge[t] if t in found else []
            yield len(own), int(own.sum()), found.get(t, set()), best.get(t, 0), [(int(s[i] - bounds[t]), int(e[i] - bounds[t])) for i in at]


def blocks(items: DataFrame, id_col: str, text_col: str, window: int):
    """Automata of blocks of items with the words in each, read from the table one partition at a time; one at least."""
    block, size = [], 0
    for r in items.select(F.col(id_col).cast("string"), text_col).toLocalIterator():
        w = item_words(r[1])
        if block and size + len(w) > BLOCK_WORDS:
            yield Automaton(block, window), size
            block, size = [], 0
        block.append((r[0], w))
        size += len(w)
    yield Automaton(block, window), size


def loads(items: DataFrame, id_col: str, text_col: str, window: int):
    """Lists of the automata of one pass."""
    load, size = [], 0
    for auto, n in blocks(items, id_col, text_col, window):
        if load and size + n > PASS_WORDS:
            yield load
            load, size = [], 0
        load.append(auto)
        size += n
    yield load


def scanned(autos: list, texts: list):
    """For each text: n_words, sorted ids of items, longest match, sorted byte spans of hit words, over all automata."""
    seen = [list(scan_texts(a, texts)) for a in autos]
    for each in zip(*seen):
        yield each[0][0], sorted(set().union(*(r[2] for r in each)) - {None}), max(r[3] for r in each), sorted({x for r in each for x in r[4]})


_FOUND = "items array<string>, longest long, spans array<array<long>>"


def _hits(docs: DataFrame, text_col: str, passes) -> DataFrame:
    """(text_hash, items, longest, spans) of distinct texts with matches, gathered over several passes."""
    spark, texts = docs.sparkSession, docs.select(F.col(text_col).alias("t")).where("t is not null")
    tables = []
    for load in passes:
        sent = spark.sparkContext.broadcast(load)

        def run(batches, sent=sent):
            for pdf in batches:
                rows = [(t, i, n, [list(x) for x in s]) for t, (_, i, n, s) in zip(pdf["t"], scanned(sent.value, pdf["t"].tolist())) if n]
                yield pd.DataFrame(rows, columns=["t", "items", "longest", "spans"])

        tables.append(written(texts.mapInPandas(run, "t string, " + _FOUND).withColumn("text_hash", F.sha2("t", 256)).drop("t"), "hits"))
        sent.destroy()
    every = tables[0]
    for t in tables[1:]:
        every = every.unionAll(t)
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return every.groupBy("text_hash").agg(flat("items").alias("items"), F.max("longest").alias("longest"), flat("spans").alias("spans"))


def _first(passes):
    """The only pass, or None, and all passes."""
    head = list(itertools.islice(passes, 2))
    return (head[0] if len(head) == 1 else None), itertools.chain(head, passes)


def contamination(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, spans of hit bytes."""
    only, passes = _first(loads(items, item_id, item_text, window))
    base = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    autos = docs.sparkSession.sparkContext.broadcast(only or [Automaton([], window)])

    def run(batches):
        for pdf in batches:
            rows = [(i, n, x, longest, [list(s) for s in spans]) for i, (n, x, longest, spans) in zip(pdf["i"].tolist(), scanned(autos.value, pdf["t"].tolist()))]
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "items", "longest", "spans"])

    if only:
        out = base.mapInPandas(run, "doc_id string, n_words long, " + _FOUND)
    else:
        hits = _hits(docs, text_col, passes)

        def count(batches):
            for pdf in batches:
                yield pd.DataFrame({"doc_id": pdf["i"], "n_words": [n for n, *_ in scanned(autos.value, pdf["t"].tolist())], "text_hash": pdf["h"]})

        counted = base.withColumn("h", F.sha2("t", 256)).mapInPandas(count, "doc_id string, n_words long, text_hash string")
        none = F.array().cast("array<string>"), F.array().cast("array<array<bigint>>")
        out = counted.join(hits, "text_hash", "left").select("doc_id", "n_words", F.coalesce("items", none[0]).alias("items"), F.coalesce("longest", F.lit(0)).alias("longest"), F.coalesce("spans", none[1]).alias("spans"))
    n = F.size("items")
    return out.select(F.col("doc_id").cast("long"), "n_words", F.size("spans").cast("long").alias("n_hit"), n.cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n >= 2).alias("contaminated"), "longest", "spans")


def _without(text: str, spans: list) -> str:
    b, out, last = text.encode(), [], 0
    for s, e in spans:
        out.append(b[last:s])
        last = e
    return b" ".join([*(x for x in out if x.strip()), b[last:]]).decode()


def decontaminate(docs: DataFrame, items: DataFrame, max_length: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """docs without the hit words of matches of max_length words or more; documents covered over max_coverage go."""
    only, passes = _first(loads(items, "item_id", "text", max_length))
    autos = docs.sparkSession.sparkContext.broadcast(only or [Automaton([], max_length)])

    def change(texts, spans=None):
        seen = list(scanned(autos.value, texts))
        spans = [s for *_, s in seen] if spans is None else [x or [] for x in spans]
        keep = [not n or len(s) <= max_coverage * n for (n, *_), s in zip(seen, spans)]
        return [_without(t, s) if s else t for t, s in zip(texts, spans)], keep

    if only:
        return with_texts(docs, change).withColumn("n_chars", F.length("text").cast("long"))
    hits = _hits(docs, "text", passes).select("text_hash", "spans")
    both = docs.select(F.struct(*docs.columns).alias("row"), F.sha2("text", 256).alias("text_hash")).join(hits, "text_hash", "left")
    free = "spans" + "_" * max(map(len, docs.columns))
    return with_texts(both.select("row.*", F.col("spans").alias(free)), change, extra=True).withColumn("n_chars", F.length("text").cast("long"))
