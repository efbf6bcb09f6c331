"""Rows alike as sequences of characters (U4, U8) and names that hold each other's words (U9), over whole tables.

The likeness is the ratio of the standard library's sequence matcher: twice the characters in matching blocks over both lengths.
Candidates come from a count filter that loses no pair: where M characters match in order, M * 2 >= least * (n + m), and each of
the n - M deletions spoils at most two of a text's pairs of neighbouring characters, each of the m - M insertions at most one. So two texts
share at least 3 * M - n - m - 1 such pairs, copies counted, and M characters in any order. Both are counted in pairs of blocks of like lengths.
Short texts meet by what is left of them instead: M characters that match in order are a part of both, so that one of the few ways to leave
n - M characters out of one text gives the same as a way to leave m - M out of the other. Time then grows with the texts and the pairs found.
"""

from __future__ import annotations

import difflib
import itertools
import math
from collections import Counter
from collections.abc import Iterator
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import texts
from docloom.functions.tables import written
from docloom.operators import facts
from docloom.operators.fusion import ordered, settled
from docloom.operators.numbering import placed

#: The likeness from which requirements are one, and names are; and words that may end a name without being part of it.
SAME, ALIGNED = 0.88, 0.80
#: Keys, and characters, that a block holds; counts that a task holds at once.
BLOCK_KEYS, BLOCK_CHARS, CELLS = 4_096, 500_000, 2_000_000
#: Short keys that a block holds; the most ways to leave characters out of a key that counts as short; pairs matched at once.
SHORT_KEYS, WAYS, MATCHED = 65_536, 4_096, 16_384
LEGAL_ENDS = "sa s.a sarl sas inc ltd llc plc corp corporation company co group groupe holding holdings".split()


def _grams(keys: list[str], known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all pairs of neighbouring characters, each with its number among equal ones, and how many each key has."""
    found = []
    for key in keys:
        seen = Counter()
        for g in map(add, key, key[1:]):
            found.append(known.setdefault((g, seen[g]), len(known)))
            seen[g] += 1
    return np.array(found, int), np.array([max(0, len(k) - 1) for k in keys], int)


def _letters(keys: list[str], known: dict) -> np.ndarray:
    """How often each key has each character."""
    at = [(i, known.setdefault(c, len(known)), n) for i, k in enumerate(keys) for c, n in Counter(k).items()]
    many = np.zeros((len(keys), len(known)), np.int32)
    if at:
        i, c, n = np.array(at).T
        many[i, c] = n
    return many


def _sharing(x: list[str], y: list[str], least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in x, places in y) of keys that share enough pairs of characters, and characters; of one list with itself the later in y only."""
    grams, letters = {}, {}
    (tx, _), (ty, my) = _grams(x, grams), _grams(y, grams)
    _letters(x, letters)
    cy = _letters(y, letters)
    cx = _letters(x, letters)
    nx, ny = np.array(list(map(len, x))), np.array(list(map(len, y)))
    matched = lambda total: np.ceil(total * least / 2 - 1e-9).astype(int)
    shared = lambda total: 3 * matched(total) - total - 1
    lengths = np.unique(ny)
    low = {n: shared(n + lengths).min() for n in np.unique(nx).tolist()}
    low = np.array([low[n] for n in nx.tolist()])
    held = np.repeat(np.arange(len(y)), my)
    order = np.argsort(ty, kind="stable")
    post, start = held[order], np.searchsorted(ty[order], np.arange(len(grams) + 1))
    first = np.concatenate([[0], np.cumsum(np.maximum(nx - 1, 0))])
    own, many = np.repeat(np.arange(len(x)), np.maximum(nx - 1, 0)), start[tx + 1] - start[tx]
    upto = np.cumsum(np.bincount(own, many, len(x)))
    lo = 0
    while lo < len(x):
        hi = max(lo + 1, min(lo + max(1, CELLS // len(y)), int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CELLS))))
        t, n, o = tx[first[lo] : first[hi]], many[first[lo] : first[hi]], own[first[lo] : first[hi]]
        cell = np.repeat((o - lo) * len(y), n) + post[np.repeat(start[t] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        met = np.bincount(cell, minlength=(hi - lo) * len(y)).reshape(hi - lo, len(y))
        i, j = np.nonzero(met >= low[lo:hi, None])
        met, i = met[i, j], i + lo
        fine = met >= shared(nx[i] + ny[j])
        fine &= np.minimum(nx[i], ny[j]) * (2 - least) >= np.maximum(nx[i], ny[j]) * least - 1e-9
        fine &= (i < j) if same else True
        i, j = i[fine], j[fine]
        each = max(1, CELLS // max(1, len(letters)))
        for k in range(0, len(i), each):
            a, b = i[k : k + each], j[k : k + each]
            fine = np.minimum(cx[a], cy[b]).sum(1) >= matched(nx[a] + ny[b])
            yield a[fine], b[fine]
        lo = hi


def _least_matched(total: int, least: float) -> int:
    """Characters that two texts of so many together have in common in order, if they reach the limit."""
    return math.ceil(total * least / 2 - 1e-9)


def _short(least: float) -> int:
    """The length up to which keys count as short: all of one length in bits, as blocks are."""
    partners = lambda m: (n for n in range(1, m + 1) if _least_matched(n + m, least) <= n)
    few = lambda m: all(math.comb(m, _least_matched(n + m, least)) <= WAYS for n in partners(m))
    return next((top for top in (15, 7, 3) if all(map(few, range(1, top + 1)))), 0)


def _left(codes: np.ndarray, kept: int) -> np.ndarray:
    """Numbers of what is left of each key, a row of code points, where all but `kept` characters are left out, in each way. Equal
    characters have equal numbers; the sums are under 2**53, so doubles hold them."""
    ways = np.array([*itertools.combinations(range(codes.shape[1]), kept)])
    weights = np.zeros((codes.shape[1], len(ways)))
    weights[ways, np.arange(len(ways))[:, None]] = np.random.default_rng(kept).integers(1 << 27, 1 << 28, kept)
    return (codes.astype(float) @ weights).astype(np.int64)


def _leaving(x: np.ndarray, y: np.ndarray, kept: int) -> np.ndarray:
    """Distinct pairs, as i * len(y) + j, of keys of x and of y, which are as long or longer, that have `kept` characters in common in order."""
    slot = lambda h: (h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
    each = lambda codes: max(1, CELLS // math.comb(codes.shape[1], kept))
    found = [np.zeros(0, np.int64)]
    for at in range(0, len(x), each(x)):
        h = _left(x[at : at + each(x)], kept)
        own, h = np.repeat(np.arange(len(h)) + at, h.shape[1]), h.ravel()
        order = np.argsort(h)
        own, h = own[order], h[order]
        seen = np.zeros(1 << 24, bool)
        seen[slot(h)] = True
        for to in range(0, len(y), each(y)):
            g = _left(y[to : to + each(y)], kept)
            j, w = np.nonzero(seen[slot(g)])
            g, j = g[j, w], j + to
            low = np.searchsorted(h, g)
            many = np.searchsorted(h, g, "right") - low
            j, low, many = j[many > 0], low[many > 0], many[many > 0]
            upto, k = np.cumsum(many), 0
            while k < len(many):
                end = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + CELLS)))
                n = many[k:end]
                i = own[np.repeat(low[k:end] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                found.append(np.unique(i * len(y) + np.repeat(j[k:end], n)))
                k = end
    return np.unique(np.concatenate(found))


def _matching(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Characters in the matching blocks of the sequence matcher, for pairs of rows of code points: it takes the longest block, of equal
    ones the first in x and then in y, and goes on at its left and its right."""
    total = np.zeros(len(x), np.int64)
    x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    ci, cj = np.arange(len(x))[:, None], np.arange(len(y))[:, None]
    pair = np.arange(x.shape[1])
    todo = (pair, 0 * pair, 0 * pair + len(x), 0 * pair, 0 * pair + len(y))
    while len(todo[0]):
        pair, alo, ahi, blo, bhi = todo
        a = np.where((ci >= alo) & (ci < ahi), x[:, pair], -1)
        b = np.where((cj >= blo) & (cj < bhi), y[:, pair], -2)
        run, best, i, j = np.zeros((len(y) + 1, len(pair)), np.int8), np.zeros(len(pair), np.int8), 0 * pair, 0 * pair
        for k in range(len(x)):
            run[1:] = (run[:-1] + np.int8(1)) * (b == a[k])
            top = run.max(0)
            more = np.flatnonzero(top > best)
            best[more], i[more], j[more] = top[more], k + 1, run[:, more].argmax(0)
        total += np.bincount(pair, best, len(total)).astype(np.int64)
        i0, j0 = i - best, j - best
        left, right = (best > 0) & (i0 > alo) & (j0 > blo), (best > 0) & (i < ahi) & (j < bhi)
        todo = tuple(np.concatenate([u[left], v[right]]) for u, v in ((pair, pair), (alo, i), (i0, ahi), (blo, j), (j0, bhi)))
    return total


def _codes(keys: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length the places of its keys, and their code points in rows."""
    n = np.array([*map(len, keys)], int)
    places = {m: np.flatnonzero(n == m) for m in np.unique(n).tolist()}
    return {m: (at, np.frombuffer("".join(keys[at]).encode("utf-32-le", "surrogatepass"), np.int32).reshape(-1, m)) for m, at in places.items() if m}


def _near_short(x: np.ndarray, y: np.ndarray, least: float, same: bool) -> Iterator[tuple]:
    """(places in x, places in y, ratios of x to y, ratios of y to x) of short keys of which one ratio reaches the limit; of one list with itself each pair once."""
    left, right = _codes(x), _codes(y)
    for (n, (at, a)), (m, (to, b)) in itertools.product(left.items(), right.items()):
        kept = _least_matched(n + m, least)
        if kept > min(n, m) or (same and n > m) or kept == n == m:
            continue
        pairs = _leaving(a, b, kept) if n <= m else _leaving(b, a, kept)
        i, j = np.divmod(pairs, len(b)) if n <= m else np.divmod(pairs, len(a))[::-1]
        if same and n == m:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), MATCHED):
            p, q = i[k : k + MATCHED], j[k : k + MATCHED]
            one, back = 2.0 * _matching(a[p], b[q]) / (n + m), 2.0 * _matching(b[q], a[p]) / (n + m)
            fine = np.maximum(one, back) >= least
            yield at[p[fine]], to[q[fine]], one[fine], back[fine]


def _paired(rows: DataFrame, least: float) -> tuple:
    """Rows (id, key) in pairs of blocks of lengths near enough, grouped for a task each: those of two blocks of short keys, and the others."""
    n, short = rows.select("id", "key", F.length("key").alias("n")), _short(least)
    parts = int(n.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = max(BLOCK_KEYS, min(SHORT_KEYS, n.count() // math.isqrt(6 * parts)))  # so that there are more pairs of blocks than partitions
    most = F.when(F.col("n") <= short, keys).otherwise(BLOCK_KEYS)
    each = F.greatest(F.least(most, F.when(F.col("n") <= short, 2).otherwise(1) * BLOCK_CHARS / F.pow(F.lit(2), F.length(F.bin("n")))), F.lit(1))
    n = written(placed(n, "n", "id").withColumn("block", F.shiftleft(F.length(F.bin("n")).cast("long"), 40) + F.floor(F.col("place") / each)), "keys")
    spans = lambda x: n.groupBy("block").agg(F.min("n").alias(f"{x}_lo"), F.max("n").alias(f"{x}_hi")).withColumnRenamed("block", x)
    near = (F.col("i_hi") * (2 - least) >= F.col("j_lo") * least - 1e-9) & (F.col("j_hi") * (2 - least) >= F.col("i_lo") * least - 1e-9)
    meet = written(spans("i").join(spans("j"), near & (F.col("i") <= F.col("j"))).select("i", "j", (F.greatest("i_hi", "j_hi") <= short).alias("short")), "blocks")

    def grouped(meet):
        wide = max(parts, min(meet.count(), 2000))
        dealt = lambda x: n.withColumnRenamed("block", x).join(F.broadcast(meet), x).select(*(F.col(c).alias(c) for c in ("i", "j", "id", "key"))).repartition(wide, "i", "j")
        return dealt("i").groupBy("i", "j").cogroup(dealt("j").groupBy("i", "j"))

    return grouped(meet.where("short").drop("short")), grouped(meet.where("not short").drop("short"))


def _candidates(pairs, least: float) -> DataFrame:
    """(a, b, ka, kb), a before b, of keys in pairs of blocks that share enough pairs of characters. Candidates go on to the next check in
    the same stage, so none is shuffled or written."""

    def run(key, left, right):
        same = key[0] == key[1]
        right = left if same else right
        x, y = left["key"].to_numpy(), right["key"].to_numpy()
        found = list(_sharing(x.tolist(), y.tolist(), least, same)) if len(x) and len(y) else []
        i, j = (np.concatenate(p) for p in zip((np.zeros(0, int), np.zeros(0, int)), *found))
        a, b, ka, kb = left["id"].to_numpy()[i], right["id"].to_numpy()[j], x[i], y[j]
        turned = a > b
        return pd.DataFrame({"a": np.where(turned, b, a), "b": np.where(turned, a, b), "ka": np.where(turned, kb, ka), "kb": np.where(turned, ka, kb)})

    return pairs.applyInPandas(run, "a long, b long, ka string, kb string")


def _alike_short(pairs, least: float) -> DataFrame:
    """alike for keys in pairs of blocks of short ones; what does not reach the limit stays in its task."""

    def run(key, left, right):
        same = key[0] == key[1]
        right = left if same else right
        none = (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0))
        i, j, score, back = (np.concatenate(p) for p in zip(none, *_near_short(left["key"].to_numpy(), right["key"].to_numpy(), least, same)))
        a, b = left["id"].to_numpy()[i], right["id"].to_numpy()[j]
        turned = a > b
        return pd.DataFrame({"a": np.where(turned, b, a), "b": np.where(turned, a, b), "score": np.where(turned, back, score), "back": np.where(turned, score, back)})

    return pairs.applyInPandas(run, "a long, b long, score double, back double")


def alike(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, score, back) of rows (id long, key string) with distinct keys, a before b, whose sequences match by `least` and more.

    The matcher treats its two sides unlike: score is the ratio of a's key to b's, back that of b's to a's; one of them reaches the limit.
    """
    short, others = _paired(rows, least)
    total = F.length("ka") + F.length("kb")
    most = (total - 2 * F.ceil(total * least / 2 - 1e-9)).cast("int")  # edits of texts with so many characters in common
    left = _candidates(others, least).withColumn("most", most).where("levenshtein(ka, kb, most) >= 0")

    def match(batches):
        for pdf in batches:
            out = []
            for a, b, x, y in zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["ka"].tolist(), pdf["kb"].tolist()):
                one = difflib.SequenceMatcher(None, x, y)
                if one.quick_ratio() >= least:
                    score, back = one.ratio(), difflib.SequenceMatcher(None, y, x).ratio()
                    if max(score, back) >= least:
                        out.append((a, b, score, back))
            yield pd.DataFrame(out, columns=["a", "b", "score", "back"]).astype({"a": "int64", "b": "int64", "score": float, "back": float})

    return _alike_short(short, least).unionByName(left.mapInPandas(match, "a long, b long, score double, back double"))


def longest_of_alike(rows: DataFrame, least: float = SAME) -> DataFrame:
    """U4: (pos, leader) of rows (pos, text) by falling length: each joins the first leader whose folded text its own matches.

    Texts of one folded form are one class, which its first row stands for; a row without letters or digits has no leader.
    """
    key = F.trim(F.regexp_replace(F.regexp_replace(texts.fold(F.col("text")), "[^a-z0-9 ]", " "), r"\s+", " "))
    r = ordered(rows.where("text is not null").select("pos", key.alias("key"), F.length("text").alias("n")).where("key <> ''"), F.desc("n"), "pos")
    classes = written(r.groupBy("key").agg(F.min("id").alias("id")), "classes")
    near = written(alike(classes, least).where(F.col("back") >= least).select("a", "b"), "alike")
    first = _first_leaders(near, settled(near))
    of = classes.join(first, F.col("id") == F.col("b"), "left").select("key", F.coalesce("to", "id").alias("to"))
    return r.join(of, "key").join(r.select(F.col("id").alias("to"), F.col("pos").alias("leader")), "to").select("pos", "leader")


def _first_leaders(near: DataFrame, state: DataFrame) -> DataFrame:
    """(b, to): the first leader among the earlier neighbours of each row that follows."""
    kept = near.join(state.where("leads").select("node"), F.col("a") == F.col("node"), "left_semi").join(state.where("not leads").select(F.col("node").alias("n")), F.col("b") == F.col("n"), "left_semi")
    return kept.groupBy("b").agg(F.min("a").alias("to"))


def _follows_shape(earlier: list[tuple]) -> bool | None:
    """A name leads unless one of the five leaders most like it has as many words: (state, score, rank of its text, same shape).

    A leader of its shape is among those five, or another of its shape is, where fewer than five of other shapes are or may become leaders more
    like it. So most names need not wait for all before them.
    """
    held = [x for x in earlier if x[0] >= 0]
    if not any(x[3] for x in held):
        return True
    others = sorted((x[1:3] for x in held if not x[3]), reverse=True)
    if any(x[0] == 1 and x[3] and (len(others) < 5 or x[1:3] > others[4]) for x in held):
        return False
    return None if any(x[0] == 0 for x in held) else True


def aligned(names: DataFrame, least: float = ALIGNED) -> DataFrame:
    """U8: (name, aligned) of distinct names by rising length, legal forms at their ends left out: of the five leaders most like a
    name (equals: the greater text first) the first with as many words; a name without one stands for itself."""
    ends = F.transform(F.reverse(F.split("name", " ")), lambda w: F.trim(w, F.lit(".")).isin(LEGAL_ENDS))
    kept = F.size(ends) - F.greatest(F.array_position(ends, False) - 1, F.lit(0))  # all words are kept where all are such ends but the first
    every = F.split(F.col("name"), " ")
    probe = F.array_join(F.slice(every, 1, F.when(F.array_contains(ends, False), kept).otherwise(1).cast("int")), " ")
    n = ordered(names.where("name is not null").select("name").distinct().select("name", probe.alias("key"), F.length("name").alias("n")), "n", "name")
    classes = ordered(n.select("key").distinct(), "key")
    n = written(n.join(classes.select("key", F.col("id").alias("c")), "key"), "names")
    # the matcher gets the earlier name first, and of two classes either may have it
    found = written(alike(classes, least), "alike")
    back = found.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("back").alias("score"))
    ways = found.select("a", "b", "score").unionByName(back).where(F.col("score") >= least).unionByName(classes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score")))
    words = F.size(F.split("key", " "))
    x, y = n.select(F.col("c").alias("a"), F.col("id").alias("x"), words.alias("wx")), n.select(F.col("c").alias("b"), F.col("id").alias("y"), words.alias("wy"))
    near = written(ways.join(x, "a").join(y, "b").where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), "score", F.col("a").alias("text_rank"), (F.col("wx") == F.col("wy")).alias("same")), "near")
    state = settled(near, _follows_shape, ("score", "text_rank", "same"))
    best = near.join(state.where("leads").select("node"), F.col("a") == F.col("node"), "left_semi").join(state.where("not leads").select(F.col("node").alias("n")), F.col("b") == F.col("n"), "left_semi")
    best = best.withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("score"), F.desc("text_rank")))).where("k <= 5 and same").groupBy("b").agg(F.min_by("a", "k").alias("to"))
    to = best.join(n.select(F.col("id").alias("to"), F.col("key").alias("aligned")), "to").select("b", "aligned")
    return n.join(to, F.col("id") == F.col("b"), "left").select("name", F.coalesce("aligned", "key").alias("aligned"))


def aliases(names: DataFrame) -> DataFrame:
    """(name, alias) of names (name, n), commonest first: the first commoner leader that holds all words of the name or whose words the
    name holds all, where a word of four letters is common to both.

    The words of one are among the other's, so both hold the rarest word of the smaller: a name is posted there, and others look it up by each of their words.
    """
    n = ordered(names.where("name is not null").groupBy("name").agg(F.sum("n").alias("n")), F.desc("n"), F.length("name"), "name")
    n = n.select("id", "name", F.array_distinct(texts.words(F.col("name"))).alias("toks")).where("size(toks) > 0")
    word = written(n.select("id", F.explode("toks").alias("w")), "words")
    often = word.groupBy("w").agg(F.count("*").alias("often"))
    rarest = word.join(often, "w").groupBy("id").agg(F.min(F.struct("often", "w")).alias("x")).select(F.col("id").alias("small"), F.col("x.w").alias("w"))
    met = rarest.join(word.withColumnRenamed("id", "large"), "w").where("small <> large").select("small", "large")
    met = met.join(n.select(F.col("id").alias("small"), F.col("toks").alias("ts")), "small").join(n.select(F.col("id").alias("large"), F.col("toks").alias("tl")), "large")
    held = met.where((F.size(F.array_except("ts", "tl")) == 0) & F.exists("ts", lambda w: F.length(w) >= 4))
    near = written(held.select(F.least("small", "large").alias("a"), F.greatest("small", "large").alias("b")).distinct(), "held")
    to = _first_leaders(near, settled(near)).join(n.select(F.col("id").alias("to"), F.col("name").alias("alias")), "to").select("b", "alias")
    return n.join(to, F.col("id") == F.col("b"), "left").select("name", F.coalesce("alias", "name").alias("alias"))


def _names(spark, at) -> DataFrame:
    return facts.entity_mentions(spark, at).select(F.col("canon").alias("name"), F.col("mentions").alias("n"))


def alias_names(spark, at):
    """U9 over the names of two mentions and more of all documents."""
    return aliases(_names(spark, at))


def aligned_names(spark, at):
    """U8 over the names of two mentions and more of all documents."""
    return aligned(_names(spark, at))


def longest_first(spark, at):
    """U4 over all benchmark items: leaders and their occurrences."""
    items = spark.read.parquet(f"{at}/benchmark.parquet").select(F.col("item_id").alias("pos"), "text")
    return longest_of_alike(items).groupBy("leader").agg(F.count("*").alias("occurrences"))


#: U9 as a fold over names in order: its state holds the leaders; the names that a name holds or is held by come from a join on words.
_N = "(SELECT name, toks, row_number() OVER (ORDER BY n DESC, length(name), name) AS k FROM (SELECT canon AS name, mentions AS n, string_split(canon, ' ') AS toks FROM (" + facts.ORACLES["entity_mentions"] + ") m) x)"
_W = f"(SELECT k, toks, unnest(list_distinct(toks)) AS w FROM {_N} n)"
_PAIRS = f"(SELECT DISTINCT a.k AS a, b.k AS b FROM {_W} a JOIN {_W} b ON a.w = b.w AND a.k < b.k WHERE length(a.w) >= 4 AND len(list_intersect(a.toks, b.toks)) = least(len(list_distinct(a.toks)), len(list_distinct(b.toks))))"
_LED = f"""(SELECT unnest(list_reduce(list({{'k': n.k, 'near': coalesce(p.near, [])}} ORDER BY n.k), lambda s, x: CASE WHEN len(list_intersect(s.near, x.near)) = 0 THEN {{'k': x.k, 'near': list_append(s.near, x.k)}} ELSE s END,
    {{'k': cast(-1 AS bigint), 'near': cast([] AS bigint[])}}).near) AS k FROM {_N} n LEFT JOIN (SELECT b, list(a) AS near FROM {_PAIRS} p GROUP BY b) p ON p.b = n.k)"""
_ALIASES = f"""SELECT n.name, coalesce(t.name, n.name) AS alias FROM {_N} n LEFT JOIN (SELECT b, min(a) AS a FROM {_PAIRS} p WHERE a IN (SELECT k FROM {_LED} l) AND b NOT IN (SELECT k FROM {_LED} l) GROUP BY b) f ON f.b = n.k LEFT JOIN {_N} t ON t.k = f.a"""
QUERIES = {f.__name__: f for f in (alias_names, aligned_names, longest_first)}
ORACLES = {"alias_names": _ALIASES}
