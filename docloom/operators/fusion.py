"""Fusion of near-duplicate rows into leaders, over whole tables.

A greedy pass in a given order makes a row a leader unless an earlier leader is near enough. Rows get ids in that order, and the near
pairs are dealt by ranges of the later row's id. In a round each range is folded in order: a row is settled once all of its earlier
neighbours are, also by rows of its own range just before. The first range that is left always settles whole, and chains within
a range cost no round, so there are no more rounds than ranges. So U3, U4, U6, U8 and U9 are joins and a few rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import plain, texts
from docloom.functions.tables import given, written
from docloom.operators.numbering import placed

#: Near pairs that one range holds, and ranges at least, where there are as many shuffle partitions.
RANGE_PAIRS, RANGES = 2_000_000, 16
#: Tokens and rows that a block of sets holds; counts, and candidates, that a task holds at once.
BLOCK_TOKENS, BLOCK_ROWS, CELLS, PAIRS = 2_000_000, 16_384, 2_000_000, 100_000


def ordered(df: DataFrame, *keys, name: str = "id") -> DataFrame:
    """df with ids that rise in the order of keys; distinct, but not without gaps. Written, so that they stay."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id()), "ordered")


def any_leader(earlier: list[tuple]) -> bool | None:
    """Whether a row leads, from (state, ...) of its earlier neighbours: state 1 leads, -1 follows, 0 is open. None: not known yet."""
    states = {x[0] for x in earlier}
    return False if 1 in states else None if 0 in states else True


def settled(pairs: DataFrame, leads=any_leader, facts: tuple = ()) -> DataFrame:
    """(node, leads) of all nodes of pairs (a, b, ...) of longs, where a stands before b; a node without an earlier one leads.

    leads(earlier) gets (state, *facts of the pair) of each earlier neighbour of a node and says whether it leads. Neighbours that follow
    do not count, so their pairs go after each round, but for one of each node.
    """
    spark = pairs.sparkSession
    state = F.lit(1).cast("int")
    pairs = written(pairs.where("a < b"), "near")
    ranges = max(min(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-pairs.count() // RANGE_PAIRS))
    roots = written(pairs.select(F.col("a").alias("node")).distinct().join(pairs.select(F.col("b").alias("node")).distinct(), "node", "left_anti").select("node", F.lit(True).alias("leads")), "settled")
    done = [roots]
    e = pairs.join(roots, F.col("a") == F.col("node"), "left").select(*pairs.columns, F.when(F.col("leads"), state).otherwise(0).alias("state"))
    e = e.repartitionByRange(ranges, "b").withColumn("first", F.col("a") == F.min("a").over(Window.partitionBy("b")))
    e = written(e.withColumn("range", F.spark_partition_id()), "near")

    def fold(batches):
        """Pairs in order of b, then a. Holds the states of this range's settled nodes, and the pairs of one node."""
        known, now, earlier = {}, None, []

        def told():
            said = leads(earlier)
            if said is not None:
                known[now] = 1 if said else -1
                return [(now, said)]
            return []

        for pdf in batches:
            out = []
            for a, b, s, *more in zip(*(pdf[c].tolist() for c in ("a", "b", "state", *facts))):
                if b != now:
                    out += told() if now is not None else []
                    now, earlier = b, []
                earlier.append((s or known.get(a, 0), *more))
            yield pd.DataFrame(out, columns=["node", "leads"]).astype({"node": "int64", "leads": bool})
        if now is not None:
            yield pd.DataFrame(told(), columns=["node", "leads"]).astype({"node": "int64", "leads": bool})

    while not e.isEmpty():
        new = e.repartition(ranges, "range").sortWithinPartitions("b", "a").mapInPandas(fold, "node long, leads boolean")
        done.append(written(new, "settled"))
        e = e.join(done[-1].select(F.col("node").alias("b")), "b", "left_anti").join(done[-1], F.col("a") == F.col("node"), "left")
        e = e.select(*pairs.columns, "first", "range", F.when(F.col("state") != 0, F.col("state")).when(F.col("leads"), 1).when(~F.col("leads"), -1).otherwise(0).cast("int").alias("state"))
        e = written(e.where("state >= 0 or first"), "near")
    return spark.read.schema(roots.schema).parquet(*(f for d in done for f in d.inputFiles()))


def leaders(edges: DataFrame) -> DataFrame:
    """The leading nodes among those of edges (a, b) of longs, where a stands before b in the order."""
    return settled(edges.select("a", "b").where("a < b").distinct()).where("leads").select("node")


def _coded(sets: DataFrame) -> DataFrame:
    """Rows (c, toks, ...) with tokens as numbers, the rarest first, their count m, and their block among rows of like counts."""
    keep = [x for x in sets.columns if x != "toks"]
    word = sets.select(*keep, F.explode(F.array_distinct("toks")).alias("t"))
    number = placed(word.groupBy("t").agg(F.count("*").alias("n")), "n", "t", name="w").select("t", F.col("w").cast("int"))
    rows = word.join(number, "t").groupBy(*keep).agg(F.array_sort(F.collect_list("w")).alias("toks")).withColumn("m", F.size("toks"))
    bits = F.length(F.bin("m"))
    rows_each = F.greatest(F.least(F.lit(BLOCK_ROWS), F.lit(BLOCK_TOKENS) / F.pow(F.lit(2), bits)), F.lit(1))
    block = F.shiftleft(bits.cast("long"), 40) + F.floor(F.col("place") / rows_each)
    return written(placed(rows, "m", "c").withColumn("block", block).drop("place"), "coded")


def _near(a: list, b: list, least: float, same: bool) -> Iterator[tuple]:
    """(rows of a, rows of b, scores) of sets of numbers that reach the limit, some rows of a at a time; for a set with itself the
    later rows of b only.

    A row of n tokens shares n * least with any that it reaches. Half of that many, the commonest, are left out at first; whoever
    shares the other half among the rest is counted whole.
    """
    ma, mb, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b]), len(b)
    ta, tb = np.concatenate(a), np.concatenate(b)
    words, col = np.unique(tb, return_inverse=True)
    held = np.repeat(np.arange(nb), mb)
    order = np.argsort(col, kind="stable")
    post, start = held[order], np.searchsorted(col[order], np.arange(len(words) + 1))
    held = held * len(words) + col  # rises, as the tokens of a row do
    at = np.minimum(np.searchsorted(words, ta), len(words) - 1)
    own, hit = np.repeat(np.arange(len(a)), ma), words[at] == ta
    need = np.ceil(ma * least - 1e-9).astype(int)
    spare = need // 2
    head = np.arange(len(ta)) - np.repeat(np.cumsum(ma) - ma, ma) < (ma - spare)[own]
    own_t, at_t = own[hit & ~head], at[hit & ~head]
    own, at = own[hit & head], at[hit & head]
    many = start[at + 1] - start[at]
    upto = np.cumsum(np.bincount(own, many, len(a)))
    first, first_t = (np.searchsorted(x, np.arange(len(a) + 1)) for x in (own, own_t))
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, min(lo + max(1, CELLS // nb), int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CELLS))))
        w, n, o = at[first[lo] : first[hi]], many[first[lo] : first[hi]], own[first[lo] : first[hi]]
        cell = np.repeat((o - lo) * nb, n) + post[np.repeat(start[w] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        met = np.bincount(cell, minlength=(hi - lo) * nb).reshape(hi - lo, nb)
        i, j = np.nonzero(met >= (need - spare)[lo:hi, None])
        both, i = met[i, j], i + lo
        kept = both + spare[i] >= np.ceil((ma[i] + mb[j]) * (least / (1 + least)) - 1e-9)
        kept &= (i < j) if same else True
        i, j, both = i[kept], j[kept], both[kept]
        for k in range(0, len(i), PAIRS):
            x, y = i[k : k + PAIRS], j[k : k + PAIRS]
            n = first_t[x + 1] - first_t[x]
            pair = np.repeat(np.arange(len(x)), n)
            seek = y[pair] * len(words) + at_t[np.repeat(first_t[x] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            found = held[np.minimum(np.searchsorted(held, seek), len(held) - 1)] == seek
            shared = both[k : k + PAIRS] + np.bincount(pair, found, len(x)).astype(int)
            score = shared / (ma[x] + mb[y] - shared)
            fine = score >= least
            yield x[fine], y[fine], score[fine]
        lo = hi


def _by_blocks(left: DataFrame, right: DataFrame, least: float, same: bool, best: bool) -> DataFrame:
    """(x, y, score) of coded rows of two sides that reach the limit or, for best, (x, score) of each block's best. A task has two blocks whose
    counts are near enough; pairs that do not reach the limit stay in it."""
    spans = lambda d, n: d.groupBy("block").agg(F.min("m").alias(f"{n}_lo"), F.max("m").alias(f"{n}_hi")).withColumnRenamed("block", n)
    meet = (F.col("i_hi") >= F.col("j_lo") * F.lit(least) - 1e-9) & (F.col("j_hi") >= F.col("i_lo") * F.lit(least) - 1e-9)
    meet = written(spans(left, "i").join(spans(right, "j"), meet & (F.col("i") <= F.col("j") if same else F.lit(True))).select("i", "j"), "blocks")
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(meet.count(), 2000))
    dealt = lambda d, n: d.withColumnRenamed("block", n).join(F.broadcast(meet), n).select(*(F.col(x).alias(x) for x in ("i", "j", "c", "toks"))).repartition(parts, "i", "j")

    def run(key, a, b):
        inside = same and key[0] == key[1]
        b = a if inside else b
        x, y = a["c"].to_numpy(), b["c"].to_numpy()
        if not len(x) or not len(y):
            return pd.DataFrame({"x": x[:0], "score": np.zeros(0)} if best else {"x": x[:0], "y": y[:0], "score": np.zeros(0)})
        found = _near(a["toks"].tolist(), b["toks"].tolist(), least, inside)
        if best:
            top = np.zeros(len(x))
            for i, _, score in found:
                np.maximum.at(top, i, score)
            return pd.DataFrame({"x": x[top > 0], "score": top[top > 0]})
        i, j, score = (np.concatenate(p) for p in zip((np.zeros(0, int), np.zeros(0, int), np.zeros(0)), *found))
        return pd.DataFrame({"x": x[i], "y": y[j], "score": score})

    kind = left.schema["c"].dataType.simpleString()
    return dealt(left, "i").groupBy("i", "j").cogroup(dealt(right, "j").groupBy("i", "j")).applyInPandas(run, f"x {kind}, score double" if best else f"x {kind}, y {kind}, score double")


def jaccard_pairs(sets: DataFrame, least: float) -> DataFrame:
    """(a, b, score) of classes (c, toks) whose sets reach the Jaccard limit, a < b."""
    rows = _coded(sets.select("c", "toks"))
    return _by_blocks(rows, rows, least, True, False).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")


def fused(items: DataFrame, least: float = 0.72, best: bool = True) -> DataFrame:
    """U3 (best leader) and U6 (first leader): (pos, leader, score) of rows (pos, toks) in the order of pos, which is any ordered type.

    Rows of equal sets are one class, so copies cost no pairs; a row without tokens leads itself.
    """
    rows = ordered(items.select(F.col("pos").alias("was"), "toks"), "was", name="pos")
    found = _fused(rows.select("pos", "toks"), least, best)
    named = rows.select(F.col("pos").alias("at"), "was")
    found = found.join(named, F.col("pos") == F.col("at")).select(F.col("was").alias("own"), "leader", "score")
    return found.join(named, F.col("leader") == F.col("at")).select(F.col("own").alias("pos"), F.col("was").alias("leader"), "score")


def _fused(items: DataFrame, least: float, best: bool) -> DataFrame:
    told = written(items.where(F.size("toks") > 0).groupBy("toks").agg(F.min("pos").alias("c")), "classes")
    pairs = written(jaccard_pairs(told, least), "pairs")
    lead = leaders(pairs).withColumnRenamed("node", "leader")
    lone = told.select("c").join(pairs.select(F.explode(F.array("a", "b")).alias("c")), "c", "left_anti").select(F.col("c").alias("leader"))
    lead = lead.unionAll(lone)
    both = pairs.select(F.col("a").alias("c"), F.col("b").alias("leader"), "score").unionAll(pairs.select(F.col("b").alias("c"), F.col("a").alias("leader"), "score")).unionAll(told.select("c", F.col("c").alias("leader"), F.lit(1.0).alias("score")))
    choices = both.join(lead, "leader", "left_semi")
    member = items.where(F.size("toks") > 0).join(told, "toks").select("pos", "c").join(choices, "c").where("leader <= pos")
    order = F.struct((-F.col("score") if best else F.lit(0.0)).alias("s"), "leader")
    chosen = member.groupBy("pos").agg(F.min(F.when(F.col("leader") == F.col("pos"), F.struct(F.lit(-9.0).alias("s"), "leader")).otherwise(order)).alias("x"), F.min_by("score", order).alias("score"))
    return chosen.select("pos", "x.leader", F.when(F.col("x.leader") == F.col("pos"), F.lit(1.0)).otherwise(F.col("score")).alias("score")).unionAll(items.where(F.size("toks") == 0).select("pos", F.col("pos").alias("leader"), F.lit(1.0)))


def best_matches(references: DataFrame, predictions: DataFrame, least: float) -> DataFrame:
    """For each reference (r, toks) the highest Jaccard of any prediction (p, toks), where it reaches the limit."""
    every = references.select(F.concat(F.lit("r"), F.to_json(F.struct("r"))).alias("c"), "toks").unionAll(predictions.select(F.concat(F.lit("p"), F.to_json(F.struct("p"))).alias("c"), "toks")).where(F.size("toks") > 0)
    side = lambda n: F.max(F.substring("c", 1, 1) == n).alias(f"of_{n}")
    one = written(every.groupBy("toks").agg(F.min("c").alias("c"), side("r"), side("p")), "sets")
    rows = _coded(one)
    ways = _by_blocks(rows.where("of_r and not of_p"), rows.where("of_p"), least, False, True).unionAll(one.where("of_r and of_p").select("c", F.lit(1.0)))
    ways = ways.groupBy("x").agg(F.max("score").alias("score"))
    named = references.where(F.size("toks") > 0).join(one, "toks").select("r", F.col("c").alias("x"))
    return named.join(ways, "x").select("r", "score")


def _turns(spark, at, role=None):
    t = spark.read.parquet(f"{at}/conversations.parquet").where("text is not null")
    t = t.where(F.col("role") == role) if role else t
    return t.select(F.struct("conv_id", "turn").alias("pos"), texts.tokens(F.col("text")).alias("toks"))


def _requirements(spark):
    return given(spark, REQUIREMENTS, "pos long, text string").select("pos", texts.tokens(F.col("text")).alias("toks"))


def fused_turns(spark, at):
    """U3 over all turns of all conversations."""
    return fused(_turns(spark, at)).select("pos.conv_id", "pos.turn", F.col("leader.conv_id").alias("leader_conv"), F.col("leader.turn").alias("leader_turn"), F.round("score", 6).alias("score"))


def fused_requirements(spark, at):
    """U3 over the requirement rows below."""
    return fused(_requirements(spark)).select("pos", "leader", F.round("score", 6).alias("score"))


def distinct_requirements(spark, at):
    """The rows that no earlier kept row comes near."""
    return fused(_requirements(spark), best=False).where("pos = leader").select("pos")


def turn_matches(spark, at):
    """Shares of user turns that an assistant turn comes near, at three limits."""
    refs = _turns(spark, at, "user").withColumnRenamed("pos", "r")
    got = best_matches(refs, _turns(spark, at, "assistant").withColumnRenamed("pos", "p"), 0.35)
    share = lambda s: F.round(F.sum((F.coalesce("score", F.lit(0.0)) >= s).cast("int")) / F.count("*"), 6)
    return refs.select("r").join(got, "r", "left").agg(F.count("*").alias("n"), share(0.35).alias("at_35"), share(0.45).alias("at_45"), share(0.60).alias("at_60"))


def requirement_recall(spark, at):
    """J8, A26 on the requirement rows: even rows are references, odd ones predictions."""
    r = _requirements(spark)
    refs = r.where("pos % 2 = 0").withColumnRenamed("pos", "r")
    got = best_matches(refs, r.where("pos % 2 = 1").withColumnRenamed("pos", "p"), 0.35)
    return refs.select("r").join(got, "r", "left").select("r", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"), *((F.coalesce("score", F.lit(0.0)) >= s).alias(f"at_{int(s * 100)}") for s in (0.35, 0.45, 0.60)))


def category_first(spark, at):
    """Of requirements with the same words in order the first."""
    r = given(spark, REQUIREMENTS, "pos long, text string").withColumn("key", F.array_join(texts.words(F.regexp_replace(texts.fold(F.col("text")), "[^a-z0-9 ]", " ")), " "))
    return r.groupBy("key").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))


REQUIREMENTS = list(enumerate([
    "The bidder must provide five certified network engineers", "Five certified network engineers must be provided", "Certified network engineers: five", "", "Response time under four hours for severity one",
    "Response time below four hours for severity one incidents", "Monthly reports in PDF format", "monthly reports in pdf format!", "Monthly réports in PDF format", "Two years of warranty on all hardware parts and labour",
    "Three years of warranty on all hardware parts and labour", "Warranty on hardware parts and labour", "Backups are encrypted at rest", "Backups are encrypted in transit and at rest", "Encrypted backups at rest and in transit and offsite",
    "Five certified network engineers and one manager", "Two years of warranty on all hardware parts and labor", "The of and", "Audit logs kept for ten years", "Audit logs are kept for ten years", "Audit logs kept ten years",
]))
_T = f"(SELECT conv_id * 1000000 + turn AS pos, conv_id, turn, role, {plain.tokens('text')} AS toks FROM conversations WHERE text IS NOT NULL)"
_R = f"(SELECT pos, text, {plain.tokens('text')} AS toks FROM {plain.values(REQUIREMENTS, 'pos long, text string')} r)"


def _greedy(items: str, best: bool) -> str:
    """A fold over rows in order; its state holds the leaders so far."""
    near = f"SELECT b.pos, list(a.pos ORDER BY a.pos) AS near FROM {items} a JOIN {items} b ON a.pos < b.pos AND {plain.jaccard('a.toks', 'b.toks')} >= 0.72 GROUP BY b.pos"
    led = f"""(SELECT unnest(list_reduce(list({{'pos': i.pos, 'near': coalesce(n.near, [])}} ORDER BY i.pos), lambda a, x: CASE WHEN len(list_intersect(a.near, x.near)) = 0 THEN {{'pos': x.pos, 'near': list_append(a.near, x.pos)}} ELSE a END,
        {{'pos': cast(-1 AS bigint), 'near': cast([] AS bigint[])}}).near) AS leader FROM {items} i LEFT JOIN ({near}) n ON i.pos = n.pos)"""
    order = f"{plain.jaccard('i.toks', 'k.toks')} DESC, k.pos" if best else "k.pos"
    return f"""(SELECT pos, leader, score FROM (SELECT i.pos, k.pos AS leader, CASE WHEN i.pos = k.pos THEN 1.0 ELSE {plain.jaccard('i.toks', 'k.toks')} END AS score,
        row_number() OVER (PARTITION BY i.pos ORDER BY CASE WHEN i.pos = k.pos THEN 0 ELSE 1 END, {order}) AS place FROM {items} i JOIN (SELECT x.pos, x.toks FROM {items} x JOIN {led} l ON x.pos = l.leader) k
        ON k.pos = i.pos OR (k.pos < i.pos AND {plain.jaccard('i.toks', 'k.toks')} >= 0.72)) c WHERE place = 1)"""


_SHARE = "round(sum(CASE WHEN score >= {0} THEN 1 ELSE 0 END) / count(*), 6) AS at_{1}".format
_BEST = "(SELECT r.pos AS r, coalesce(max({j}), 0.0) AS score FROM {refs} r LEFT JOIN {preds} p ON true GROUP BY r.pos)"
_KEY = f"trim(regexp_replace(regexp_replace({plain.fold('text')}, '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


QUERIES = {f.__name__: f for f in (fused_turns, fused_requirements, distinct_requirements, turn_matches, requirement_recall, category_first)}
ORACLES = {
    "fused_turns": f"SELECT pos // 1000000 AS conv_id, pos % 1000000 AS turn, leader // 1000000 AS leader_conv, leader % 1000000 AS leader_turn, round(score, 6) AS score FROM {_greedy(_T, True)} g",
    "fused_requirements": f"SELECT pos, leader, round(score, 6) AS score FROM {_greedy(_R, True)} g",
    "distinct_requirements": f"SELECT pos FROM {_greedy(_R, False)} g WHERE pos = leader",
    "turn_matches": f"SELECT count(*) AS n, {_SHARE(0.35, 35)}, {_SHARE(0.45, 45)}, {_SHARE(0.60, 60)} FROM " + _BEST.format(j=plain.jaccard("r.toks", "p.toks"), refs=f"(SELECT * FROM {_T} t WHERE role = 'user')", preds=f"(SELECT * FROM {_T} t WHERE role = 'assistant')") + " b",
    "requirement_recall": "SELECT r, CASE WHEN score >= 0.35 THEN round(score, 6) ELSE 0.0 END AS score, score >= 0.35 AS at_35, score >= 0.45 AS at_45, score >= 0.60 AS at_60 FROM " + _BEST.format(j=plain.jaccard("r.toks", "p.toks"), refs=f"(SELECT * FROM {_R} t WHERE pos % 2 = 0)", preds=f"(SELECT * FROM {_R} t WHERE pos % 2 = 1)") + " b",
    "category_first": f"SELECT {_KEY} AS key, min(pos) AS pos, count(*) AS n FROM {_R} r GROUP BY ALL",
}
