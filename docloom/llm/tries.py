"""Conversation prefix trie, built level by level.

At each depth the conversations still live are grouped by (parent node, next turn); a node is named by the smallest conv_id that
passes through it, so (depth, conv_id) is its key. A conversation that is alone in its node leaves the loop: the rest of it is a
chain of nodes of its own, found by one join at the end. So there are as many rounds as the longest beginning that two
conversations share. Then joins from the deepest level up add up children, leaves and savings.

Hot keys: groups and sums are made by partial aggregation. A conversation finds its node by a join on (parent node, turn) in which
the keys of over a HEAVY-th of the live conversations, fewer than HEAVY of them, are broadcast and leave the shuffle. Turns are
numbered by ranges of (conv_id, turn), so that one conversation may span many partitions. The ids that end in one node are
joined to text in pieces, also by ranges; one task then hashes a node's pieces in order as they stream by.

Turns stand in order of turn (null first), then role, then text, so repeated rows are turns of their own. A null role or text is
empty. Rows without a conv_id take no part; without conversations there is no node. Turns are compared by the SHA-256 of the role's
length, role and text. No other column is read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.shared import written

HEAVY = 1000
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _keyed(left: DataFrame, right: DataFrame, on: list, total: int) -> DataFrame:
    """left joined to right, a written table of one row a key whose n says how many of left's `total` rows have the key."""
    heavy, light = right.where(F.col("n") * HEAVY > total), right.where(F.col("n") * HEAVY <= total)
    rest = left.join(F.broadcast(heavy.select(on)), on, "left_anti")
    return left.join(F.broadcast(heavy), on).unionByName(rest.join(light, on))


def _all(tables: list[DataFrame]) -> DataFrame:
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(f for t in tables for f in t.inputFiles()))


def placed(conversations: DataFrame, id_col="conv_id", turn_col="turn", role_col="role", text_col="text", graft: int = 0, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(c, place, mark, words, size) of all turns, places from 1, and (c, size) of all conversations.

    With graft, conversation c begins with the first h turns of conversation c - c % graft (all of them, if fewer) in place of
    its own first h, where h is crc32 of the decimal c modulo heads; it may be left without turns.
    """
    spark = conversations.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    dealt = rows.repartitionByRange(parts, "c", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("c", "turn", "role", "text")
    mark = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = written(dealt.select("c", F.monotonically_increasing_id().alias("at"), mark.alias("mark"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")).withColumn("part", F.shiftright("at", 33)), "turns")
    runs = rows.groupBy("c", "part").agg(F.min("at").alias("low"), F.count("*").alias("rows"))
    one = Window.partitionBy("c")
    runs = written(runs.select("c", "part", "low", F.coalesce(F.sum("rows").over(one.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("rows").over(one).alias("own")), "runs")
    convs = runs.groupBy("c").agg(F.first("own").alias("own"))
    if graft:
        base = convs.select(F.col("c").alias("base"), F.col("own").alias("there"))
        convs = convs.withColumns({"base": F.col("c") - F.col("c") % graft, "h": F.crc32(F.col("c").cast("string")) % heads}).join(base, "base", "left")
        convs = convs.withColumn("lead", F.least("h", F.coalesce("there", F.lit(0)))).withColumn("size", F.col("lead") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    else:
        convs = convs.select("*", F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("lead"), F.col("own").alias("size"))
    convs = written(convs, "conversations")
    found = rows.join(runs.join(convs.select("c", "h", "lead", "size"), "c"), ["c", "part"])
    found = found.select("c", (F.col("at") - F.col("low") + F.col("before") + 1).alias("place"), "mark", "words", "size", "h", "lead")
    turns = found.where("place > h").select("c", (F.col("place") - F.col("h") + F.col("lead")).alias("place"), "mark", "words", "size")
    if graft:
        first = found.where((F.col("c") % graft == 0) & (F.col("place") < heads)).select(F.col("c").alias("base"), "place", "mark", "words")
        turns = turns.unionByName(convs.where("lead > 0").select("c", "base", "lead", "size").join(first, "base").where("place <= lead").select("c", "place", "mark", "words", "size"))
    turns = written(turns.repartitionByRange(parts, "place", "c").sortWithinPartitions("place", "c"), "placed")
    return turns, convs.select("c", "size")


def _pieces(batches):
    """Runs of ids that end in one node, comma-joined; ids come in order."""
    for b in batches:
        depth, node, c = (b.column(k).to_numpy() for k in range(3))
        if len(c):
            cut = np.flatnonzero(np.append(True, (depth[1:] != depth[:-1]) | (node[1:] != node[:-1])))
            ids = pc.cast(b.column(2), pa.string()).to_pylist()
            yield pa.RecordBatch.from_pydict({"depth": depth[cut], "node": node[cut], "low": c[cut], "piece": [",".join(ids[x:y]) for x, y in zip(cut, [*cut[1:], len(c)])]})


def _digests(batches):
    """The hash of each node's pieces, which come in order; only the present node's hash is held."""
    now, state = None, None
    for b in batches:
        out = []
        for depth, node, piece in zip(*(b.column(k).to_pylist() for k in (0, 1, 3))):
            if (depth, node) == now:
                state.update(b",")
            else:
                if now:
                    out.append((*now, state.hexdigest()))
                now, state = (depth, node), hashlib.sha256()
            state.update(piece.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["depth", "node", "ends"])
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], ["depth", "node", "ends"])


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node (see NODE) of the trie of turns (c, place, mark, words, size) of conversations (c, size)."""
    spark = turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total, root, size = convs.agg(F.count("*"), F.min("c"), F.sum("size")).first()
    if not total:
        return spark.createDataFrame([], NODE)
    at = lambda depth: turns.where(F.col("place") == depth).select("c", "mark", "words", "size")
    step, levels, ended, live = at(1).withColumn("node", F.lit(root).cast("long")), [], [], total
    while True:
        depth = len(levels) + 1
        groups = step.groupBy("node", "mark").agg(F.min("c").alias("first"), F.count("*").alias("n"), F.max("words").alias("words"), F.max("size").alias("size"))
        levels.append(written(groups.select("*", F.lit(depth).cast("long").alias("depth")), "level"))
        shared = levels[-1].where("n > 1")
        more = shared.agg(F.sum("n")).first()[0]
        if not more:
            break
        stay = written(_keyed(step, shared.select("node", "mark", "first", "n"), ["node", "mark"], live).select("c", F.col("first").alias("node"), "size", F.lit(depth).cast("long").alias("depth")), "live")
        ended.append(stay)
        step, live = at(depth + 1).join(stay.select("c", "node"), "c"), more
    sums, nodes = None, []
    for level in reversed(levels):
        own = level.where("n > 1").select("depth", "node", "first", "n", "words")
        if sums is not None:
            own = own.join(sums, F.col("first") == F.col("above"), "left")
        else:
            own = own.select("*", *(F.lit(None).cast("long").alias(x) for x in ("above", "children", "leaves", "saved")))
        own = own.select("depth", "node", "first", "n", F.coalesce("children", F.lit(0)).cast("long").alias("children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("words") + F.coalesce("saved", F.lit(0))).cast("long").alias("saved"))
        nodes.append(written(own, "nodes"))
        lone = level.where("n = 1").select("node", F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
        both = nodes[-1].select("node", "leaves", "saved").unionByName(lone)
        sums = both.groupBy(F.col("node").alias("above")).agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    top = sums.agg(F.coalesce(F.sum("children"), F.lit(0)).alias("children"), F.coalesce(F.sum("leaves"), F.lit(1)).alias("leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"))
    top = top.select(F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("node"), F.lit(root).cast("long").alias("first"), F.lit(total).cast("long").alias("n"), "children", "leaves", "saved")
    ends = convs.where("size = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("node"), "c")
    if ended:
        ends = ends.unionByName(_all(ended).where("depth = size").select("depth", "node", "c"))
    pieces = ends.repartitionByRange(parts, "depth", "node", "c").sortWithinPartitions("depth", "node", "c").mapInArrow(_pieces, "depth long, node long, low long, piece string")
    hashed = pieces.repartition(parts, "depth", "node").sortWithinPartitions("depth", "node", "low").mapInArrow(_digests, "depth long, node long, ends string")
    none = hashlib.sha256(b"").hexdigest()
    many = _all(nodes).unionByName(top).join(hashed.select(F.col("depth").alias("of"), F.col("node").alias("end"), "ends"), (F.col("depth") == F.col("of")) & (F.col("first") == F.col("end")), "left")
    many = many.select(F.col("first").alias("conv_id"), "depth", F.col("node").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(none)).alias("ends_sha256"))
    alone = _all(levels).where("n = 1").select(F.col("first").alias("c"), F.col("depth").alias("since"), "node", F.col("size").alias("n"))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    chain = _keyed(turns.select("c", "place", "size"), alone, ["c"], size).where("place >= since")
    chain = chain.select(F.col("c").alias("conv_id"), F.col("place").alias("depth"), F.when(F.col("place") == F.col("since"), F.col("node")).otherwise(F.col("c")).alias("parent_conv_id"), one.alias("n_convs"), (F.col("place") < F.col("size")).cast("long").alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
                         F.when(F.col("place") == F.col("size"), F.sha2(F.col("c").cast("string"), 256)).otherwise(none).alias("ends_sha256"))
    return many.unionByName(chain)
