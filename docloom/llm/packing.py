"""Best-fit packing by sum of squares.

Only a document's first piece may be shorter than the capacity; all others fill a sequence. Short pieces are dealt into groups
of about GROUP documents by a hash of the id, the piece and how often a task met it before; each group takes its pieces from the
longest, and places each in the open bin, among those it fits, whose choice makes the sum over gaps of squared counts of open bins
smallest (ties: the smaller gap left); a bin is opened where none fits. Null text is empty, and an empty text is its end token
alone. Rows without an id and repeated rows are packed each; however many alike there are, they are dealt over all groups.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, END, GROUP = 1024, 2, 20_000
_CODER: dict = {}


def _coder(ranks: str):
    """The coder of the rank file, and the pattern and ids of the added tokens in the JSON file beside it (longest first)."""
    import base64
    import json

    import public_tokenizers as P
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(ranks.removesuffix(".tiktoken") + ".json", encoding="utf-8") as f:
        added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={}), cut, added


def encode(text: str | None, ranks: str) -> np.ndarray:
    """Byte-level ids, as the JSON file of the vocabulary gives them; its added tokens are one id each wherever they stand."""
    if ranks not in _CODER:
        _CODER[ranks] = _coder(ranks)
    coder, cut, added = _CODER[ranks]
    ids = []
    for k, part in enumerate(cut.split(text or "") if cut else [text or ""]):
        ids += [added[part]] if k % 2 else coder.encode_ordinary(part)
    return np.array([*ids, END], "<u4")


def place(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, all within 1..capacity."""
    count = np.zeros(capacity + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, n = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        # the sum grows by 2 (count of the gap left - count of the gap taken) + 2, and by one less where the bin is filled
        grown = 2 * (count[: capacity + 1 - s] - count[s:])
        grown[0] -= 1
        cost = np.where(count[s:] > 0, grown, 1 << 60)
        g = int(np.argmin(cost)) + s
        if count[g]:
            b = bins[g].pop()
            count[g] -= 1
        else:
            b, g, n = n, capacity, n + 1
        where[i], offset[i] = b, capacity - g
        if g > s:
            bins[g - s].append(b)
            count[g - s] += 1
    return where, offset


def pack(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    groups = max(1, docs.count() // GROUP)

    def cut(batches):
        met: dict[int, int] = {}
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["i"].tolist(), pdf["t"].tolist()):
                ids = encode(t, ranks)
                first = len(ids) % capacity or capacity
                for k, s in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[s : first if not k else s + capacity]
                    crc = zlib.crc32(part.tobytes())
                    what = zlib.crc32(f"{i}/{k}".encode(), crc)
                    met[what] = again = met.get(what, -1) + 1
                    rows.append((i, k, s, len(part), crc, again))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "again"])

    def fill(pdf):
        pdf = pdf.sort_values(["doc_id", "ids_crc32", "piece"], ignore_index=True)
        b, o = place(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=b + pdf["g"].to_numpy().astype("int64") * (1 << 40), offset=o).drop(columns=["g", "again"])

    kind = "doc_id string, piece int, start long, length long, ids_crc32 long"
    pieces = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).mapInPandas(cut, kind + ", again long").withColumn("g", F.pmod(F.xxhash64("doc_id", "length", "ids_crc32", "again"), F.lit(groups)))
    return pieces.groupBy("g").applyInPandas(fill, kind + ", sequence_id long, offset long").withColumn("doc_id", F.col("doc_id").cast("long"))
