"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents are dealt into groups of bounded size by the hash of their id, and each group is packed by itself: items in
falling order go to the open bin that they fill best; where none has room, the bin size of least cost for a token opens;
in the end every bin is cut down to the least permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logoscope.llm.shared import written

#: Permitted lengths; the cost of a sequence of length c is c + OVERHEAD + c * c / ATTENTION.
CAPACITIES = (2048, 4096, 8192, 16384)
OVERHEAD, ATTENTION = 64.0, 262144.0
#: Items that are packed together: enough to fill bins well, few enough for one task.
GROUP_ITEMS = 20_000


def cost(capacity: int) -> float:
    return capacity + OVERHEAD + capacity * capacity / ATTENTION


def best_fit(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int]]:
    """(bin of each item, capacity of each bin). Items longer than the largest capacity aren't allowed."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    rest = sum(lengths)
    room: list[tuple[int, int]] = []  # (free, bin), ascending
    used: list[int] = []
    placed = [0] * len(lengths)
    for i in order:
        n = lengths[i]
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, where = room.pop(at)
        else:
            # of what is still to come, a bin can be filled up; the cost for each token that it would hold decides
            _, size = min((cost(c) / (n + min(c - n, rest - n)), c) for c in capacities if c >= n) if n else (0, capacities[0])
            free, where = size, len(used)
            used.append(0)
        placed[i] = where
        used[where] += n
        rest -= n
        if free > n:
            insort(room, (free - n, where))
    return placed, [next(c for c in capacities if c >= u) for u in used]


def pack(docs: DataFrame, length, capacities: tuple[int, ...] = CAPACITIES, id_col: str = "doc_id") -> DataFrame:
    """(id, piece, n_tokens, bin_id, bin_start, capacity): where each piece of each row lies.

    ``length`` is a column of token counts; null counts as 0, and rows of length 0 have no piece. A document longer than
    the largest capacity is cut into full pieces and a rest; piece p starts at token p * max(capacities). Bins are named
    group and number; bin_start is the piece's first token in its bin. Bins hold their items in falling order of length.
    Repeated ids are items of their own; extra columns are ignored; an empty table gives no rows."""
    top = max(capacities)
    sizes = tuple(sorted(capacities))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(length, F.lit(0)).cast("long").alias("n")).where("n > 0")
    pieces = rows.select("id", F.posexplode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / top))).alias("piece", "skip"), "n")
    pieces = pieces.select("id", "piece", F.least(F.col("n") - F.col("piece") * top, F.lit(top)).alias("n_tokens"))
    pieces = written(pieces, "packing-pieces")
    groups = max(1, -(-pieces.count() // GROUP_ITEMS))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(key, pdf):
        pdf = pdf.sort_values(["id", "piece"], kind="stable", ignore_index=True)
        placed, capacity = best_fit(pdf["n_tokens"].tolist(), sizes)
        pdf["number"] = placed
        pdf = pdf.sort_values(["number", "n_tokens", "id", "piece"], ascending=[True, False, True, True], kind="stable", ignore_index=True)
        pdf["bin_start"] = pdf.groupby("number")["n_tokens"].cumsum() - pdf["n_tokens"]
        pdf["capacity"] = [capacity[b] for b in pdf["number"]]
        pdf["bin_id"] = f"{key[0]}-" + pdf["number"].astype(str)
        return pd.DataFrame(pdf[["id", "piece", "n_tokens", "bin_id", "bin_start", "capacity"]])

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("id", "piece"), F.lit(groups)))
    out = f"id {kind}, piece int, n_tokens long, bin_id string, bin_start long, capacity int"
    return dealt.groupBy("g").applyInPandas(lambda key, pdf: run(key, pdf), out).withColumnRenamed("id", id_col)


def byte_tokens(text_col: str = "text"):
    """Length of a text for a byte-level vocabulary: its UTF-8 bytes and an end token."""
    return F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1
