"""Sharding by a k-d tree, in DataFrame operations only.

Groups of equal texts are points in metadata dimensions with a weight in bytes; a group is never split. Groups that hold
a notable part of a shard's bytes, or very many rows, are placed first, each on the emptiest shard, the heaviest first.
All others go through a k-d tree: every node is split along its widest dimension at the distributed weighted quantile that
gives either side the bytes its shards still lack, until each leaf is one shard. The quantiles of all nodes of a level are
found together, by histograms of the weight that are refined around them: what is shuffled is a histogram a node,
whatever the input.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logoscope.llm.shared import Workspace, partitions

#: Order keys of a dimension hold this many bits of its value, then bits of the group's hash, so that no split is
#: coarser than a group even along a dimension of few values.
VALUE_BITS, HASH_BITS = 24, 36
#: Histogram cells for each node and refinement, and the share of a node's weight that a quantile may be off by.
CELLS, SLACK = 1 << 14, 0.0005
#: A group of more than 1/HEAVY of a shard's bytes is placed first, and one of more than 1/MANY_ROWS of all rows; with
#: many shards only those of more than 1/MOST_HEAVY of all bytes. This bounds how many there are, and so what is collected.
HEAVY, MANY_ROWS, MOST_HEAVY = 128, 10_000, 100_000
#: Values of a metadata dimension that are broadcast at most; a shuffle join beyond.
BROADCAST_VALUES = 200_000


def value_places(tables: Workspace, groups: DataFrame, value: str) -> DataFrame:
    """(value, place): where the middle of a value's weight lies in the whole weight, from 0 to 1, values in order.

    Values are range-partitioned, summed in each partition and offset by the partitions before."""
    totals = groups.groupBy(value).agg(F.sum("w").cast("double").alias("w"))
    dealt = totals.repartitionByRange(partitions(groups.sparkSession), value).withColumn("part", F.spark_partition_id())
    dealt = tables.written(dealt, "values")
    sums = dealt.groupBy("part").agg(F.sum("w").alias("part_w"))  # a row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = sums.agg(F.sum("part_w").alias("all_w"))
    offsets = sums.withColumn("offset", F.coalesce(F.sum("part_w").over(before), F.lit(0.0))).drop("part_w").crossJoin(F.broadcast(every))
    upto = F.sum("w").over(Window.partitionBy("part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.withColumn("upto", upto).join(F.broadcast(offsets), "part")
    return tables.written(placed.select(value, ((F.col("offset") + F.col("upto") - F.col("w") / 2) / F.col("all_w")).alias("place")), "value-places")


def weighted_cuts(tables: Workspace, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, cut): of each node the value at or below which about the share ``part`` of its weight lies.

    ``rows`` (node, v, w), ``nodes`` (node, part, lo, hi, all_w). One pass a refinement, over histograms of CELLS cells;
    it ends when every node's cell around the quantile holds less than SLACK of its weight or one value."""
    state = nodes.withColumn("below", F.lit(0.0))
    while True:
        width = F.ceil((F.col("hi") - F.col("lo") + 1) / F.lit(CELLS)).cast("long")
        cells = (
            rows.join(F.broadcast(state.withColumn("width", width)), "node")
            .where(F.col("v").between(F.col("lo"), F.col("hi")))
            .withColumn("cell", F.floor((F.col("v") - F.col("lo")) / F.col("width")).cast("long"))
            .groupBy("node", "part", "all_w", "below", "cell")
            .agg(F.sum("w").cast("double").alias("w"), F.max("v").alias("hi"), F.min("v").alias("lo"))
        )
        upto = Window.partitionBy("node").orderBy("cell")
        reached = cells.withColumn("upto", F.col("below") + F.sum("w").over(upto)).withColumn("goal", F.col("all_w") * F.col("part"))
        # the first cell that reaches the goal, or the last one
        order = Window.partitionBy("node").orderBy(F.desc(F.col("upto") >= F.col("goal")), F.when(F.col("upto") >= F.col("goal"), F.col("cell")).otherwise(-F.col("cell")))
        found = reached.withColumn("first", F.row_number().over(order)).where("first = 1")
        found = tables.written(found.select("node", "part", "lo", "hi", "all_w", (F.col("upto") - F.col("w")).alias("below"), "w"), "cuts")
        if not found.where((F.col("hi") > F.col("lo")) & (F.col("w") > F.col("all_w") * SLACK)).limit(1).count():
            break
        state = found.drop("w")
    # the goal falls into the last cell: cut at its top or just below its bottom, whichever is nearer
    goal = F.col("all_w") * F.col("part")
    near_top = F.abs(F.col("below") + F.col("w") - goal) <= F.abs(goal - F.col("below"))
    return found.select("node", F.when(near_top, F.col("hi")).otherwise(F.col("lo") - 1).alias("cut"))


def kd_tree(tables: Workspace, points: DataFrame, dims: int, room: list[float]) -> DataFrame:
    """(h, crc, leaf) of ``points`` (h, crc, w, k0, k1, ...): leaf i is to hold a share of the weight like ``room[i]``.

    Nodes are ranges of leaves, named by their first leaf. ``room`` is a number a shard; driver and plan hold no more."""
    spark = points.sparkSession
    rows, level = points.withColumn("node", F.lit(0)), [(0, len(room))]
    upto = [0.0]
    for r in room:
        upto.append(upto[-1] + r)
    while any(b - a > 1 for a, b in level):
        halves = [(a, (a + b) // 2, b) for a, b in level if b - a > 1]
        parts = [(a, m, (upto[m] - upto[a]) / (upto[b] - upto[a]) if upto[b] > upto[a] else (m - a) / (b - a)) for a, m, b in halves]
        parts = spark.createDataFrame(parts, "node int, middle int, part double")
        spans = rows.groupBy("node").agg(
            F.sum("w").cast("double").alias("all_w"), *[f(f"k{i}").alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]
        )
        wide = lambda i: F.shiftright(F.col(f"hi{i}"), HASH_BITS) - F.shiftright(F.col(f"lo{i}"), HASH_BITS)
        widest = F.greatest(*[wide(i) for i in range(dims)]) if dims > 1 else wide(0)
        axis = F.coalesce(*[F.when(wide(i) >= widest, F.lit(i)) for i in range(dims)])
        pick = lambda name, at: F.element_at(F.array(*[F.col(f"{name}{i}") for i in range(dims)]), at + 1)
        nodes = spans.join(F.broadcast(parts), "node").withColumn("axis", axis)
        nodes = tables.written(nodes.select("node", "middle", "part", "axis", pick("lo", F.col("axis")).alias("lo"), pick("hi", F.col("axis")).alias("hi"), "all_w"), "nodes")
        valued = rows.join(F.broadcast(nodes.select("node", "axis")), "node").select("node", pick("k", F.col("axis")).alias("v"), "w")
        cuts = weighted_cuts(tables, valued, nodes.drop("middle", "axis"))
        known = nodes.select("node", "middle", "axis").join(F.broadcast(cuts), "node")
        moved = rows.join(F.broadcast(known), "node", "left")
        node = F.when(pick("k", F.col("axis")) > F.col("cut"), F.col("middle")).otherwise(F.col("node"))
        done = tables.written(moved.select("h", "crc", "w", *[f"k{i}" for i in range(dims)], node.alias("node")), "level")
        if rows is not points and id(rows) in tables.of:
            tables.drop(rows)
        rows = done
        level = sorted([x for a, m, b in halves for x in ((a, m), (m, b))] + [(a, b) for a, b in level if b - a == 1])
    return rows.select("h", "crc", F.col("node").alias("leaf"))


def place_first(heavy: list[tuple], total: int, shards: int) -> tuple[list[int], list[float]]:
    """(shard of each of the ``heavy`` weights, in falling order; room that each shard has left)."""
    loads = [(0, s) for s in range(shards)]
    at = []
    for w in heavy:
        load, s = heapq.heappop(loads)
        at.append(s)
        heapq.heappush(loads, (load + w, s))
    # shards that heavy groups fill by themselves take nothing more; the others share what is left evenly
    rest, filled, level = total - sum(heavy), 0.0, 0.0
    for n, (load, _) in enumerate(sorted(loads), 1):
        if n > 1 and (load * (n - 1) - filled) >= rest:
            break
        filled += load
        level = (filled + rest) / n
    room = [0.0] * shards
    for load, s in loads:
        room[s] = max(0.0, level - load)
    return at, room


def kd_shards(
    docs: DataFrame,
    target_bytes: int | None = None,
    shards: int | None = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    meta: tuple[str, ...] = ("lang", "source"),
) -> DataFrame:
    """One row per row of ``docs``: id, size (UTF-8 bytes and 1), text_crc32, shard, slot (gapless from 0 in a shard).

    Rows of equal text share a shard, always. Dimensions are the logarithm of the size and the string columns ``meta``, by
    the place of a value in the weight of all. There are ``shards`` shards, or as many as bring them to ``target_bytes``
    or less where groups allow it. Null texts count as empty, null metadata as the empty string; a group has the least
    metadata of its rows. Extra columns are ignored; ids may repeat or be null (then slots among equal ids are arbitrary).
    An empty table gives no rows. The result is read from a table of the shared folder."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    with Workspace(spark, "shards") as tables:
        facts = docs.select(
            F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"),
            F.xxhash64(text).alias("h"), *[F.coalesce(F.col(m), F.lit("")).alias(f"m{i}") for i, m in enumerate(meta)],
        )
        facts = tables.written(facts, "facts")
        n, total = facts.agg(F.count("*"), F.sum("size")).first()
        total = total or 0
        shards = max(1, -(-total // target_bytes)) if target_bytes else shards
        groups = facts.groupBy("h", "crc").agg(
            F.sum("size").alias("w"), F.count("*").alias("n"), F.max("size").alias("size"), *[F.min(f"m{i}").alias(f"m{i}") for i in range(len(meta))]
        )
        groups = tables.written(groups, "groups")
        is_heavy = (F.col("w") > max(total / shards / HEAVY, total / MOST_HEAVY)) | (F.col("n") > max(64, n / MANY_ROWS))
        heavy = [(r.w, r.h, r.crc) for r in groups.where(is_heavy).select("w", "h", "crc").collect()]  # see HEAVY for the bound
        heavy.sort(key=lambda x: (-x[0], x[1], x[2]))
        at, room = place_first([w for w, _, _ in heavy], total, shards)
        known = spark.createDataFrame([(h, c, s) for (_, h, c), s in zip(heavy, at, strict=True)], "h long, crc long, shard int")
        light = groups.where(~is_heavy)
        keys = [F.log2("size") / 40.0]  # sizes of up to 2 ^ 40 bytes
        for i in range(len(meta)):
            places = value_places(tables, light, f"m{i}").withColumnRenamed("place", f"place{i}")
            few = places.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES
            light = light.join(F.broadcast(places) if few else places, f"m{i}")
            keys.append(F.col(f"place{i}"))
        tie = F.shiftrightunsigned(F.xxhash64("h", "crc"), 64 - HASH_BITS)
        scaled = [F.shiftleft(F.floor(k * (2**VALUE_BITS - 1)).cast("long"), HASH_BITS).bitwiseOR(tie).alias(f"k{i}") for i, k in enumerate(keys)]
        points = tables.written(light.select("h", "crc", "w", *scaled), "points")
        leaves = kd_tree(tables, points, len(keys), room).withColumnRenamed("leaf", "shard")
        # rows of heavy groups find their shard by a broadcast, so no task of the join of the others has a hot group
        first = facts.join(F.broadcast(known), ["h", "crc"])
        others = facts.join(F.broadcast(known), ["h", "crc"], "left_anti").join(leaves, ["h", "crc"])
        columns = ["id", "size", "crc", "shard", F.pmod(F.xxhash64("id", "h"), F.lit(partitions(spark))).alias("chunk")]
        placed = tables.kept(first.select(columns).union(others.select(columns)), "shard-of")
        return numbered(placed, id_col)


def numbered(placed: DataFrame, id_col: str) -> DataFrame:
    """Slots without a window over a whole shard: shards are numbered in chunks, whose counts give the offsets (a row a
    shard and chunk: broadcast while these are as few as the bound, else joined by shuffle)."""
    before = Window.partitionBy("shard").orderBy("chunk")
    counts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "chunk", (F.sum("n").over(before) - F.col("n")).alias("offset"))
    few = counts.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES
    slot = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("id")) - 1
    return placed.join(F.broadcast(offsets) if few else offsets, ["shard", "chunk"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("offset") + slot).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", **how) -> None:
    """Writes ``docs`` in one folder a shard under ``path``. Ids must be unique."""
    place = kd_shards(docs, id_col=id_col, **how).select(F.col(id_col).alias("__id"), "shard")
    docs.join(place, F.col(id_col).eqNullSafe(F.col("__id"))).drop("__id").write.partitionBy("shard").parquet(path)
