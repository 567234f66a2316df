"""Near-duplicate documents by Jaccard similarity of word shingles: an exact self-join with signature trees.

1. Each text becomes a set of shingle hashes; equal sets are one node from then on.
2. A set with too many members that no other set has can't overlap enough with any: a sample of each set's members, the
   least hashes, is compared with all other samples, and a set goes if its unique members in it leave it a chance of less
   than MISSED to have a link. This keeps documents apart that share passages but no more.
3. The trees' top level. Sets are dealt by size range, so that linked sets are in equal or neighbouring ranges, and the
   bitmap of all hashes is cut into p slices. Linked sets of one range differ in at most p - 1 members, so at least one
   slice of their bitmaps is equal: a top node holds the sets of a size range that are equal in a slice. Sets that
   share no top node can't overlap enough, whatever else they hold, and no pair of top nodes need be compared. Top nodes
   with a common set are tied together into candidate groups: every link is inside one. As that holds for any cut of the
   bitmaps, large groups are cut again in other ways, and fall apart unless links or likeness hold them together. It
   also holds for sets without some members, whichever these are: so large groups are cut without the members that many
   of their sets have, as the sets with a common line would else be one group that grows with the corpus.
4. In each candidate group a signature tree finds the links by dual traversal. A large group is cut into chunks, which
   pivots tie together; what the pivots do not tie is compared with every chunk, so nothing is lost. That takes as many
   passes as keep the copies of texts below twice the texts of all groups.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logoscope.llm.components import components
from logoscope.llm.shared import Workspace, partitions, remembered
from logoscope.llm.signature_tree import forest, mixed, shingles, word_hashes

#: Sets and members of a chunk, pivots of a large group, members of a task that holds many small groups.
CHUNK_SETS, CHUNK_MEMBERS, PIVOTS, TASK_MEMBERS = 1000, 2_000_000, 8, 1_000_000
#: Candidates up to this number are broadcast as (id, set, group) to pick their texts; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Members in a sample, at least, of sets that have them; odds that a set with a link is dropped for its sample.
SAMPLED, MISSED = 48, 1e-12
#: Groups of more sets are refined by further cuts of the bitmaps, at most so many, while that makes them much smaller.
REFINED_SETS, SEEDS = 200, 4
#: Cuts of a bitmap that are tried for one with few empty slices; slices that are gathered before they leave a task.
ROUNDS, GATHERED = 24, 1 << 20
#: Members are common if more sets of large groups have them; at most so many, the most frequent, are sent to the tasks.
COMMON_SETS, COMMON_MEMBERS = 100, 200_000
#: Empty slices allowed, as shares of the others, in the cuts that are tried first, of sets without common members.
SPARSE = (0, 0, 0.25, 1, 3)
_MEMBER, _LEAD = np.uint64(0x5851F42D4C957F2D), np.uint64(0x2545F4914F6CDD1D)


@cache
def ranges(num: int, den: int, most: int = 1 << 40) -> tuple[int, ...]:
    """Starts of the size ranges: a range ends where a set can't be linked with the smallest set of the range."""
    starts = [1]
    while starts[-1] < most:
        starts.append(starts[-1] * den // num + 1)
    return tuple(starts)


@cache
def slicing(i: int, num: int, den: int) -> tuple[int, int]:
    """(p, e) for links whose smaller set is in range i: number of slices, and of empty ones that a set may have.

    Sets of sizes a <= b <= a / t of similarity t differ in at most a (1 - t) / t members, m for the range's largest a.
    Of p = m + 1 + e slices at least e + 1 are then equal, so one that is not empty is, if a set has e empty ones."""
    starts = ranges(num, den)
    m = (den - num) * (starts[i + 1] - 1) // num
    e = int(2 * (m + 1) * math.exp(-starts[i] / (m + 1))) if m else 0
    return m + 1 + e, e


@cache
def cuts(p: int) -> np.ndarray:
    return np.array([-(-(j << 64) // p) for j in range(1, p)], np.uint64)


def attempts(members: np.ndarray, i: int, num: int, den: int, seed: int, common: np.ndarray | None):
    """(members, p, e, number) of the cuts that a set in size range i tries: first, without its common members."""
    p, e = slicing(i, num, den)
    if common is not None and len(common):
        rare = members[common[np.searchsorted(common, members).clip(max=len(common) - 1)] != members]
        for r, share in enumerate(SPARSE):
            more = max(e, int(share * (p - e)))
            yield rare, p - e + more, more, SEEDS * ROUNDS + seed * len(SPARSE) + r
    for r in range(ROUNDS):
        yield members, p, e, seed * ROUNDS + r


def slices(members: np.ndarray, i: int, num: int, den: int, seed: int = 0, common: np.ndarray | None = None):
    """Hashes of the slices of a set (ascending hashes) in size range i. Cuts are tried in a fixed order until one leaves
    the set few empty slices; as two sets try the same ones, they meet in the first that suits either. Empty slices are
    left out but in the last round, which a set only reaches if its similarity is low or its hashes are odd.

    Members in ``common`` (ascending) are left out at first: linked sets differ in no more members without them."""
    for left, p, e, cut in attempts(members, i, num, den, seed, common):
        part = left if cut == 0 else np.sort(mixed(left ^ np.uint64(cut)))
        at = np.concatenate([[0], np.searchsorted(part, cuts(p)), [len(part)]])
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(part ^ _MEMBER))])
        salt = mixed(np.array([(i << 16) + cut + 1], np.uint64))
        content = total[at[1:]] - total[at[:-1]]
        held = at[1:] > at[:-1]
        if cut == seed * ROUNDS + ROUNDS - 1:
            content = np.where(held, content, np.arange(p, dtype=np.uint64) + np.uint64(1))
            held[:] = True
        yield mixed(content[held] + salt)
        if p - np.count_nonzero(held) <= e:
            return


def names_of(members: np.ndarray) -> int:
    """64-bit name of a set, from its size and two sums over its members."""
    one, two = members.sum(dtype=np.uint64), mixed(members ^ _MEMBER).sum(dtype=np.uint64)
    return int(mixed(mixed(np.array([one + np.uint64(len(members))], np.uint64)) + two)[0])


def set_of(text: str | None, k: int) -> np.ndarray:
    return np.unique(shingles(word_hashes(text or ""), k))


def level(n: int) -> int:
    """A sample holds the members of a set of n whose hashes are less than 2 ^ (64 - level)."""
    return max(0, (n // SAMPLED).bit_length() - 1)


def sketched(rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(id, n, h, sample, tested) of every row (id, text): size and name of its set, a sample of its members, and how many
    of these, the first ones, the sample of any linked set would hold if that set has them."""

    def run(batches):
        remembered("shingles")
        for b in batches:
            n, h, samples, tested = [], [], [], []
            for t in b.column(1):
                s = set_of(t.as_py(), k)
                n.append(len(s))
                h.append(names_of(s))
                samples.append(s[: np.searchsorted(s, np.uint64((1 << (64 - x)) - 1), "right")].view(np.int64) if (x := level(len(s))) else s.view(np.int64))
                x = level(len(s) * den // num)
                tested.append(int(np.searchsorted(s, np.uint64((1 << (64 - x)) - 1), "right")) if x else len(s))
            arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(samples, pa.list_(pa.int64())), pa.array(tested, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "h", "sample", "tested"])

    return rows.mapInArrow(run, "id long, n long, h long, sample array<long>, tested int")


def possible_sets(sketches: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of ``classes`` that may have a link. At most 1 - t of a linked set's members are in no other set; the
    chance that so many of a sample are has Chernoff's bound."""
    members = sketches.where("n > 0 and id is not null").select(F.col("h"), F.posexplode("sample").alias("at", "member"), "tested")
    members = members.select("member", "h", (F.col("at") < F.col("tested")).alias("own"))
    alone = members.groupBy("member").agg(F.min("h").alias("h"), F.max("h").alias("last"), F.max("own").alias("own")).where("h = last and own")
    counted = classes.join(alone.groupBy("h").agg(F.count("*").alias("u")), "h", "left")
    u, most, tested = F.coalesce("u", F.lit(0)), 1 - num / den, F.col("tested")
    share = u / tested
    rest = F.when(share < 1, (tested - u) * F.log((1 - share) / (1 - most))).otherwise(0.0)
    unlikely = F.when(share > most, u * F.log(share / most) + rest >= -math.log(MISSED)).otherwise(False)
    return counted.where(~unlikely).drop("u")


def gathered(top: np.ndarray, node: np.ndarray):
    """Rows (top node, set), each once. Sets that meet here already are tied to the least of them, which alone goes on: so
    a top node that very many sets share leaves a task as one row."""
    order = np.lexsort((node, top))
    top, node = top[order], node[order]
    first = np.concatenate([[True], top[1:] != top[:-1]])
    lead = node[first][np.cumsum(first) - 1]
    tied = np.unique(np.stack([lead, node])[:, lead != node], axis=1)
    name = mixed(tied[0].view(np.uint64) ^ _LEAD).view(np.int64)
    one, at = np.unique(name, return_index=True)
    return np.concatenate([top[first], one, name]), np.concatenate([node[first], tied[0][at], tied[1]])


def named_sets(b: pa.RecordBatch, k: int):
    """(place, name, set) of the rows (h, text, ...) of a batch; other texts of the same id are passed over."""
    for at, (name, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
        s = set_of(text.as_py(), k)
        if np.array([names_of(s)], np.uint64).view(np.int64)[0] == name:
            yield at, name, s


def common_members(tables: Workspace, texts: DataFrame, k: int) -> np.ndarray:
    """Ascending hashes of members that more than COMMON_SETS of the sets (h, text, ...) have, at most COMMON_MEMBERS.

    A task reads all its sets and names the members that two or more of them have: those of one set in a task, which are
    most, make no rows, and don't count. What is found only steers how groups are cut; links meet whatever is in it."""

    def run(batches):
        remembered("shingles")
        held, n = [], 0

        def flush():
            member, sets = np.unique(np.concatenate(held), return_counts=True)
            member, sets = member[sets > 1], sets[sets > 1]
            for s in range(0, len(member), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(member[s : s + (1 << 17)].view(np.int64)), pa.array(sets[s : s + (1 << 17)])], ["member", "sets"])

        for b in batches:
            for _, _, s in named_sets(b, k):
                held.append(s)
                n += len(s)
                if n >= GATHERED:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    counts = texts.select("h", "text").mapInArrow(run, "member long, sets long").groupBy("member").agg(F.sum("sets").alias("sets"))
    counts = tables.written(counts.where(F.col("sets") > COMMON_SETS), "common-members")
    most = counts.orderBy(F.desc("sets"), "member").limit(COMMON_MEMBERS).select("member").toPandas()["member"]
    return np.sort(most.to_numpy(np.int64).view(np.uint64))


def top_nodes(texts: DataFrame, k: int, num: int, den: int, seed: int = 0, common: np.ndarray | None = None) -> DataFrame:
    """(top, node): the top nodes that sets are in, from rows (h, text, cc); those of different cc are apart."""

    def run(batches):
        remembered("shingles")
        starts = np.array(ranges(num, den))
        tops, nodes, held = [], [], 0

        def flush():
            t, n = gathered(np.concatenate(tops).view(np.int64), np.repeat(np.array([x for x, _ in nodes], np.int64), [c for _, c in nodes]))
            for s in range(0, len(t), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(t[s : s + (1 << 17)]), pa.array(n[s : s + (1 << 17)])], ["top", "node"])

        for b in batches:
            groups = b.column(2).to_pylist()
            for at, name, s in named_sets(b, k):
                i, cc = int(np.searchsorted(starts, len(s), "right")) - 1, groups[at]
                # as the smaller set of a link, and as the larger one of a link with the range below
                for j in (i, i - 1):
                    if j >= 0 and slicing(j, num, den)[0] > 1 and len(s) * num <= (int(starts[j + 1]) - 1) * den:
                        for found in slices(s, j, num, den, seed, common):
                            tops.append(found ^ np.uint64(cc & (1 << 64) - 1))
                            nodes.append((name, len(found)))
                            held += len(found)
                if held >= GATHERED:
                    yield from flush()
                    tops, nodes, held = [], [], 0
        if held:
            yield from flush()

    return texts.mapInArrow(run, "top long, node long")


def linked(k: int, num: int, den: int):
    """Of the groups in one task: (a, b), a set and the set that stands for its component, where these differ."""

    def run(key, pdf):
        remembered("shingles")
        out = []
        for _, part in pdf.groupby("cc", sort=False):
            sets = [set_of(t, k) for t in part["text"]]
            h = part["h"].to_numpy()
            # an id that several texts have brings all of them; each set is taken once, where it belongs
            mine = np.array([names_of(s) for s in sets], np.uint64).view(np.int64) == h
            at = np.flatnonzero(mine)
            at = at[np.unique(h[at], return_index=True)[1]]
            if len(at) < 2:
                continue
            h = h[at]
            root = h[forest([sets[i] for i in at], num, den, part["label"].to_numpy()[at])]
            out.append(pd.DataFrame({"a": h, "b": root})[h != root])
        return pd.concat(out) if out else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})

    return run


def near_texts(rows: DataFrame, near: DataFrame) -> DataFrame:
    """(h, text) of the sets ``near`` (h, rep): their rows' texts. An id of several texts gives all of them, named alike."""
    few = near.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    held = near.select(F.col("rep").alias("id"), "h")
    return rows.join(F.broadcast(held) if few else held, "id").select("h", "text")


def tied(tables: Workspace, texts: DataFrame, k: int, num: int, den: int, seed: int, common: np.ndarray | None = None) -> DataFrame:
    """(h, cc): sets (h, text, cc) that share top nodes, and new names of their groups, which are parts of the old."""
    upto = Window.partitionBy("top").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = top_nodes(texts.select("h", "text", "cc"), k, num, den, seed, common).select(F.col("node").alias("a"), F.first("node").over(upto).alias("b"))
    ties = tables.written(met.where("a <> b").distinct(), "candidate-ties")
    return components(ties).select(F.col("id").alias("h"), F.col("component").alias("cc"))


def candidate_groups(tables: Workspace, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(h, cc): sets that may have a link, and the name of their candidate group."""
    groups, before, common = tied(tables, texts.withColumn("cc", F.lit(0).cast("long")), k, num, den, 0), math.inf, None
    for seed in range(1, SEEDS):
        large = tables.written(groups.groupBy("cc").agg(F.count("*").alias("sets")).where(F.col("sets") > REFINED_SETS), "groups-to-refine")
        now = large.agg(F.sum("sets")).first()[0] or 0
        if not now or now > 0.8 * before:
            break
        before, held = now, groups.join(large.select("cc"), "cc")
        held = texts.join(F.broadcast(held) if now <= BROADCAST_ROWS else held, "h")
        common = common_members(tables, held, k) if common is None else common
        parts = tied(tables, held, k, num, den, seed, common)
        groups = tables.written(groups.join(large, "cc", "left_anti").select("h", "cc").union(parts), "refined-groups")
    return groups


def links_of(tables: Workspace, texts: DataFrame, near: DataFrame, groups: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): links among sets, enough to tie every component together."""
    groups = tables.written(groups.join(near, "h").select("cc", "h", "n"), "candidate-groups")
    size = groups.groupBy("cc").agg(F.count("*").alias("sets"), F.sum("n").alias("total"))
    chunks = F.greatest(F.ceil(F.col("sets") / CHUNK_SETS), F.ceil(F.col("total") / CHUNK_MEMBERS)).cast("long")
    large = tables.written(size.select("cc", chunks.alias("chunks")).where("chunks > 1"), "large-groups")
    total, candidates = groups.agg(F.sum("n"), F.count("*")).first()
    tasks = max(4 * partitions(texts.sparkSession), -(-(total or 0) // TASK_MEMBERS))
    held = groups.select("cc", "h")
    texts = texts.join(F.broadcast(held) if candidates <= BROADCAST_ROWS else held, "h").select("cc", "h", F.col("h").alias("label"), "text")
    columns = ["k1", "k2", "cc", "h", "label", "text"]
    find = linked(k, num, den)
    cut_some = large.limit(1).count() > 0
    small = texts.join(large, "cc", "left_anti") if cut_some else texts
    small = small.withColumn("k1", F.lit(-1).cast("long")).withColumn("k2", F.pmod(F.xxhash64("cc"), F.lit(tasks)))
    links = tables.written(small.select(columns).groupBy("k1", "k2").applyInPandas(find, "a long, b long"), "links")
    if not cut_some:
        return links
    cut = tables.written(texts.join(large, "cc").withColumn("chunk", F.pmod(F.xxhash64("h"), F.col("chunks"))), "large-texts")
    slot = F.pmod(F.xxhash64("h", F.lit(2)), F.lit(PIVOTS))
    pivots = cut.groupBy("cc", slot.alias("slot")).agg(F.min("h").alias("h")).select("cc", "h")
    spread = cut.join(pivots, ["cc", "h"], "left_semi").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    dealt = cut.unionByName(spread).withColumn("k1", F.col("cc")).withColumn("k2", F.col("chunk"))
    in_chunks = tables.written(dealt.select(columns).groupBy("k1", "k2").applyInPandas(find, "a long, b long"), "links-in-chunks")
    parts = components(in_chunks).withColumnRenamed("id", "h")
    labels = cut.select("cc", "h").distinct().join(parts, "h", "left").select("cc", "h", F.coalesce("component", "h").alias("label"))
    labels = tables.written(labels, "large-labels")
    counts = labels.groupBy("cc", "label").agg(F.count("*").alias("c"))
    main = counts.groupBy("cc").agg(F.max(F.struct("c", "label")).getField("label").alias("main"))
    rest = tables.written(labels.join(main, "cc").where("label <> main").select("cc", "h"), "large-rest")
    rests = tables.written(rest.groupBy("cc").agg(F.ceil(F.count("*") / CHUNK_SETS).cast("long").alias("rests")), "large-rests")
    if not rests.limit(1).count():
        return links.union(in_chunks)
    # what pivots have not tied to the group's main part: dealt into shares, and each share meets every chunk. A share of
    # all groups makes about two copies of their texts, so no more shares are taken at once than the texts of all groups
    full = cut.drop("label").join(labels, ["cc", "h"]).join(rests, "cc")
    at_once = max(1, candidates // (2 * max(1, cut.count())))
    share = F.pmod(F.xxhash64("h", F.lit(3)), F.col("rests"))
    found = links.union(in_chunks)
    for first in range(0, rests.agg(F.max("rests")).first()[0], at_once):
        end = F.least(F.col("rests"), F.lit(first + at_once))
        now = full.where(F.col("rests") > first)
        every = now.withColumn("k", F.explode(F.sequence(F.lit(first).cast("long"), end - 1)))
        alone = now.join(rest, ["cc", "h"], "left_semi").withColumn("k", share).where((F.col("k") >= first) & (F.col("k") < end))
        alone = alone.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        both = every.unionByName(alone).withColumn("k1", F.col("cc")).withColumn("k2", F.col("chunk") * F.col("rests") + F.col("k"))
        found = found.union(tables.written(both.select(columns).groupBy("k1", "k2").applyInPandas(find, "a long, b long"), "links-of-rest"))
    return found


def near_groups(
    docs: DataFrame, k: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``: the size of its set of k-word shingles and the least id
    that links of similarity >= num / den reach.

    Null and empty texts and texts of white space have no shingles and link with nothing; shorter texts than k words are
    one shingle. Ids are whole numbers and meant to be unique; the rows of a repeated id are one node of the links. Rows
    with a null id link with nothing. Extra columns are ignored; an empty table gives no rows. Shingles and sets are
    compared as 64-bit hashes. The result is a table of the shared folder; what led to it is deleted."""
    spark, (num, den) = docs.sparkSession, similarity
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with Workspace(spark, "near-groups") as tables:
        sketches = tables.written(sketched(rows, k, num, den), "sketches")
        sizes = tables.written(sketches.select("id", "n", "h"), "sizes")
        nodes = sizes.where("n > 0 and id is not null")
        firsts = sketches.where("n > 0 and id is not null").groupBy("h").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("tested").alias("tested"))
        classes = tables.written(firsts, "classes")
        near = tables.written(possible_sets(sketches, classes, num, den).select("h", "rep", "n"), "possible-sets")
        tables.drop(sketches)
        texts = near_texts(rows, near)
        links = links_of(tables, texts, near, candidate_groups(tables, texts, k, num, den), k, num, den)
        # the sets of a repeated id are one node
        repeated = nodes.groupBy("id").agg(F.min("h").alias("b"), F.max("h").alias("last")).where("b <> last").select("id", "b")
        links = links.union(nodes.join(repeated, "id").where("h <> b").select(F.col("h").alias("a"), "b"))
        parts = components(links).withColumnRenamed("id", "h")
        tied = parts.join(classes, "h")
        least = tied.groupBy("component").agg(F.min("rep").alias("component_id"))
        tied = tables.written(tied.select("h", "component").join(least, "component").select("h", "component_id"), "class-components")
        named = classes.join(tied, "h", "left").select("h", F.coalesce("component_id", "rep").alias("component_id"))
        found = nodes.join(named, "h").select("id", "n", "component_id")
        alone = sizes.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
        found = found.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
        return tables.kept(found, "near-groups-found")


def drop_near_copies(docs: DataFrame, k: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the row of the least id for each group of near copies; columns unchanged. Rows of a repeated id stay
    or go together; rows with a null id stay."""
    gone = near_groups(docs, k, similarity, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct()
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, docs[id_col] == F.col("__gone"), "left_anti")
