"""Exact top-k search by inner product over an impact-ordered index, a score at a time (Anh and Moffat, Pruned query evaluation
using pre-computed impacts, 2006; here with proof instead of pruning).

The index is a table of shards. In a shard every dimension has a posting list ordered by component and cut into segments
of quantised components. A query takes the segments of all dimensions in falling order of impact, its own component times the largest one
of the segment, and adds up partial scores. What it hasn't read of a dimension adds at most the impact of the next segment, so partial
score and open bounds limit every vector from above. The traversal ends when that proves that few enough vectors can still reach the
k-th best score known; these are scored exactly from the whole vector. A first bound for each query comes from exact scores
of a bounded sample of vectors, so nearly all shards end early; the sample decides nothing else.

Queries are taken in blocks of bounded size against all shards. Nothing but a block of queries and that sample is held in one
place, a shard is one row, and each task hands on at most k rows a query.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logoscope.llm.shared import Workspace, partitions

#: Vectors of a shard at most, and at least where there are tasks to spare; segments of a posting list.
SHARD_ROWS, LEAST_SHARD_ROWS, SEGMENTS = 16_384, 2_048, 32
#: Components of the sample for first bounds, and vectors of it; components of a block of queries.
SAMPLE_COMPONENTS, SAMPLE_ROWS, BLOCK_COMPONENTS = 4_000_000, 4_096, 8_000_000
#: Scale of components; sums below this are exact in doubles.
SCALE, EXACT = 1024, 1 << 53
LONG = (1 << 63) - 1


def whole(vector: Column, scale: int = SCALE) -> Column:
    """Components as whole numbers; null for a vector that is null, empty, or holds a null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & (F.size(vector) > 0)
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(vector, lambda x: F.floor(scale * x.cast("double"))))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column, all of one length."""
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1).astype(np.int64)


def products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """v @ q as whole numbers: in doubles while these are exact, else with Python's integers, held within a long."""
    top = lambda x: max(1, int(np.abs(x.astype(np.float64)).max(initial=0)))
    if v.shape[1] * top(v) * top(q) < EXACT:
        return np.rint(v.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return np.clip(v.astype(object) @ q.astype(object), -LONG - 1, LONG).astype(np.int64)


def shard_row(ids: np.ndarray, v: np.ndarray) -> dict:
    """A shard: posting lists in falling order of component, and where their segments begin.

    Segments are the levels of components quantised to SEGMENTS steps of a list's range; empty levels have none."""
    n, d = v.shape
    order = np.argsort(-v, axis=0, kind="stable")
    lists = np.take_along_axis(v, order, 0)
    top, bottom = lists[0].astype(np.float64), lists[-1].astype(np.float64)
    level = np.floor((top - lists) * (SEGMENTS - 1e-6) / np.maximum(top - bottom, 1))
    starts = np.vstack([np.ones(d, bool), np.diff(level, axis=0) > 0])
    dim, at = np.nonzero(starts.T)
    return {"n": n, "d": d, "ids": ids.tobytes(), "members": order.T.astype("<u4").tobytes(), "values": lists.T.tobytes(), "dims": dim.astype("<u4").tobytes(), "starts": at.astype("<u4").tobytes()}


SHARD = "n long, d long, ids binary, members binary, values binary, dims binary, starts binary"


class Shard:
    def __init__(self, row: dict):
        self.n, self.d = n, d = row["n"], row["d"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.members = np.frombuffer(row["members"], "<u4").reshape(d, n)
        self.values = np.frombuffer(row["values"], np.int64).reshape(d, n)
        self.dims, self.starts = (np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("dims", "starts"))
        last = np.append(self.dims[1:] != self.dims[:-1], True)
        self.ends = np.where(last, n, np.append(self.starts[1:], n))
        self.high, self.low = self.values[self.dims, self.starts], self.values[self.dims, self.ends - 1]
        self.vectors = np.empty((n, d), np.int64)
        for i in range(d):
            self.vectors[self.members[i], i] = self.values[i]
        self.largest = int(np.abs(self.vectors.astype(np.float64)).max(initial=0))

    def exact(self, rows: np.ndarray, q: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of ``rows``, and the rows: without those of the query's own id."""
        rows = rows[self.ids[rows] != own]
        return products(self.vectors[rows], q), rows

    def search(self, q: np.ndarray, own: int, k: int, bound: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The best ``k`` of this shard that reach ``bound`` (scores, ids), and how many postings were read for it."""
        if self.d * max(1, self.largest) * max(1, int(np.abs(q.astype(np.float64)).max())) >= EXACT:
            score, rows = self.exact(np.arange(self.n), q, own)
            return *best(score, self.ids[rows], k, bound), self.n * self.d
        q = q.astype(np.float64)
        # impact of a segment: the most that one of its postings adds. Zero components add nothing and have no list
        impact = np.where(q[self.dims] > 0, q[self.dims] * self.high, q[self.dims] * self.low)
        use = np.flatnonzero(q[self.dims] != 0)
        use = use[np.argsort(-impact[use], kind="stable")]
        sizes = np.cumsum((self.ends - self.starts)[use])
        total = int(sizes[-1]) if len(use) else 0
        read, first = max(1, total // 8), True
        while True:
            taken = use[: np.searchsorted(sizes, read, "left") + 1]
            upper = self.upper(q, impact, taken, use[len(taken) :])
            if first and k < self.n:
                # a bound of this shard's own: exact scores of those that lead so far
                score, rows = self.exact(np.argpartition(-upper, min(2 * k, self.n - 1))[: 2 * k + 1], q, own)
                if len(score) >= k:
                    bound = max(bound, int(np.partition(score, len(score) - k)[len(score) - k]))
                first = False
            possible = np.flatnonzero(upper >= bound)
            done = int(sizes[len(taken) - 1]) if len(taken) else 0
            # proof: no other vector reaches the bound. Going on pays while there are more of these than postings to come
            if done >= total or len(possible) * self.d <= min(total, 2 * done) - done:
                break
            read = 2 * done
        score, rows = self.exact(possible, q, own)
        return *best(score, self.ids[rows], k, bound), done

    def upper(self, q: np.ndarray, impact: np.ndarray, taken: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """The highest score that each vector can have once the segments ``taken`` are added up."""
        rest = np.zeros(self.d)
        rest[self.dims[open_[::-1]]] = impact[open_[::-1]]  # of several the first in order, which is the largest, stays
        members, excess = [np.zeros(0, np.int64)], [np.zeros(0)]
        dims = self.dims[taken]
        low, high = np.full(self.d, self.n), np.zeros(self.d, np.int64)
        np.minimum.at(low, dims, self.starts[taken])
        np.maximum.at(high, dims, self.ends[taken])
        for i in np.unique(dims):  # segments are taken from one end of a list, so what is taken of it is one slice
            members.append(self.members[i, low[i] : high[i]])
            excess.append(q[i] * self.values[i, low[i] : high[i]] - rest[i])
        return np.bincount(np.concatenate(members).astype(np.int64), np.concatenate(excess), self.n) + rest.sum()


def best(score: np.ndarray, ids: np.ndarray, k: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` by falling score, then rising id, of those that reach ``bound``."""
    held = score >= bound
    score, ids = score[held], ids[held]
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def build_index(vectors: DataFrame, shards: int) -> DataFrame:
    """Shards of rows (id, v), one a row: each task makes shards of the rows it has, of one length of vectors each."""

    def build(batches):
        held: dict[int, list] = {}

        def shard(d):
            ids, rows = zip(*held.pop(d), strict=True)
            return pa.RecordBatch.from_pylist([shard_row(np.concatenate(ids), np.vstack(rows))], SHARD_TYPE)

        for b in batches:
            lengths = b.column(1).value_lengths().to_numpy()
            for d in np.unique(lengths).tolist():
                some = np.flatnonzero(lengths == d)
                ids, v = b.column(0).take(pa.array(some)).to_numpy(), matrix(b.column(1).take(pa.array(some)))
                for s in range(0, len(v), SHARD_ROWS):
                    held.setdefault(d, []).append((ids[s : s + SHARD_ROWS], v[s : s + SHARD_ROWS]))
                    if sum(len(x) for x, _ in held[d]) >= SHARD_ROWS:
                        yield shard(d)
        for d in list(held):
            yield shard(d)

    return vectors.select("id", "v").repartition(shards).mapInArrow(build, SHARD)


SHARD_TYPE = pa.schema([("n", pa.int64()), ("d", pa.int64()), *[(c, pa.binary()) for c in ("ids", "members", "values", "dims", "starts")]])


def first_bounds(queries: DataFrame, sample: list, k: int) -> DataFrame:
    """(id, v, bound) of queries: the k-th best score among the sample's vectors, which k vectors reach; the least long
    where the sample has fewer."""
    ids = np.array([r.id for r in sample], np.int64)
    vectors = {d: [i for i, r in enumerate(sample) if len(r.v) == d] for d in {len(r.v) for r in sample}}
    known = {d: (ids[i], np.array([sample[j].v for j in i], np.int64)) for d, i in vectors.items()}

    def run(batches):
        for b in batches:
            bounds = []
            for own, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                q = np.array(v.as_py(), np.int64)
                others, rows = known.get(len(q), (np.zeros(0, np.int64), np.zeros((0, len(q)), np.int64)))
                score = products(rows[others != own], q)
                bounds.append(int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else -LONG - 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bounds, pa.int64())], ["id", "v", "bound"])

    return queries.select("id", "v").mapInArrow(run, "id long, v array<long>, bound long")


def search_block(index: DataFrame, queries: list, k: int) -> DataFrame:
    """(query, id, score) of a block of queries (id, v, bound): of each task at most ``k`` rows a query, the best of its
    shards. From shard to shard a query's bound rises."""
    block = index.sparkSession.sparkContext.broadcast([(r.id, np.array(r.v, np.int64), r.bound) for r in queries])

    def run(batches):
        known = block.value
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(known)
        bounds = [b for _, _, b in known]
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard({n: batch.column(n)[row].as_py() for n in batch.schema.names})
                for i, (own, q, _) in enumerate(known):
                    if len(q) == shard.d:
                        score, ids, _ = shard.search(q, own, k, bounds[i])
                        if len(score):
                            held[i] = best(np.append(held[i][0], score), np.append(held[i][1], ids), k, bounds[i])
                            if len(held[i][0]) == k:
                                bounds[i] = max(bounds[i], int(held[i][0][-1]))
        sizes = [len(s) for s, _ in held]
        if sum(sizes):
            names = np.repeat([own for own, _, _ in known], sizes)
            columns = [names, np.concatenate([i for _, i in held]), np.concatenate([s for s, _ in held]), np.repeat(np.arange(len(known)), sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "id", "score", "place"])

    return index.mapInArrow(run, "query long, id long, score long, place long")


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` rows with the highest inner product of floor(scale * x), of all rows but those of
    the query's id, for every row where ``is_query`` (over the columns of ``vectors``) holds. Ties go to the smaller id.

    Rows whose id is null, or whose vector is null, empty, or holds a null or non-finite component, take no part; vectors
    of different lengths don't meet. Of a repeated id every row is a candidate; as a query an id counts once for each of
    its different vectors, each with ranks of its own. Zero vectors score 0. Components beyond a long, and scores beyond one, are
    held at its ends. Extra columns are ignored; an empty table gives no rows, and with fewer candidates there are fewer
    ranks. The result is exact: sample and bounds only save work.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), whole(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where("id is not null and v is not null")
    with Workspace(spark, "impact-search") as tables:
        n, d, asked, most = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1)), F.count_if("asks"), F.max(F.size("v"))).first()
        if not asked:
            return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
        shards = max(-(-n // SHARD_ROWS), min(partitions(spark), -(-n // LEAST_SHARD_ROWS)))
        index = tables.written(build_index(rows, shards), "shards")
        share = int((1 << 30) * min(1.0, min(SAMPLE_ROWS, SAMPLE_COMPONENTS // d) / n)) + 1
        sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).select("id", "v").limit(2 * SAMPLE_ROWS).collect()
        blocks = -(-asked * most // BLOCK_COMPONENTS)
        asks = first_bounds(rows.where("asks").select("id", "v").distinct(), sample, k)
        asks = tables.written(asks.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks))), "queries")
        found = []
        for b in range(blocks):
            queries = asks.where(F.col("block") == b).select("id", "v", "bound").collect()
            made = search_block(index, queries, k).withColumn("block", F.lit(b))
            found.append(tables.written(made, "found"))
        every = reduce(DataFrame.union, found)
        # a query is a place in a block; its rows are at most k a task
        order = Window.partitionBy("block", "place").orderBy(F.desc("score"), "id")
        top = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return tables.kept(top.select(F.col("query").alias("query_id"), "rank", F.col("id").alias(id_col), "score"), "top")
