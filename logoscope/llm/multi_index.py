"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of the vectors, form a grid of cells (Babenko and Lempitsky 2012). Every vector lies in
one cell; as a query it visits the cells nearest to it in multi-sequence order, as many as a calibration asks for, and what it
meets there is verified by its cosine. The calibration compares a bounded set of queries with all vectors once; where these have
few links, it moves the queries themselves away by the threshold's angle and asks how far down the cell of the moved vector is. Cells are worked on in blocks of bounded size, so a
cell that holds a large part of all vectors becomes many tasks; only link counts and a spanning forest leave a block.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logoscope.llm.components import components
from logoscope.llm.shared import Workspace

#: Mean vectors of a cell that the grid is sized for, and codewords of a half at most.
CELL_ROWS, MAX_CODEWORDS = 48, 1024
#: Vectors that fit the codebooks, queries of the first calibration, and rounds of k-means (samples by hash).
FIT_ROWS, CALIBRATION_ROWS, ROUNDS, SEED = 20_000, 400, 8, 7
#: Components of all vectors of such a sample together: bounds what reaches the driver whatever the dimension.
SAMPLE_COMPONENTS = 16_000_000
#: Queries with links that make a calibration by links; queries compared at once in it; ids of queries are divisible by EVERY.
ENOUGH_LINKED, QUERIES_AT_ONCE, EVERY = 100, 512, 20
#: Share of links that the calibrated traversal must meet, of vectors moved by the full angle too (links are nearer), and
#: cells that it visits at least.
TARGET_RECALL, TARGET_MOVED, LEAST_VISITS = 0.998, 0.99, 4
#: Vectors of each side of a block; cell numbers of a dimension.
BLOCK, CELLS = 4096, MAX_CODEWORDS**2


def usable(vector) -> F.Column:
    """Whether a vector can be compared: not null, no null, NaN or infinite component, not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & fine & some, F.lit(False))


def normalised(rows) -> np.ndarray:
    """Vectors of length 1. They are divided by the power of two of their largest component first, so no finite vector
    over- or underflows."""
    x = np.array(rows, np.float64)
    if not x.size:
        return x
    power = np.frexp(np.abs(x).max(1, keepdims=True))[1]
    x = np.ldexp(x, -power)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def k_means(x: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(ROUNDS):
        near = distances(x, centres).argmin(1)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres * centres).sum(1) - 2 * x @ centres.T


class Grid:
    """The product of two codebooks; a cell is number i * K + j."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second, self.k = first, second, len(first)

    def orders(self, x: np.ndarray):
        """Of each half: codewords by ascending distance, and these distances."""
        half = self.first.shape[1]
        for part, book in ((x[:, :half], self.first), (x[:, half:], self.second)):
            d = distances(part, book)
            o = np.argsort(d, axis=1, kind="stable")
            yield o, np.take_along_axis(d, o, 1)

    def visits(self, x: np.ndarray, count: int) -> np.ndarray:
        """The first ``count`` cells of the multi-sequence traversal of every row of ``x``, nearest first.

        The cell of ranks (a, b) comes after the (a + 1)(b + 1) - 1 cells of lower ranks, so only cells with
        (a + 1)(b + 1) <= count can be among the first; these are ordered by their summed distance."""
        count = min(count, self.k * self.k)
        step = max(1, 8_000_000 // (count * (1 + int(np.log(count)))))
        if len(x) > step:
            return np.concatenate([self.visits(x[i : i + step], count) for i in range(0, len(x), step)])
        (o1, d1), (o2, d2) = self.orders(x)
        a = np.concatenate([np.full(min(self.k, count // (r + 1)), r) for r in range(min(self.k, count))])
        b = np.concatenate([np.arange(min(self.k, count // (r + 1))) for r in range(min(self.k, count))])
        first = np.argsort(d1[:, a] + d2[:, b], axis=1, kind="stable")[:, :count]
        return np.take_along_axis(o1[:, a], first, 1) * self.k + np.take_along_axis(o2[:, b], first, 1)

    def ranks(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The place of a cell in the traversal of each row of ``x``, counted over all cells; of equals the last."""
        half = self.first.shape[1]
        out = np.empty(len(x), np.int64)
        for start in range(0, len(x), 1024):
            rows = slice(start, start + 1024)
            d1, d2 = distances(x[rows, :half], self.first), distances(x[rows, half:], self.second)
            for n, (a, b, cell) in enumerate(zip(d1, d2, cells[rows], strict=True)):
                out[start + n] = np.searchsorted(np.sort(b), a[cell // self.k] + b[cell % self.k] + 1e-9 - a, "right").sum() - 1
        return out


def fit(vectors: DataFrame, total: int, dimension: int) -> Grid:
    """Codebooks from a sample of at most about FIT_ROWS of the ``total`` rows (least, rep, w, e)."""
    rows = min(FIT_ROWS, SAMPLE_COMPONENTS // dimension)
    part = F.pmod(F.xxhash64("least"), F.lit(1 << 20)) < max(1, int((1 << 20) * min(1.0, rows / max(1, total))))
    drawn = vectors.where(part).select("e").collect()
    drawn = drawn or vectors.select("e").limit(1).collect()
    x = normalised([r.e for r in drawn])
    k = max(2, min(MAX_CODEWORDS, round((total / CELL_ROWS) ** 0.5)))
    half = max(1, x.shape[1] // 2)
    return Grid(k_means(x[:, :half], k), k_means(x[:, half:], k) if x.shape[1] > 1 else np.zeros((k, 0)))


def depth(vectors: DataFrame, grid: Grid, total: int, threshold: float, most: int = CALIBRATION_ROWS) -> int:
    """Cells to visit for TARGET_RECALL: of at most about ``most`` queries (ids divisible by EVERY, thinned by hash), compared with
    all vectors in one pass, how far down a query's traversal is the cell of a link, or the query's cell down the link's. Each
    query counts alike, however many links it has. With fewer than ENOUGH_LINKED linked queries also TARGET_MOVED of the
    queries' images at the threshold's angle must be met, so a table with few links needs no more than that one pass."""
    place, share = F.pmod(F.xxhash64("least", F.lit(1)), F.lit(1 << 20)), max(1, int((1 << 20) * min(1.0, EVERY * most / max(1, total))))
    drawn = vectors.where((F.pmod("least", F.lit(EVERY)) == 0) & (place < share)).select("rep", "e").limit(2 * most).collect()
    if not drawn:
        drawn = vectors.select("rep", "e").limit(1).collect()
    queries, names = normalised([r.e for r in drawn]), np.array([r.rep for r in drawn])
    table = link_ranks(vectors, grid, threshold, queries, names)
    table["share"] = table.n / table.groupby("q").n.transform("sum") / max(1, table.q.nunique())
    reached = table.groupby("rank").share.sum().sort_index().cumsum()
    cells = [LEAST_VISITS, *(reached[reached >= TARGET_RECALL - 1e-9].index[:1] + 1)]
    if table.q.nunique() < ENOUGH_LINKED:
        queries = np.tile(queries, (max(1, most // len(queries)), 1))  # few queries are moved several ways
        moved = turned(queries, threshold)
        ranks = np.minimum(grid.ranks(queries, grid.visits(moved, 1)[:, 0]), grid.ranks(moved, grid.visits(queries, 1)[:, 0]))
        cells.append(np.quantile(ranks, TARGET_MOVED, method="higher") + 1)
    return int(max(cells))


def turned(x: np.ndarray, cosine: float) -> np.ndarray:
    """Rows of length 1, each moved in a random direction until its cosine with itself as it was is ``cosine``."""
    u = np.random.default_rng(SEED).normal(size=x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    size = np.sqrt((u * u).sum(1, keepdims=True))
    return cosine * x + (1 - cosine * cosine) ** 0.5 * np.divide(u, size, out=np.zeros_like(u), where=size > 0)


def link_ranks(vectors: DataFrame, grid: Grid, threshold: float, queries: np.ndarray, names: np.ndarray) -> pd.DataFrame:
    """(q, rank, n) of the links of queries among all vectors."""
    at = grid.visits(queries, 1)[:, 0]

    def pairs(x, rep):
        for start in range(0, len(queries), QUERIES_AT_ONCE):
            q, v = np.nonzero(queries[start : start + QUERIES_AT_ONCE] @ x.T >= threshold)
            other = names[start + q] != rep[v]
            yield start + q[other], v[other]

    def once(x, row, cell):
        """Ranks of cells for rows; equal pairs are ranked once."""
        pair, back = np.unique(np.stack([row, cell]), axis=1, return_inverse=True)
        return grid.ranks(x[pair[0]], pair[1])[back.ravel()]

    def ranks(batches):
        for b in batches:
            x, rep = normalised(b.column(1).to_pylist()), np.array(b.column(0).to_pylist())
            for q, v in pairs(x, rep):
                if len(q):
                    rows, back = np.unique(v, return_inverse=True)
                    own = grid.visits(x[rows], 1)[back, 0]
                    rank = np.minimum(once(queries, q, own), once(x, v, at[q]))
                    pair, n = np.unique(np.stack([q, rank]), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (pair[0], pair[1], n)], ["q", "rank", "n"])

    counts = vectors.select("rep", "e").mapInArrow(ranks, "q long, rank long, n long").groupBy("q", "rank").agg(F.sum("n").alias("n"))
    return counts.toPandas()


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component, from links (a, b) among nodes 0 to n - 1."""
    root = np.arange(n)
    while len(a):
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        np.minimum.at(low, root, low)
        low = low[root]
        while (low[low] != low).any():
            low = low[low]
        if (low == root).all():
            break
        root = low
    return root


def block_links(threshold: float):
    """Of one block: (rep, links, root) of every vector with a link in it."""

    def run(key, pdf):
        cell = key[0]
        pdf = pdf.sort_values("rep", kind="stable").reset_index(drop=True)
        x = normalised(np.stack(pdf["e"].to_numpy()))
        home, w = pdf["home"].to_numpy(), pdf["w"].to_numpy()
        a_rows, b_rows = np.flatnonzero(pdf["side"].to_numpy() == 0), np.flatnonzero(pdf["side"].to_numpy() == 1)
        rep = pdf["rep"].to_numpy()
        found_a, found_b = [], []
        for start in range(0, len(a_rows), 512):
            i, j = np.nonzero(x[a_rows[start : start + 512]] @ x[b_rows].T >= threshold)
            found_a.append(a_rows[start + i])
            found_b.append(b_rows[j])
        a = np.concatenate(found_a) if found_a else np.zeros(0, int)
        b = np.concatenate(found_b) if found_b else np.zeros(0, int)
        other = rep[a] != rep[b]
        a, b = a[other], b[other]
        # a pair at home in this cell is met from both ends; one of a visitor maybe in the visitor's cell too
        visitor = home[b] != cell
        links = np.zeros(len(pdf), np.int64)
        np.add.at(links, a[~visitor], w[b[~visitor]])
        va, vb = a[visitor], b[visitor]
        if len(va):
            seen = np.stack(pdf["visits"].to_numpy())
            met = np.zeros(len(va), bool)
            for start in range(0, len(va), 100_000):
                s = slice(start, start + 100_000)
                met[s] = (seen[va[s]] == home[vb[s]][:, None]).any(1)
            here = ~met | (cell < home[vb])
            np.add.at(links, va[here], w[vb[here]])
            np.add.at(links, vb[here], w[va[here]])
        names, node = np.unique(rep, return_inverse=True)
        root = forest(len(names), node[a], node[b])
        total = np.bincount(node, weights=links, minlength=len(names)).astype(np.int64)
        linked = np.zeros(len(names), bool)
        linked[node[a]] = linked[node[b]] = True
        return pd.DataFrame({"rep": names[linked], "links": total[linked], "root": names[root[linked]]})

    return run


def placer(grid: Grid, count: int, offset: int):
    """Home and visited cells of vectors, with ``offset`` added."""

    def place(batches):
        for b in batches:
            seen = grid.visits(normalised(b.column(2).to_pylist()), count) + offset
            arrays = [b.column(0), b.column(1), b.column(2), pa.array(seen[:, 0], pa.int64()), pa.array(list(seen), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["rep", "w", "e", "home", "visits"])

    return place


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row: links are pairs of other rows with cosine >= ``threshold``.

    Null, zero and non-finite vectors, vectors with null components, and rows without an id have no links and stay. Finite
    components may be of any magnitude. Vectors of equal components are compared once, for all their rows. Vectors of each
    dimension have an index of their own, however few they are; those of a dimension that a single one has are linked with nothing.
    Rows of equal id are one node of the links, whatever their vectors; ``n_links`` counts rows. Extra columns are ignored; an empty
    table gives no rows. Links found are exact; some may be missed (see TARGET_RECALL).
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("e"))
    good = rows.where(usable(F.col("e")) & F.col("id").isNotNull())
    with Workspace(vectors.sparkSession, "near-vectors") as tables:
        return tables.kept(_links(tables, rows, good, threshold, id_col), "near-vectors-found")


def _links(tables: Workspace, rows: DataFrame, good: DataFrame, threshold: float, id_col: str) -> DataFrame:
    # a class is a vector with the rows that have it: rep is its number, least its smallest id, w its rows
    classes = good.groupBy("e").agg(F.min("id").alias("least"), F.count("*").alias("w")).withColumn("rep", F.monotonically_increasing_id())
    classes = tables.written(classes, "vectors")
    sizes = {r.d: r.n for r in classes.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).collect()}  # a row a dimension
    if not sizes:
        return _without(rows, id_col)
    kind = classes.schema["e"].dataType.simpleString()
    cells = []
    # cells of a dimension are numbered from dimension * CELLS
    for d in sorted(d for d, n in sizes.items() if n > 1):
        main = classes.where(F.size("e") == d)
        grid = fit(main, sizes[d], d)
        place = placer(grid, depth(main, grid, sizes[d], threshold, max(1, min(CALIBRATION_ROWS, SAMPLE_COMPONENTS // d))), d * CELLS)
        cells.append(main.select("rep", "w", "e").mapInArrow(place, f"rep long, w long, e {kind}, home long, visits array<long>"))
    alone = F.size("e").cast("long") * CELLS
    cells.append(classes.where(F.size("e").isin([d for d, n in sizes.items() if n == 1])).select("rep", "w", "e", alone.alias("home"), F.array(alone).alias("visits")))
    placed = tables.written(reduce(DataFrame.union, cells), "vector-cells")
    # blocks of a cell: chunks of the vectors at home there times chunks of the vectors that visit it
    at_home = placed.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("h_chunks"))
    visiting = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("v_chunks"))
    chunks = at_home.join(visiting, "cell")  # a row a cell: the grid bounds it, so it is broadcast
    mine, every = F.pmod(F.xxhash64("rep"), F.col("n")), F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    home_side = placed.withColumn("cell", F.col("home")).join(F.broadcast(chunks), "cell").withColumn("n", F.col("h_chunks")).withColumn("m", F.col("v_chunks"))
    home_side = home_side.select("*", mine.cast("int").alias("h"), every.alias("v"), F.lit(0).alias("side"))
    visit_side = placed.select("*", F.explode("visits").alias("cell")).join(F.broadcast(chunks), "cell").withColumn("n", F.col("v_chunks")).withColumn("m", F.col("h_chunks"))
    visit_side = visit_side.select("*", mine.cast("int").alias("v"), every.alias("h"), F.lit(1).alias("side"))
    columns = ["cell", "h", "v", "side", "rep", "w", "home", "visits", "e"]
    blocks = home_side.select(columns).union(visit_side.select(columns)).groupBy("cell", "h", "v")
    found = tables.written(blocks.applyInPandas(block_links(threshold), "rep long, links long, root long"), "vector-links")
    members = tables.written(good.join(classes.select("e", "rep"), "e").select("id", "rep"), "members")
    # classes that an id has rows of are one node
    shared = members.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last").select("id", "a")
    tied = members.join(shared, "id").select("a", F.col("rep").alias("b"))
    parts = tables.written(components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).union(tied)), "parts")
    least = classes.select("rep", "least").join(parts.withColumnRenamed("id", "rep"), "rep").groupBy("component").agg(F.min("least").alias("node"))
    named = parts.join(least, "component").select(F.col("id").alias("rep"), "node")
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.join(counted, "rep", "left").join(named, "rep", "left")
    known = known.select("rep", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("node", "least").alias("component_id"))
    listed = members.join(known, "rep").select("id", "n_links", "component_id")
    listed = listed.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    return listed.union(_without(rows, id_col))


def _without(rows: DataFrame, id_col: str) -> DataFrame:
    """The result of rows that can't be compared."""
    rest = rows.where(~(usable(F.col("e")) & F.col("id").isNotNull()))
    return rest.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
