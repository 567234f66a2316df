"""Quality classification: random Fourier features of document statistics, ridge scores, isotonic calibration.

The features z(x) = sqrt(2/D) cos(Wx + b) approximate a Gaussian kernel (Rahimi and Recht 2007). Each partition sums its
share of the normal equations, partial sums are added in groups of partitions, and one D x D system is solved. Scores are
calibrated by pool-adjacent-violators over a histogram of scores of rows that the ridge fit has not seen.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logoscope.llm.shared import Workspace, give_back, remembered, written

STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper", "digit", "symbol", "punctuation", "white",
    "non_ascii", "line_length", "distinct_words", "repeated_pairs", "top_word", "shouted_words", "lone_symbols", "symbol_ends",
    "short_words",
)
#: Number of Fourier features, kernel width in units of the statistics' standard deviations, ridge weight, seed.
FEATURES, WIDTH, RIDGE, SEED = 192, 4.0, 1e-4, 20
#: Cells of the score histogram that is calibrated, and partial sums that reach the driver.
CELLS, SUMS = 1000, 16
#: Labelled rows of which statistics enter the fit at most: a bounded sample by hash, evenly over all rows.
MAX_FIT = 2_000_000
#: Rows that go, up to this number, are broadcast as (id, hash of the text) to take them out; more are joined by shuffle.
BROADCAST_ROWS = 500_000
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("a") : ord("z") + 1] = 3
_KIND[ord("0") : ord("9") + 1] = 4
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_KIND[128:] = 7


def statistics(text: str) -> list[float]:
    """STATISTICS of one whole text, in time linear in its length."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=8) / n
    words = raw.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    ends = sum(c for w, c in tally.items() if _KIND[w[-1]] == 6 or w.endswith(b"!!"))
    shouted = sum(c for w, c in tally.items() if len(w) > 1 and w == w.upper() and w != w.lower())
    lone = sum(c for w, c in tally.items() if len(w) == 1 and _KIND[w[0]] == 6)
    return [
        math.log1p(n), math.log1p(len(words)), float(lengths.mean()), float(lengths.std()),
        float(counts[2]), float(counts[4]), float(counts[6]), float(counts[5]), float(counts[1]), float(counts[7]),
        math.log1p(n / (1 + raw.count(b"\n"))), len(tally) / m, 1 - pairs / max(1, len(words) - 1), max(tally.values(), default=0) / m,
        shouted / m, lone / m, ends / m, float((lengths <= 2).mean()),
    ]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<double>): the statistics of every text; null counts as empty. Reads each whole text once."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        remembered("statistics")
        for b in batches:
            x = [statistics(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["id", "x"])
        b = None
        give_back()

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"id {kind}, x array<double>")


def features(x: np.ndarray, centre: np.ndarray, scale: np.ndarray, count: int = FEATURES) -> np.ndarray:
    """Random Fourier features of standardised statistics, with a constant at the end."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(size=(x.shape[1], count)) / WIDTH
    phase = rng.uniform(0, 2 * np.pi, count)
    z = np.clip((x - centre) / scale, -8, 8)
    return np.hstack([math.sqrt(2 / count) * np.cos(z @ w + phase), np.ones((len(x), 1))])


def isotonic(cells: np.ndarray, positives: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over cells in ascending order: (centres of the cells, non-decreasing rates)."""
    blocks: list[list[float]] = []
    for p, t in zip(positives.tolist(), totals.tolist(), strict=True):
        blocks.append([p, t, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p2, t2, n2 = blocks.pop()
            blocks[-1][0] += p2
            blocks[-1][1] += t2
            blocks[-1][2] += n2
    return cells, np.array([p / t for p, t, n in blocks for _ in range(n)])


def _partial_sums(rows: DataFrame, centre: np.ndarray, scale: np.ndarray, weight: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Z'WZ and Z'Wy over (x, y): summed in each partition, then in SUMS groups of partitions, then here."""
    d = FEATURES + 1

    def part(batches):
        from pyspark import TaskContext

        total = np.zeros((d, d + 1))
        seen = 0
        for b in batches:
            x = np.array(b.column(0).to_pylist(), float).reshape(-1, len(centre))
            y = np.array(b.column(1).to_pylist(), float)
            z = features(x, centre, scale)
            zw = z * np.where(y > 0, weight[1], weight[0])[:, None]
            total[:, :d] += zw.T @ z
            total[:, d] += zw.T @ y
            seen += len(y)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SUMS], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["g", "s"])

    def add(key, pdf):
        import pandas as pd

        total = sum(np.frombuffer(s) for s in pdf["s"])
        return pd.DataFrame({"s": [total.tobytes()]})

    sums = rows.select("x", "y").mapInArrow(part, "g int, s binary").groupBy("g").applyInPandas(add, "s binary").collect()
    total = sum((np.frombuffer(bytes(r.s)) for r in sums), np.zeros(d * (d + 1))).reshape(d, d + 1)
    return total[:, :d], total[:, d]


def train(tables: Workspace, stats: DataFrame, labelled: DataFrame) -> dict:
    """A model from ``stats`` (id, x) of all rows and ``labelled`` (id, y, fold): fold 0 fits, fold 1 calibrates.

    At most about MAX_FIT labelled rows enter the fit. Without labels of both kinds the model scores all rows by the
    share of label 1 (1 where there are no labels)."""
    n = len(STATISTICS)
    moments = stats.agg(
        F.count("*").alias("n"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(n)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(n)]
    ).first()
    rows = stats.join(labelled, "id").select("x", F.col("y").cast("double").alias("y"), "fold")
    rows = tables.written(rows, "labelled")
    tally = {(r.fold, r.y): r["count"] for r in rows.groupBy("fold", "y").count().collect()}
    ones, zeros = (sum(c for (f, y), c in tally.items() if y == v) for v in (1.0, 0.0))
    flat = {"flat": ones / (ones + zeros) if ones + zeros else 1.0}
    if not tally.get((0, 1.0)) or not tally.get((0, 0.0)) or not moments.n:
        return flat
    centre = np.array([moments[f"m{i}"] for i in range(n)])
    scale = np.array([moments[f"s{i}"] or 1.0 for i in range(n)])
    fit = rows.where("fold = 0")
    held = tally[0, 1.0] + tally[0, 0.0]
    if held > MAX_FIT:
        fit = fit.where(F.pmod(F.xxhash64("x"), F.lit(1 << 20)) < int((1 << 20) * MAX_FIT / held))
    even = (0.5 * held / tally[0, 0.0], 0.5 * held / tally[0, 1.0])
    a, b = _partial_sums(fit, centre, scale, even)
    beta = np.linalg.solve(a + RIDGE * held * np.eye(len(b)), b)
    model = {"centre": centre, "scale": scale, "beta": beta}
    raw = scored(rows.where("fold = 1").withColumnRenamed("y", "id").select("id", "x"), model, "double")
    cell = F.least(F.greatest(F.floor(F.col("score") * CELLS), F.lit(0)), F.lit(CELLS - 1))
    bins = raw.groupBy(cell.alias("cell")).agg(F.sum("id").alias("ones"), F.count("*").alias("all")).orderBy("cell").collect()
    if bins:
        at = np.array([(r["cell"] + 0.5) / CELLS for r in bins])
        model["cells"], model["rates"] = isotonic(at, np.array([r["ones"] for r in bins]), np.array([r["all"] for r in bins], float))
    return model


def score_of(x: np.ndarray, model: dict) -> np.ndarray:
    """Scores of rows of STATISTICS."""
    if "flat" in model:
        return np.full(len(x), model["flat"])
    score = np.clip(features(x, model["centre"], model["scale"]) @ model["beta"], 0, 1)
    return np.interp(score, model["cells"], model["rates"]) if "cells" in model else score


def scored(stats: DataFrame, model: dict, kind: str) -> DataFrame:
    """(id, score from 0 to 1) of every row of ``stats``."""

    def run(batches):
        for b in batches:
            score = score_of(np.array(b.column(1).to_pylist(), float).reshape(-1, len(STATISTICS)), model)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], ["id", "score"])

    return stats.select("id", "x").mapInArrow(run, f"id {kind}, score double")


def labelled_rows(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, y, fold) of labels 0 or 1 with an id: a quarter of them, by the crc32 of the id, is fold 1."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    fold = (F.pmod(F.shiftright(F.crc32(F.col(id_col).cast("string").cast("binary")), 8), F.lit(4)) == 3).cast("int")
    return known.select(F.col(id_col).alias("id"), F.col(label_col).alias("y"), fold.alias("fold"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, score) of every row of ``docs``, learned from ``labels`` (id, label 0 or 1) alone.

    A quarter of the labelled rows calibrates; the others fit. Null and empty texts have statistics of zero and are scored
    like any other. Null labels and ids teach nothing; of an id with several labels each counts, and so does each of
    several rows of an id. Extra columns are ignored. An empty table gives no rows; without usable labels see ``train``.
    The result is read from a table of all rows' statistics in the shared folder.
    """
    stats = written(measured(docs, id_col, text_col), "quality-statistics")
    with Workspace(docs.sparkSession, "quality") as tables:
        model = train(tables, stats, labelled_rows(labels, id_col, label_col))
    return scored(stats, model, docs.schema[id_col].dataType.simpleString()).withColumnRenamed("id", id_col)


def keep_good(
    docs: DataFrame, labels: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``least``, columns unchanged: scored where they lie. The model is that
    of ``quality_scores``; rows with a null id are scored like others. What goes is a table of the shared folder, of ids and
    hashes of texts, and is taken out when the result is read: so no copy of the texts that stay is left there, and a caller
    who writes the result hands no texts to Python. Rows of one id and text have one score and go or stay together."""
    with Workspace(docs.sparkSession, "quality") as tables:
        stats = tables.written(measured(docs, id_col, text_col), "statistics")
        model = train(tables, stats, labelled_rows(labels, id_col, label_col))

    def run(batches):
        remembered("statistics")
        for b in batches:
            x = np.array([statistics(t.as_py() or "") for t in b.column(2)], float).reshape(-1, len(STATISTICS))
            goes = pa.array(~(score_of(x, model) >= least))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["__gone", "__text"]).filter(goes)
        b = None
        give_back()

    named, hashed = docs[f"`{id_col}`"], F.xxhash64(docs[f"`{text_col}`"])
    rows = docs.select(named.alias("__gone"), hashed.alias("__text"), docs[f"`{text_col}`"].alias("__whole"))
    gone = written(rows.mapInArrow(run, f"__gone {docs.schema[id_col].dataType.simpleString()}, __text long"), "quality-gone")
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, named.eqNullSafe(gone["__gone"]) & (hashed == gone["__text"]), "left_anti")
