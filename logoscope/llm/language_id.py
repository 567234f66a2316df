"""Language identification by string kernels: n-gram presence, Nystroem landmarks, kernel ridge one-versus-rest.

The kernel blends the n-gram orders of ORDERS; for each it is the number of (hashed) byte n-grams that two texts share,
over the geometric mean of the numbers that they have. A text's kernel values with all landmarks come from one matrix
product a batch of texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: n-gram order: cells that its n-grams are hashed to.
ORDERS = {1: 256, 2: 4096, 3: 8192}
WIDTH = sum(ORDERS.values())
#: Labelled rows of one language in the fit at most (a bounded sample by hash of the id), landmarks of one language.
SAMPLE_PER_LANGUAGE, LANDMARKS_PER_LANGUAGE = 800, 32
#: Rows and landmarks of all languages together, which bounds the driver's memory: with more than eight languages each has
#: fewer rows. Languages that are learned at most: those of most rows.
SAMPLE_ROWS, LANDMARKS, LANGUAGES = 6_400, 1_024, 400
RIDGE, SHARPNESS, BATCH = 1e-3, 6.0, 256
UNKNOWN = "und"
_KEEP = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def mark(row: np.ndarray, text: str) -> None:
    """Sets the cells of the whole text's n-grams in a row of WIDTH zeros."""
    b = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass").translate(_KEEP), np.uint8).astype(np.uint32)
    at, code = 0, np.zeros(len(b), np.uint32)
    for n, cells in ORDERS.items():
        code = b if n == 1 else code[:-1] * np.uint32(257) + b[n - 1 :]
        if len(code):
            row[at + ((code * np.uint32(2654435761)) >> np.uint32(32 - cells.bit_length() + 1))] = 1
        at += cells


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Blended kernel between rows of presence matrices."""
    total, at = np.zeros((len(a), len(b)), np.float32), 0
    for cells in ORDERS.values():
        x, y = a[:, at : at + cells], b[:, at : at + cells]
        norm = np.sqrt(np.maximum(x.sum(1), 1))[:, None] * np.sqrt(np.maximum(y.sum(1), 1))
        total += (x @ y.T) / norm
        at += cells
    return total / len(ORDERS)


def sample(rows: DataFrame) -> DataFrame:
    """(lang, bits): presence of the n-grams of about SAMPLE_PER_LANGUAGE rows (id, text, lang) of each language, and of about
    SAMPLE_ROWS of all."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    known = [(r.lang, r.n) for r in counts.collect()]
    counts = rows.sparkSession.createDataFrame(known, "lang string, n long")
    share = min(SAMPLE_PER_LANGUAGE, SAMPLE_ROWS // max(1, len(known)))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < (1 << 20) * F.lit(share) / F.col("n")

    def pack(batches):
        for b in batches:
            langs, bits = [], []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if has_letter(text := text.as_py()):
                    row = np.zeros(WIDTH, np.uint8)
                    mark(row, text)
                    langs.append(lang)
                    bits.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(bits, pa.binary())], ["lang", "bits"])

    return rows.join(F.broadcast(counts), "lang").where(part).select("lang", "text").mapInArrow(pack, "lang string, bits binary")


def train(rows: DataFrame) -> dict | None:
    """A model from rows (id, text, lang); None if no row has a language and a letter. What reaches the driver is WIDTH
    bits for each row of the bounded sample."""
    drawn = sorted((r.lang, bytes(r.bits)) for r in sample(rows).collect())
    if not drawn:
        return None
    names = sorted({lang for lang, _ in drawn})
    x = np.unpackbits(np.array([np.frombuffer(b, np.uint8) for _, b in drawn]), axis=1)[:, :WIDTH].astype(np.float32)
    y = np.array([names.index(lang) for lang, _ in drawn])
    rng = np.random.default_rng(4)
    picked = np.concatenate([rng.permutation(np.flatnonzero(y == k))[: min(LANDMARKS_PER_LANGUAGE, LANDMARKS // len(names))] for k in range(len(names))])
    marks = x[picked]
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(float))
    root = vectors / np.sqrt(np.maximum(values, 1e-8))
    phi = np.hstack([kernel(x, marks) @ root, np.ones((len(x), 1))])
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    weights = np.linalg.solve(phi.T @ phi + RIDGE * len(x) * np.eye(phi.shape[1]), phi.T @ target)
    return {"names": names, "marks": np.packbits(marks.astype(np.uint8), axis=1), "w": (root @ weights[:-1]).astype(np.float32), "bias": weights[-1]}


def predict(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; UNKNOWN with score 0 for null text and text without a letter."""
    kind = docs.schema[id_col].dataType.simpleString()

    def score(texts: list[str], marks: np.ndarray):
        x = np.zeros((len(texts), WIDTH), np.float32)
        for row, text in zip(x, texts, strict=True):
            mark(row, text)
        margin = SHARPNESS * (kernel(x, marks) @ model["w"] + model["bias"])
        p = np.exp(margin - margin.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p.max(1)

    def run(batches):
        marks = np.unpackbits(model["marks"], axis=1)[:, :WIDTH].astype(np.float32) if model else None
        for b in batches:
            names, scores = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            for start in range(0, b.num_rows, BATCH):
                part = b.column(1).slice(start, BATCH).to_pylist()
                some = [i for i, t in enumerate(part) if has_letter(t)] if model else []
                if some:
                    best, p = score([part[i] for i in some], marks)
                    for i, k, s in zip(some, best.tolist(), p.tolist(), strict=True):
                        names[start + i], scores[start + i] = model["names"][k], s
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def identify(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``predict`` for ``docs`` with a model of ``labelled``, of which only text and language are learned.

    Null languages and null or letterless texts teach nothing; texts of any length are read whole; ties go to the first
    language by name; extra columns are ignored; an empty table gives no rows, and one without labels only UNKNOWN."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return predict(docs, train(rows), id_col, text_col)
