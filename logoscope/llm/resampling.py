"""Importance resampling of documents towards a target: hashed n-gram counts of both sides, a weight for each document,
and a draw without replacement by Gumbel noise (Xie et al., Data Selection for Language Models via Importance Resampling, 2023).

Texts are read once. Separators are collapsed to single spaces; a regular expression for each number of words, with overlapping
matches and a look around at the words' ends, finds the spans of the n-grams, whose bytes are hashed as they stand. What is
written of a document are its bucket numbers, two bytes a feature, so counting and weighing don't scan again. Tasks count
buckets before the shuffle, which therefore holds at most a row a bucket and task; texts are never shuffled.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logoscope.llm.shared import Workspace, partitions

#: Buckets of features, words of the longest one, words of a document that can be drawn, and share that is drawn.
BUCKETS, ORDERS, LEAST_WORDS, PERCENT = 10_000, 3, 20, 5
#: Bytes of a text from which on its matches aren't listed.
LONG_TEXT = 1 << 24
#: Gains and noise are whole thousandths.
SCALE = 1000
#: Bytes as they count: capitals of ASCII lowered, letters, digits and bytes beyond ASCII kept, the rest a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_ROW_BITS = 33  # monotonically_increasing_id: partition above, row below


def scanners(orders: int) -> list:
    """For each number of words a pattern that matches the space before a word and looks ahead at the run that begins there."""
    import regex

    return [regex.compile(rb" (?=([^ ]++" + rb" [^ ]++" * n + rb")(?![^ ]))") for n in range(orders)]


def features(text: bytes, scans: list) -> np.ndarray:
    """The crc32 of every run of words of a normalised text (a single space before each word). A long text's matches come one by
    one, so that no list of them is held."""
    every = (lambda s: s.findall(text, overlapped=True)) if len(text) < LONG_TEXT else (lambda s: (m[1] for m in s.finditer(text, overlapped=True)))
    return np.concatenate([np.fromiter(map(zlib.crc32, every(s)), np.uint32) for s in scans])


def normalised(text: bytes) -> bytes:
    return b" ".join([b"", *text.translate(WORDS).split()])


def bucketed(texts: DataFrame, text_col: str, orders: int, buckets: int, kept: list[Column]) -> DataFrame:
    """``kept`` columns with n_words, n_features and held, the sorted bucket numbers of a text's features as bytes."""
    kind = _kind(buckets)

    def run(batches):
        scans = scanners(orders)
        for b in batches:
            n_words, n_features, held = [], [], []
            for text in b.column(0).cast(pa.large_binary()):
                flat = normalised(text.as_py() or b"")
                found = np.sort((features(flat, scans) % buckets).astype(kind))
                n_words.append(flat.count(b" "))
                n_features.append(len(found))
                held.append(found.tobytes())
            columns = [*b.columns[1:], pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(held, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names[1:], "n_words", "n_features", "held"])

    rows = texts.select(F.col(text_col).alias("_text"), *kept)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, schema + "n_words long, n_features long, held binary")


def _kind(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def bucket_counts(held: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) over all rows; each task counts its own before the shuffle."""
    kind = _kind(buckets)

    def run(batches):
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column(0):
                n += np.bincount(np.frombuffer(x.as_py(), kind), minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], ["bucket", "n"])

    return held.select("held").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """What a feature of each bucket says for the target, in thousandths: the smoothed log ratio of its shares. The table has
    a row a bucket, so the number of buckets bounds what the driver gets."""
    n = raw.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    n = n.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    n = n.collect()
    s, t = (sum(r[c] for r in n) + buckets for c in ("s", "t"))
    out = np.zeros(buckets, np.int64)
    for r in n:
        out[r.bucket] = math.floor(SCALE * math.log((r.t + 1.0) * s / ((r.s + 1.0) * t)))
    return out


def noise(seed: str, ident: Column) -> Column:
    """Gumbel noise of an identifier in thousandths, from a sha256; null counts as an empty identifier."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(hexed, 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(tables: Workspace, rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``place``, their number from 1 in ``order``: dealt by range, sorted where they lie, and moved by the
    rows of the ranges before, of which there is one number a partition. ``order`` must not tie, so no range is hot."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    laid = tables.written(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_at", _ROW_BITS).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = laid.groupBy(part).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1) + 1
    return laid.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("place", place).drop("_part", "_at", "_before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    seed: str = "42",
    orders: int = ORDERS,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of ``docs``: how much its features are those of ``target`` (by
    its ``text_col``), that plus noise, and its place among the ``percent`` of the documents of at least ``least_words``
    words that are drawn; null for the others.

    Ties go to the smaller id, rows without one last. Null and empty texts have no feature and weight 0. Rows of a repeated
    id share their noise and are drawn each; of equal rows of one id either comes first. An empty target, or one without
    words, counts nothing for every bucket. Extra columns are ignored, whatever their names; an empty table gives no rows.
    """
    with Workspace(docs.sparkSession, "resampling") as tables:
        ident = docs[id_col].alias("id")
        held = bucketed(docs.select(ident, docs[text_col].alias("text")), "text", orders, buckets, [F.col("id")])
        held = tables.written(held.withColumn("row", F.monotonically_increasing_id()), "features")
        gain = gains(bucket_counts(held, buckets), bucket_counts(bucketed(target, text_col, orders, buckets, []), buckets), buckets)
        kind = _kind(buckets)

        def weigh(batches):
            for b in batches:
                weights = [int(gain[np.frombuffer(x.as_py(), kind)].sum()) for x in b.column("held")]
                columns = [b.column(c) for c in ("row", "id", "n_words", "n_features")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(weights, pa.int64())], ["row", "id", "n_words", "n_features", "weight"])

        id_kind = held.schema["id"].dataType.simpleString()
        weighed = held.select("row", "id", "n_words", "n_features", "held").mapInArrow(weigh, f"row long, id {id_kind}, n_words long, n_features long, weight long")
        scored = tables.written(weighed.withColumn("score", F.col("weight") + noise(seed, F.col("id"))), "scores")
        long = F.col("n_words") >= least_words
        drawn = percent * scored.where(long).count() // 100
        placed = ranked(tables, scored.withColumn("long", long), [F.desc("long"), F.desc("score"), F.asc_nulls_last("id"), F.asc("row")])
        rank = F.when(F.col("long") & (F.col("place") <= drawn), F.col("place"))
        return tables.kept(placed.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.alias("rank")), "resampled")
