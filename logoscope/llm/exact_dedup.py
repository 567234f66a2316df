"""Exact deduplication by content sort, in DataFrame operations only.

Rows are range-partitioned by sampled splitters over the start of the normalised text (a hash settles equal starts, and
a salt divides texts that very many rows share), each partition is sorted externally by the whole normalised text, and
neighbours are compared in full: a run of equal texts is a group. Runs of a divided text are then merged; there are few
of them by construction, as a text is divided only if it has more than ``rows / MAX_HOT`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logoscope.llm.shared import Workspace, partitions, written

WHITE = " \t\n\x0b\f\r"
#: At most so many texts can be hot: a hot text has more than 1/MAX_HOT of all rows. This bounds what is broadcast.
MAX_HOT = 10_000
#: Texts with no more rows than this are never divided.
LEAST_HOT = 64
#: Characters of the normalised text in a splitter: keeps the sample of splitters small, however long texts are.
SPLITTER_CHARS = 48


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Rows with equal normalised text form a group; the row with the most code points in its original text stays, of
    several the smallest id. A null id counts as larger than any other: such a row stays only before shorter texts or in a
    group of null ids, and then one row of the group does, with a null keep_id. Null and empty texts and texts of white
    space are equal to each other. Extra columns are ignored, whatever their names. Repeated ids count as rows of their
    own, all of them kept if their id is; an empty table gives no rows. The result is read from a table of the shared
    folder; what led to it is deleted.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("id"),
        normalised(F.col(text_col)).alias("norm"),
        F.coalesce(F.length(F.col(text_col)), F.lit(0)).alias("n_cp"),
    )
    with Workspace(spark, "content-sort") as tables:
        hashed = rows.select(F.xxhash64("norm").alias("h"))
        total = docs.count()
        limit = max(LEAST_HOT, -(-total // MAX_HOT))
        hot = hashed.groupBy("h").agg(F.count("*").alias("rows_of")).where(F.col("rows_of") > limit)
        hot = tables.written(hot.select("h", F.ceil(F.col("rows_of") / limit).cast("long").alias("cuts")), "hot-texts")
        keyed = (
            rows.withColumn("h", F.xxhash64("norm"))
            .join(F.broadcast(hot), "h", "left")
            .select(
                "id",
                "norm",
                "n_cp",
                "h",
                F.col("cuts").isNotNull().alias("divided"),
                F.substring("norm", 1, SPLITTER_CHARS).alias("start"),
                F.coalesce(F.pmod(F.xxhash64("id"), F.col("cuts")), F.lit(0)).alias("salt"),
            )
            .repartitionByRange(partitions(spark), "start", "h", "salt")
        )
        run = Window.partitionBy("start", "h", "salt", "norm").orderBy(F.desc("n_cp"), F.asc_nulls_last("id"))
        whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        runs = written(
            keyed.select(
                "id",
                "divided",
                F.first("id").over(run).alias("lead"),
                F.first("n_cp").over(run).alias("lead_cp"),
                F.row_number().over(run).alias("at"),
                F.count("*").over(whole).alias("size"),
                F.sha2("norm", 256).alias("text_sha256"),
            ),
            "text-runs",
        )
    merged = (
        runs.where("divided and at = 1")
        .groupBy("text_sha256")
        .agg(
            F.min(F.struct((-F.col("lead_cp")).alias("cp"), F.col("lead").isNull().alias("none"), "lead")).getField("lead").alias("all_lead"),
            F.sum("size").alias("all_size"),
        )
    )
    divided = F.col("all_size").isNotNull()
    keep = F.when(divided, F.col("all_lead")).otherwise(F.col("lead"))
    # a divided text has all its null ids in one run, as their salt is the same
    kept = F.coalesce(F.col("id") == keep, F.col("id").isNull() & keep.isNull() & (F.col("at") == 1))
    return runs.join(F.broadcast(merged), "text_sha256", "left").select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("all_size", "size").alias("group_size"), kept.alias("kept"), "text_sha256"
    )


#: Dropped rows up to this number are broadcast as (id, hash of the text) to take them out; more are joined by shuffle.
BROADCAST_ROWS = 500_000


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that another row of equal text replaces; columns unchanged.

    Rows of one id and text stay or go together. Of rows with a null id one stays for each text that no row with an id
    has."""
    groups = exact_groups(docs, id_col, text_col)
    sha = F.sha2(normalised(docs[text_col]), 256)
    gone = groups.where(~F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__gone"), F.col("text_sha256").alias("__text")).distinct()
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    named = docs.where(docs[id_col].isNotNull()).join(F.broadcast(gone) if few else gone, (docs[id_col] == F.col("__gone")) & (sha == F.col("__text")), "left_anti")
    nulls = groups.where(F.col(id_col).isNull())
    if not nulls.limit(1).count():
        return named
    first = F.row_number().over(Window.partitionBy("__text").orderBy(F.desc(F.length(text_col))))
    nameless = docs.where(docs[id_col].isNull()).withColumn("__text", sha).withColumn("__at", first).where("__at = 1")
    stays = nulls.where("kept").select("text_sha256").distinct()
    nameless = nameless.join(stays, F.col("__text") == F.col("text_sha256"), "left_semi")
    return named.unionByName(nameless.select(*[f"`{c}`" for c in docs.columns]))
