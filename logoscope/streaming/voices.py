"""Voices for a stream of utterances, by settings that may change while the stream runs.

Settings are a table of versions: the rows that a tenant publishes at one time replace all that it had. The table is read
anew for each micro-batch, so a running stream takes up what was published since the batch before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FIELDS = ["voice_name", "voice_dialect", "rate", "average_pitch", "gain"]


def publish(settings: DataFrame, since, path: str) -> None:
    """Adds a version: ``settings`` (tenant, lang, FIELDS) hold for their tenants from ``since`` on. Other tenants keep theirs.

    Published twice, a version is the same as once. A tenant that loses all its languages publishes one row with a null
    language."""
    settings.select(F.lit(since).cast("long").alias("since"), "tenant", "lang", *FIELDS).write.mode("append").parquet(path)


def voiced_at(rows: DataFrame, versions: DataFrame, at: str, other: str = "caller") -> DataFrame:
    """``rows`` (tenant, lang, at, ...) with the voice that their tenant's settings had for their language at that time.

    ``other`` where there is none: no version by then, a language that the version in force lacks, an empty voice name, or a
    null tenant, language or time. Of several rows of one version and language the smallest counts."""
    # dealt out before they are grouped: small files of many rows are read in few tasks
    parts = int(versions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = versions.where("tenant IS NOT NULL AND since IS NOT NULL").repartition(parts, "tenant")
    times = known.groupBy("tenant").agg(F.array_sort(F.collect_set("since")).alias("__times"))
    held = known.where("voice_name IS NOT NULL AND voice_name <> '' AND lang IS NOT NULL")
    held = held.groupBy("tenant", "lang", F.col("since").alias("__version")).agg(F.min(F.struct(*FIELDS)).alias("__voice"))
    version = F.array_max(F.filter("__times", lambda t: t <= F.col(at)))
    found = rows.join(times, "tenant", "left").withColumn("__version", version).join(held, ["tenant", "lang", "__version"], "left")
    fields = [F.col(f"__voice.{f}").alias(f) for f in FIELDS[1:]]
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce("__voice.voice_name", F.lit(other)).alias("voice_name"), *fields)


def voiced_stream(rows: DataFrame, path: str, at: str, out: str, checkpoint: str, other: str = "caller") -> StreamingQuery:
    """A running stream of ``rows`` with their voices, written under ``out``; ``path`` is the table of ``publish``, which must
    hold a version.

    A micro-batch has a folder of its own that it replaces, so one that is run again after a stop leaves its rows once. A
    version published after a batch doesn't change rows written before."""

    def batch(some: DataFrame, number: int) -> None:
        versions = some.sparkSession.read.parquet(path)
        voiced_at(some, versions, at, other).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
