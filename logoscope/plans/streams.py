"""Queries on streams: run over what there is, to the end, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from logoscope.functions import rewrite
from logoscope.plans import duck as D
from logoscope.plans.detection import EVENTS, SESSIONS, VOICED, turn_detections
from logoscope.plans.registry import query, table
from logoscope.plans.texts import docs2
from logoscope.sources import utterances as U
from logoscope.sources.scratch import scratch
from logoscope.streaming.sessions import replayed, session_stream


def to_end(stream, name):
    path = scratch(stream.sparkSession, name)
    return U.run_to_end(stream, f"{path}/out", f"{path}/checkpoint")


def doc_stream(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parque[t]")  # a pattern, as the table may be one file


@query("utterances_stream", f"SELECT doc_id, line_no, text FROM {D.lines('(SELECT * FROM documents)')}")
def utterances_stream(spark, sf_dir):
    return to_end(U.lines(doc_stream(spark, sf_dir)), "utterances")


@query("speakable_stream", f"SELECT doc_id, line_no, {D.expand_unpronounceable('text')} AS said FROM {D.lines(D.DOCS2)}")
def speakable_stream(spark, sf_dir):
    names = rewrite.names_in(docs2(spark, sf_dir), "text")
    lines = U.lines(doc_stream(spark, sf_dir).select("doc_id", F.expr(U.INJECTED).alias("text")))
    return to_end(lines.select("doc_id", "line_no", rewrite.expand_unpronounceable(F.col("text"), names).alias("said")), "speakable")


def spoken_stream(spark, sf_dir):
    path = scratch(spark, "detections")
    found = turn_detections(spark, sf_dir)
    found.write.parquet(path)
    stream = replayed(spark.read.schema(found.schema).parquet(path), scratch(spark, "detections-in-slices"))
    return to_end(session_stream(stream, voiced=VOICED), "sessions")


@query("session_language_stream", SESSIONS + " SELECT conv_id AS session, turn AS seq, spoken FROM f WHERE rn > 0")
def session_language_stream(spark, sf_dir):
    return spoken_stream(spark, sf_dir).select("session", "seq", "spoken")


@query("switch_events_stream", SESSIONS + EVENTS)
def switch_events_stream(spark, sf_dir):
    return spoken_stream(spark, sf_dir).where("effective <> before").select("session", "seq", "before", F.col("effective").alias("lang"))
