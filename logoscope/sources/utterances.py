"""Utterances: lines of documents, lists of elements, turns of conversations, streams of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logoscope.functions.text import is_blank

#: Written in texts by queries, so that symbols and scripts which the tables lack occur; the same in Spark and DuckDB.
INJECTED = """text || CASE doc_id % 8 WHEN 0 THEN ' Привет мир' WHEN 1 THEN ' :) ' WHEN 2 THEN ' ──────' WHEN 3 THEN ' 漢字かな'
 WHEN 4 THEN ' →→ ½ ©' WHEN 5 THEN ' שלום' WHEN 6 THEN ' ⠓⠑⠇⠇⠕' ELSE ' 😀 at 12:30:45 👨‍👩‍👧' END"""


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, line_no, text, ...): lines of texts that aren't blank, numbered from 0 as they stand."""
    rows = docs.select(id_col, *keep, F.posexplode(F.split(text_col, "\n")).alias("line_no", "text"))
    return rows.where(~is_blank(F.col("text")))


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a streaming query over what there is, writes Parquet, and reads it back."""
    spark: SparkSession = stream.sparkSession
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
