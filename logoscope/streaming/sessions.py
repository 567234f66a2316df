"""The session state machine on live utterances: the same steps as in batch, with the state in Spark's state store.

Within a micro-batch a session's rows are taken in order of seq; sessions have no timeout. The session's state is a
single value, however long the session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from logoscope.operators.session import SENTINELS, SURE, THRESHOLD, Session

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Rows of a slice of replayed detections, and files that a slice and a micro-batch have at most.
SLICE_ROWS, SLICE_FILES = 5_000_000, 8


class SessionProcessor(StatefulProcessor):
    def __init__(self, default: str, threshold: int, sure: float, voiced: list[str] | None):
        self.default, self.threshold, self.sure, self.voiced = default, max(1, threshold), sure, voiced

    def init(self, handle) -> None:
        self.state = handle.getValueState("session", "current string, heard string, effective string")

    def handleInputRows(self, key, rows, timerValues):
        current, heard, effective = self.state.get() if self.state.exists() else (self.default, "", self.default)
        session = Session(self.default, self.threshold, self.sure, current, heard.split(",") if heard else [])
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable").astype(object)
        batch = batch.where(batch.notna(), None)
        before, spoken, after = [], [], []
        for script, lang, conf, words, hint in batch[["script_lang", "lang", "conf", "words", "hint"]].itertuples(index=False):
            before.append(effective)
            spoken.append(session.step(script, lang, conf, words, hint))
            if spoken[-1] in self.voiced if self.voiced is not None else spoken[-1] not in SENTINELS:
                effective = spoken[-1]
            after.append(effective)
        self.state.update((session.current, ",".join(session.heard), effective))
        yield pd.DataFrame({"session": key[0], "seq": batch["seq"].astype("int64"), "before": before, "spoken": spoken, "effective": after})

    def close(self) -> None:
        pass


def session_stream(detections: DataFrame, default: str = "en", threshold: int = THRESHOLD, sure: float = SURE, voiced: list[str] | None = None) -> DataFrame:
    """A stream (session, seq, script_lang, lang, conf, words, hint) with ``spoken``, the language of each utterance, and
    ``before`` and ``effective``, the languages of the voice before and after it. Only a language of ``voiced`` (null: any
    but the sentinels) moves the voice."""
    spark = detections.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kind = detections.schema["session"].dataType.simpleString()
    return detections.groupBy("session").transformWithStateInPandas(
        statefulProcessor=SessionProcessor(default, threshold, sure, voiced),
        outputStructType=f"session {kind}, seq long, before string, spoken string, effective string",
        outputMode="Append",
        timeMode="None",
    )


def replayed(detections: DataFrame, path: str, slice_rows: int = SLICE_ROWS, files: int = SLICE_FILES) -> DataFrame:
    """A stream of the rows of a table of detections, in micro-batches of bounded size, for ``session_stream``.

    They are written under ``path`` in slices of about ``slice_rows`` rows by seq, at least two, one after the other, as a
    stream takes files by their time; a session has one file in a slice. So a session comes in the order of its seq, and
    no micro-batch holds much more of it than a slice, whatever its length. Rows of one seq are in one slice; rows without
    a seq come first."""
    slices = max(2, -(-detections.count() // slice_rows))
    cuts = sorted(set(detections.stat.approxQuantile("seq", [i / slices for i in range(1, slices)], 0.1 / slices)))
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        rows = detections if low is None else detections.where(F.col("seq") > low)
        if high is not None:
            rows = rows.where(F.coalesce(F.col("seq") <= high, F.lit(True)) if low is None else F.col("seq") <= high)
        rows.repartition(files, "session").write.mode("append").parquet(path)
    return detections.sparkSession.readStream.schema(detections.schema).option("maxFilesPerTrigger", files).parquet(path)
