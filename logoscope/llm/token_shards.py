"""Documents as token ids in shards that are sorted-string tables keyed by document identifier."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from itertools import accumulate, chain, groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logoscope.llm import sstable
from logoscope.llm.known_pieces import Known, spread
from logoscope.llm.pieces import PATTERN, boundaries, pieces
from logoscope.llm.shared import give_back, new_path, partitions, remembered

#: A file is closed after the document that takes it to this size.
FILE_BYTES = 128 << 20
#: Entries of a batch that a reader hands to Spark.
BATCH_ROWS = 10_000
#: Matches that go to the tokenizers library as one text.
LINES = 100


class Encoder:
    """Ids by a tokenizer file of the tokenizers library, as bytes of unsigned integers.

    A byte-level tokenizer encodes each match of its pattern by itself, so matches seen before are looked up and only
    new ones go to the library. A tokenizer of another kind gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.type = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.line = self._library(["\n"])[0]
        sample = f"It's  the 1st\n\n of 'em,\té² {PATTERN}"
        whole = self._library([sample])[0].tolist()
        parts = self._ask(pieces(sample))[0].tolist()
        self.by_piece = "ByteLevel" in repr(self.library.pre_tokenizer) and whole == parts
        self.cache = Known(self._ask, self.type)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.type) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask(self, matches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of matches of the pattern, one after the other, and the number of each. Those that don't end in white space go
        to the library as lines of a text: they are its matches again, and the id of a line's end is none of theirs."""
        texts, lines = [], []
        for blank, run in groupby(matches, lambda x: x[-1].isspace() or len(self.line) != 1):
            run = list(run)
            step = 1 if blank else LINES
            texts += ["\n".join(run[i : i + step]) for i in range(0, len(run), step)]
            lines += [0 if blank else len(run[i : i + step]) for i in range(0, len(run), step)]
        ids, counts = self._library(texts), []
        for i, n in enumerate(lines):
            if n:
                ends = np.flatnonzero(ids[i] == self.line)
                counts.append(np.diff(ends, prepend=-1, append=len(ids[i])) - 1)
                ids[i] = np.delete(ids[i], ends)
            else:
                counts.append([len(ids[i])])
        return np.concatenate(ids), np.concatenate(counts)

    def _found(self, texts: list[str]):
        """(pool, at, n) of ``Known.look_up`` for the matches in ``texts``, and the first match of each text, the end last."""
        text = "".join(texts)
        heads = np.fromiter(accumulate(map(len, texts), initial=0), np.int64, len(texts) + 1)
        cut = boundaries(text, heads)
        first = np.searchsorted(cut, heads)
        raw = np.frombuffer(text.encode() + bytes(16), np.uint8)
        if len(raw) - 16 > len(text):
            cut = np.append(np.flatnonzero(raw[:-16] & 0xC0 != 0x80), len(raw) - 16)[cut]
        return *self.cache.look_up(raw, cut[:-1], np.diff(cut)), first

    def counts(self, texts: list[str]) -> list[int]:
        """The number of ids of each text."""
        if not self.by_piece:
            return [len(x) for x in self._library(texts)]
        _, _, n, first = self._found(texts)
        return np.diff(np.append(0, np.cumsum(n))[first]).tolist()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return [x.tobytes() for x in self._library(texts)]
        pool, at, n, first = self._found(texts)
        ends = np.append(0, np.cumsum(n))[first] * self.type.itemsize
        every = spread(pool, at, n).tobytes()
        return [every[a:b] for a, b in pairwise(ends.tolist())]


def encoder(path: str) -> Encoder:
    held = remembered("tokenizer")
    if path not in held:
        held[path] = Encoder(path)
        give_back()  # what reading the file took
    return held[path]


def _in_turn(encode, batches, chars: int = 1 << 19):
    """(id, result of ``encode``) of each row, as many texts at once as have about so many characters."""
    ids, texts, held = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            text = t.as_py() or ""
            ids.append(i)
            texts.append(text)
            held += len(text)
            if held >= chars:
                yield from zip(ids, encode(texts), strict=True)
                ids, texts, held = [], [], 0
    yield from zip(ids, encode(texts), strict=True)


def _store(uri: str):
    """The file system of a folder and the folder's path there, by the names that Spark uses for the same stores."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def _batch(columns, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if n == "file" else pa.int64()) for x, n in zip(columns, names, strict=True)], names)


def write_tables(
    docs: DataFrame,
    tokenizer: str,
    out: str,
    end_id: int | None,
    files: int | None = None,
    file_bytes: int = FILE_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encodes every whole text and writes it under ``out`` (a folder that all executors share), in ascending id order
    over the files. Returns the written manifest: file, first and last id, entries, tokens, base (ids before the file).

    Each of ``files`` tasks writes as many files of about ``file_bytes`` as its rows need. Null text counts as empty;
    ``end_id`` is appended to every document. Only files of tasks that ended well are in the manifest: a task that is run
    again writes files of other names. Empty tables give an empty manifest; repeated identifiers lie next to each other,
    also over the end of a file; null identifiers come first; extra columns are ignored.
    """
    spark = docs.sparkSession

    def write(batches):
        coder = encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], coder.type).tobytes()
        store, base = _store(out)
        store.create_dir(base, recursive=True)
        rows = _in_turn(coder.encode_many, batches)
        for head in rows:
            first = head[0]
            name = f"{uuid.uuid4().hex}.sst"
            with store.open_output_stream(f"{base}/{name}") as stream:
                writer = sstable.Writer(stream, coder.type.itemsize)
                for last, ids in chain([head], rows):
                    writer.add(sstable.to_key(last), ids + end)
                    if writer.at + len(writer.block) >= file_bytes:
                        break
                writer.close()
            yield _batch([[name], [first], [last], [writer.entries], [writer.ids]], ["file", "first_id", "last_id", "entries", "tokens"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    rows = rows.repartitionByRange(files or partitions(spark), "id").sortWithinPartitions("id")
    made = rows.mapInArrow(write, "file string, first_id long, last_id long, entries long, tokens long")
    made.write.parquet(f"{out}/manifest")
    manifest = spark.read.parquet(f"{out}/manifest")
    order = [F.col(c).asc_nulls_first() for c in ("first_id", "last_id", "file")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_tables(spark: SparkSession, out: str, manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every entry of the files, read back in parallel, several files a task. A file is
    read by ranges of about ``sstable.READ_BYTES``, so a task holds some blocks and a batch of results."""

    def read(batches):
        store, base = _store(out)
        for b in batches:
            for name, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{name}") as f:
                    rows = []
                    for ident, values in sstable.Reader(lambda spot, n, f=f: f.read_at(n, spot), f.size()):
                        rows.append((ident, at, len(values), zlib.crc32(values.astype("<u4").tobytes())))
                        at += len(values)
                        if len(rows) == BATCH_ROWS:
                            yield _batch(zip(*rows, strict=True), ["id", "start", "n_tokens", "ids_crc32"])
                            rows = []
                    if rows:
                        yield _batch(zip(*rows, strict=True), ["id", "start", "n_tokens", "ids_crc32"])

    dealt = manifest.select("file", "base").repartition(partitions(spark))
    return dealt.mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def lookup(spark: SparkSession, out: str, manifest: DataFrame, wanted: list[int | None]) -> DataFrame:
    """(id, ids) of single documents, null among them: only files whose range can hold one are opened, and of these only
    footer, filter, index and the block that the index names are read. Of a repeated id a file gives its first document."""
    near = F.lit(False)
    for w in wanted:
        low = F.col("first_id").isNull()
        near = near | (low if w is None else (low | (F.col("first_id") <= w)) & F.coalesce(F.col("last_id") >= w, F.lit(False)))

    def find(batches):
        store, base = _store(out)
        for b in batches:
            for name in b.column(0).to_pylist():
                with store.open_input_file(f"{base}/{name}") as f:
                    table = sstable.Reader(lambda spot, n, f=f: f.read_at(n, spot), f.size())
                    hits = [(w, ids) for w in wanted if (ids := table.get(w)) is not None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for w, _ in hits], pa.int64()), pa.array([x.astype(np.int64) for _, x in hits], pa.list_(pa.int64()))], ["id", "ids"]
                )

    held = manifest.where(near).select("file").repartition(partitions(spark))
    return held.mapInArrow(find, "id long, ids array<long>")


def token_counts(docs: DataFrame, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of every row, the end token of ``end_id`` included: texts are encoded where they lie, without a
    shuffle. Null text counts as empty; null and repeated ids stay; extra columns are ignored; empty tables give no rows."""
    end = 0 if end_id is None else 1

    def run(batches):
        coder = encoder(tokenizer)
        for b in batches:
            counts = [n + end for _, n in _in_turn(coder.counts, [b])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], ["id", "n_tokens"])
        b = None
        give_back()

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``docs`` to a new folder of the shared one and returns what its files hold, a row a document."""
    spark = docs.sparkSession
    out = new_path(spark, "token-tables")
    manifest = write_tables(docs, tokenizer, out, end_id, id_col=id_col, text_col=text_col)
    if not manifest.limit(1).count():
        return spark.createDataFrame([], f"{id_col} long, start long, n_tokens long, ids_crc32 long")
    return read_tables(spark, out, manifest, id_col)
