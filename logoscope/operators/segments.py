"""Mixed-language texts: runs of words of one language, pauses between them, and changes of language."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logoscope.functions import codepoints as C
from logoscope.functions import text as X
from logoscope.operators import ngram, packed

#: Words on each side that a word's scores are smoothed over; seconds of pause at a change of language.
NEAR, PAUSE = 2, 0.3
SEGMENTS = "array<struct<seg:int,lang:string,text:string>>"
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")


def mixed_texts(texts: DataFrame, model: DataFrame, key: list[str], most: int = X.MIXED_MOST, text_col: str = "text") -> DataFrame:
    """(key, segments) of the texts with two languages or more: array<struct<seg, lang, text>>, runs of words whose smoothed
    scores favour one language. Texts of fewer than 8 or more than ``most`` words aren't split.

    Texts of more than 30 words are taken sentence by sentence (at most 40 words each): a run ends with its chunk, and a
    chunk of fewer than 8 words is of one language. Chunks without letters say nothing. Words without letters have no
    language of their own: they take that of the words around.

    A text is one row throughout, and nothing is shuffled. Only with a model too large to be sent around words become rows
    that are joined to it; keys must then be unique."""
    fits = packed.pack(model)
    if fits is None:
        rows = _joined(texts, model, key, most, text_col)
        parts = F.array_sort(F.collect_list(F.struct("seg", "lang", "text")))
        return rows.groupBy(*key).agg(parts.alias("segments"))
    split = _splitter(texts.sparkSession, fits, max(X.MIXED_LEAST, most))
    return texts.select(*key, split(F.col(text_col)).alias("segments")).where("segments is not null")


def listed(mixed: DataFrame, key: list[str], fields: tuple[str, ...] = ("seg", "lang", "text")) -> DataFrame:
    """The segments of ``mixed`` (key, segments) as rows."""
    return mixed.select(*key, F.explode("segments").alias("_x")).select(*key, *[f"_x.{f}" for f in fields])


def mixed_segments(texts: DataFrame, model: DataFrame, key: list[str], most: int = X.MIXED_MOST, text_col: str = "text") -> DataFrame:
    """(key, seg, lang, text): the rows of ``mixed_texts``."""
    return listed(mixed_texts(texts, model, key, most, text_col), key)


def chunks_of(text: str, most: int) -> list[list[str]]:
    """Words of a text by chunk; no chunk of a text that isn't worth a search."""
    words = text.split()
    if not X.MIXED_LEAST <= len(words) <= most:
        return []
    if len(words) <= X.WHOLE_WORDS:
        return [words]
    sentences = [s.split() for s in SENTENCE_END.split(text)]
    return [s[i : i + X.CHUNK_WORDS] for s in sentences for i in range(0, len(s), X.CHUNK_WORDS)]


def _splitter(spark: SparkSession, model: packed.Packed, most: int):
    """UDF text -> SEGMENTS, null for a text of one language. The words of a batch lie in one array: scores of a word's
    neighbourhood are differences of running sums, runs are cut where language, chunk or text changes."""
    shared = spark.sparkContext.broadcast(model)

    def split(texts: pa.Array) -> pa.Array:
        model, n = shared.value, len(texts)
        chunks = [(i, c) for i, t in enumerate(texts.to_pylist()) if t for c in chunks_of(t, most)]
        tokens = [w for _, c in chunks for w in c]
        sizes = np.fromiter((len(c) for _, c in chunks), np.int64, len(chunks))
        points, of = C.flatten([w.lower() for w in tokens])
        letter = (model.flags[points] & C.LETTER) > 0
        score, grams = model.sums(points[letter], of[letter], len(tokens))
        chunk = np.repeat(np.arange(len(chunks)), sizes)
        said = np.bincount(chunk, grams, len(chunks))[chunk] > 0
        start, end = (np.cumsum(sizes) - sizes)[chunk], np.cumsum(sizes)[chunk]
        at, short = np.arange(len(tokens)), sizes[chunk] < X.MIXED_LEAST
        running = np.vstack([np.zeros(score.shape[1]), np.cumsum(score, axis=0)])
        low, high = np.where(short, start, np.maximum(start, at - NEAR)), np.where(short, end, np.minimum(end, at + NEAR + 1))
        lang = (running[high] - running[low])[said].argmax(1) if len(model.languages) else np.zeros(0, np.int64)
        at, chunk = (at[said], chunk[said]) if len(lang) else (at[:0], chunk[:0])
        text = np.fromiter((i for i, _ in chunks), np.int64, len(chunks))[chunk]
        # texts of one language go; then runs of the rest
        first = np.flatnonzero(C.edges(text))
        mixed = np.zeros(n, bool)
        if len(first):
            mixed[text[first]] = np.minimum.reduceat(lang, first) != np.maximum.reduceat(lang, first)
        kept = mixed[text]
        at, chunk, text, lang = at[kept], chunk[kept], text[kept], lang[kept]
        cut = np.flatnonzero(C.edges(text) | C.edges(chunk) | C.edges(lang)) if len(at) else at
        runs = np.bincount(text[cut], minlength=n)
        ends = np.append(cut[1:], len(at))
        said = [" ".join([tokens[j] for j in at[a:b]]) for a, b in zip(cut, ends, strict=True)] if len(cut) else []
        seg = np.arange(len(cut)) - (np.cumsum(runs) - runs)[text[cut]]
        names = pa.array(model.languages, pa.string()).take(pa.array(lang[cut]))
        rows = pa.StructArray.from_arrays([pa.array(seg, pa.int32()), names, pa.array(said, pa.string())], ["seg", "lang", "text"])
        offsets = np.concatenate([[0], np.cumsum(runs)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), rows, mask=pa.array(~mixed))

    return F.arrow_udf(C.in_slices(split), SEGMENTS)


def _joined(texts: DataFrame, model: DataFrame, key: list[str], most: int, text_col: str) -> DataFrame:
    """(key, seg, lang, text) with a model of any size. Texts are dealt by key once, before they are cut; grams, words,
    windows and runs stay in that partitioning. The number of partitions is given, since a text grows to a row a letter."""
    by = ngram.wide(model)
    n = range(len(by.languages))
    text = F.col(text_col)
    long = F.size(X.words(text)) > X.WHOLE_WORDS
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.where(X.mixed_eligible(text, F.lit(2), most)).select(*key, text_col).repartition(parts, *key)
    chunks = F.when(long, X.sentence_chunks(text)).otherwise(F.array(text))
    cut = dealt.select(*key, long.alias("long"), F.posexplode(chunks).alias("chunk", "part")).where(F.col("part").rlike(r"\p{L}"))
    tokens = X.words(F.col("part"))
    short = F.col("long") & (F.size(tokens) < X.MIXED_LEAST)
    split = cut.select(*key, "chunk", short.alias("short"), F.posexplode(tokens).alias("pos", "token"))
    word = F.array_join(ngram.word_list(F.col("token")), "")
    graded = split.select(*key, "chunk", "short", "pos", "token", F.explode_outer(ngram.grams_of(word)).alias("gram"))
    scored = by.joined(graded).groupBy(*key, "chunk", "pos").agg(F.first("token").alias("token"), F.first("short").alias("short"), *by.sums())
    inside = Window.partitionBy(*key, "chunk").orderBy("pos")
    around, across = inside.rowsBetween(-NEAR, NEAR), inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    score = lambda i: F.coalesce(F.col(f"s_{i}"), F.lit(0))
    near = [F.when(F.col("short"), F.sum(score(i)).over(across)).otherwise(F.sum(score(i)).over(around)).alias(f"near_{i}") for i in n]
    best = F.array_min(F.array(*[F.struct((-F.col(f"near_{i}")).alias("s"), F.lit(by.languages[i]).alias("lang")) for i in n]))
    spoken = scored.select(*key, "chunk", "pos", "token", *near).select(*key, "chunk", "pos", "token", best.getField("lang").alias("lang"))
    along, whole = Window.partitionBy(*key).orderBy("chunk", "pos"), Window.partitionBy(*key)
    changed = ((F.lag("lang").over(along) != F.col("lang")) | (F.lag("chunk").over(along) != F.col("chunk"))).cast("int")
    runs = spoken.withColumn("changed", F.coalesce(changed, F.lit(0))).withColumn("seg", F.sum("changed").over(along))
    runs = runs.withColumn("least", F.min("lang").over(whole)).withColumn("most", F.max("lang").over(whole)).where("least <> most")
    said = F.array_join(F.array_sort(F.collect_list(F.struct("pos", "token"))).getField("token"), " ")
    return runs.groupBy(*key, "seg", "lang").agg(said.alias("text")).select(*key, F.col("seg").cast("int").alias("seg"), "lang", "text")


def switch_pauses(segments: DataFrame, key: list[str], order: str = "seg", pause: float = PAUSE) -> DataFrame:
    """``segments`` with the pause before each: ``pause`` seconds where the language differs from the one before."""
    before = F.lag("lang").over(Window.partitionBy(*key).orderBy(order))
    return segments.withColumn("pause", F.when(before != F.col("lang"), F.lit(float(max(0.0, pause)))).otherwise(0.0))


def with_pauses(segments: Column, pause: float = PAUSE) -> Column:
    """An array of segments with the pause before each, as ``switch_pauses`` of rows."""
    said = lambda x, i: F.when((i > 0) & (F.get(segments, i - 1)["lang"] != x["lang"]), F.lit(float(max(0.0, pause)))).otherwise(0.0)
    return F.transform(segments, lambda x, i: x.withField("pause", said(x, i)))


def switch_events(spoken: DataFrame, session: str, order: str, lang: str, start: str, voiced: list[str]) -> DataFrame:
    """(session, order, before, lang) of each effective change of language; sessions begin in ``start``.

    Only a language with a voice (see ``voiced``) takes effect: another one, or a sentinel, leaves the voice as it is."""
    before = F.coalesce(F.lag(lang).over(Window.partitionBy(session).orderBy(order)), F.lit(start))
    heard = spoken.where(F.col(lang).isin(voiced))
    return heard.select(session, order, before.alias("before"), F.col(lang).alias("lang")).where("lang <> before")
