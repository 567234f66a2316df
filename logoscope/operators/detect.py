"""Language of texts: script first, then statistics for what is left; and which hint goes before which."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logoscope.functions import codepoints as C
from logoscope.functions import scripts
from logoscope.functions import tables as T
from logoscope.functions import text as X
from logoscope.operators import ngram, packed
from logoscope.operators.packed import Scorer

MODES = ("off", "markup_only", "markup_text", "always")


def signals_udf(spark: SparkSession):
    """UDF text -> struct<script, words, natural>: dominant script, number and text of natural words; null for blank texts."""
    shared = C.shared_tables(spark)

    def read(texts: pa.Array) -> pa.Array:
        blank, script, words, natural = C.signals([t or "" for t in texts.to_pylist()], shared.value)
        return pa.StructArray.from_arrays([pa.array(script, pa.string()), pa.array(words, pa.int32()), pa.array(natural, pa.string())], ["script", "words", "natural"], mask=pa.array(blank))

    return F.arrow_udf(C.in_slices(read), "struct<script:string,words:int,natural:string>")


def detected_udf(spark: SparkSession, model: packed.Packed, enabled: list[str]):
    """UDF text -> struct<script_lang, words, score>, null for blank texts: signals and score in one pass, so that a task has one
    Python worker and no text goes to and fro between two."""
    shared, weights = C.shared_tables(spark), spark.sparkContext.broadcast(model)
    langs = {s: x for s, x in T.SCRIPT_LANGUAGES.items() if x in T.SENTINELS or x in enabled}

    def read(texts: pa.Array) -> pa.Array:
        blank, script, words, natural = C.signals([t or "" for t in texts.to_pylist()], shared.value)
        tier = [langs.get(s) for s in script]
        score = packed.best(weights.value, [t.lower() if x is None else "" for t, x in zip(natural, tier, strict=True)])
        return pa.StructArray.from_arrays([pa.array(tier, pa.string()), pa.array(words, pa.int32()), score], ["script_lang", "words", "score"], mask=pa.array(blank))

    return F.arrow_udf(C.in_slices(read), f"struct<script_lang:string,words:int,score:{packed.SCORE}>")


def detect(texts: DataFrame, model: DataFrame | Scorer, key: list[str], enabled: list[str], text_col: str = "text") -> DataFrame:
    """(key, script_lang, lang, conf, words) of texts that aren't blank: the language by script (a sentinel or enabled),
    else the likeliest one. ``model`` is a trigram model, or a scorer that stands in for it (see ``packed.Scorer``).

    ``words`` is the number of natural words. Only texts without a script language are scored, and of these only what
    letters and natural words leave; texts that leave nothing have no language. Texts are read and scored where they lie, a
    row each, with nothing shuffled; only a model too large to be sent around is joined, by ``key``, which must then be unique. Keys may have any name but those of the result."""
    spark = texts.sparkSession
    by = model if callable(model) else packed.pack(model, enabled)
    if isinstance(by, packed.Packed):
        # blank texts go before: a condition on what the UDF gives would have Spark call it twice
        rows = texts.where(~X.is_blank(F.col(text_col))).select(*key, detected_udf(spark, by, enabled)(F.col(text_col)).alias("_found"))
        script, score = F.col("_found.script_lang"), F.col("_found.score")
        return rows.select(*key, script.alias("script_lang"), F.coalesce(script, score["lang"]).alias("lang"), score["conf"].alias("conf"), F.col("_found.words").alias("words"))
    tier = scripts.usable(scripts.script_language(F.col("_signals.script")), F.array(*[F.lit(x) for x in enabled]))
    rows = texts.select(*key, signals_udf(spark)(F.col(text_col)).alias("_signals")).where("_signals is not null")
    rows = rows.select(*key, tier.alias("script_lang"), F.col("_signals.words").alias("words"), F.col("_signals.natural").alias("_natural"))
    open_ = F.when(F.col("script_lang").isNull() & (F.col("words") > 0), F.col("_natural"))
    if by is None:
        return _joined(rows, model, key, enabled, open_)
    score = packed.checked(spark, by)
    found = rows.select(*key, "script_lang", "words", score(open_).alias("_score"))
    of = lambda f: F.when(F.col("script_lang").isNull() & (F.col("words") > 0), F.col(f"_score.{f}"))
    return found.select(*key, "script_lang", F.coalesce("script_lang", of("lang")).alias("lang"), of("conf").alias("conf"), "words")


def _joined(rows: DataFrame, model: DataFrame, key: list[str], enabled: list[str], open_: Column) -> DataFrame:
    """As ``detect``, with a model of any size: grams are joined to it, and a text keeps one row without a gram."""
    by = ngram.wide(model, enabled)
    cut = rows.select(*key, "script_lang", "words", F.explode_outer(ngram.grams_of(open_)).alias("gram"))
    found = by.joined(cut).groupBy(*key, "script_lang", "words").agg(*by.sums() or [F.count("*").alias("s_0")])
    best = found.select(*key, "script_lang", "words", F.array_min(by.scored()).alias("b"))
    return best.select(*key, "script_lang", F.coalesce("script_lang", "b.lang").alias("lang"), F.col("b.conf").alias("conf"), "words")


def resolve(mode: Column, mixed: Column, markup: Column, locale: Column, script_lang: Column, detected: Column, default: Column) -> Column:
    """Language of a line by mode, with or without a voice: ``markup`` of the range (for mixed lines only), else ``locale`` of the
    object, else what the mode detects. Null in mode off: the line's voice stays."""
    hint = F.coalesce(F.when(mixed, X.lang_code(markup)), X.lang_code(locale))
    by_mode = (
        F.when(mode == "always", detected)
        .when(mode == "markup_text", F.coalesce(hint, detected))
        .when(mode == "markup_only", F.coalesce(hint, script_lang, default))
    )
    return F.when(mode != "off", by_mode)


def resolve_utterance(mode: Column, mixed: Column, voice: Column, script_lang: Column, detected: Column, default: Column, voiced: Column) -> Column:
    """Language of an utterance that comes with the language of a voice (null for none; one without a voice doesn't count): unless
    the line is mixed the voice is trusted, else the mode decides. A language without a voice leaves the voice as it is."""
    known = F.when(F.array_contains(voiced, voice), voice)
    found = F.when(~mixed & known.isNotNull(), known).when(mode == "markup_only", F.coalesce(known, script_lang, default)).otherwise(detected)
    return F.when(mode != "off", F.coalesce(F.when(F.array_contains(voiced, found), found), known))
