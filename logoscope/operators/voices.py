"""Voice catalogues and per-language voice settings of many tenants.

``voices`` is (tenant, ord, voice_name, lang_tag, variant); ``settings`` is (tenant, lang, voice_name, voice_lang,
voice_dialect, rate, average_pitch, gain); ``enabled`` is (tenant, pos, lang); ``scripts`` is (tenant, script, lang).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logoscope.functions.tables import SCRIPT_LANGUAGES, SENTINELS
from logoscope.functions.text import dialect

#: What a voice has where nothing else is set (fixed values).
RATE, PITCH, GAIN = 50.0, 5.0, 10.0
#: Names of profile voices that stand for no voice (fixed values).
PLACEHOLDERS = ("default default voice", "")


def based(voices: DataFrame) -> DataFrame:
    """Voices with a language, and its primary subtag in lower case as ``lang``."""
    return voices.where("lang_tag is not null and lang_tag <> ''").withColumn("lang", F.lower(F.regexp_extract("lang_tag", "^[^-_]*", 0)))


def catalog(voices: DataFrame) -> DataFrame:
    """(tenant, lang, voices): the voices of each language in catalogue order."""
    entry = F.struct("ord", "voice_name", "lang_tag", "variant")
    return based(voices).groupBy("tenant", "lang").agg(F.array_sort(F.collect_list(entry)).alias("voices"))


def first_voices(voices: DataFrame) -> DataFrame:
    """(tenant, lang, voice_name, voice_dialect, ord) of the first voice of each language."""
    first = F.min(F.struct("ord", "voice_name", "lang_tag")).alias("v")
    found = based(voices).groupBy("tenant", "lang").agg(first)
    return found.select("tenant", "lang", "v.voice_name", dialect(F.col("v.lang_tag")).alias("voice_dialect"), "v.ord")


def assign(rows: DataFrame, settings: DataFrame, enabled: DataFrame, other: str = "caller") -> DataFrame:
    """``rows`` (tenant, lang, ...) with the voice of their language; ``other`` where it is not enabled or has no voice."""
    usable = settings.where("voice_name is not null and voice_name <> ''").join(enabled.select("tenant", "lang"), ["tenant", "lang"], "left_semi")
    usable = usable.select("tenant", "lang", "voice_name", "voice_dialect", "rate", "average_pitch", "gain")
    return rows.join(usable, ["tenant", "lang"], "left").withColumn("voice_name", F.coalesce("voice_name", F.lit(other)))


def existing(settings: DataFrame, voices: DataFrame) -> DataFrame:
    """Settings whose voice is in the catalogue of their language."""
    return settings.join(based(voices).select("tenant", "lang", "voice_name"), ["tenant", "lang", "voice_name"], "left_semi")


def removed(settings: DataFrame, enabled: DataFrame, voices: DataFrame) -> DataFrame:
    """(tenant, lang): enabled languages with settings that no voice is left for."""
    wanted = enabled.select("tenant", "lang").intersect(settings.select("tenant", "lang"))
    return wanted.subtract(based(voices).select("tenant", "lang"))


def overlay(voices: DataFrame, profiles: DataFrame) -> DataFrame:
    """(tenant, lang, voice_name, voice_dialect, rate, average_pitch, table, profile): the catalogue's first voices with
    profiles (tenant, ord, profile, lang, voice_name, voice_dialect, rate, average_pitch, table) laid over them.

    Profiles count in order, field by field. One with a placeholder's name sets rate and pitch only, and only for a
    language that is known by then; a named voice is taken if its language's catalogue has it, and makes its language
    known in any case."""
    first = first_voices(voices).select("tenant", "lang", F.col("voice_name").alias("first_name"), F.col("voice_dialect").alias("first_dialect"))
    has = based(voices).select("tenant", "lang", "voice_name").distinct().withColumn("has", F.lit(True))
    told = profiles.where("lang is not null and lang <> ''").withColumn("named", ~F.lower(F.coalesce("voice_name", F.lit(""))).isin(*PLACEHOLDERS))
    told = told.join(has, ["tenant", "lang", "voice_name"], "left").join(first.select("tenant", "lang", F.lit(True).alias("in_catalog")), ["tenant", "lang"], "left")
    told = told.withColumn("start", F.min(F.when(F.col("named"), F.col("ord"))).over(Window.partitionBy("tenant", "lang")))
    told = told.where(F.coalesce("in_catalog", F.lit(False)) | (F.col("ord") >= F.col("start")))
    last = lambda field, where: F.max_by(field, F.when(where, F.col("ord")))
    taken = F.col("named") & F.coalesce("has", F.lit(False))
    laid = told.groupBy("tenant", "lang").agg(
        last("voice_name", taken).alias("voice_name"), last("voice_dialect", taken).alias("voice_dialect"),
        last("rate", F.col("rate").isNotNull()).alias("rate"), last("average_pitch", F.col("average_pitch").isNotNull()).alias("average_pitch"),
        last("table", F.col("named") & (F.coalesce("table", F.lit("")) != "")).alias("table"), F.max_by("profile", "ord").alias("profile"),
        F.max(taken).alias("taken"),
    )
    both = first.join(laid, ["tenant", "lang"], "full")
    own = F.coalesce("taken", F.lit(False))
    return both.select(
        "tenant", "lang", F.when(own, F.col("voice_name")).otherwise(F.coalesce("first_name", F.lit(""))).alias("voice_name"),
        F.when(own, F.coalesce("voice_dialect", F.lit(""))).otherwise(F.coalesce("first_dialect", F.lit(""))).alias("voice_dialect"),
        F.coalesce("rate", F.lit(RATE)).alias("rate"), F.coalesce("average_pitch", F.lit(PITCH)).alias("average_pitch"), "table", "profile",
    )


def auto_configure(mapped: DataFrame, order: DataFrame, baseline: DataFrame) -> DataFrame:
    """Settings of a first run for all languages of ``mapped`` (see ``overlay``), with the default profile's gain, and
    which language is the default: English, or else the first of ``order`` (tenant, lang, ord)."""
    rows = mapped.join(order.select("tenant", "lang", "ord"), ["tenant", "lang"], "left").join(baseline.select("tenant", "gain"), "tenant", "left")
    rank = F.row_number().over(Window.partitionBy("tenant").orderBy(F.col("lang") != "en", F.col("ord").asc_nulls_last(), "lang"))
    return rows.select(
        "tenant", "lang", "voice_name", F.col("lang").alias("voice_lang"), "voice_dialect", "rate", "average_pitch",
        F.coalesce("gain", F.lit(GAIN)).alias("gain"), F.coalesce("table", F.lit("")).alias("contraction_table"), (rank == 1).alias("is_default"),
    )


def sync(settings: DataFrame, enabled: DataFrame, scripts: DataFrame, defaults: DataFrame, voices: DataFrame) -> dict[str, DataFrame]:
    """Settings brought in line with the catalogue: ``settings``, ``enabled``, ``scripts``, ``defaults`` (tenant,
    default_language), and ``changed`` (tenant, changed) for every tenant of ``defaults``.

    Enabled languages with settings but without a voice go, with their settings. An enabled language's vanished voice
    becomes the first of its catalogue. Scripts of languages that aren't enabled go, default scripts of enabled ones
    come, and a default language that isn't enabled becomes the first enabled one."""
    keys = ["tenant", "lang"]
    gone = removed(settings, enabled, voices)
    left = enabled.join(gone, keys, "left_anti")
    kept = settings.join(gone, keys, "left_anti")
    has = based(voices).select(*keys, "voice_name").distinct().withColumn("has", F.lit(True))
    first = first_voices(voices).select(*keys, F.col("voice_name").alias("new_name"), F.col("voice_dialect").alias("new_dialect"))
    on = left.select(*keys, F.lit(True).alias("on"))
    checked = kept.join(has, [*keys, "voice_name"], "left").join(on, keys, "left").join(first, keys, "left")
    lost = F.col("on") & F.col("has").isNull() & (F.coalesce("voice_name", F.lit("")) != "") & F.col("new_name").isNotNull()
    checked = checked.withColumn("lost", F.coalesce(lost, F.lit(False)))
    put = lambda new, old: F.when(F.col("lost"), F.col(new)).otherwise(F.col(old)).alias(old)
    renewed = checked.select(*keys, put("new_name", "voice_name"), put("lang", "voice_lang"), put("new_dialect", "voice_dialect"), "rate", "average_pitch", "gain", "lost")
    sentinel = F.col("lang").isin(*SENTINELS)
    fine = scripts.join(on, keys, "left").withColumn("fine", sentinel | F.col("on").isNotNull())
    stay = fine.where("fine").select("tenant", "script", "lang")
    table = scripts.sparkSession.createDataFrame(list(SCRIPT_LANGUAGES.items()), "script string, lang string")
    due = defaults.select("tenant").crossJoin(F.broadcast(table)).join(on, keys, "left").where(sentinel | F.col("on").isNotNull())
    new = due.join(stay.select("tenant", "script"), ["tenant", "script"], "left_anti").select("tenant", "script", "lang")
    head = left.groupBy("tenant").agg(F.min_by("lang", "pos").alias("head"), F.collect_set("lang").alias("langs"))
    repaired = defaults.join(head, "tenant", "left").withColumn("moved", F.coalesce(~F.array_contains("langs", F.col("default_language")) & F.col("head").isNotNull(), F.lit(False)))
    signs = [gone.select("tenant"), renewed.where("lost").select("tenant"), fine.where("not fine").select("tenant"), new.select("tenant"), repaired.where("moved").select("tenant")]
    touched = signs[0]
    for s in signs[1:]:
        touched = touched.union(s)
    flags = defaults.select("tenant").join(touched.distinct().withColumn("changed", F.lit(True)), "tenant", "left")
    return {
        "settings": renewed.drop("lost"), "enabled": left, "scripts": stay.union(new),
        "defaults": repaired.select("tenant", F.when(F.col("moved"), F.col("head")).otherwise(F.col("default_language")).alias("default_language")),
        "changed": flags.select("tenant", F.coalesce("changed", F.lit(False)).alias("changed")),
    }
