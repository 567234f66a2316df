"""Queries on voice catalogues, settings and character names. Tenants are customers (or suppliers); their catalogues and
settings are written from their keys by SQL that Spark and DuckDB share."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import functions as F

from logoscope.functions import tables as T
from logoscope.operators import voices as V
from logoscope.plans import duck as D
from logoscope.plans.registry import query, table
from logoscope.sources import settings as S
from logoscope.sources.scratch import scratch
from logoscope.streaming.voices import publish, voiced_stream

VOICES = """SELECT c_custkey AS tenant, v.ord, v.voice_name, v.lang_tag, v.variant FROM {customer} CROSS JOIN (SELECT * FROM (VALUES
 (0, 'daniel', 'en-GB', 'm'), (1, 'amy', 'en_US', 'f'), (2, 'viktor', 'de-DE', 'm'), (3, 'petra', 'DE', 'f'), (4, 'yuri', 'ru', 'm'),
 (5, 'nil', NULL, 'n'), (6, 'ana', 'es-MX', 'f'), (7, 'juan', 'es', 'm'), (8, 'marie', 'fr_FR.UTF-8', 'f'), (9, 'lena', 'de-AT', 'f')) AS x(ord, voice_name, lang_tag, variant)) v
 WHERE (c_custkey + v.ord * 7) % 4 <> 0"""
SETTINGS = """SELECT c_custkey AS tenant, v.lang, v.voice_name, v.lang AS voice_lang, v.voice_dialect, v.rate, v.average_pitch, v.gain FROM {customer} CROSS JOIN (SELECT * FROM (VALUES
 (0, 'en', 'daniel', 'GB', 100D0, 5D0, 5D0), (1, 'de', 'petra', '', 65D0, 5D0, 5D0), (2, 'ru', 'yuri', '', 63D0, 5D0, 5D0), (3, 'it', 'luca', 'IT', 50D0, 4D0, 10D0),
 (4, 'es', '', '', 50D0, 6D0, 10D0), (5, 'fr', 'jean', 'CA', 70D0, 5D0, 10D0)) AS x(k, lang, voice_name, voice_dialect, rate, average_pitch, gain)) v WHERE (c_custkey + v.k * 3) % 5 <> 0""".replace("D0", ".0E0")
ENABLED = """SELECT c_custkey AS tenant, v.pos, v.lang FROM {customer} CROSS JOIN (SELECT * FROM (VALUES (0, 'de'), (1, 'ru'), (2, 'en'), (3, 'it'), (4, 'fr'), (5, 'pl')) AS x(pos, lang)) v
 WHERE (c_custkey + v.pos * 5) % 3 <> 0"""
SCRIPTS = """SELECT c_custkey AS tenant, v.script, v.lang FROM {customer} CROSS JOIN (SELECT * FROM (VALUES (0, 'CYRILLIC', 'uk'), (1, 'GREEK', 'el'), (2, 'IPA', 'ipa'), (3, 'LAO', 'it')) AS x(k, script, lang)) v
 WHERE (c_custkey + v.k) % 4 <> 0"""
DEFAULTS = "SELECT c_custkey AS tenant, CASE c_custkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ru' ELSE 'xx' END AS default_language FROM {customer}"
PROFILES = """SELECT c_custkey AS tenant, v.ord, v.profile, v.lang, v.voice_name, v.voice_dialect, v.rate, v.average_pitch, v.braille AS tab FROM {customer} CROSS JOIN (SELECT * FROM (VALUES
 (0, 'default', 'en', 'Default default voice', '', 60.0E0, NULL, ''), (1, 'work', 'de', 'viktor', 'DE', 70.0E0, 4.0E0, 'de-g1.ctb'), (2, 'old', 'de', 'gone', 'XX', NULL, 6.0E0, ''),
 (3, 'none', '', 'amy', 'US', 99.0E0, 9.0E0, 'x'), (4, 'far', 'pl', '', '', 40.0E0, 1.0E0, 'no'), (5, 'pol', 'pl', 'ewa', 'PL', 80.0E0, NULL, 'pl.ctb'), (6, 'amy', 'en', 'amy', 'US', NULL, NULL, ''),
 (7, 'late', 'pl', '', '', NULL, 7.0E0, '')) AS x(ord, profile, lang, voice_name, voice_dialect, rate, average_pitch, braille)) v WHERE (c_custkey + v.ord * 11) % 6 <> 0"""
BODIES = """SELECT c_custkey AS tenant, CASE c_custkey % 6
 WHEN 0 THEN '{{"enabled": false, "word_threshold": ' || CAST(c_custkey % 10 AS VARCHAR(9)) || ', "speak_unicode": false, "detection_mode": "sometimes"}}'
 WHEN 1 THEN '{{"enabled_languages": ["en", "de"], "speak_unicode": true, "detection_mode": "always", "switch_confidence": 0.8}}'
 WHEN 2 THEN '{{"speak_emojis": false, "unicode_verbosity": "verbose", "ignored_apps": ["gedit"], "language_to_profile": {{"de": "work", "en": "amy"}}}}'
 WHEN 3 THEN '{{"enabled": tru, "word_threshold": 5'
 WHEN 4 THEN '{{"language_to_profile": {{"en": "x", "zz": "y"}}, "language_settings": {{}}, "mixed_max_words": 300}}'
 ELSE '{{"language_to_profile": {{"en": "x"}}, "language_settings": {{"en": {{"rate": 1}}}}, "default_language": "de", "language_switch_pause": 0.5}}' END AS body FROM {customer}"""
PROFILE_PART = '{{"default":{{"voices":{{"default":{{"rate":61.5,"family":{{"lang":"en"}}}}}}}}}}'
GENERAL_PART = '{{"voices":{{"default":{{"rate":33.0,"average-pitch":4.5}}}}}}'
FILES = f"""SELECT c_custkey AS tenant, CASE c_custkey % 5
 WHEN 0 THEN '{{{{"profiles":{PROFILE_PART},"general":{GENERAL_PART}}}}}'
 WHEN 1 THEN '{{{{"general": {GENERAL_PART} "x": 1, "profiles" : {PROFILE_PART}}}}}'
 WHEN 2 THEN '{{{{"profiles": {{{{"default": oops}}}}, "general": {GENERAL_PART}, }}}}'
 WHEN 3 THEN '{{{{ hopeless' ELSE '{{{{"general":{{{{"voices":{{{{"default":{{{{"gain":7.5}}}}}}}}}}}}}}}}' END AS body FROM {{customer}}"""
NAMES = """SELECT s_suppkey AS tenant, CASE s_suppkey % 4 WHEN 0 THEN '{{"→": {{"brief": "r", "verbose": "to the right"}}, "½": "half", "x": 5}}'
 WHEN 1 THEN '{{"★": {{"verbose": "star ' || CAST(s_suppkey AS VARCHAR(9)) || '"}}, "©": {{"brief": "", "verbose": ""}}}}' WHEN 2 THEN 'broken' ELSE '{{"q": {{"brief": "queue"}}}}' END AS body FROM {supplier}"""


KEYS = {"customer": "c_custkey", "supplier": "s_suppkey"}


def rows(spark, sf_dir, sql, name="customer"):
    """Rows of the tenants, whose keys are dealt out first: each becomes many rows, which must not all be sorted where one file is read."""
    given = table(spark, sf_dir, name)
    if name in KEYS:
        given = given.select(KEYS[name]).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), KEYS[name])
    return spark.sql(sql, **{name: given})


def duck(sql, name="customer"):
    return "(" + sql.format(**{name: name}) + ")"


def customers(spark, sf_dir):
    return {k: rows(spark, sf_dir, sql) for k, sql in {"voices": VOICES, "settings": SETTINGS, "enabled": ENABLED, "scripts": SCRIPTS, "defaults": DEFAULTS}.items()}


BASED = f"(SELECT *, lower(regexp_extract(lang_tag, '^[^-_]*')) AS lang FROM {duck(VOICES)} WHERE lang_tag IS NOT NULL)"
DIALECT = "CASE WHEN contains(lang_tag, '-') THEN substr(lang_tag, strpos(lang_tag, '-') + 1) WHEN contains(lang_tag, '_') THEN substr(lang_tag, strpos(lang_tag, '_') + 1) ELSE '' END"
FIRST = f"(SELECT tenant, lang, voice_name, {DIALECT} AS voice_dialect, ord FROM (SELECT *, row_number() OVER (PARTITION BY tenant, lang ORDER BY ord) AS r FROM {BASED}) WHERE r = 1)"


@query("voice_catalog", f"SELECT tenant, lang, string_agg(voice_name || '|' || lang_tag || '|' || variant, ',' ORDER BY ord) AS voices FROM {BASED} GROUP BY ALL")
def voice_catalog(spark, sf_dir):
    found = V.catalog(rows(spark, sf_dir, VOICES))
    entry = F.transform("voices", lambda v: F.concat_ws("|", v["voice_name"], v["lang_tag"], v["variant"]))
    return found.select("tenant", "lang", F.array_join(entry, ",").alias("voices"))


@query("voices_per_language", f"SELECT lang, count(*) AS voices, count(DISTINCT tenant) AS tenants FROM {BASED} GROUP BY lang")
def voices_per_language(spark, sf_dir):
    return V.based(rows(spark, sf_dir, VOICES)).groupBy("lang").agg(F.count("*").alias("voices"), F.count_distinct("tenant").alias("tenants"))


@query("available_languages", f"SELECT tenant, string_agg(lang, ',' ORDER BY lang) AS languages FROM (SELECT DISTINCT tenant, lang FROM {BASED}) GROUP BY tenant")
def available_languages(spark, sf_dir):
    found = V.based(rows(spark, sf_dir, VOICES)).groupBy("tenant").agg(F.array_sort(F.collect_set("lang")).alias("l"))
    return found.select("tenant", F.array_join("l", ",").alias("languages"))


@query("first_voice", f"SELECT tenant, lang, voice_name, voice_dialect FROM {FIRST}")
def first_voice(spark, sf_dir):
    return V.first_voices(rows(spark, sf_dir, VOICES)).drop("ord")


@query("voice_exists", f"SELECT s.tenant, s.lang, s.voice_name FROM {duck(SETTINGS)} s WHERE EXISTS (SELECT 1 FROM {BASED} b WHERE b.tenant = s.tenant AND b.lang = s.lang AND b.voice_name = s.voice_name)")
def voice_exists(spark, sf_dir):
    return V.existing(rows(spark, sf_dir, SETTINGS), rows(spark, sf_dir, VOICES)).select("tenant", "lang", "voice_name")


REMOVED = f"(SELECT tenant, lang FROM {duck(ENABLED)} INTERSECT SELECT tenant, lang FROM {duck(SETTINGS)} EXCEPT SELECT tenant, lang FROM {BASED})"


@query("removed_languages", f"SELECT tenant, lang FROM {REMOVED}")
def removed_languages(spark, sf_dir):
    c = customers(spark, sf_dir)
    return V.removed(c["settings"], c["enabled"], c["voices"])


DOC_TENANT = "SELECT doc_id, lang, doc_id % 100 + 1 AS tenant FROM {documents}"


@query(
    "assign_voice",
    f"""SELECT d.doc_id, d.lang, coalesce(s.voice_name, 'caller') AS voice_name, s.rate, s.gain FROM {duck(DOC_TENANT, 'documents')} d LEFT JOIN (
        SELECT * FROM {duck(SETTINGS)} WHERE voice_name <> '' AND (tenant, lang) IN (SELECT (tenant, lang) FROM {duck(ENABLED)})) s USING (tenant, lang)""",
)
def assign_voice(spark, sf_dir):
    c = customers(spark, sf_dir)
    docs = rows(spark, sf_dir, DOC_TENANT, "documents")
    return V.assign(docs, c["settings"], c["enabled"]).select("doc_id", "lang", "voice_name", "rate", "gain")


#: Settings of a second version, of two customers in three: rates rise, and those of even number lose German.
CHANGED = f"SELECT tenant, lang, voice_name, voice_dialect, rate + 10.0E0 AS rate, average_pitch, gain FROM ({SETTINGS}) WHERE tenant % 3 > 0 AND NOT (tenant % 2 = 0 AND lang = 'de')"
FROM_HALF = "(SELECT max(doc_id) // 2 FROM documents)"


@query(
    "assign_voice_stream",
    f"""WITH d AS (SELECT doc_id, tenant, lang, doc_id >= {FROM_HALF} AND tenant % 3 > 0 AS late FROM {duck(DOC_TENANT, 'documents')}),
        s AS (SELECT false AS late, * FROM (SELECT tenant, lang, voice_name, rate, gain FROM {duck(SETTINGS)})
          UNION ALL SELECT true, * FROM (SELECT tenant, lang, voice_name, rate, gain FROM {duck(CHANGED)}))
        SELECT doc_id, d.lang, coalesce(voice_name, 'caller') AS voice_name, rate, gain
        FROM d LEFT JOIN (SELECT * FROM s WHERE voice_name <> '') s ON s.tenant = d.tenant AND s.lang = d.lang AND s.late = d.late""",
)
def assign_voice_stream(spark, sf_dir):
    """Voices of a running stream, whose settings change after half of it."""
    docs = rows(spark, sf_dir, DOC_TENANT, "documents")
    top = docs.agg(F.max("doc_id")).first()[0] or 0
    folder = scratch(spark, "voices")
    source, settings, out = (f"{folder}/{x}" for x in ("rows", "settings", "voiced"))
    publish(rows(spark, sf_dir, SETTINGS), 0, settings)
    halves = docs.where(F.col("doc_id") < top // 2), docs.where(F.col("doc_id") >= top // 2)
    halves[0].write.parquet(source)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 64).parquet(source)
    running = voiced_stream(stream, settings, "doc_id", out, f"{folder}/checkpoint")
    try:
        running.processAllAvailable()
        publish(rows(spark, sf_dir, CHANGED), top // 2, settings)
        halves[1].write.mode("append").parquet(source)
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.parquet(out).select("doc_id", "lang", "voice_name", "rate", "gain")


OVERLAY = f"""(WITH f AS (SELECT * FROM {FIRST}), p AS (SELECT *, lower(voice_name) NOT IN ('default default voice', '') AS named FROM {duck(PROFILES)} WHERE lang <> ''),
 q AS (SELECT p.*, f.lang IS NOT NULL AS known, EXISTS (SELECT 1 FROM {BASED} b WHERE b.tenant = p.tenant AND b.lang = p.lang AND b.voice_name = p.voice_name) AS has,
   min(CASE WHEN named THEN p.ord END) OVER (PARTITION BY p.tenant, p.lang) AS start FROM p LEFT JOIN f USING (tenant, lang)),
 r AS (SELECT * FROM q WHERE known OR ord >= start),
 a AS (SELECT tenant, lang, arg_max(voice_name, ord) FILTER (WHERE named AND has) AS voice_name, arg_max(voice_dialect, ord) FILTER (WHERE named AND has) AS voice_dialect,
   arg_max(rate, ord) FILTER (WHERE rate IS NOT NULL) AS rate, arg_max(average_pitch, ord) FILTER (WHERE average_pitch IS NOT NULL) AS average_pitch,
   arg_max(tab, ord) FILTER (WHERE named AND tab <> '') AS tab, arg_max(profile, ord) AS profile FROM r GROUP BY ALL)
 SELECT tenant, lang, coalesce(a.voice_name, f.voice_name, '') AS voice_name, coalesce(CASE WHEN a.voice_name IS NOT NULL THEN a.voice_dialect END, f.voice_dialect, '') AS voice_dialect,
   coalesce(rate, 50.0) AS rate, coalesce(average_pitch, 5.0) AS average_pitch, tab, profile FROM f FULL JOIN a USING (tenant, lang))"""


def mapped(spark, sf_dir):
    return V.overlay(rows(spark, sf_dir, VOICES), rows(spark, sf_dir, PROFILES).withColumnRenamed("tab", "table"))


@query("profile_overlay", f"SELECT tenant, lang, voice_name, voice_dialect, CAST(rate AS DOUBLE) AS rate, CAST(average_pitch AS DOUBLE) AS average_pitch, tab, profile FROM {OVERLAY}")
def profile_overlay(spark, sf_dir):
    return mapped(spark, sf_dir).withColumnRenamed("table", "tab")


BASELINE = f"""(SELECT tenant, CASE WHEN k IN (0, 1) THEN 61.5 WHEN k = 2 THEN 33.0 ELSE 50.0 END::DOUBLE AS rate,
  CASE WHEN k IN (0, 1, 2) THEN 4.5 ELSE 5.0 END::DOUBLE AS average_pitch, CASE WHEN k = 4 THEN 7.5 ELSE 10.0 END::DOUBLE AS gain FROM (SELECT c_custkey AS tenant, c_custkey % 5 AS k FROM customer))"""


@query("baseline_settings", f"SELECT * FROM {BASELINE}")
def baseline_settings(spark, sf_dir):
    return S.baseline(S.load_lenient(rows(spark, sf_dir, FILES)))


@query(
    "load_settings_lenient",
    f"""SELECT c_custkey AS tenant, CASE c_custkey % 5 WHEN 0 THEN p WHEN 1 THEN p END AS profiles, CASE c_custkey % 5 WHEN 3 THEN NULL WHEN 4 THEN '{{"voices":{{"default":{{"gain":7.5}}}}}}' ELSE g END AS general,
        CASE c_custkey % 5 WHEN 0 THEN 'strict' WHEN 4 THEN 'strict' WHEN 3 THEN 'lost' ELSE 'salvaged' END AS state
        FROM customer, (SELECT '{PROFILE_PART.format()}' AS p, '{GENERAL_PART.format()}' AS g)""",
)
def load_settings_lenient(spark, sf_dir):
    return S.load_lenient(rows(spark, sf_dir, FILES))


BROKEN = f"""SELECT tenant, CASE WHEN recovered = '' THEN 'lost' ELSE 'salvaged' END AS state,
 greatest(strpos(body, 'oops'), strpos(body, 'hopeless'), strpos(body, '"x"')) - 1 AS error_at, recovered, body
 FROM (SELECT tenant, body, concat_ws(',', CASE WHEN contains(body, '{PROFILE_PART.format()}') THEN 'profiles' END, CASE WHEN contains(body, '{GENERAL_PART.format()}') THEN 'general' END) AS recovered
   FROM {duck(FILES)} WHERE NOT json_valid(body))"""


@query("settings_quarantine", BROKEN)
def settings_quarantine(spark, sf_dir):
    """Broken bodies of a table by state: where they are broken, and what was saved."""
    path = scratch(spark, "settings-by-state")
    S.store_by_state(rows(spark, sf_dir, FILES), path)
    return S.quarantine(spark, path)


@query(
    "auto_configure",
    f"""SELECT o.tenant, o.lang, o.voice_name, o.voice_dialect, CAST(o.rate AS DOUBLE) AS rate, b.gain, coalesce(o.tab, '') AS contraction_table,
        row_number() OVER (PARTITION BY o.tenant ORDER BY o.lang <> 'en', f.ord NULLS LAST, o.lang) = 1 AS is_default
        FROM {OVERLAY} o LEFT JOIN {FIRST} f USING (tenant, lang) LEFT JOIN {BASELINE} b USING (tenant)""",
)
def auto_configure(spark, sf_dir):
    base = S.baseline(S.load_lenient(rows(spark, sf_dir, FILES)))
    found = V.auto_configure(mapped(spark, sf_dir), V.first_voices(rows(spark, sf_dir, VOICES)), base)
    return found.select("tenant", "lang", "voice_name", "voice_dialect", "rate", "gain", "contraction_table", "is_default")


@query(
    "sync_voices",
    f"""WITH gone AS (SELECT * FROM {REMOVED}), e AS (SELECT * FROM {duck(ENABLED)} WHERE (tenant, lang) NOT IN (SELECT (tenant, lang) FROM gone)),
     s AS (SELECT t.*, f.voice_name AS nn, f.voice_dialect AS nd, e.lang IS NOT NULL AND t.voice_name <> '' AND f.voice_name IS NOT NULL
         AND NOT EXISTS (SELECT 1 FROM {BASED} b WHERE b.tenant = t.tenant AND b.lang = t.lang AND b.voice_name = t.voice_name) AS lost
       FROM {duck(SETTINGS)} t LEFT JOIN e USING (tenant, lang) LEFT JOIN {FIRST} f USING (tenant, lang) WHERE (t.tenant, t.lang) NOT IN (SELECT (tenant, lang) FROM gone)),
     sl AS (SELECT tenant, string_agg(lang || '=' || CASE WHEN lost THEN nn || '/' || nd ELSE voice_name || '/' || voice_dialect END, ',' ORDER BY lang) AS settings, bool_or(lost) AS lost FROM s GROUP BY tenant),
     c AS (SELECT x.*, lang IN ('ipa', 'unicode_braille') OR (tenant, lang) IN (SELECT (tenant, lang) FROM e) AS fine FROM {duck(SCRIPTS)} x),
     n AS (SELECT tenant, script, lang FROM (SELECT c_custkey AS tenant FROM customer), (VALUES {", ".join(f"('{k}', '{v}')" for k, v in T.SCRIPT_LANGUAGES.items())}) AS v(script, lang)
       WHERE (lang IN ('ipa', 'unicode_braille') OR (tenant, lang) IN (SELECT (tenant, lang) FROM e)) AND (tenant, script) NOT IN (SELECT (tenant, script) FROM c WHERE fine)),
     cl AS (SELECT tenant, string_agg(script || ':' || lang, ',' ORDER BY script) AS scripts FROM (SELECT tenant, script, lang FROM c WHERE fine UNION ALL SELECT * FROM n) GROUP BY tenant),
     h AS (SELECT tenant, arg_min(lang, pos) AS head, list(lang) AS langs, string_agg(lang, ',' ORDER BY pos) AS enabled FROM e GROUP BY tenant)
     SELECT d.tenant, h.enabled, sl.settings, cl.scripts, CASE WHEN list_contains(langs, default_language) OR head IS NULL THEN default_language ELSE head END AS default_language,
       coalesce(sl.lost, false) OR coalesce(NOT list_contains(langs, default_language), false) OR d.tenant IN (SELECT tenant FROM gone) OR d.tenant IN (SELECT tenant FROM c WHERE NOT fine) OR d.tenant IN (SELECT tenant FROM n) AS changed
     FROM {duck(DEFAULTS)} d LEFT JOIN h USING (tenant) LEFT JOIN sl USING (tenant) LEFT JOIN cl USING (tenant)""",
)
def sync_voices(spark, sf_dir):
    """A row a tenant: what its settings are after the catalogue was looked at."""
    done = V.sync(**customers(spark, sf_dir))
    listed = lambda df, sort, text: df.groupBy("tenant").agg(F.array_sort(F.collect_list(F.struct(sort, text.alias("t")))).getField("t").alias("x"))
    enabled = listed(done["enabled"], "pos", F.col("lang")).select("tenant", F.array_join("x", ",").alias("enabled"))
    voices = F.concat("lang", F.lit("="), "voice_name", F.lit("/"), "voice_dialect")
    settings = listed(done["settings"], "lang", voices).select("tenant", F.array_join("x", ",").alias("settings"))
    scripts = listed(done["scripts"], "script", F.concat_ws(":", "script", "lang")).select("tenant", F.array_join("x", ",").alias("scripts"))
    out = done["defaults"].join(enabled, "tenant", "left").join(settings, "tenant", "left").join(scripts, "tenant", "left")
    return out.join(done["changed"], "tenant")


LOADED = """SELECT tenant, k <> 0 AS enabled, CASE WHEN k = 0 THEN CAST(tenant % 10 AS INTEGER) ELSE 2 END AS word_threshold, CASE WHEN k = 5 THEN 'de' ELSE 'en' END AS default_language,
 k NOT IN (0, 2) AS speak_emojis, CASE k WHEN 0 THEN 'off' WHEN 2 THEN 'verbose' ELSE 'brief' END AS unicode_verbosity, CASE WHEN k = 1 THEN 0.8 ELSE 0.92 END::DOUBLE AS switch_confidence,
 true AS speak_emoticons, false AS enable_mixed_language, CASE WHEN k = 5 THEN 0.5 ELSE 0.3 END::DOUBLE AS language_switch_pause, CASE WHEN k = 4 THEN 300 ELSE 600 END AS mixed_max_words,
 CASE WHEN k = 1 THEN 'always' ELSE 'markup_text' END AS detection_mode, CASE WHEN k = 1 THEN 'en,de' ELSE '' END AS enabled_languages, CASE WHEN k = 2 THEN 'gedit' ELSE '' END AS ignored_apps
 FROM (SELECT c_custkey AS tenant, c_custkey % 6 AS k FROM customer)"""


def flat(loaded):
    for c in ("enabled_languages", "ignored_apps"):
        loaded = loaded.withColumn(c, F.array_join(c, ","))
    return loaded


@query("load_settings", LOADED)
def load_settings(spark, sf_dir):
    return flat(S.load_settings(rows(spark, sf_dir, BODIES)))


@query("save_settings", LOADED)
def save_settings(spark, sf_dir):
    """Settings written as JSON, and read again."""
    path = scratch(spark, "settings")
    S.save_settings(S.load_settings(rows(spark, sf_dir, BODIES)), path)
    return flat(S.load_settings(spark.read.schema("tenant bigint, body string").json(path)))


@query(
    "migrate_profile_map",
    f"""SELECT o.tenant, o.lang, o.voice_name, o.voice_dialect, CAST(o.rate AS DOUBLE) AS rate, CAST(o.average_pitch AS DOUBLE) AS average_pitch, coalesce(o.tab, '') AS contraction_table
        FROM {OVERLAY} o WHERE (o.tenant % 6 = 2 AND o.lang IN ('de', 'en')) OR (o.tenant % 6 = 4 AND o.lang IN ('en', 'zz'))""",
)
def migrate_profile_map(spark, sf_dir):
    return S.migrate_profile_map(rows(spark, sf_dir, BODIES), mapped(spark, sf_dir)).drop("voice_lang")


CUSTOM = """(SELECT tenant, ch, brief AS brief_name, v1 AS verbose_name FROM (SELECT s_suppkey AS tenant, s_suppkey % 4 AS k FROM supplier), (VALUES (0, '→', 'r', 'to the right'), (0, '½', 'half', 'half'), (1, '★', '', 'star'),
 (1, '©', '', ''), (3, 'q', 'queue', '')) AS v(kk, ch, brief, v0), LATERAL (SELECT CASE WHEN v0 = 'star' THEN 'star ' || tenant ELSE v0 END AS v1) WHERE k = kk)"""


def custom(spark, sf_dir):
    return S.load_names(rows(spark, sf_dir, NAMES, "supplier"))


def named(df):
    return df.withColumnsRenamed({"brief": "brief_name", "verbose": "verbose_name"})


@query("load_custom_names", f"SELECT * FROM {CUSTOM}")
def load_custom_names(spark, sf_dir):
    return named(custom(spark, sf_dir))


CHANGES = """SELECT s_suppkey AS tenant, v.ch, v.brief, v.said AS verb, v.remove FROM {supplier} CROSS JOIN (SELECT * FROM (VALUES ('→', '', '', true), ('★', 'st', 'a star', false), ('∞', 'inf', 'no end', false)) AS x(ch, brief, said, remove)) v
 WHERE s_suppkey % 3 <> 0"""


@query(
    "save_custom_names",
    f"""SELECT tenant, ch, brief_name, verbose_name FROM {CUSTOM} WHERE (tenant, ch) NOT IN (SELECT (tenant, ch) FROM {duck(CHANGES, 'supplier')})
        UNION ALL SELECT tenant, ch, brief, verb FROM {duck(CHANGES, 'supplier')} WHERE NOT remove""",
)
def save_custom_names(spark, sf_dir):
    """A table of names after changes were merged into it."""
    path = scratch(spark, "names")
    S.create_names(custom(spark, sf_dir), path)
    S.merge_names(spark, path, rows(spark, sf_dir, CHANGES, "supplier").withColumnRenamed("verb", "verbose"))
    return named(S.stored_names(spark, path))


@query("custom_name_lookup", f"SELECT tenant, ch, coalesce(nullif(brief_name, ''), nullif(verbose_name, '')) AS brief_name, nullif(verbose_name, '') AS verbose_name FROM {CUSTOM}")
def custom_name_lookup(spark, sf_dir):
    brief, verbose = F.col("brief"), F.col("verbose")
    forms = [S.custom_name(brief, verbose, v).alias(f"{v}_name") for v in ("brief", "verbose")]
    return custom(spark, sf_dir).select("tenant", "ch", *forms)


def built_in():
    return [(unicodedata.lookup(n), n, said) for n, said in T.SPOKEN_NAMES.items()]


@query(
    "merge_char_names",
    f"""SELECT tenant, ch, coalesce(b.unicode_name, o.unicode_name) AS unicode_name, coalesce(nullif(c.brief_name, ''), b.name, '') AS brief_name, coalesce(nullif(c.verbose_name, ''), b.name, '') AS verbose_name, c.ch IS NOT NULL AS is_custom
        FROM (SELECT s_suppkey AS tenant, v.* FROM supplier, (VALUES {", ".join(f"({D.quoted(a)}, {D.quoted(b)}, {D.quoted(c)})" for a, b, c in built_in())}) AS v(ch, unicode_name, name)) b
        FULL JOIN {CUSTOM} c USING (tenant, ch) LEFT JOIN (VALUES ('★', 'BLACK STAR'), ('q', 'LATIN SMALL LETTER Q')) AS o(ch, unicode_name) USING (ch)""",
)
def merge_char_names(spark, sf_dir):
    known = spark.createDataFrame(built_in(), "ch string, unicode_name string, name string")
    others = spark.createDataFrame([(chr(p), unicodedata.name(chr(p), None)) for p in range(0x20, sys.maxunicode + 1)], "ch string, unicode_name string").where("unicode_name is not null")
    tenants = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tenant"))
    return named(S.merged_names(tenants, known, custom(spark, sf_dir), others))
