"""Settings of many tenants as JSON: typed rows with defaults, salvage of broken files, names of characters."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logoscope.operators.detect import MODES
from logoscope.operators.voices import GAIN, PITCH, RATE

#: Defaults of the scalar settings (fixed values).
DEFAULTS = {
    "enabled": True, "word_threshold": 2, "default_language": "en", "speak_emojis": True, "unicode_verbosity": "brief",
    "switch_confidence": 0.92, "speak_emoticons": True, "enable_mixed_language": False, "language_switch_pause": 0.3,
    "mixed_max_words": 600, "detection_mode": "markup_text",
}
#: Sections of a settings file.
SECTIONS = ("profiles", "general")
SCHEMA = """enabled boolean, word_threshold int, enabled_languages array<string>, default_language string, speak_emojis boolean,
 speak_unicode boolean, unicode_verbosity string, switch_confidence double, speak_emoticons boolean, enable_mixed_language boolean,
 language_switch_pause double, mixed_max_words int, detection_mode string, ignored_apps array<string>,
 language_settings map<string,string>, language_to_profile map<string,string>, _corrupt_record string"""


def parsed(rows: DataFrame, body: str = "body") -> DataFrame:
    """``rows`` with a struct ``s`` of the JSON in ``body``; null where it is broken."""
    s = F.from_json(body, SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return rows.withColumn("s", s).withColumn("s", F.when(F.col("s._corrupt_record").isNull(), F.col("s")))


def load_settings(rows: DataFrame) -> DataFrame:
    """(tenant, settings...): typed settings of bodies (tenant, body). What a body lacks, and all of a broken one, is the
    default; an old switch stands in for two newer settings; an unknown mode is ignored."""
    loaded = parsed(rows)
    own = {k: F.col(f"s.{k}") for k in DEFAULTS}
    own["speak_emojis"] = F.coalesce(own["speak_emojis"], F.col("s.speak_unicode"))
    old = F.when(F.col("s.speak_unicode"), F.lit("brief")).when(~F.col("s.speak_unicode"), F.lit("off"))
    own["unicode_verbosity"] = F.coalesce(own["unicode_verbosity"], old)
    own["detection_mode"] = F.when(own["detection_mode"].isin(*MODES), own["detection_mode"])
    lists = [F.coalesce(F.col(f"s.{k}"), F.array().cast("array<string>")).alias(k) for k in ("enabled_languages", "ignored_apps")]
    return loaded.select("tenant", *[F.coalesce(own[k], F.lit(v)).alias(k) for k, v in DEFAULTS.items()], *lists)


def save_settings(settings: DataFrame, path: str) -> None:
    """One JSON body a tenant, as text with the tenant."""
    fields = [c for c in settings.columns if c != "tenant"]
    settings.select("tenant", F.to_json(F.struct(*fields)).alias("body")).write.json(path)


def migrate_profile_map(rows: DataFrame, mapped: DataFrame) -> DataFrame:
    """Settings from an old map of languages to profiles, of tenants without newer ones: the voices of ``mapped`` (see
    ``overlay``) for its languages."""
    old = parsed(rows).where(F.coalesce(F.size("s.language_settings"), F.lit(0)) <= 0)
    wanted = old.select("tenant", F.explode("s.language_to_profile").alias("lang", "old_profile")).select("tenant", "lang")
    found = wanted.join(mapped, ["tenant", "lang"])
    return found.select(
        "tenant", "lang", "voice_name", F.col("lang").alias("voice_lang"), "voice_dialect", "rate",
        "average_pitch", F.coalesce("table", F.lit("")).alias("contraction_table"),
    )


def _salvaged(text: str) -> dict:
    decoder, found = json.JSONDecoder(), {}
    for name in SECTIONS:
        at = re.search(rf'"{re.escape(name)}"\s*:\s*(?=\{{)', text)
        if at:
            try:
                found[name] = decoder.raw_decode(text, at.end())[0]
            except (ValueError, RecursionError):
                continue
    return found


def _json(value) -> str | None:
    """JSON of a section; a plain string as it is, nothing for null. Half surrogates become question marks."""
    said = value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return said if said is None else said.encode("utf-8", "replace").decode()


def _no_constant(name: str):
    raise ValueError(name)


def sections(text: str) -> tuple[str, int | None, str | None, str | None]:
    """(state, place of the error in code points, profiles, general) of one body. A broken body gives its first object of
    each section's name that is sound."""
    try:
        whole, state, at = json.loads(text, parse_constant=_no_constant), "strict", None
    except (ValueError, RecursionError) as error:
        whole, at = _salvaged(text), getattr(error, "pos", None)
        state = "salvaged" if whole else "lost"
    profiles, general = (_json(whole.get(n)) if isinstance(whole, dict) else None for n in SECTIONS)
    return state, at, profiles, general


def tagged(rows: DataFrame) -> DataFrame:
    """(tenant, state, error_at, profiles, general, body): the sections of bodies (tenant, body) as JSON, whole or salvaged,
    in one scan that parses each body once. ``state`` is strict, salvaged or lost; the body is kept of broken ones only.
    Null bodies give no row, empty ones are lost, repeated tenants a row each; other columns are ignored."""
    kind = rows.schema["tenant"].dataType.simpleString()

    def read(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [sections(t) for t in texts]
            state, at, profiles, general = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [], [])
            body = [None if f == "strict" else t for f, t in zip(state, texts, strict=True)]
            columns = [pa.array(state, pa.string()), pa.array(at, pa.int64()), *(pa.array(x, pa.string()) for x in (profiles, general, body))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["tenant", "state", "error_at", "profiles", "general", "body"])

    known = rows.where(F.col("body").isNotNull()).select("tenant", "body")
    return known.mapInArrow(read, f"tenant {kind}, state string, error_at long, profiles string, general string, body string")


def load_lenient(rows: DataFrame) -> DataFrame:
    """(tenant, profiles, general, state) of bodies (tenant, body), see ``tagged``."""
    return tagged(rows).select("tenant", "profiles", "general", "state")


def store_by_state(rows: DataFrame, path: str) -> None:
    """Writes ``tagged`` bodies as a table with a folder for each state. A second run replaces the first."""
    tagged(rows).write.mode("overwrite").partitionBy("state").parquet(path)


def usable(spark: SparkSession, path: str) -> DataFrame:
    """(tenant, profiles, general, state) of a table by state: what could be read, without the folder of lost bodies."""
    return _by_state(spark, path).where(F.col("state").isin("strict", "salvaged")).select("tenant", "profiles", "general", "state")


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """(tenant, state, error_at, recovered, body) of the broken bodies of a table by state: where each is broken, and which
    sections were saved. Folders of sound bodies aren't read."""
    saved = [F.when(F.col(n).isNotNull(), F.lit(n)) for n in SECTIONS]
    broken = _by_state(spark, path).where(F.col("state").isin("salvaged", "lost"))
    return broken.select("tenant", "state", "error_at", F.concat_ws(",", *saved).alias("recovered"), "body")


def _by_state(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``, also where it has no row and so no file that names its columns."""
    return spark.read.schema("tenant bigint, error_at bigint, profiles string, general string, body string, state string").parquet(path)


def baseline(rows: DataFrame) -> DataFrame:
    """(tenant, rate, average_pitch, gain) of loaded sections (tenant, profiles, general): each field by itself from the
    default profile, else the general section, else the constants."""
    value = lambda column, path: F.get_json_object(column, path).cast("double")
    fields = {"rate": RATE, "average-pitch": PITCH, "gain": GAIN}
    found = [
        F.coalesce(value("profiles", f"$.default.voices.default['{k}']"), value("general", f"$.voices.default['{k}']"), F.lit(v)).alias(k.replace("-", "_"))
        for k, v in fields.items()
    ]
    return rows.select("tenant", *found)


def load_names(rows: DataFrame) -> DataFrame:
    """(tenant, ch, brief, verbose): names of characters from bodies (tenant, body). A string is both forms; of an object
    each form, '' if absent; anything else is left out."""
    entry = rows.select("tenant", F.explode(F.from_json("body", "map<string,variant>")).alias("ch", "v"))
    kind = F.schema_of_variant("v")
    form = lambda f: F.when(kind == "STRING", F.variant_get("v", "$", "string")).otherwise(F.coalesce(F.try_variant_get("v", f"$.{f}", "string"), F.lit("")))
    return entry.where((kind == "STRING") | kind.startswith("OBJECT")).select("tenant", "ch", form("brief").alias("brief"), form("verbose").alias("verbose"))


def put_names(names: DataFrame, changes: DataFrame) -> DataFrame:
    """``names`` after ``changes`` (tenant, ch, brief, verbose, remove): set or removed by tenant and character."""
    rest = names.join(changes.select("tenant", "ch"), ["tenant", "ch"], "left_anti")
    return rest.unionByName(changes.where("not remove").select("tenant", "ch", "brief", "verbose"))


#: Buckets of a table of names: a change rewrites those of the tenants that it names.
BUCKETS = 64


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("tenant"), F.lit(buckets)).cast("int").alias("bucket")


def _write_names(names: DataFrame, path: str, mode: str) -> None:
    dealt = names.repartition("bucket").sortWithinPartitions("bucket", "tenant", "ch")
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def create_names(names: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes names (tenant, ch, brief, verbose) as a table in ``buckets`` folders by tenant. Names without a tenant or a
    character are left out. Each bucket has a row without a tenant, so that it stays when its last name goes."""
    own = names.where("tenant is not null and ch is not null").select("tenant", "ch", "brief", "verbose", _bucket(buckets))
    _write_names(own.unionByName(_marks(names.sparkSession.range(buckets), "id"), allowMissingColumns=True), path, "overwrite")


def _marks(numbers: DataFrame, column: str) -> DataFrame:
    return numbers.select(F.col(column).cast("int").alias("bucket"))


def stored_names(spark: SparkSession, path: str) -> DataFrame:
    """(tenant, ch, brief, verbose) of a table of names."""
    return spark.read.parquet(path).where("tenant is not null").select("tenant", "ch", "brief", "verbose")


def merge_names(spark: SparkSession, path: str, changes: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Sets or removes names of a table of ``buckets``, by ``changes`` (tenant, ch, brief, verbose, remove), and returns the
    buckets that it rewrote. Only buckets with a name that changes are rewritten; others keep their files. So a second run
    of the same changes rewrites nothing.

    Changes without a tenant or a character do nothing. Of several changes of one name one that sets it wins, the one of
    the largest verbose and then brief form. One job may write a table at a time. Files are replaced bucket by bucket when all are
    written; a driver lost in the midst of that leaves some buckets old, and the same changes run again complete it, but the
    bucket that was being replaced has to be taken from a copy."""
    known = changes.where("tenant is not null and ch is not null")
    best = F.max(F.struct((~F.col("remove")).alias("set"), "verbose", "brief"))
    one = known.groupBy("tenant", "ch").agg(best.alias("c"))
    one = one.select("tenant", "ch", "c.brief", "c.verbose", (~F.col("c.set")).alias("remove"), _bucket(buckets))
    held = spark.read.parquet(path)
    now = held.select("tenant", "ch", F.col("brief").alias("b"), F.col("verbose").alias("v"), F.lit(True).alias("there"))
    same = F.col("b").eqNullSafe(F.col("brief")) & F.col("v").eqNullSafe(F.col("verbose"))
    moves = F.when(F.col("remove"), F.col("there").isNotNull()).otherwise(F.col("there").isNull() | ~same)
    touched = one.join(now, ["tenant", "ch"], "left").where(moves).select("bucket").distinct()
    numbers = sorted(r.bucket for r in touched.collect())  # at most a row a bucket
    if numbers:
        part = held.where(F.col("bucket").isin(numbers) & F.col("tenant").isNotNull()).drop("bucket")
        after = put_names(part, one.where(F.col("bucket").isin(numbers)))
        marks = _marks(spark.createDataFrame([(n,) for n in numbers], "n int"), "n")
        _write_names(after.withColumn("bucket", _bucket(buckets)).unionByName(marks, allowMissingColumns=True), path, "overwrite")
    return numbers


def custom_name(brief, verbose, verbosity: str) -> F.Column:
    """The name in a form, else the verbose one, else null."""
    asked = brief if verbosity == "brief" else verbose
    return F.coalesce(F.nullif(asked, F.lit("")), F.nullif(verbose, F.lit("")))


def merged_names(tenants: DataFrame, built_in: DataFrame, custom: DataFrame, names: DataFrame) -> DataFrame:
    """(tenant, ch, unicode_name, brief, verbose, is_custom): built-in names (ch, unicode_name, name) of every tenant with
    custom ones over them; names (ch, unicode_name) names other custom characters, unnamed ones are U+XXXX."""
    base = tenants.select("tenant").crossJoin(F.broadcast(built_in))
    own = custom.withColumnRenamed("brief", "b").withColumnRenamed("verbose", "v").withColumn("is_custom", F.lit(True))
    both = base.join(own, ["tenant", "ch"], "full").join(F.broadcast(names.withColumnRenamed("unicode_name", "other")), "ch", "left")
    code = F.concat(F.lit("U+"), F.lpad(F.hex(F.expr("ascii(ch)")), 4, "0"))
    form = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), "name", F.lit(""))
    return both.select(
        "tenant", "ch", F.coalesce("unicode_name", "other", code).alias("unicode_name"), form("b").alias("brief"), form("v").alias("verbose"),
        F.coalesce("is_custom", F.lit(False)).alias("is_custom"),
    )
