"""Scripts of texts: counts, the dominant one, and the language that stands for it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logoscope.functions import tables as T
from logoscope.functions.chars import bound, script_classes

#: No character below this belongs to another script than Latin: cheap test, and what is cut before counting.
BEYOND, BELOW = r"[\x{250}-\x{10ffff}]", r"[\x{0}-\x{24f}]+"
LETTERS = r"[\p{L}\p{M}\p{N}\x{2800}-\x{28ff}]"
LEAST_SHARE = 0.5
COUNTS = "array<struct<script:string,n:int,first:int>>"


def letters_total(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{LETTERS[1:]}+", ""))


def script_counts(text: Column) -> Column:
    """(script, n, first) of every script but Latin that occurs; first orders scripts by where they begin."""
    found = lambda rest: F.array(*[
        F.struct(F.lit(s).alias("script"), F.regexp_count(rest, F.lit(c)).alias("n"), F.regexp_instr(rest, F.lit(c)).alias("first"))
        for s, c in sorted(script_classes().items()) if s != "LATIN"
    ])
    beyond = bound(F.regexp_replace(text, BELOW, ""), lambda rest: F.filter(found(rest), lambda x: x["n"] > 0))
    return F.when(text.rlike(BEYOND), beyond).otherwise(F.array().cast(COUNTS))


def dominant_script(text: Column) -> Column:
    """The most frequent script but Latin (of equals the first to occur) if half of the letters are of it; else null."""
    order = F.array_min(F.transform(script_counts(text), lambda x: F.struct((-x["n"]).alias("n"), x["first"].alias("first"), x["script"].alias("script"))))
    return bound(order, lambda o: F.when(-o["n"] >= LEAST_SHARE * letters_total(text), o["script"]))


def char_script(c: Column) -> Column:
    """Script of a single character, LATIN included; null for none."""
    classes = script_classes()
    beyond = F.coalesce(*[F.when(c.rlike(f"^{x}$"), F.lit(s)) for s, x in sorted(classes.items()) if s != "LATIN"])
    latin = F.when(c.rlike(f"^{classes['LATIN']}$"), F.lit("LATIN"))
    return F.when(c.rlike(f"^{BEYOND}$"), F.coalesce(beyond, latin)).otherwise(latin)


def script_language(script: Column, languages: dict[str, str] | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in (languages or T.SCRIPT_LANGUAGES).items() for x in pair])
    return table[script]


def usable(lang: Column, enabled: Column) -> Column:
    """A script's language if it is a sentinel or enabled."""
    return F.when(lang.isin(*T.SENTINELS) | F.array_contains(enabled, lang), lang)
