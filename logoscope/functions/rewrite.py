"""Rewriting of emoji, emoticons and unpronounceable characters into words, each in one pass over a text.

A text is split where a pattern matches, the matches are looked up, and the parts are put together again, so what one
rule writes no other match of the same rule reads.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logoscope.functions import tables as T
from logoscope.functions.chars import SPACE, bound, char_class, char_names, emoji_chars, literal_map, ranges, unpronounceable_class, unpronounceable_ranges
from logoscope.functions.text import USUAL, trimmed

TOKEN = rf":[^{SPACE}:]+:"


def replaced(text: Column, pattern: str, word) -> Column:
    """``text`` with ``word(match)`` for every match of ``pattern``."""

    def join(t):
        pairs = F.arrays_zip(F.split(t, pattern, -1).alias("gap"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("match"))
        return F.concat_ws("", F.transform(pairs, lambda p: F.concat(p["gap"], F.coalesce(word(p["match"]), F.lit("")))))

    return bound(text, join)


def single_spaced(text: Column) -> Column:
    return F.regexp_replace(text, "  +", " ")


def _alternatives(items) -> str:
    return "|".join(re.escape(x) for x in sorted(items, key=lambda x: (-len(x), x)))


def _firsts(items) -> str:
    """A class of the first characters: a cheap test of a position, ahead of all alternatives."""
    return char_class(ranges(sorted({ord(x[0]) for x in items})))


def emoji_pattern(names: dict[str, str]) -> str:
    return _alternatives(names)


def expand_emojis(text: Column, lang: str = "en", names: dict[str, dict[str, str]] | None = None) -> Column:
    """Emoji sequences as their names in ``lang`` (else in English). A text without one is unchanged; in one with an
    emoji, whatever stands between two colons is a name as well, and spaces are tidied."""
    names = names or T.EMOJI_NAMES
    table = names.get(lang, names["en"])
    pattern = emoji_pattern(table)
    lookup = literal_map({k: ":" + v.replace(" ", "_") + ":" for k, v in table.items()})
    word = lambda t: replaced(t, pattern, lambda m: lookup[m])
    spoken = replaced(word(text), TOKEN, lambda m: F.concat(F.lit(" "), F.translate(F.substring(m, F.lit(2), F.length(m) - 2), "_", " "), F.lit(" ")))
    return F.when(text.rlike(_firsts(table)) & text.rlike(pattern), trimmed(single_spaced(spoken))).otherwise(text)


def expand_emoji_char(c: Column, lang: str = "en", names: dict[str, dict[str, str]] | None = None) -> Column:
    """Name of a sequence that is one emoji; else null."""
    names = names or T.EMOJI_NAMES
    return literal_map(names.get(lang, names["en"]))[c]


WORD = r"[\p{L}\p{N}_]"


def expand_emoticons(text: Column) -> Column:
    """Emoticons that touch no word character as words; spaces are tidied in any case."""
    table = T.EMOTICONS
    pattern = f"(?={_firsts(table)})(?<!{WORD})(?:{_alternatives(table)})(?!{WORD})"
    lookup = literal_map({k: f" {v} " for k, v in table.items()})
    said = lambda t: F.when(t.rlike(pattern), replaced(t, pattern, lambda m: lookup[m])).otherwise(t)
    return trimmed(single_spaced(bound(text, said)))


def expand_unpronounceable(text: Column, names: dict[str, str], lang: str = "en", emojis: bool = True) -> Column:
    """Unpronounceable characters as ``names`` (see ``names_in``): a run of one as " n name characters ", one alone as
    " name "; invisible ones (name '') go, unnamed ones stay. Emoji go first. Spaces are tidied, but not at the ends."""
    if emojis:
        return bound(expand_emojis(text, lang), lambda t: expand_unpronounceable(t, names, lang, emojis=False))
    odd = unpronounceable_ranges(emoji_chars())
    said_of = sorted(ord(c) for c in names if len(c) == 1 and any(a <= ord(c) <= b for a, b in odd))
    if not names:
        return text
    lookup = literal_map(names)

    def word(run):
        n, name = F.length(run), lookup[F.substring(run, 1, 1)]
        said = F.when(n > 1, F.concat(F.lit(" "), n.cast("string"), F.lit(" "), name, F.lit(" characters "))).otherwise(F.concat(F.lit(" "), name, F.lit(" ")))
        return F.when(name.isNull(), run).when(name == "", F.lit("")).otherwise(said)

    # Only characters with a name change. The class of all is long, so it is held against what is left without the usual ones.
    done = single_spaced(replaced(text, f"({char_class(ranges(said_of))})\\1*", word) if said_of else text)
    rest = F.regexp_replace(text, f"{USUAL}+", "")
    return F.when(rest.rlike(unpronounceable_class()), done).otherwise(text)


def names_in(rows: DataFrame, text_col: str, verbosity: str = "brief", lang: str = "en", custom: dict[str, str] | None = None) -> dict[str, str]:
    """Names of the unpronounceable characters that occur in a column. The distinct characters are collected: Unicode
    bounds their number, however large the table."""
    names = char_names(verbosity, lang) | {c: n for c, n in (custom or {}).items() if n}
    if verbosity == "brief":
        names |= {c: "" for c, n in char_names(verbosity, lang).items() if n == ""}
    # Distinct characters first: the long class is held against each of them once.
    some = rows.select(F.explode(F.split(F.regexp_replace(F.col(text_col), f"{USUAL}+", ""), "")).alias("c")).distinct()
    odd = some.where(F.col("c").rlike(f"^{unpronounceable_class()}$"))
    found = [r.c for r in odd.collect()]
    return {c: names[c] for c in found if c in names}


def speakable_text(text: Column, names: dict[str, str], lang: str = "en", emoticons: bool = True) -> Column:
    """A whole line as it is read: unpronounceable characters and emoji, then emoticons."""
    said = expand_unpronounceable(text, names, lang)
    return expand_emoticons(said) if emoticons else said


def speakable_char(c: Column, names: dict[str, str], lang: str = "en") -> Column:
    """One character as it is read: by emoji name, by name ('' is skipped), or as it is."""
    return F.coalesce(expand_emoji_char(c, lang), literal_map(names)[c] if names else F.lit(None).cast("string"), c)
