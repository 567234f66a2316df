"""The character dimension: scripts and spoken names by code point, and regular expression classes made from it.

Classes are written with \\x{...} ranges, which both Java and RE2 read, and come from this Python's Unicode tables, so a
cluster's Java version doesn't change results. The dimension is built once a driver and is a few thousand rows.
"""

from __future__ import annotations

import unicodedata
from functools import cache
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logoscope.functions import tables as T

_LAST = 0x110000


def ranges(points) -> list[tuple[int, int]]:
    """Ascending code points as ranges."""
    out = []
    for _, run in groupby(enumerate(points), lambda x: x[1] - x[0]):
        run = [p for _, p in run]
        out.append((run[0], run[-1]))
    return out


def char_class(spans, negated: bool = False) -> str:
    """A regular expression class of code point ranges."""
    body = "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans)
    return f"[{'^' if negated else ''}{body}]"


@cache
def categories() -> list[str]:
    return [unicodedata.category(chr(p)) for p in range(_LAST)]


@cache
def of_category(*firsts: str) -> tuple[tuple[int, int], ...]:
    """Ranges of the characters whose category starts with one of ``firsts``."""
    return tuple(ranges(p for p, c in enumerate(categories()) if c.startswith(firsts)))


@cache
def script_ranges() -> dict[str, tuple[tuple[int, int], ...]]:
    """Ranges of every script, LATIN, IPA and BRAILLE among them; scripts do not overlap."""
    points: dict[str, list[int]] = {"BRAILLE": list(range(0x2800, 0x2900)), "IPA": [], "LATIN": []}
    for p, category in enumerate(categories()):
        if category[0] not in "LMN" or 0x2800 <= p <= 0x28FF:
            continue
        name = unicodedata.name(chr(p), "")
        script = "IPA" if 0x250 <= p <= 0x2AF else next((s for k, s in T.SCRIPT_KEYWORDS.items() if k in name), None)
        if script or "LATIN" in name:
            points.setdefault(script or "LATIN", []).append(p)
    return {s: tuple(ranges(p)) for s, p in points.items()}


@cache
def script_classes() -> dict[str, str]:
    return {s: char_class(r) for s, r in script_ranges().items()}


#: Python's white space, as a class body.
SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

#: The same characters.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


@cache
def letters_class() -> str:
    """Letters, marks, numbers and braille cells: what a script's share is measured against."""
    spans = sorted([*of_category("L", "M", "N"), (0x2800, 0x28FF)])
    return char_class(spans)


@cache
def invisible_class() -> str:
    return char_class(sorted([*of_category("Cf"), *T.INVISIBLE]))


@cache
def unpronounceable_ranges(emoji: tuple[str, ...] = ()) -> tuple[tuple[int, int], ...]:
    """Characters that need a name: not read aloud, and phonetic or neither letter nor decimal digit; or an emoji."""
    spoken = bytearray(_LAST)
    for a, b in (*of_category("L"), *of_category("Nd")):
        spoken[a : b + 1] = b"\1" * (b + 1 - a)
    for a, b in T.PHONETIC:
        spoken[a : b + 1] = bytes(b + 1 - a)
    for e in emoji:
        if len(e) == 1:
            spoken[ord(e)] = 0
    for a, b in T.READ_ALOUD:
        spoken[a : b + 1] = b"\1" * (b + 1 - a)
    for p in (*range(0xD800, 0xE000),):
        spoken[p] = 1
    return tuple(ranges(p for p in range(_LAST) if not spoken[p]))


@cache
def emoji_chars() -> tuple[str, ...]:
    return tuple(sorted({s for names in T.EMOJI_NAMES.values() for s in names if len(s) == 1}))


@cache
def unpronounceable_class() -> str:
    return char_class(unpronounceable_ranges(emoji_chars()))


def spoken_name(name: str, verbosity: str) -> str:
    """What is said for a Unicode name."""
    if name in T.SPOKEN_NAMES:
        return T.SPOKEN_NAMES[name]
    name = next((name[len(p) :] for p in T.NAME_PREFIXES if name.startswith(p)), name)
    if verbosity == "brief":
        name = " ".join(w for w in name.split() if w not in T.BRIEF_WORDS) or name
    return name.lower()


@cache
def char_names(verbosity: str, lang: str = "en") -> dict[str, str]:
    """Name of every unpronounceable character that has one; the empty string for those that brief mode skips."""
    hidden = {chr(p) for a, b in (*of_category("Cf"), *T.INVISIBLE) for p in range(a, b + 1)} if verbosity == "brief" else set()
    emoji = T.EMOJI_NAMES.get(lang, T.EMOJI_NAMES["en"])
    names = {}
    for a, b in unpronounceable_ranges(emoji_chars()):
        for p in range(a, b + 1):
            c = chr(p)
            if c in hidden:
                names[c] = ""
            elif c in emoji:
                names[c] = emoji[c]
            elif name := unicodedata.name(c, ""):
                names[c] = spoken_name(name, verbosity)
    return names


def char_dimension(spark: SparkSession) -> DataFrame:
    """(ch, unicode_name, script, invisible, pronounceable, brief, verbose) of every named character."""
    script = {p: s for s, spans in script_ranges().items() for a, b in spans for p in range(a, b + 1)}
    brief, verbose = char_names("brief"), char_names("verbose")
    hidden = {p for a, b in (*of_category("Cf"), *T.INVISIBLE) for p in range(a, b + 1)}
    odd = {p for a, b in unpronounceable_ranges(emoji_chars()) for p in range(a, b + 1)}
    rows = [
        (c, unicodedata.name(c, ""), script.get(p), p in hidden, p not in odd, brief.get(c), verbose.get(c))
        for p in range(_LAST)
        if p in odd or p in script
        for c in [chr(p)]
        if not 0xD800 <= p <= 0xDFFF and (p in script or unicodedata.name(c, ""))
    ]
    return spark.createDataFrame(rows, "ch string, unicode_name string, script string, invisible boolean, pronounceable boolean, brief string, verbose string")


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it: keeps nested rewrites small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
