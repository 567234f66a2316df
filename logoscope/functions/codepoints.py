"""Texts of an Arrow batch as one array of code points: what detection reads of them, by table look-ups in numpy.

The tables are made from the driver's Unicode data and sent to the executors: two bytes a code point, whatever the data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from logoscope.functions import chars
from logoscope.functions.text import SHORT_CAPITALS

LETTER, SEPARATOR, COUNTED, SPACE, STABLE, CASED = 1, 2, 4, 8, 16, 32
BLANK = 32
#: Bytes of texts that are looked at together; a longer text is looked at alone.
SLICE = 1 << 18
LEAST_SHARE = 0.5
_tables: Tables | None = None


@dataclass
class Tables:
    """``flags`` by code point; number of its script in ``names``, 0 for none and for LATIN."""

    flags: np.ndarray
    script: np.ndarray
    names: list[str]


def tables() -> Tables:
    """Built once a driver."""
    global _tables
    if _tables is None:
        flags = np.zeros(0x110000, np.uint8)
        for p, category in enumerate(chars.categories()):
            c, kind = chr(p), category[0]
            flags[p] = (
                LETTER * (kind == "L") | SEPARATOR * (kind == "Z") | COUNTED * (kind in "LMN" or 0x2800 <= p <= 0x28FF) | SPACE * c.isspace()
                | STABLE * (c.upper() == c) | CASED * (c.lower() != c)
            )
        script, names = np.zeros(0x110000, np.uint8), [""]
        for name, spans in sorted(chars.script_ranges().items()):
            if name != "LATIN":
                names.append(name)
                for a, b in spans:
                    script[a : b + 1] = len(names) - 1
        _tables = Tables(flags, script, names)
    return _tables


def shared_tables(spark: SparkSession):
    """The tables as a broadcast variable."""
    return spark.sparkContext.broadcast(tables())


def slices(texts: pa.Array) -> list[pa.Array]:
    """Consecutive parts of a batch of about SLICE bytes: bounds the arrays that are made of them."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
    return [texts.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def in_slices(read):
    """``read``, a function of a batch of texts, as one that takes the batch part by part."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([read(part) for part in slices(texts)])

    return run


def lowered(texts: pa.Array) -> list[str]:
    return [t.lower() if t else "" for t in texts.to_pylist()]


def flatten(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and of each the index of its text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return points, np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))


def strings(points: np.ndarray, sizes: np.ndarray) -> list[str]:
    """Consecutive runs of code points as texts."""
    every = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    ends = np.cumsum(sizes).tolist()
    return [every[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def edges(of: np.ndarray) -> np.ndarray:
    """Whether an element differs from the one before it; the first does."""
    new = np.ones(len(of), bool)
    new[1:] = of[1:] != of[:-1]
    return new


def grams(letters: np.ndarray, of: np.ndarray, letter: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each letter with what stands before and after it in its word, ``blank`` at the word's ends. ``letters`` holds blank where
    ``letter`` is false; words don't go beyond a text (see ``of``)."""
    left, right, new = np.full_like(letters, blank), np.full_like(letters, blank), edges(of)
    left[1:], right[:-1] = letters[:-1], letters[1:]
    left[new] = blank
    right[:-1][new[1:]] = blank
    return left[letter], letters[letter], right[letter]


def dominant(points: np.ndarray, of: np.ndarray, n: int, t: Tables) -> list[str | None]:
    """Of each of ``n`` texts the most frequent script but Latin (of equals the first to occur), if half of its letters are of it."""
    letters = np.bincount(of[(t.flags[points] & COUNTED) > 0], minlength=n)
    script = t.script[points]
    at = np.flatnonzero(script)
    found: list[str | None] = [None] * n
    pair, first, count = np.unique(of[at] * len(t.names) + script[at], return_index=True, return_counts=True)
    text = pair // len(t.names)
    order = np.lexsort((first, -count, text))
    for i in order[edges(text[order])]:
        if count[i] >= LEAST_SHARE * letters[text[i]]:
            found[text[i]] = t.names[pair[i] % len(t.names)]
    return found


def signals(texts: list[str], t: Tables) -> tuple[np.ndarray, list[str | None], np.ndarray, list[str]]:
    """Of each text whether it is blank, its dominant script, and number and text of its natural words: the words of its letters and
    separators, without short ones in capitals. Where nothing but letters is left, no other rule of natural words applies."""
    points, of = flatten(texts)
    n, flags = len(texts), t.flags[points]
    blank = np.bincount(of[(flags & SPACE) == 0], minlength=n) == 0
    script = dominant(points, of, n, t)
    held = (flags & (LETTER | SEPARATOR)) > 0
    points, of, flags = points[held], of[held], flags[held]
    letter = (flags & LETTER) > 0
    start = letter & (edges(of) | ~np.concatenate([[False], letter[:-1]]))
    word = np.cumsum(start)[letter] - 1
    points, of, flags, start = points[letter], of[letter], flags[letter], start[letter]
    count = int(word[-1]) + 1 if len(word) else 0
    size = np.bincount(word, minlength=count)
    loud = (np.bincount(word[(flags & STABLE) == 0], minlength=count) == 0) & (np.bincount(word[(flags & CASED) > 0], minlength=count) > 0)
    kept = ~(loud & (size <= SHORT_CAPITALS))
    owner = of[start][kept]
    words = np.bincount(owner, minlength=n)
    stays = kept[word]
    points, of, start = points[stays], of[stays], start[stays]
    # a space before each word but a text's first
    gaps = np.flatnonzero(start & ~edges(of))
    sizes = np.bincount(of, minlength=n) + np.maximum(words - 1, 0)
    return blank, script, words, strings(np.insert(points, gaps, BLANK), sizes)
