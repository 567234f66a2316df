"""Splitting of texts into the matches of the byte-level BPE pattern, by character classes in numpy."""

from __future__ import annotations

import numpy as np

#: The pattern of the public byte-level BPE vocabularies; it covers every text without gaps (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """Class of every code point, as the pattern's own regular expression engine sees it; built once a process."""
    global _classes
    if _classes is None:
        import regex

        table = np.zeros(0x110000, np.uint8)
        kinds = [(k, regex.compile(p)) for k, p in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+"))]
        for start in range(0, len(table), 0x800):  # some at a time: all at once would leave each worker 100 MB larger
            if not 0xD800 <= start < 0xE000:
                some = "".join(map(chr, range(start, start + 0x800)))
                for kind, pattern in kinds:
                    for m in pattern.finditer(some):
                        table[start + m.start() : start + m.end()] = kind
        table[0xD800:0xE000] = OTHER
        _classes = table
    return _classes


def boundaries(text: str, heads: np.ndarray | None = None) -> np.ndarray:
    """Starts of the matches of PATTERN in ``text``, and its length as the last element. Where ``heads`` are given, a text of
    its own begins at each of these offsets."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    if not n:
        return np.zeros(1, np.int64)
    kind = char_classes()[cp]
    head = np.zeros(n + 2, bool)
    head[[0, n, n + 1]] = True
    if heads is not None:
        head[heads] = True
    start = head[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # a run of white space before another character gives up its last character; a plain space joins what follows
    after = np.flatnonzero(start & ~head[:n] & (kind != SPACE))
    after = after[kind[after - 1] == SPACE]
    start[after - 1] = True
    joined = after[cp[after - 1] == 32]
    start[joined] = False
    # contractions: an apostrophe that is a match of its own takes one or two letters with it
    tick = np.flatnonzero(cp == 39)
    if len(tick):
        tick = tick[start[tick] & ~head[tick + 1]]
        tick = tick[kind[tick + 1] == LETTER]
        one = cp[tick + 1]
        two = np.where(head[tick + 2], 0, cp[np.minimum(tick + 2, n - 1)])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[tick[short | long] + 1] = False
        for at, width in ((tick[short], 2), (tick[long], 3)):
            end = at + width
            start[end[end < n]] = True
    return np.append(np.flatnonzero(start), n)


def pieces(text: str) -> list[str]:
    """The matches of PATTERN, in order."""
    cut = boundaries(text).tolist()
    return [text[a:b] for a, b in zip(cut, cut[1:], strict=False)]
