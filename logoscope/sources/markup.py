"""Declared languages in HTML: lines of a page's text, and ranges of its offsets with the language of the element around them.

``pieces`` joins any ranges with any lines by overlap of offsets. Both sides are dealt by page and stretch of BUCKET characters, so a
page of any length is spread over tasks, and a pair meets in one stretch only: that in which the later of the two begins.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logoscope.functions.text import is_blank

TOKEN = re.compile(r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<[^>]*>|[^<]+")
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*)")
LANG = re.compile(r"""\slang=(?:"([^"]*)"|'([^']*)')""")
#: Elements that end a line, and elements without an end.
BLOCKS = (
    "article", "blockquote", "body", "br", "div", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "p",
    "pre", "section", "table", "td", "th", "title", "tr", "ul",
)
VOID = ("br", "hr", "img", "input", "link", "meta")
#: Characters of a stretch that lines and ranges are dealt by.
BUCKET = 4096
SCAN = "struct<locale:string,lines:array<struct<line_no:int,start:int,end:int,text:string>>,ranges:array<struct<start:int,end:int,lang:string>>>"


def scan(page: str) -> dict:
    """Locale of the page (the html element's), lines of its text with their offsets, and ranges that cover the text without
    gaps: each has the language tag of the innermost element around it that has one, else null.

    An end tag closes the nearest open element of its name and what is open inside it; one without such an element is
    ignored. What isn't closed goes on to the end. Scripts, styles and comments aren't text."""
    locale, open_, at = None, [], 0
    lines, parts, ranges = [], [], []
    start = 0

    def line_end(after: int) -> None:
        nonlocal start
        lines.append({"line_no": len(lines), "start": start, "end": at, "text": "".join(parts)})
        parts.clear()
        start = after

    def said(n: int) -> None:
        nonlocal at
        lang = open_[-1][1] if open_ else None
        if ranges and ranges[-1]["lang"] == lang:
            ranges[-1]["end"] = at + n
        elif n:
            ranges.append({"start": at, "end": at + n, "lang": lang})
        at += n

    for token in TOKEN.findall(page):
        if not token.startswith("<"):
            text = html.unescape(token).replace("\n", " ")
            parts.append(text)
            said(len(text))
            continue
        tag = TAG.match(token)
        if not tag or token.startswith(("<script", "<style")):
            continue
        name, found = tag[2].lower(), LANG.search(token)
        if name in BLOCKS:
            line_end(at + 1)
            said(1)
        if tag[1]:
            same = [i for i, (n, _) in enumerate(open_) if n == name]
            if same:
                del open_[same[-1] :]
        elif name not in VOID:
            lang = (found[1] if found[1] is not None else found[2]) if found else None
            if name == "html":
                locale, lang = locale or lang, None
            open_.append((name, lang if lang is not None else open_[-1][1] if open_ else None))
    line_end(at)
    return {"locale": locale or None, "lines": [x for x in lines if x["text"]], "ranges": ranges}


def _scan(pages: pa.Array) -> pa.Array:
    line = pa.struct([("line_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])
    kind = pa.struct([("locale", pa.string()), ("lines", pa.list_(line)), ("ranges", pa.list_(span))])
    return pa.array([None if p is None else scan(p) for p in pages.to_pylist()], kind)


def scanned(page: Column) -> Column:
    """``scan`` of a column of HTML; null for null."""
    return F.arrow_udf(_scan, SCAN)(page)


def pieces(lines: DataFrame, ranges: DataFrame, key: list[str]) -> DataFrame:
    """(key, line_no, start, lang, text): parts of lines (key, line_no, start, end, text) that ranges (key, start, end, lang) cut out.

    Where ranges overlap each gives a piece; what no range covers gives none; blank pieces and empty ranges go. Null keys meet nothing."""
    stretch = lambda d: d.where("start < end").withColumn("_stretch", F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor((F.col("end") - 1) / BUCKET))))
    left = stretch(lines.select(*key, "line_no", "start", "end", "text"))
    right = stretch(ranges.select(*key, F.col("start"), F.col("end"), "lang"))
    right = right.select(*key, "_stretch", F.col("start").alias("_from"), F.col("end").alias("_to"), "lang")
    low, high = F.greatest("start", "_from"), F.least("end", "_to")
    met = left.join(right, [*key, "_stretch"]).where((low < high) & (F.floor(low / BUCKET) == F.col("_stretch")))
    cut = met.select(*key, "line_no", low.alias("start"), "lang", F.substring(F.col("text"), low - F.col("start") + 1, high - low).alias("text"))
    return cut.where(~is_blank(F.col("text")))
