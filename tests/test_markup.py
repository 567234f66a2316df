"""Declared languages: nested elements against a plain walk, overlap joins against brute force, and which rule goes first."""

import random

import pytest
from pyspark.sql import functions as F

from logoscope.operators import detect
from logoscope.sources import markup

NESTED = '<html lang="en"><body>a<p lang="de">b<b>c<i lang=\'ru\'>d</i>e</b></p><!-- <p lang="x"> --><script>var t="</p>"</script>f<p lang="">g</q>h<br>i'


def test_scan():
    got = markup.scan(NESTED)
    assert got["locale"] == "en"
    text = {}
    for line in got["lines"]:
        text |= {line["start"] + i: c for i, c in enumerate(line["text"])}
        assert line["end"] - line["start"] == len(line["text"])
    lang = {text[i]: r["lang"] for r in got["ranges"] for i in range(r["start"], r["end"]) if i in text}
    assert lang == {"a": None, "b": "de", "c": "de", "d": "ru", "e": "de", "f": None, "g": "", "h": "", "i": ""}
    assert [x["text"] for x in got["lines"]] == ["a", "bcde", "f", "gh", "i"]
    ends = [r["end"] for r in got["ranges"]]
    assert [r["start"] for r in got["ranges"]] == [0, *ends[:-1]]
    assert markup.scan("") == {"locale": None, "lines": [], "ranges": []} and markup.scan("x < y &amp; z\n")["lines"][0]["text"] == "x  y & z "


@pytest.mark.parametrize("bucket", [3, 16, 4096])
def test_overlaps(spark, monkeypatch, bucket):
    monkeypatch.setattr(markup, "BUCKET", bucket)
    rng = random.Random(bucket)
    lines, ranges, want = [], [], []
    for page in range(5):
        at = 0
        for n in range(6):
            size = rng.randint(0, 30)
            lines.append((page, n, at, at + size, "".join(rng.choice("abc ") for _ in range(size))))
            at += size + 1
        ranges += [(page, a, a + rng.randint(0, 40), rng.choice(["de", "en", None])) for a in (rng.randint(0, at) for _ in range(8))]
    lines.append((None, 0, 0, 3, "abc"))
    for p, n, s, e, t in lines:
        for q, a, b, lang in ranges:
            if p == q and max(s, a) < min(e, b) and t[max(s, a) - s : min(e, b) - s].strip():
                want.append((p, n, max(s, a), lang, t[max(s, a) - s : min(e, b) - s]))
    got = markup.pieces(
        spark.createDataFrame(lines, "page int, line_no int, start int, end int, text string"), spark.createDataFrame(ranges, "page int, start int, end int, lang string"), ["page"]
    )
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def resolved(spark, mode, mixed, markup_lang, locale, script, found):
    row = spark.createDataFrame([(mode, mixed, markup_lang, locale, script, found)], "mode string, mixed boolean, m string, l string, s string, d string")
    voiced = F.array(F.lit("en"), F.lit("de"))
    line = detect.resolve(F.col("mode"), F.col("mixed"), F.col("m"), F.col("l"), F.col("s"), F.col("d"), F.lit("en"))
    voice = F.when(F.array_contains(voiced, line), line)
    said = detect.resolve_utterance(F.col("mode"), F.col("mixed"), voice, F.col("s"), F.col("d"), F.lit("en"), voiced)
    return tuple(row.select(line.alias("a"), said.alias("b")).first())


def test_rules(spark):
    r = lambda *x: resolved(spark, *x)
    assert r("off", True, "de", "de", None, "de") == (None, None)
    # a range counts in mixed lines only, and before the locale
    assert r("markup_text", True, "de_DE", "en", None, "fr") == ("de", "de")
    assert r("markup_text", False, "de_DE", "EN", None, "de") == ("en", "en")
    # a tag without a voice ends the search for the line; its utterance has no voice to trust, so it is detected
    assert r("markup_text", False, None, "fr", None, "de") == ("fr", "de")
    # a mixed line's utterance is detected whatever its voice
    assert r("markup_text", True, None, "en", None, "de") == ("en", "de")
    assert r("always", False, "en", "en", None, "de") == ("de", "de")
    # a script without a voice leaves the voice as it is
    assert r("markup_only", False, None, None, "ru", None) == ("ru", None)
    assert r("markup_only", False, None, None, None, "de") == ("en", "en")
    assert r("markup_only", True, "de", None, None, "en") == ("de", "de")


def test_references_in_the_sql(spark, tmp_path):
    """The SQL of resolve_language reads character references as the scan does: bare ones, prefixes of names, numbers."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from logoscope.plans import catalog

    said = [
        "Of that*** ing&amp;&amp;&amp", "a&ampb &notit; &copyx &am &quo &zwnj;c", "&#65;&#x42;c &#x41 &#128; &#1;d &#xD800;e &#1114112; &#99999999999999999999; &# &#x; &",
        "&nbsp;&NewLine;&bne;z &lt;p&gt; &CounterClockwiseContourIntegral; &&amp;amp;",
    ]
    html = [f"<html><body><h1>{t}</h1><p lang='de'>{t}<i lang='fr'>und {t}</i> das</p></body></html>" for t in said for _ in range(12)]
    pq.write_table(pa.table({"page_id": range(len(html)), "html": html}), tmp_path / "pages.parquet")
    docs = "/root/testdata/sf0.001/documents.parquet"
    (tmp_path / "documents.parquet").symlink_to(docs)
    got = catalog.QUERIES["resolve_language"](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = con.execute(catalog.ORACLES["resolve_language"]).fetchall()
    assert len(want) > len(html) and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
