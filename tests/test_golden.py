"""Worked examples, as rows through the column functions."""

import pytest
from pyspark.sql import functions as F

from logoscope.functions import chars, rewrite, scripts
from logoscope.functions import text as X


def column(spark, values, use):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in rows.orderBy("i").select(use(F.col("c"))).collect()]


def test_language_tags(spark):
    tags = ["de-DE", "en-Latn-US", "de_DE.UTF-8", "de@variant", "", None, " EN ", "-x"]
    assert column(spark, tags, X.lang_code) == ["de", "en", "de", "de", None, None, "en", None]
    assert column(spark, ["en-GB", "en", "en_US-x", "a-b-c"], X.dialect) == ["GB", "", "x", "b-c"]
    assert column(spark, ["en-GB", "en", "en_US-x"], X.second_subtag) == ["GB", "", "US"]


def test_scripts(spark):
    assert column(spark, list("Жかəa1") + ["⠓"], scripts.char_script) == ["CYRILLIC", "CJK", "IPA", "LATIN", None, "BRAILLE"]
    texts = ["abЖЖ", "abcЖ", "", None, "Жש", "12Жש"]
    assert column(spark, texts, scripts.dominant_script) == ["CYRILLIC", None, None, None, "CYRILLIC", None]


def test_words(spark):
    natural = lambda c: F.array_join(X.natural_words(X.clean_letters(c)), " ")
    assert column(spark, ["see /usr/bin foo_bar LS", "", "ABCDE ABCD don't"], natural) == ["see usrbin foobar", "", "ABCDE dont"]
    noise = ["/usr", "-v", "--verbose", "KEY=val", "a.b.c", "foo_bar", "1.2.3", "|", "word", "don't"]
    assert column(spark, noise, X.is_noise) == [True] * 8 + [False] * 2


def test_spoken_names():
    brief, verbose = chars.char_names("brief"), chars.char_names("verbose")
    assert brief["​"] == "" and verbose["​"] == "zero width space"
    assert [brief[c] for c in "½∞→"] == ["one half", "infinity", "right arrow"]
    assert "×" not in brief and "–" not in brief
    assert brief["─"] == "horizontal" and verbose["─"] == "light horizontal"


@pytest.mark.parametrize(("verbosity", "said"), [("brief", " 6 horizontal characters "), ("verbose", " 6 light horizontal characters ")])
def test_runs(spark, verbosity, said):
    names = chars.char_names(verbosity)
    some = {c: names[c] for c in "─½→"}
    assert column(spark, ["──────", "a½b", "plain", None], lambda c: rewrite.expand_unpronounceable(c, some)) == [said, "a one half b", "plain", None]


def test_emojis(spark):
    texts = ["Family: 👨‍👩‍👧", "Reactions: 👨‍👩‍👧‍👦 then 🇬🇧", "12:30", "12:30:45 😀"]
    said = ["Family: family man woman girl", "Reactions: family man woman girl boy then United Kingdom", "12:30", "12 30 45 grinning face"]
    assert column(spark, texts, rewrite.expand_emojis) == said


def test_emoticons(spark):
    texts = ["hi :)  x", "http://a", "(item 8)", "D: drive", ":):)", "a ¯\\_(ツ)_/¯ b"]
    said = ["hi smiley face x", "http://a", "(item cool face", "horrified drive", "smiley face smiley face", "a shrug b"]
    assert column(spark, texts, rewrite.expand_emoticons) == said


def test_tables(spark):
    paths = ["/usr/share/liblouis/tables/de-g1-detailed.ctb", "/x/IPA.utb", "/x/unicode-braille.utb"]
    assert column(spark, paths, X.text_table) == ["de", None, None]


def test_chunks(spark):
    long = " ".join(f"w{i}" for i in range(85))
    assert column(spark, ["One. Two!  Three\n\nfour", long], X.sentence_chunks) == [
        ["One.", "Two!", "Three", "four"],
        [" ".join(f"w{i}" for i in range(a, min(a + 40, 85))) for a in (0, 40, 80)],
    ]
