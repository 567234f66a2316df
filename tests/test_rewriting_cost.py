"""Rewriting and script counting read a text few times, and hold the long class of characters against what is unusual in it alone."""

from pyspark.sql import functions as F

from logoscope.functions import chars, rewrite, scripts


def plan(spark, column):
    return spark.createDataFrame([], "text string").select(column.alias("x"))._jdf.queryExecution().analyzed().toString()


def test_long_class_is_held_against_the_rest(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000000")
    shown = plan(spark, rewrite.expand_unpronounceable(F.col("text"), {"→": "arrow"}, emojis=False))
    assert shown.count(chars.unpronounceable_class()) == 1
    # what is left of a text for the scripts is cut once, not once a script
    assert plan(spark, scripts.script_counts(F.col("text"))).count(scripts.BELOW) == 1


def test_odd_texts(spark):
    texts = ["a  b", "a→→  ½b", "a\ue000  b", "→ ", " x  🇬🇧 →", "q  q", ":)  a→", "a :) b", "\u2003 a \x1c"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    names = rewrite.names_in(rows, "text")
    assert set("→½") <= set(names) and "" not in names
    said = rows.select("i", rewrite.expand_unpronounceable(F.col("text"), {"→": "arrow", "q": "queue"}).alias("a"), rewrite.expand_emoticons(F.col("text")).alias("b"))
    got = {r.i: (r.a, r.b) for r in said.collect()}
    # an unnamed character stays, but spaces are tidied; usual characters are never named
    assert [got[i][0] for i in range(6)] == ["a  b", "a 2 arrow characters ½b", "a\ue000 b", " arrow ", "x United Kingdom arrow ", "q  q"]
    assert [got[i][1] for i in (0, 6, 7, 8)] == ["a b", "smiley face a→", "a smiley face b", "a"]
