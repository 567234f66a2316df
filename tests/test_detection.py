"""Detection in one map stage: against the native functions, against joins with the model, and with other scorers."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logoscope.functions import scripts
from logoscope.functions import text as X
from logoscope.operators import detect, ngram, packed, segments

ENABLED = ["de", "en", "ru"]
LABELLED = [("en", "the cat and the dog with this"), ("de", "der hund und die katze mit nicht"), ("ru", "это кот и собака"), ("tr", "İstanbul ve IĞDIR ılık")]


@pytest.fixture(scope="module")
def model(spark):
    return ngram.train(spark.createDataFrame(LABELLED, "lang string, text string")).cache()


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    words = ["the", "der", "und", "katze", "USA", "NATO!", "don't", "a_b", "/usr/bin", "это", "ЭТО", "漢字", "ʃəː", "⠓⠑", "שלום", "😀", "12", "İl", "ΣΑΣ", "ﬁn", "x", "\xa0", " ", "á", "१२", "。"]
    rows = [None, "", " ", "\x1f", "\n", "12 34", "USA", "漢a", "a漢", "漢字 ab"]
    rows += ["".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", "", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    return spark.createDataFrame(list(enumerate(rows)), "id int, text string").cache()


def rows(df):
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())


def test_signals_are_the_native_functions(spark, texts):
    t = F.col("text")
    natural = X.natural_words(X.clean_letters(t))
    want = texts.where(~X.is_blank(t)).select("id", scripts.dominant_script(t).alias("script"), F.size(natural).alias("words"), F.array_join(natural, " ").alias("natural"))
    got = texts.select("id", detect.signals_udf(spark)(t).alias("s")).where("s is not null").select("id", "s.script", "s.words", "s.natural")
    assert rows(got) == rows(want)


def test_packed_is_joined(spark, texts, model, monkeypatch):
    made = lambda: [
        rows(detect.detect(texts, model, ["id"], ENABLED)), rows(detect.detect(texts, model, ["id"], [])), rows(packed.scores(texts, model, ["id"])),
        rows(packed.top(texts, model, ["id"])), rows(segments.mixed_segments(texts, model, ["id"])),
    ]
    dense = made()
    monkeypatch.setattr(packed, "DENSE", 0)
    assert made() == dense
    monkeypatch.setattr(packed, "CELLS", 0)
    assert made() == dense
    assert all(len(x) > 50 for x in dense)


def test_one_map_stage(spark, texts, model):
    plan = detect.detect(texts, model, ["id"], ENABLED)._jdf.queryExecution().executedPlan().toString()
    plan += segments.mixed_texts(texts, model, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Generate" not in plan


def test_another_scorer(spark, texts):
    @F.arrow_udf(packed.SCORE)
    def by_length(text: pa.Array) -> pa.Array:
        sizes = [len(t) if t else None for t in text.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([None if s is None else "en" if s % 2 else "de" for s in sizes]), pa.array([None if s is None else 0.5 for s in sizes])], ["lang", "conf"])

    got = {r.id: r for r in detect.detect(texts, by_length, ["id"], ENABLED).collect()}
    natural = X.natural_words(X.clean_letters(F.col("text")))
    for r in texts.where(~X.is_blank(F.col("text"))).select("id", F.array_join(natural, " ").alias("n")).collect():
        if got[r.id].script_lang is None:
            assert (got[r.id].lang, got[r.id].conf) == ((None, None) if not r.n else ("en" if len(r.n) % 2 else "de", 0.5))
        else:
            assert got[r.id].lang == got[r.id].script_lang and got[r.id].conf is None


@pytest.mark.parametrize("made", ["string", "struct<lang:string>", "struct<lang:string,conf:float>", "struct<lang:int,conf:double>"])
def test_scorers_are_checked(spark, texts, made):
    with pytest.raises(TypeError):
        detect.detect(texts, lambda c: F.lit(None).cast(made), ["id"], ENABLED)


def test_columns_of_any_name_and_empty_tables(spark, model):
    clash = spark.createDataFrame([(1, "s", "der hund und", "b")], "id int, s string, text string, natural string")
    assert [r.lang for r in detect.detect(clash, model, ["id", "s", "natural"], ENABLED).collect()] == ["de"]
    assert detect.detect(clash.limit(0), model, ["id"], ENABLED).count() == 0
    assert segments.mixed_texts(clash.limit(0), model, ["id"]).count() == 0
