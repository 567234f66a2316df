"""What bounds a task: tenants are dealt out before they become rows, and detection is one pass in Python."""

from logoscope.llm import quality
from logoscope.operators import detect, ngram
from logoscope.plans import tenants
from logoscope.streaming import voices

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tenants_are_dealt_before_they_are_many(spark):
    shown = plan(tenants.first_voice(spark, DIR))
    # beneath the join that makes rows of a tenant, with its key alone
    assert shown.index("Join") < shown.index("RepartitionByExpression [c_custkey")
    versions = spark.createDataFrame([], "since long, tenant long, lang string, voice_name string, voice_dialect string, rate double, average_pitch double, gain double")
    rows = spark.createDataFrame([], "tenant long, lang string, at long")
    assert plan(voices.voiced_at(rows.where("at > 0"), versions, "at")).count("RepartitionByExpression [tenant") == 2


def test_detection_is_one_pass_in_python(spark):
    docs = spark.createDataFrame([("en", "the cat and the dog"), ("de", "der hund und die katze")], "lang string, text string")
    rows = spark.createDataFrame([(1, "the dog"), (2, "die katze"), (3, "мир"), (4, " "), (5, "123"), (6, None)], "i int, text string")
    found = detect.detect(rows, ngram.train(docs), ["i"], ["en", "de", "ru"])
    assert plan(found).count("ArrowEvalPython") == 1
    got = {r.i: (r.script_lang, r.lang, r.conf is None, r.words) for r in found.collect()}
    assert got == {1: (None, "en", False, 2), 2: (None, "de", False, 2), 3: ("ru", "ru", True, 1), 5: (None, None, True, 0)}


def test_the_quality_filter_has_been_through_python_before_a_caller_writes(spark):
    """A caller's write would hand texts over in batches of the session's size, here of ten thousand rows."""
    docs = spark.createDataFrame([(i, f"text {i}" if i % 2 else "!! " * i, i) for i in range(40)] + [(None, None, 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    kept = quality.keep_good(docs, labels, 0.0)
    assert "MapInArrow" not in plan(kept) and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert sorted(kept.collect(), key=str) == sorted(docs.collect(), key=str) and kept.schema == docs.schema
