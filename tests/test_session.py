"""The state machine: the worked example, batch against stream, and settings salvage."""

import random
import time

import pytest
from pyspark.sql import functions as F

from logoscope.operators import ngram, segments
from logoscope.operators.session import Session, session_language
from logoscope.sources import settings, utterances
from logoscope.streaming.sessions import replayed, session_stream

COLUMNS = "session long, seq long, script_lang string, lang string, conf double, words int, hint string"


def test_worked_example():
    s = Session("en", 2, 0.92, "en")
    steps = [("de", 0.785, 3), ("de", 0.99, 2), ("de", 0.99, 2), ("en", 0.60, 1), ("de", 0.99, 5), ("en", 0.60, 2)]
    assert [s.step(None, *x) for x in steps] == ["en", "en", "de", "de", "de", "en"]


def test_scripts_hints_and_blanks():
    s = Session("en", 2, 0.92, "en")
    assert s.step("ipa", "ipa", None, 0) == "ipa" and s.current == "en"
    assert s.step("ru", "ru", None, 1) == "ru"
    assert s.step(None, None, None, None) == "ru"
    assert s.step(None, "de", 0.1, 1) == "ru" and s.heard == ["de"]
    assert s.step(None, None, None, None, hint="fr") == "fr" and s.heard == ["de"]
    assert s.step(None, "de", 0.1, 1) == "de"


def test_scripts_alone():
    s = Session("en", 2, 0.92, "en", [], False, False)
    assert s.step("ru", "ru", None, 1) == "ru" and s.current == "en"
    assert s.step(None, "de", 1.0, 9) is None and s.step(None, None, None, None) is None
    s = Session("en", 2, 0.92, "en", [], False, True)
    assert s.step("ru", "ru", None, 1) == "ru" and s.step(None, "de", 1.0, 9) == "ru"
    s = Session("en", 2, 0.92, "en", [], True, False)
    assert s.step(None, None, None, 0) == "en" and s.step(None, None, None, None) is None


def test_only_voices_take_effect(spark):
    spoken = spark.createDataFrame(list(enumerate(["en", "fr", "ipa", "de", "de", "fr", "de", "en"])), "seq int, spoken string").selectExpr("1 AS session", "*")
    got = segments.switch_events(spoken, "session", "seq", "spoken", "en", ["en", "de"]).orderBy("seq").collect()
    assert [(r.seq, r.before, r.lang) for r in got] == [(3, "en", "de"), (7, "de", "en")]


def test_mixed_chunks(spark):
    labelled = spark.createDataFrame([("en", "the cat and the dog with this"), ("de", "der hund und die katze mit nicht")], "lang string, text string")
    model = ngram.train(labelled)
    en, de = "the cat and the dog with this cat", "der hund und die katze mit nicht hund"
    long = f"{en} {en} {en}. Die katze. 12 34. {de}! der hund the der."
    texts = [(1, long), (2, f"{en} {de}"), (3, f"{en} {en} {en} {en} {en}"), (4, "the cat der hund"), (5, f"{en} {en} {en} {en} {en} {de}"), (6, None), (7, "")]
    got = segments.mixed_segments(spark.createDataFrame(texts, "id int, text string"), model, ["id"]).orderBy("id", "seg").collect()
    of = lambda i: [(r.seg, r.lang, r.text) for r in got if r.id == i]
    # a sentence ends a run, short sentences are of one language, one without letters is left out
    assert of(1) == [(0, "en", f"{en} {en} {en}."), (1, "de", "Die katze."), (2, "de", f"{de}!"), (3, "de", "der hund the der.")]
    assert [(s, x) for s, x, _ in of(2)] == [(0, "en"), (1, "de")]  # at most 30 words: as a whole
    assert of(3) == of(4) == of(6) == of(7) == []
    # 48 words without a sentence's end: 40 and 8
    assert of(5) == [(0, "en", " ".join([en] * 5)), (1, "de", de)]


def detections(spark, n=40):
    rng = random.Random(5)
    rows = [
        (s, q, rng.choice([None, None, None, "ru", "ipa"]), rng.choice(["en", "de", "fr", None]), rng.random(), rng.randint(0, 5), rng.choice([None] * 9 + ["de"]))
        for s in range(12) for q in range(n)
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.mark.parametrize("threshold", [2, 3])
def test_batch_equals_steps(spark, threshold):
    rows = detections(spark)
    got = {(r.session, r.seq): r.spoken for r in session_language(rows, "en", threshold).collect()}
    state, of = None, None
    for r in rows.orderBy("session", "seq").collect():
        if r.session != of:
            of, state = r.session, Session("en", threshold, 0.92, "en")
        assert got[r.session, r.seq] == state.step(r.script_lang, r.lang, r.conf, r.words, r.hint)


def giant(n, sessions, seed, quiet):
    """Rows of few sessions; ``quiet`` of ten rows have no signal, so states before a range stay open for long."""
    rng = random.Random(seed)
    rows = []
    for q in range(n):
        if rng.randrange(10) < quiet:
            row = (None, None, None, rng.choice([None, 1]), None)
        else:
            lang = rng.choice(["en", "de", "fr", "it", None])
            row = (rng.choice([None] * 30 + ["ru", "ipa"]), lang, rng.random() * 0.95, rng.randint(0, 3), rng.choice([None] * 60 + ["de", "es"]))
        rows.append((None if rng.randrange(9) == 0 and sessions > 1 else rng.randrange(sessions), q, *row))
    return rows


@pytest.mark.parametrize("threshold, sessions, quiet, more", [
    (2, 1, 5, {}), (3, 1, 9, {}), (1, 1, 5, {}), (4, 2, 3, {}), (2, 40, 5, {}), (2, 1, 5, {"statistical": False}),
    (2, 1, 5, {"fallback": False}), (2, 2, 5, {"statistical": False, "fallback": False}),
])
def test_giant_session_in_ranges(spark, threshold, sessions, quiet, more):
    given = giant(600, sessions, threshold, quiet)
    found = session_language(spark.createDataFrame(given, COLUMNS), "en", threshold, ranges=16, **more)
    state, of, expected = None, "", {}
    for s, q, *row in sorted(given, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        if s != of:
            of, state = s, Session("en", threshold, 0.92, "en", [], more.get("statistical", True), more.get("fallback", True))
        expected[s, q] = state.step(*row)
    rows = found.collect()
    assert len(rows) == 600 and {(r.session, r.seq): r.spoken for r in rows} == expected


def test_giant_session_is_spread_and_odd_rows(spark):
    rows = spark.createDataFrame(giant(400, 1, 3, 5), COLUMNS)
    tasks = session_language(rows, ranges=8).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 400
    ends = session_language(rows, ranges=8).inputFiles()
    assert len(ends) >= 8  # a file a range
    assert session_language(rows.where("false")).collect() == []
    twice = spark.createDataFrame([(1, 1, None, "de", 0.99, 5, None)] * 3 + [(1, None, None, "fr", 0.1, 1, None)], COLUMNS)
    assert [r.spoken for r in session_language(twice.selectExpr("*", "1 AS part", "2 AS era")).orderBy("seq").collect()] == ["en", "de", "de", "de"]


def test_stream_equals_batch(spark, tmp_path):
    rows = detections(spark, 12)
    for part, where in enumerate(("seq < 5", "seq between 5 and 8", "seq > 8")):
        rows.where(where).coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    done = utterances.run_to_end(session_stream(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = {(r.session, r.seq): r.spoken for r in done.collect()}
    assert got == {(r.session, r.seq): r.spoken for r in session_language(rows).collect()}


def test_stream_stopped_and_started_again(spark, tmp_path):
    detections(spark, 12).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    total, out, checkpoint = rows.count(), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    stream = session_stream(replayed(rows, str(tmp_path / "in"), slice_rows=-(-total // 6), files=2))
    first = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
    until = time.time() + 60
    while not first.recentProgress and time.time() < until:
        time.sleep(0.05)
    first.stop()
    assert 0 < spark.read.schema(stream.schema).parquet(out).count() < total  # in mid-stream
    done = utterances.run_to_end(stream, out, checkpoint).collect()
    assert len(done) == total
    assert {(r.session, r.seq): r.spoken for r in done} == {(r.session, r.seq): r.spoken for r in session_language(rows).collect()}


def test_salvage(spark):
    bodies = ['{"profiles": {"a": {"b": "}"}}, "general": {"x": 1}}', '{"general": {"x": 1} oops "profiles": {"q": 2}}', '{"profiles": {bad}, }', "nothing", None]
    rows = spark.createDataFrame(list(enumerate(bodies)), "tenant int, body string")
    got = {r.tenant: (r.profiles, r.general, r.state) for r in settings.load_lenient(rows).collect()}
    assert got == {0: ('{"a":{"b":"}"}}', '{"x":1}', "strict"), 1: ('{"q":2}', '{"x":1}', "salvaged"), 2: (None, None, "lost"), 3: (None, None, "lost")}


def test_native_queries_have_no_python(spark):
    import __spark_entry__ as entry

    for name in ("expand_unpronounceable", "speakable_text", "script_counts", "sync_voices"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "Python" not in plan and "Arrow" not in plan, name


