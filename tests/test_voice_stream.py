"""Voices on a stream: settings that change while it runs, a stop and a restart, rows without an answer."""

import duckdb

from logoscope.streaming.voices import publish, voiced_at, voiced_stream

SETTINGS = "tenant long, lang string, voice_name string, voice_dialect string, rate double, average_pitch double, gain double"
ROWS = "at long, tenant long, lang string"


def settings(spark, *rows):
    return spark.createDataFrame([(t, lang, name, "", 50.0, 5.0, 10.0) for t, lang, name in rows], SETTINGS)


def add(spark, path, *rows):
    spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(path)


def test_settings_that_change_while_a_stream_runs(spark, tmp_path):
    path, source, out, checkpoint = (str(tmp_path / x) for x in ("settings", "rows", "out", "checkpoint"))
    publish(settings(spark, (1, "en", "daniel"), (1, "de", "petra"), (2, "en", "amy")), 0, path)
    add(spark, source, (1, 1, "en"), (2, 1, "de"), (3, 2, "en"))
    stream = spark.readStream.schema(ROWS).parquet(source)
    running = voiced_stream(stream, path, "at", out, checkpoint)
    running.processAllAvailable()
    change = settings(spark, (1, "en", "lena"))
    publish(change, 10, path)
    publish(change, 10, path)  # twice is as once
    add(spark, source, (9, 1, "de"), (10, 1, "en"), (11, 1, "de"), (12, 2, "en"))  # one of before the change comes late
    running.processAllAvailable()
    running.stop()
    publish(settings(spark, (2, None, None)), 20, path)
    add(spark, source, (19, 2, "en"), (20, 2, "en"))
    again = voiced_stream(stream, path, "at", out, checkpoint)
    again.processAllAvailable()
    again.stop()
    got = sorted((r["at"], r.voice_name) for r in spark.read.parquet(out).collect())
    assert got == [(1, "daniel"), (2, "petra"), (3, "amy"), (9, "petra"), (10, "lena"), (11, "caller"), (12, "amy"), (19, "amy"), (20, "caller")]


def test_rows_without_an_answer(spark, tmp_path):
    publish(settings(spark, (1, "en", "daniel"), (1, "en", "amy"), (1, "de", ""), (None, "en", "x")), 5, str(tmp_path / "s"))
    rows = spark.createDataFrame([(4, 1, "en"), (5, 1, "en"), (6, 1, "de"), (6, 1, None), (6, None, "en"), (None, 1, "en"), (6, 3, "en"), (5, 1, "en")], ROWS)
    versions = spark.read.parquet(str(tmp_path / "s"))
    got = [tuple(r) for r in voiced_at(rows, versions, "at").select("at", "tenant", "lang", "voice_name").collect()]
    assert len(got) == 8 and sorted(g[:3] for g in got if g[3] == "amy") == [(5, 1, "en")] * 2
    assert {g[3] for g in got} == {"amy", "caller"}
    assert voiced_at(rows.limit(0), versions, "at").count() == 0


def test_query_equals_sql(spark):
    import __spark_entry__ as entry

    where = "/root/testdata/sf0.001"
    got = [tuple(r) for r in entry.queries()["assign_voice_stream"](spark, where).collect()]
    db = duckdb.connect()
    for name in ("documents", "customer"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{where}/{name}.parquet'")
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(db.execute(entry.oracle_sql()["assign_voice_stream"]).fetchall(), key=key)
    assert len({r[2] for r in got}) > 3
