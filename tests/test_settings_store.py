"""Tables of settings by state and of names in buckets."""

import glob
import json
import os

from logoscope.sources import settings as S

NAMES = "tenant bigint, ch string, brief string, verbose string"
CHANGES = f"{NAMES}, remove boolean"


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def names(spark, path):
    return sorted(tuple(r) for r in S.stored_names(spark, path).collect())


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "names")
    S.create_names(spark.createDataFrame([(t, c, f"{c}{t}", f"long {c}") for t in range(40) for c in "ab"], NAMES), path, 8)
    before, rows = files(path), names(spark, path)
    assert len(before) == 8 and len(rows) == 80
    changes = spark.createDataFrame([(3, "a", "new", "newer", False), (3, "b", "", "", True), (3, "z", "z", None, False), (None, "a", "x", "x", False)], CHANGES)
    touched = S.merge_names(spark, path, changes, 8)
    after = files(path)
    assert len(touched) == 1
    assert {f for f in before if f not in after} == {f for f in before if f"bucket={touched[0]}/" in f}
    want = [r for r in rows if r[0] != 3] + [(3, "a", "new", "newer"), (3, "z", "z", None)]
    assert names(spark, path) == sorted(want)
    assert S.merge_names(spark, path, changes, 8) == [] and files(path) == after


def test_merge_of_a_bucket_that_becomes_empty(spark, tmp_path):
    path = str(tmp_path / "names")
    S.create_names(spark.createDataFrame([(1, "a", "x", "y"), (2, "a", "x", "y"), (None, "a", "x", "y")], NAMES), path, 4)
    S.merge_names(spark, path, spark.createDataFrame([(1, "a", None, None, True), (9, "q", None, None, True)], CHANGES), 4)
    assert names(spark, path) == [(2, "a", "x", "y")]
    S.merge_names(spark, path, spark.createDataFrame([(2, "a", None, None, True)], CHANGES), 4)
    assert names(spark, path) == []
    twice = [(5, "a", "b", "v", False), (5, "a", "c", "v", False), (5, "a", None, None, True)]
    S.merge_names(spark, path, spark.createDataFrame(twice, CHANGES), 4)
    assert names(spark, path) == [(5, "a", "c", "v")]


def test_names_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "names")
    S.create_names(spark.createDataFrame([], NAMES), path, 4)
    assert names(spark, path) == []
    assert S.merge_names(spark, path, spark.createDataFrame([], CHANGES), 4) == []


def test_bodies_by_state(spark, tmp_path):
    deep = "[" * 100_000
    bodies = {
        1: '{"profiles": {"b": 1, "a": [1.50, "é"]}, "general": {"x": null}}',
        2: '{"general": {"x": 1} "y", "profiles": {"a": 2}}',
        3: '{"profiles": {"a": oops}, "general": {"x": 2}, }',
        4: "", 5: "{ no", 6: '{"general": {}} x', 7: "[1]", 8: None, 9: '{"general": NaN}', 10: '{"profiles": "\\ud800"}', 11: deep, 12: '{"general": "text"}',
    }
    path = str(tmp_path / "settings")
    rows = spark.createDataFrame(list(bodies.items()), "tenant bigint, body string")
    S.store_by_state(rows, path)
    good = {r.tenant: (r.profiles, r.general, r.state) for r in S.usable(spark, path).collect()}
    assert good == {
        1: ('{"b":1,"a":[1.5,"é"]}', '{"x":null}', "strict"), 2: ('{"a":2}', '{"x":1}', "salvaged"), 3: (None, '{"x":2}', "salvaged"),
        6: (None, "{}", "salvaged"), 7: (None, None, "strict"), 10: ("?", None, "strict"), 12: (None, "text", "strict"),
    }
    bad = {r.tenant: (r.state, r.error_at, r.recovered) for r in S.quarantine(spark, path).collect()}
    assert bad == {
        2: ("salvaged", 21, "profiles,general"), 3: ("salvaged", bodies[3].index("oops"), "general"), 4: ("lost", 0, ""), 5: ("lost", 2, ""),
        6: ("salvaged", 16, "general"), 9: ("lost", None, ""), 11: ("lost", None, ""),
    }
    assert {r.tenant: r.body for r in S.quarantine(spark, path).collect()} == {t: bodies[t] for t in bad}
    S.store_by_state(rows.where("tenant = 1"), path)
    assert S.quarantine(spark, path).count() == 0 and [json.loads(r.general) for r in S.usable(spark, path).collect()] == [{"x": None}]
