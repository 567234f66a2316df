"""Odd cases of the operators: repeated and null ids, hot groups, extreme numbers, clashing columns, empty tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logoscope.llm import exact_dedup, jaccard_join, kd_shards, multi_index, pii, quality
from logoscope.llm.shared import shared_dir


def test_slices_meet():
    """Sets of any allowed difference share a top node in every seed, whatever is in it."""
    rng = np.random.default_rng(3)
    starts = np.array(jaccard_join.ranges(80, 100))
    for seed in (0, 2):
        for n in (1, 2, 4, 5, 6, 9, 10, 25, 60, 200, 900):
            for _ in range(12):
                both = rng.integers(0, 2**63, n).astype(np.uint64)
                cut = int(rng.integers(0, n // 5 + 1))
                a, b = np.unique(both[: n - cut]), np.unique(np.concatenate([both[: n - cut], rng.integers(0, 2**63, int(rng.integers(0, cut + 1))).astype(np.uint64)]))
                union = len(np.union1d(a, b))
                if not len(a) or 100 * len(np.intersect1d(a, b)) < 80 * union or np.array_equal(a, b):
                    continue
                tops = []
                for s in (a, b):
                    i = int(np.searchsorted(starts, len(s), "right")) - 1
                    tops.append({x for j in (i, i - 1) if j >= 0 and jaccard_join.slicing(j, 80, 100)[0] > 1 for f in jaccard_join.slices(s, j, 80, 100, seed) for x in f.tolist()})
                assert tops[0] & tops[1]


def test_near_groups_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "REFINED_SETS", 2)
    rng = random.Random(2)
    text = lambda: [rng.choice("abcdefghijklmnop") + str(rng.randrange(90)) for _ in range(120)]
    near = lambda t: " ".join([*t[:60], "other", *t[61:]])
    a, b, c = text(), text(), text()
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, " ".join(c)), (None, near(c)), (5, " ".join(c)), (5, " ".join(c)), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("cc", F.lit("x"))
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_join.near_groups(df).collect())
    assert got == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4)]
    kept = jaccard_join.drop_near_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 1, 4]


def test_exact_null_and_repeated_ids(spark):
    rows = [(1, "a b"), (None, "ab"), (None, "x"), (None, " x"), (2, None), (None, ""), (7, "q"), (7, "ab"), (8, "a  b"), (8, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__at", F.lit(1)).withColumn("norm", F.lit("n"))
    kept = sorted((r.doc_id or 0, r.text) for r in exact_dedup.drop_copies(df).select("doc_id", F.coalesce("text", F.lit("-")).alias("text")).collect())
    assert kept == [(0, " x"), (2, "-"), (7, "q"), (8, "a  b"), (8, "z")]
    groups = exact_dedup.exact_groups(df)
    assert groups.where("kept").count() == 5 and groups.count() == len(rows)
    hot = spark.createDataFrame([(None, "same")] * 300 + [(9, "longer  same"[6:])], "doc_id long, text string")
    assert [r.doc_id for r in exact_dedup.drop_copies(hot.where("doc_id is null")).collect()] == [None]


@pytest.mark.parametrize("shards", [1, 5, 8])
def test_shards_keep_groups(spark, shards):
    """No group of equal texts is split, a hot one neither; the other shards share what is left evenly."""
    rng = random.Random(shards)
    texts = ["w" * rng.randint(0, 300) + str(rng.randint(0, 250)) for _ in range(900)] + ["hot " * 40] * 400 + ["long " * 9000] + [None, ""] * 30
    rows = [(i % 1000, t, rng.choice([None, "en", "de"]), f"https://host/{rng.randint(0, 9)}", "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, leaf string").withColumn("shard", F.lit(1))
    got = kd_shards.kd_shards(df, shards=shards).collect()
    assert len(got) == len(rows)
    by_crc, sums, slots = {}, {}, {}
    for r in got:
        by_crc.setdefault(r.text_crc32, set()).add(r.shard)
        sums[r.shard] = sums.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(s) == 1 for s in by_crc.values()) and set(sums) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    weights = {}
    for t in texts:
        weights[t or ""] = weights.get(t or "", 0) + len(t or "") + 1
    total, alone = sum(weights.values()), 0
    for n, w in enumerate(sorted(weights.values(), reverse=True)):  # shards that one group fills by itself
        if n >= shards - 1 or w < (total - alone) / (shards - n):
            rest = shards - n
            break
        alone += w
    loads = sorted(sums.values())[:rest]
    assert max(loads) <= 1.03 * (total - alone) / rest


def test_vectors_of_any_magnitude(spark):
    rows = [(1, [1e200, 0.0, 0.0, 0.0]), (2, [1e200, 1e190, 0.0, 0.0]), (3, [1e-200, 0.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.0, 0.0]), (5, [5e-324, 0.0, 0.0, 0.0]),
            (6, [0.0, 1.7e308, 0.0, 0.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [-1.0, 0.0, 0.0, 0.0]), (10, [0.0]), (11, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: tuple(r[1:]) for r in multi_index.near_duplicates(df).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 5)] == [(4, 1, True)] + [(4, 1, False)] * 4
    assert got[7] == (1, 7, True) and got[8] == (1, 7, False) and all(got[i] == (0, i, True) for i in (6, 9, 10, 11))


def test_quality_filter_is_the_score(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    rows = [(i, (" ".join(word() for _ in range(30)) + ".") if i % 3 else (word() + "!! ") * 30, "s") for i in range(300)] + [(None, None, "s"), (5, "", "s"), (5, "a", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300, 2)], "doc_id long, quality int")
    scores = quality.quality_scores(docs, labels)
    kept = quality.keep_good(docs, labels, 0.5)
    assert kept.columns == docs.columns and kept.count() == scores.where("score >= 0.5").count()
    assert quality.keep_good(docs.limit(0), labels, 0.5).count() == 0


def brute_terms(texts):
    """Disclosing terms, counted text by text."""
    import re

    n = len(texts)
    held, entities = [], {}
    for t in texts:
        words = set(re.findall(r"[^\W\d_]+", re.sub(r"[a-z]+@[a-z]+\.org", " ", t or "").lower()))
        found = set(re.findall(r"[a-z]+@[a-z]+\.org", t or ""))
        found = {p for e in found for p in (e, f"{e.split('@')[0]}@", f"@{e.split('@')[1]}", "email")}
        held.append((t or "", words, found))
        for e in found:
            entities.setdefault(e, 0)
            entities[e] += 1
    n_t = {}
    for _, words, _ in held:
        for w in words:
            n_t[w] = n_t.get(w, 0) + 1
    out = set()
    for e, n_e in entities.items():
        share = n_e / n
        for w, count in n_t.items():
            n_te = sum(w in words and e in found for _, words, found in held)
            if not n_te or n_e == n or math.log(n_te / count / share) / math.log(1 / share) < pii.THRESHOLD:
                continue
            k = len({t for t, words, found in held if w in words and e in found})
            every = k + count - n_te
            if k / every <= share:
                continue
            rest = (every - k) * math.log((every - k) / every / (1 - share)) if every > k else 0.0
            chance = math.exp(-(k * math.log(k / every / share) + rest))
            if sum(c == count for c in n_t.values()) * chance <= pii.CHANCE:
                out.add(w)
    return out


def test_entities(spark):
    """Values, their shared parts and their kinds; none of a text without personal data."""
    texts = ["Ann@x.org, 10.1.2.3 and +49 30 1234567", "4111 1111 1111 1111", "none", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [sorted(r.e) for r in df.select(pii.entities_of(pii.base_spans(F.col("text"))).alias("e")).collect()]
    first = ["domain:x.org", "email", "email:ann@x.org", "ip", "ip:10.1.2.3", "name:ann", "network:10.1", "phone", "phone prefix:493012", "phone:+49 30 1234567"]
    assert got == [first, ["card", "card prefix:411111", "card:4111 1111 1111 1111"], [], []]


def test_terms_of_rare_entities(spark):
    """A name of the two texts of an entity discloses it in a small corpus too, where its pair is one of many."""
    rng = random.Random(2)
    texts = [" ".join("w" + "".join(rng.choice("abcdefghij") for _ in range(3)) for _ in range(6)) for _ in range(1500)]
    for i in range(0, 1500, 100):
        texts[i] += f" p{'abcdefghijklmno'[i // 100]}@mail.org"
    texts[100] += " zuname"
    texts[700] += " zuname pb@mail.org"
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert all("term" in spans[i] for i in (100, 700)) and sum("term" in s for s in spans.values()) < 20


def test_terms_against_brute_force(spark):
    rng = random.Random(12)
    word = lambda: "w" + "".join(rng.choice("abcdef") for _ in range(2))
    people = [("".join(rng.choice("ghijk") for _ in range(6)), f"{'abcdefgh'[i]}@mail.org") for i in range(8)]
    texts = []
    for i in range(260):
        words = [word() for _ in range(rng.randint(0, 25))]
        if i % 6 == 0:
            name, mail = people[rng.randrange(8)]
            words += [name, mail] if rng.random() < 0.9 else [name]
        rng.shuffle(words)
        texts.append(" ".join(words))
    texts += texts[:40] * 2 + [None, ""]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, base string, n_chars int").withColumn("h", F.lit(1)).withColumn("term", F.lit(2))
    got = set()
    for r in pii.report(df).collect():
        for s in filter(None, r.spans.split(",")):
            kind, a, b = s.split(":")
            if kind == "term":
                got.add(texts[r.doc_id][int(a) : int(b)])
    want = brute_terms(texts)
    assert got == want and want & {p for p, _ in people}
    clean = pii.sanitise(df)
    assert clean.columns == df.columns and clean.count() == len(texts)
    assert not any("@mail" in (r.text or "") or set((r.text or "").split()) & want for r in clean.collect())
    assert pii.sanitise(df.limit(0)).count() == 0


def test_shared_folder_must_be_named(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(ValueError):
        shared_dir(Session)
    assert shared_dir(spark)


def test_slices_meet_without_common_members():
    """Sets of any allowed difference share a top node whatever members count as common: few, most or all."""
    rng = np.random.default_rng(5)
    starts = np.array(jaccard_join.ranges(80, 100))
    for seed in (1, 3):
        for n in (5, 9, 25, 60, 200, 900):
            for share in (0.1, 0.5, 0.9, 1):
                both = rng.integers(0, 2**63, n).astype(np.uint64)
                cut = int(rng.integers(1, n // 5 + 1))
                a, b = np.unique(both[: n - cut]), np.unique(np.concatenate([both[: n - cut], rng.integers(0, 2**63, int(rng.integers(1, cut + 1))).astype(np.uint64)]))
                if 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
                    continue
                common = np.unique(np.concatenate([rng.choice(both, int(share * n), replace=False), rng.integers(0, 2**63, 50).astype(np.uint64)]))
                tops = []
                for s in (a, b):
                    i = int(np.searchsorted(starts, len(s), "right")) - 1
                    tops.append({x for j in (i, i - 1) if j >= 0 and jaccard_join.slicing(j, 80, 100)[0] > 1 for f in jaccard_join.slices(s, j, 80, 100, seed, common) for x in f.tolist()})
                assert tops[0] & tops[1]


@pytest.mark.parametrize("refined", [20, 10**6])
def test_a_common_line_makes_no_large_group(spark, monkeypatch, refined):
    """Pairs of near copies, all with one line: cut again they are small groups; where large groups are left as they are,
    the texts that pivots don't tie are taken in passes, which make a bounded number of copies each."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    line, rows = " ".join(word() for _ in range(18)), []
    for i in range(300):
        words = [word() for _ in range(rng.randint(52, 56))]
        rows += [(2 * i, f"{line}\n{' '.join(words)}"), (2 * i + 1, f"{line}\n{' '.join([*words[:-1], word()])}")]
    for name, value in (("REFINED_SETS", refined), ("COMMON_SETS", 30), ("CHUNK_SETS", 15)):
        monkeypatch.setattr(jaccard_join, name, value, raising=False)
    largest, copies, plain_groups, plain_written = [], [], jaccard_join.candidate_groups, jaccard_join.Workspace.written

    def groups(*args):
        found = plain_groups(*args)
        largest.append(found.groupBy("cc").count().agg(F.max("count")).first()[0])
        return found

    def written(self, df, name):
        copies.append(name)
        return plain_written(self, df, name)

    monkeypatch.setattr(jaccard_join, "candidate_groups", groups)
    monkeypatch.setattr(jaccard_join.Workspace, "written", written)
    got = {r.doc_id: r.component_id for r in jaccard_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i, _ in rows}
    if refined == 20:
        assert largest[0] <= 20
    else:
        assert largest[0] > 60 and copies.count("links-of-rest") > 1


def test_pipeline_leaves_no_copies_of_texts(spark, tmp_path, monkeypatch):
    """What the quality filter leaves in the shared folder are the rows that go; of the stages' tables only the last stays."""
    import corpus_pipeline

    from logoscope.llm import shared

    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}")
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, sf_dir)
    assert kept.count() > 0.5 * docs.count()
    left = sum(p.stat().st_size for p in tmp_path.rglob("part-*"))
    assert 0 < left < 0.1 * docs.agg(F.sum(F.length("text"))).first()[0]
    assert corpus_pipeline.run(spark, sf_dir).count()
    assert [p.name.rpartition("-")[0] for p in (tmp_path / "logoscope").glob("stage-*")] == ["stage-pii"]


def test_quality_filter_takes_out_rows_by_shuffle(spark, monkeypatch):
    """Rows of a null or repeated id go or stay by their own text, whichever way they are taken out."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    good, bad = (lambda: " ".join(word() for _ in range(30)) + "."), (lambda: (word() + "!! ") * 30)
    rows = [(i, good() if i % 3 else bad()) for i in range(300)]
    odd = [(None, good()), (None, bad()), (7, good()), (7, bad()), (None, None), (8, None), (8, "")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300, 2)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows + odd + odd[:2], "doc_id long, text string")
    few = sorted(map(str, quality.keep_good(docs, labels, 0.5).collect()))
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    assert sorted(map(str, quality.keep_good(docs, labels, 0.5).collect())) == few
    assert len(few) == quality.quality_scores(docs, labels).where("score >= 0.5").count()
    for row, stays in zip(odd[:4], (2, 0, 1, 0), strict=True):
        assert few.count(f"Row(doc_id={row[0]}, text={row[1]!r})") == stays
