"""Fill-in-the-middle, importance resampling and exact search against plain versions, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logoscope.llm import fill_middle, impact_index, resampling

ODD = [None, "", "\n", "\n\n", "a", "a\n", "a\n\nb", "<P>", "x\n<S", "<M>y\n", "P>\n<", "é\n漢字\n😀", "a\r\nb", "<\n<P\n>", "\x00\n\x00"]


def split(seed, ident, text, fim, spm):
    """(n, form, prefix_chars, middle_chars, output) as one text by itself."""
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    hexed = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    h = [int(hexed[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return n, "plain", None, None, t
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("fim,spm", [(100, 50), (60, 0), (100, 100), (0, 50)])
def test_fill_middle(spark, monkeypatch, fim, spm):
    monkeypatch.setattr(fill_middle, "RUN_CHARS", 40)
    rng = random.Random(fim + spm)
    texts = ODD + ["".join(rng.choice(["ab", "<", "P>", "\n", " ", "ß"]) for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["long\n" * 5000]
    rows = [(i if i % 9 else None, t, "n", 1) for i, t in enumerate(texts)] + [(3, "a\nb\nc", "n", 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, h1 string, n int")
    made = fill_middle.transform(df, "7", fim, spm)
    got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    shown = sorted(repr(tuple(r)[1:6]) + str(r.doc_id) for r in got)
    assert shown == sorted(repr(split("7", i, t, fim, spm)) + str(i) for i, t, _, _ in rows)
    assert sorted(r.back for r in got) == sorted(t or "" for _, t, _, _ in rows)
    assert fill_middle.transform(df.limit(0)).count() == 0


def test_marks_must_be_told_apart():
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<<", "a", "b"), ("ab", "ba", "c")):
        with pytest.raises(ValueError):
            fill_middle.Marks(*bad)
    fill_middle.Marks("⟨p", "⟨s", "⟨m")


def features(text, buckets):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled(rows, target, buckets, least, percent, seed="42"):
    found = [(i, *features(t, buckets)) for i, t in rows]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in features(x, buckets)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(buckets)]
    out, drawable = [], []
    for i, n, f in found:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
        if n >= least:
            drawable.append(out[-1])
    drawable.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(drawable[: percent * len(drawable) // 100]):
        r[4] = k + 1
    return sorted(map(repr, out))


@pytest.mark.parametrize("buckets,long_text", [(97, 1 << 24), (10_000, 0), (70_000, 1 << 24)])
def test_resampling(spark, monkeypatch, buckets, long_text):
    monkeypatch.setattr(resampling, "LONG_TEXT", long_text)
    rng = random.Random(buckets)
    word = lambda: "".join(rng.choice(["a", "B", "é", "9", "ÀÉ", "漢"]) for _ in range(rng.randint(1, 3)))
    text = lambda n: "".join(word() + rng.choice([" ", "\n", ", ", "--", "\x00", "\x7f", "'"]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 12))) for i in range(200)] + [(300, None), (301, ""), (302, " .\n"), (None, text(9)), (7, text(9)), (303, text(3000)), (304, "one"), (305, "one two")]
    rows += [(9, rows[9][1])] * 40
    target = [text(30), None, ""]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, row string, held string").repartition(5)
    got = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), "42", 3, buckets, 5, 30)
    assert sorted(repr(list(r)) for r in got.collect()) == resampled(rows, target, buckets, 5, 30)
    assert resampling.resample(docs.limit(0), docs.select("text")).count() == 0
    none = resampling.resample(docs, docs.select("text").limit(0), "42", 3, buckets, 5, 30)
    assert sorted(repr(list(r)) for r in none.collect()) == resampled(rows, [], buckets, 5, 30)


def best(rows, asks, k):
    """Results of every query row (id, vector), vectors as whole numbers."""
    ok = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and ok(v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in whole if asks(i)}:
        scores = [(-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in whole if j != i and len(v) == len(q)]
        out += [(i, n + 1, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard,segments,kind", [(64, 4, "random"), (200, 32, "near"), (4096, 1, "copies")])
def test_exact_search(spark, monkeypatch, shard, segments, kind):
    for name, value in (("SHARD_ROWS", shard), ("LEAST_SHARD_ROWS", 50), ("SEGMENTS", segments), ("SAMPLE_ROWS", 20), ("BLOCK_COMPONENTS", 100)):
        monkeypatch.setattr(impact_index, name, value)
    rng = np.random.default_rng(len(kind))
    x = rng.normal(size=(700, 8))
    if kind == "near":
        x[100:] = x[rng.integers(0, 100, 600)] + rng.normal(scale=0.05, size=(600, 8))
    if kind == "copies":
        x[200:] = x[0]
        x[100:120] = 0
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000, None), (1001, []), (1002, [None] + [1.0] * 7), (1003, [float("nan")] * 8), (1004, [float("inf")] * 8), (None, [1.0] * 8), (1050, [1.0, 2.0]), (1005, [2.0, -1.0]), (1006, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, id int, v int")
    got = impact_index.top_k(df, F.col("vec_id") % 50 == 0, 10)
    assert sorted(map(tuple, got.collect())) == best(rows, lambda i: i % 50 == 0, 10)
    assert impact_index.top_k(df.limit(0), F.lit(True)).count() == 0 and impact_index.top_k(df, F.lit(None).cast("boolean")).count() == 0


def test_search_of_repeated_ids_and_huge_components(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [3.0, -1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [-1.0, 5.0]), (5, [1e12, 1.0]), (6, [1e12, 1e12])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, impact_index.top_k(df, F.col("vec_id") != 3, 4).collect()))
    assert got == best(rows, lambda i: i != 3, 4)


def test_traversal_stops_on_proof():
    """Near vectors are found after part of the postings is read, and what it reads decides nothing."""
    rng = np.random.default_rng(1)
    v = np.floor(1024 * rng.normal(size=(2000, 16))).astype(np.int64)
    v[1000:1030] = v[3] + rng.integers(-9, 9, (30, 16))
    shard = impact_index.Shard(impact_index.shard_row(np.arange(2000), v))
    shares = []
    for i in range(40):
        score, ids, read = shard.search(v[i], i, 10, -(1 << 63))
        every = v @ v[i]
        order = [j for j in np.lexsort((np.arange(2000), -every)) if j != i][:10]
        assert ids.tolist() == order and score.tolist() == every[order].tolist()
        shares.append(read / v.size)
    assert shares[3] < 0.6 and np.mean(shares) < 0.8
