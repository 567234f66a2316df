"""Near-duplicate operators, classifiers, packing and the pipeline against brute force and held-out rows."""

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logoscope.llm import jaccard_join, language_id, multi_index, packing, quality, signature_tree, token_shards
from logoscope.llm.components import components


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 230)] + [(5, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(300, links)
    assert got == {x: want[x] for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_sets(texts, k):
    out = []
    for t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").replace("\x0b", " ").replace("\x0c", " ")
        w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def variants(rng, count, words=60):
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(150)]
    texts = []
    for _ in range(count):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, words))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "  ", "\n"]).join(t))
    return texts


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_near_groups(spark, k, num, den, monkeypatch):
    rng = random.Random(11)
    base = ["w%d" % i for i in range(200)]
    family = []
    for i in range(60):  # a chain of small changes, which ties far ends together
        family.append(" ".join(base))
        base[rng.randrange(200)] = f"x{i}"
    texts = variants(rng, 90) + family + [None, "", " \n", "one", "ONE", "two words", "É a b c d e", "é a b c d e", "z " * 3000]
    monkeypatch.setattr(jaccard_join, "CHUNK_SETS", 25)  # large groups are cut
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("rep", F.lit("x")).withColumn("n", F.lit(0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_groups(df, k, (num, den)).collect()}
    sets = shingle_sets(texts, k)
    links = [
        (i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
        and den * (c := len(sets[i] & sets[j])) >= num * (len(sets[i]) + len(sets[j]) - c)
    ]
    want = roots(len(texts), links)
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}
    assert jaccard_join.near_groups(df.limit(0), k, (num, den)).count() == 0


def test_forest():
    rng = np.random.default_rng(2)
    for _ in range(20):
        base = [rng.integers(0, 2**63, rng.integers(1, 80)).astype(np.uint64) for _ in range(6)]
        sets = []
        for _ in range(60):
            s = base[rng.integers(6)].copy()
            s = np.unique(np.concatenate([s[rng.random(len(s)) < 0.95], rng.integers(0, 2**63, rng.integers(0, 4)).astype(np.uint64)]))
            sets.append(s if len(s) else np.array([7], np.uint64))
        links = [(i, j) for i in range(60) for j in range(i) if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - c)]
        want = roots(60, links)
        got = signature_tree.forest(sets, 80, 100)
        assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(60) for j in range(60))


def test_multi_index(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16))
    x[300:420] = x[rng.integers(0, 60, 120)] + rng.normal(scale=0.05, size=(120, 16))
    x[420:440] = x[0]
    x[440:520] = x[1] + rng.normal(scale=0.05, size=(80, 16))
    vectors = [list(map(float, v)) for v in x]
    odd = [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0]]
    monkeypatch.setattr(multi_index, "BLOCK", 40)
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors + odd)], "vec_id long, embedding array<double>, rep int")
    got = {r.vec_id: tuple(r[1:]) for r in multi_index.near_duplicates(df, 0.95).collect()}
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(i, j) for i, j in zip(*np.nonzero(y @ y.T >= 0.95), strict=True) if i > j]
    count = np.bincount(np.array(pairs).ravel(), minlength=600)
    found = np.array([got[i][0] for i in range(600)])
    assert (found <= count).all() and found.sum() >= 0.9 * count.sum()
    want = roots(600, pairs)
    assert sum(got[i][1] == want[i] for i in range(600)) >= 590
    assert [got[600 + i] for i in range(5)] == [(0, 600 + i, True) for i in range(5)]
    assert got[605] == (1, 605, True) and got[606] == (1, 605, False)
    assert multi_index.near_duplicates(df.limit(0)).count() == 0


def test_multi_index_depth(spark, monkeypatch):
    """Links farther down the traversal than 4 K cells are met, and few links that the first queries do not have."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1000, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, i, list(map(float, v))) for i, v in enumerate(x)], "rep long, least long, e array<double>")
    grid = multi_index.Grid(multi_index.k_means(x[:, :6], 8), multi_index.k_means(x[:, 6:], 8))
    homes = grid.visits(x, 1)[:, 0]

    def met(threshold, most=400):
        seen = grid.visits(x, multi_index.depth(df, grid, 1000, threshold, most))
        pairs = [(i, j) for i, j in zip(*np.nonzero(x @ x.T >= threshold), strict=True) if i > j]
        return np.mean([homes[i] in seen[j] or homes[j] in seen[i] for i, j in pairs])

    assert met(0.0) >= 0.98
    monkeypatch.setattr(multi_index, "LEAST_VISITS", 1)
    # few queries have a link: they are moved by the threshold's angle
    assert met(0.86, 25) >= 0.9 and met(0.86) >= 0.95
    # a table without links: one pass of the queries, and a depth for what a link would need
    asked = []
    ranks = multi_index.link_ranks
    monkeypatch.setattr(multi_index, "link_ranks", lambda *a: asked.append(len(a[3])) or ranks(*a))
    assert 1 < multi_index.depth(df, grid, 1000, 0.97) < 64 and asked == [50]
    every = grid.visits(x[:50], 64)
    for cell in (0, 9, 63):
        assert (every[np.arange(50), grid.ranks(x[:50], np.full(50, cell))] == cell).all()


@pytest.mark.parametrize("block", [4096, 60])
def test_multi_index_dimensions(spark, monkeypatch, block):
    """Near links in every dimension, each by an index of its own, however few its vectors."""
    rng = np.random.default_rng(6)
    tables = [rng.normal(size=(n, d)) for n, d in ((200, 16), (150, 10), (20, 3))]
    for x in tables:
        half = len(x) // 2
        x[half:] = x[:half] + rng.normal(scale=0.01, size=(half, x.shape[1]))
    monkeypatch.setattr(multi_index, "BLOCK", block)
    rows = [list(map(float, v)) for x in tables for v in x]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in multi_index.near_duplicates(df, 0.95).collect()}
    first = 0
    for x in tables:
        y = x / np.linalg.norm(x, axis=1, keepdims=True)
        want = (y @ y.T >= 0.95).sum(1) - 1
        found = np.array([got[first + i] for i in range(len(x))])
        assert (found <= want).all() and found.sum() >= 0.98 * want.sum() and want.sum() >= len(x)
        first += len(x)


def test_multi_index_repeated_ids(spark):
    """Rows of an id are one node, whatever their vectors; null ids are linked with nothing."""
    a, c, d = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 1.0, 0.05, 0.0]
    rows = [(1, a), (2, a), (2, c), (3, d), (None, d), (9, [0.0, 0.0, 1.0, 0.0]), (9, [0.0, 0.0, 1.0, 0.0]), (7, [1.0]), (8, [1.0, 2.0, 3.0])]
    got = sorted(map(str, map(tuple, multi_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())))
    want = [(1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (3, 1, 1, False), (None, 0, None, True), (9, 1, 9, True), (9, 1, 9, True), (7, 0, 7, True), (8, 0, 8, True)]
    assert got == sorted(map(str, want))


def test_multi_index_of_a_small_table(spark, monkeypatch):
    """Below 4,096 vectors as above: through cells, of which a vector visits few."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 24))
    x[1500:] = x[:1500] + rng.normal(scale=0.04, size=(1500, 24))
    visited = []
    monkeypatch.setattr(multi_index, "placer", lambda grid, count, offset, make=multi_index.placer: visited.append((grid.k**2, count)) or make(grid, count, offset))
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in multi_index.near_duplicates(df, 0.95).collect()}
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (y @ y.T >= 0.95).sum(1) - 1
    found = np.array([got[i] for i in range(3000)])
    assert (found <= want).all() and found.sum() >= 0.97 * want.sum() > 2000
    (cells, count), = visited
    assert count < cells / 3


def test_language(spark):
    rng = random.Random(1)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ei"], "cc": ["eux", "ion", "le"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, text(lang := rng.choice(list(syllables)), rng.randint(3, 40)), lang) for i in range(300)]
    odd = [(900, None, "aa"), (901, "", None), (902, "12 -- !", "bb"), (903, text("cc", 20_000), None), (904, text("aa", 5), None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("w", F.lit(1))
    got = {r.doc_id: r for r in language_id.identify(df, df.where("doc_id % 3 > 0")).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    assert sum(got[i].lang_pred == lang for i, _, lang in held) >= 0.97 * len(held)
    assert [got[i].lang_pred for i in (900, 901, 902, 903, 904)] == ["und"] * 3 + ["cc", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.identify(df, df.limit(0)).collect()} == {"und"}
    assert language_id.identify(df.limit(0), df).count() == 0


def test_language_sample_is_bounded_over_all_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 20)
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 60)
    texts = [(None if i % 3 else i, f"{chr(97 + k)}{chr(98 + k)} words {i}", f"l{k:02d}") for k in range(24) for i in range(k + 10)]
    drawn = language_id.sample(spark.createDataFrame(texts, "id long, text string, lang string")).collect()
    assert len(drawn) < 150 and {r.lang for r in drawn} <= {f"l{k:02d}" for k in range(4, 24)}
    assert len(drawn) > 10  # rows without an id are drawn one by one, not all or none


def test_quality(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    good = lambda: " ".join(word() for _ in range(rng.randint(5, 80))).capitalize() + "."
    bad = [lambda: " ".join(word().upper() + "!!" for _ in range(30)), lambda: (word() + " ") * 40, lambda: " ".join(word() + "###" for _ in range(30))]
    rows = [(i, good() if i % 4 else rng.choice(bad)(), int(i % 4 > 0)) for i in range(800)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, ""), (901, "", ""), (902, "a " * 60_000, "")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 5] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    held = [r for r in rows if r[0] % 5 == 0]
    assert sum((got[i] >= 0.7) == bool(q) for i, _, q in held) >= 0.97 * len(held)
    assert len(got) == 803 and all(0 <= s <= 1 for s in got.values())
    assert {r.score for r in quality.quality_scores(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_isotonic():
    at, rate = quality.isotonic(np.arange(5), np.array([0, 3, 1, 4, 5]), np.array([4.0, 4, 4, 5, 5]))
    assert rate.tolist() == [0, 0.5, 0.5, 0.8, 1.0]


def test_packing(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([None, 0, 1, 100, 2048, rng.randint(1, 3000), rng.randint(1, 60_000)])) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, n long").withColumn("piece", F.lit("x")).withColumn("g", F.lit(1))
    got = packing.pack(df, F.col("n")).collect()
    pieces, bins = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.n_tokens))
        bins.setdefault(r.bin_id, []).append((r.bin_start, r.n_tokens, r.capacity))
    top = max(packing.CAPACITIES)
    for i, n in rows:
        want = [(p, min(top, n - p * top)) for p in range(-(-n // top))] if n else []
        assert sorted(pieces.get(i, [])) == want
    for items in bins.values():
        items.sort()
        used = sum(n for _, n, _ in items)
        assert [s for s, _, _ in items] == [sum(n for _, n, _ in items[:j]) for j in range(len(items))]
        assert {c for _, _, c in items} == {next(c for c in packing.CAPACITIES if c >= used)}
    assert sum(n or 0 for _, n in rows) > 0.95 * sum(x[0][2] for x in bins.values())
    assert packing.pack(df.limit(0), F.col("n")).count() == 0


def plain_best_fit(lengths):
    """Best fit item by item, every open bin looked at."""
    order, bins, rest = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)), [], sum(lengths)
    for i in order:
        n = lengths[i]
        fits = [b for b in bins if b[0] - sum(lengths[j] for j in b[1]) >= n]
        if fits:
            best = min(fits, key=lambda b: (b[0] - sum(lengths[j] for j in b[1]), bins.index(b)))
        else:
            sizes = [c for c in packing.CAPACITIES if c >= n]
            best = (min(sizes, key=lambda c: packing.cost(c) / min(c, rest)), [])
            bins.append(best)
        best[1].append(i)
        rest -= n
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 16384), st.integers(1, 300), st.sampled_from([1, 2047, 2048, 8192, 16384])), max_size=60))
def test_best_fit_against_plain(lengths):
    placed, capacity = packing.best_fit(lengths)
    want = plain_best_fit(lengths)
    assert [sorted(i for i, b in enumerate(placed) if b == k) for k in range(len(capacity))] == [sorted(items) for _, items in want]
    assert capacity == [min(c for c in packing.CAPACITIES if c >= sum(lengths[i] for i in items)) for _, items in want]


def test_packing_of_token_counts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(31)
    rows = [(i, rng.choice([None, "", " ".join(rng.choice("red mango sky 汉字 it's".split()) for _ in range(rng.randint(1, 9000)))]), "x") for i in range(60)]
    rows += [rows[3], (None, "a b", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = packing.pack(token_shards.token_counts(docs, path, 2), F.col("n_tokens")).collect()
    top, pieces = max(packing.CAPACITIES), []
    for i, text, _ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids) + 1
        pieces += [(-1 if i is None else i, p, min(top, n - p * top)) for p in range(-(-n // top))]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.n_tokens) for r in got) == sorted(pieces)
    lengths = [n for _, _, n in pieces]
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r.n_tokens)
    assert sorted(sorted(x) for x in bins.values()) == sorted(sorted(lengths[i] for i in items) for _, items in plain_best_fit(lengths))


def test_pipeline(spark):
    import corpus_pipeline as P

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    rows = docs
    for name, stage in P.STAGES[:-1]:
        rows = stage(spark, rows, sf_dir)
        assert rows.columns == docs.columns
        rows = spark.createDataFrame(rows.toPandas(), docs.schema)
        kept[name] = {r.doc_id: r.text for r in rows.collect()}
    bad = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 0").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    assert not bad & set(kept["quality"]) and len(good - set(kept["quality"])) <= 0.02 * len(good)
    groups = {}
    for i, t in kept["quality"].items():
        groups.setdefault(t.translate(str.maketrans("", "", " \t\n\x0b\f\r")), []).append((-len(t), i))
    assert set(kept["exact_dedup"]) == {min(g)[1] for g in groups.values()}
    exact = sorted(kept["exact_dedup"])
    sets = shingle_sets([kept["exact_dedup"][i] for i in exact], 5)
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * (c := len(sets[i] & sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - c)]
    near = sorted(kept["near_dedup"])
    assert near == [exact[i] for i, r in enumerate(roots(len(sets), linked)) if i == r]
    assert set(kept["pii"]) == set(near) and not any("@mail" in t for t in kept["pii"].values())
    packed = P.STAGES[-1][1](spark, rows, sf_dir)
    coder = token_shards.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(coder.library.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept["pii"].items()}
    assert {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()} == want


def test_pipeline_odd_rows(spark, tmp_path):
    import corpus_pipeline as P

    base = "/root/testdata/sf0.001"
    spark.read.parquet(f"{base}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{base}/documents.parquet").limit(40)
    first = docs.orderBy("doc_id").limit(1)
    odd = first.withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat("text", F.lit(" and a last word of its own")))
    blank = first.withColumn("doc_id", F.lit(10**6).cast("long")).withColumn("text", F.lit(None).cast("string"))
    empty = first.withColumn("doc_id", F.lit(10**6 + 1).cast("long")).withColumn("text", F.lit(" "))
    long = first.withColumn("doc_id", F.lit(10**6 + 2).cast("long")).withColumn("text", F.repeat(F.col("text"), 400))
    rows = docs.union(first).union(odd).union(odd).union(blank).union(empty).union(long)
    for name in ("n_tokens", "h", "term", "id", "piece", "score", "keep_id", "component", "rep", "s"):
        rows = rows.withColumn(name, F.lit("x"))
    for table, at in ((rows, tmp_path / "odd"), (rows.limit(0), tmp_path / "none")):
        table.write.parquet(f"{at}/documents.parquet")
        spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0
    kept = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        before, kept = kept, spark.createDataFrame(stage(spark, kept, f"{tmp_path}/odd").toArrow(), rows.schema)
        assert kept.columns == rows.columns and not kept.select("doc_id").subtract(before.select("doc_id")).count()
    packed = {r.doc_id for r in P.STAGES[-1][1](spark, kept, f"{tmp_path}/odd").collect()}
    assert packed and packed == {r.doc_id for r in kept.select("doc_id").collect()}
