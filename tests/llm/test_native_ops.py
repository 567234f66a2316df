"""Exact dedup, sharding and personal data against brute force, and the odd cases that they define."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from logoscope.llm import exact_dedup, kd_shards, pii

WHITE = re.compile(r"[\x20\x09-\x0D]")
TEXTS = [None, "", " \t\x0b\f\r\n", "a b", "ab", "a  b ", "é", "é", "ab" * 5000, "a b", "x", None, "A B", "ab "]


def documents(spark, texts, extra=True):
    rows = [(i, t, ["en", None, "de"][i % 3], f"s{i % 2}", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(1) for c in ("id", "h", "norm", "salt", "size", "leaf", "shard_", "base")}) if extra else df


def brute_groups(texts):
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(WHITE.sub("", t or ""), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), i == min(g)[1], hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, i in g}


@pytest.mark.parametrize("texts", [[], TEXTS, TEXTS + ["hot text"] * 200 + ["hot  text"] * 150 + ["hot text "] * 3])
def test_exact_groups(spark, texts):
    got = {r[0]: tuple(r[1:]) for r in exact_dedup.exact_groups(documents(spark, texts)).collect()}
    assert got == brute_groups(texts)


def test_drop_copies(spark):
    df = documents(spark, TEXTS)
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, g in brute_groups(TEXTS).items() if g[2]}


def test_kd_shards(spark):
    rng = random.Random(1)
    texts = ["w" * rng.randint(0, 400) + str(rng.randint(0, 300)) for _ in range(1500)] + ["copy"] * 20 + [None, "", ""]
    rows = kd_shards.kd_shards(documents(spark, texts), shards=8).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    sums, slots, of_text = {}, {}, {}
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").encode()) + 1
        sums[r.shard] = sums.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        of_text.setdefault(texts[r.doc_id] or "", set()).add(r.shard)
    assert set(sums) == set(range(8)) and max(sums.values()) < 1.06 * min(sums.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())


def test_kd_shards_edges(spark):
    assert kd_shards.kd_shards(documents(spark, [])).count() == 0
    one = kd_shards.kd_shards(documents(spark, ["same"] * 40), shards=4).collect()
    assert sorted(r.doc_id for r in one) == list(range(40)) and len({r.shard for r in one}) == 1
    assert len({r.shard for r in kd_shards.kd_shards(documents(spark, ["abc" * 9, "d"]), target_bytes=10**6).collect()}) == 1


def luhn(s):
    return sum((d := int(c) * (1 + i % 2)) - 9 * (d > 9) for i, c in enumerate(reversed(s))) % 10 == 0


def brute_spans(t):
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    found = []
    for k, (kind, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }
            if fine[kind]():
                found.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def test_spans(spark):
    rng = random.Random(8)
    parts = ["a@b.c", "x_d@e.f", "@", ".", "1.2.3.4", "255.256.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (386) 555-3733", "+", "é", "😀", " ", "-", "7", "0007.1.1.255", "\n", "word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)] + [None, "", "a" * 50_000 + "@", "9" * 30_000, "1 " * 20_000]
    got = {r.doc_id: r for r in pii.report(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = brute_spans(t or "")
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("term")] == want, t
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s.startswith(k) for s in want) for k in ("email", "ip", "card", "phone")]


def test_disclosing_terms_and_sanitise(spark):
    told = [f"note {w} said zebulon writes from jane.doe@mail.org often" for w in ("one", "two", "three", "four")]
    clean = [f"the weather is fine said nobody writes number{i} often from the note" for i in range(60)]
    df = documents(spark, told + clean + [None, ""], extra=False)
    spans = {r.doc_id: r.spans for r in pii.report(df).collect()}
    at = told[0].index("zebulon")
    assert f"term:{at}:{at + 7}" in spans[0].split(",") and "term" not in spans[10]
    assert not any(s.startswith(f"term:{told[0].index('writes')}:") for s in spans[0].split(","))
    out = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert len(out) == df.count() and out[0].text == "note one said [TERM] writes from [EMAIL] often"
    assert out[0].n_chars == len(out[0].text) and out[20].text == clean[16] and out[64].text is None
    assert pii.report(documents(spark, [])).count() == 0


def test_terms_of_rare_entities_in_whole_texts(spark):
    """A term far from its entity, of entities of two documents and of one, is marked in documents without the entity too."""
    filler = "the weather is fine and nobody was there " * 6
    told = [f"zebulon {filler}jane.doe@mail.org", f"{filler}jane.doe@mail.org {filler} Zebulon", f"quu {filler}4111 1111 1111 1111"]
    clean = [filler + "Zebulon" if i == 7 else filler for i in range(120)]
    df = documents(spark, told + clean + [None], extra=False)
    spans = {r.doc_id: r.spans.split(",") for r in pii.report(df).collect()}
    assert spans[0][0] == "term:0:7" and spans[1][-1].startswith("term:") and spans[2][0] == "term:0:3"
    assert spans[10] == [f"term:{len(filler)}:{len(filler) + 7}"] and spans[11] == [""]
    out = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert out[10].text == filler + "[TERM]" and out[10].n_chars == len(out[10].text) and out[11].n_chars == 11
    assert out[0].text == f"[TERM] {filler}[EMAIL]" and out[11].text == filler and out[123].text is None
