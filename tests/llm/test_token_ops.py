"""Token tables and BPE against the libraries, and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logoscope.llm import bpe, sstable, token_shards
from logoscope.llm.pieces import PATTERN, boundaries, pieces
from logoscope.llm.shared import new_path

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORDS = [a + b + c for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
TEXTS = ["It's the 1st\n\n 'll  \té²", None, "", "漢字 かな", "x" * 3000 + " " * 500 + "ab" * 2000, "It's the 1st\n\n 'll  \té²", "<|endoftext|> a"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aé1²٣ \n\t' stmdrevl!?_-漢ʼ ")))
def test_pieces(text):
    import regex

    assert pieces(text) == regex.findall(PATTERN, text)


def test_pattern_is_the_public_one():
    assert PATTERN == public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_merges_equal_the_library(text):
    import tiktoken

    coder = bpe.codec(RANKS)
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    assert coder.encode(text) == own.encode_ordinary(text)
    assert coder.decode(coder.encode(text)).decode() == text


def test_one_piece_alone_and_in_batches(library):
    coder = bpe.codec(RANKS)
    rng = random.Random(3)
    some = ["".join(rng.choice("abcdeghinorst") for _ in range(rng.randint(2, 31))) for _ in range(500)]
    for w in some:
        assert bpe.merge(w.encode(), coder.ranks) == tuple(library.encode_ordinary(w))
    assert [tuple(x) for x in coder.in_turn(some, chars=50)] == [tuple(library.encode_ordinary(w)) for w in some]


def frame(spark, texts):
    return spark.createDataFrame([(i * 3 - 5, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")


def test_round_trip(spark, library):
    got = {r[0]: tuple(r[1:]) for r in bpe.round_trip(frame(spark, TEXTS), RANKS).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert got[i * 3 - 5] == want
    assert bpe.round_trip(frame(spark, []), RANKS).count() == 0
    assert {r.doc_id: r.ids for r in bpe.encode_column(frame(spark, TEXTS), RANKS).collect()}[-5] == library.encode_ordinary(TEXTS[0])


def test_token_tables(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    library.encode_special_tokens = True
    docs = frame(spark, TEXTS * 30)
    out = new_path(spark, "token-tables")
    manifest = token_shards.write_tables(docs, TOKENIZER, out, end_id=2)
    got = {r.doc_id: r for r in token_shards.read_tables(spark, out, manifest).collect()}
    at = 0
    for i, t in enumerate(TEXTS * 30):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        r = got[i * 3 - 5]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    found = {r.id: r.ids for r in token_shards.lookup(spark, out, manifest, [-5, 1, 2, 10**9]).collect()}
    assert set(found) == {-5, 1} and found[1] == [2]
    assert token_shards.round_trip(frame(spark, []), TOKENIZER, 2).count() == 0


def test_rolled_files_null_and_repeated_ids(spark):
    rng = random.Random(8)
    rows = [(i // 3 if i >= 20 else None, "w%d " % i * rng.randint(0, 40), "x", i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string, base long")
    out = new_path(spark, "token-tables")
    manifest = token_shards.write_tables(docs, TOKENIZER, out, 2, files=2, file_bytes=600)
    files = manifest.orderBy("base").collect()
    assert len(files) > 20 and sum(r.entries for r in files) == len(rows)
    assert [r.base for r in files] == [sum(f.tokens for f in files[:i]) for i in range(len(files))]
    got = sorted(token_shards.read_tables(spark, out, manifest).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    counts = token_shards.token_counts(docs, TOKENIZER, 2).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted((r.doc_id or -1, r.n_tokens) for r in counts)
    assert {r.id for r in token_shards.lookup(spark, out, manifest, [None, 7, 55, 99, 10**9]).collect()} == {None, 7, 55, 99}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aé1²٣ \n\t\r' stmdrevl!?_-漢ʼ\u3000\u00a0<|>"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_pieces_encode_as_whole_texts(text):
    coder = token_shards.encoder(TOKENIZER)
    assert coder.by_piece
    whole = coder.library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(coder.encode_many([text])[0], coder.type).tolist() == whole


def test_table_format():
    import io

    rng = random.Random(2)
    rows = sorted({rng.randint(-(2**62), 2**62) for _ in range(3000)} | set(range(500)))
    stream = io.BytesIO()
    writer = sstable.Writer(stream, 2)
    for i in [None, *rows]:
        writer.add(sstable.to_key(i), np.arange((i or 0) % 40, dtype="<u2").tobytes())
    writer.close()
    data, reads = stream.getvalue(), []
    table = sstable.Reader(lambda at, n: reads.append(n) or data[at : at + n], len(data))
    assert table.get(rows[5]) is not None and len(reads) == 4  # footer, index, filter and one block
    assert [i for i, _ in table] == [None, *rows]
    assert all(len(table.get(i)) == i % 40 for i in rows[::7]) and table.get(501) is None and len(table.get(None)) == 0
    assert len(table.last_keys) > 1


def test_caches_are_bounded(monkeypatch):
    """Pieces of any length are encoded, but only short ones stay, in two generations of a bounded number."""
    import public_tokenizers

    from logoscope.llm import bpe, token_shards

    texts = [" ".join(f"w{i}x{j}" for i in range(300)) + "y" * 500 for j in range(6)]
    coders = [token_shards.Encoder(public_tokenizers.path("byte_bpe_50k.json")), bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))]
    for coder in coders:
        want = [coder.encode_many([t])[0] for t in texts]
        coder.cache.limit = 50
        for _ in range(2):
            assert [coder.encode_many([t])[0] for t in texts] == want
        assert max(map(len, coder.cache.keys() | coder.cache.old.keys())) <= bpe.KEPT_CHARS
        assert len(coder.cache) + len(coder.cache.old) < 3000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aé1²٣ \n\t' stmdrevl!?_-漢ʼ😀\0"), max_size=40), max_size=8))
def test_texts_are_cut_and_encoded_together(texts):
    """Many texts are cut at once, as if each were alone; counts need no ids."""
    at = np.cumsum([0, *map(len, texts)])
    alone = [a + s for a, t in zip(at.tolist(), texts, strict=False) for s in boundaries(t)[:-1].tolist()]
    assert boundaries("".join(texts), at).tolist() == [*alone, at[-1]]
    coder = token_shards.encoder(TOKENIZER)
    want = [e.ids for e in coder.library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, coder.type).tolist() for x in coder.encode_many(texts)] == want
    assert coder.counts(texts) == list(map(len, want))


def test_matches_are_asked_once(monkeypatch):
    """Words that come again are not asked for again, also beyond the 120,000 that a dictionary had room for, through growth
    of the table, two generations, and keys that agree but for length, zero bytes or what follows 15 bytes."""
    coder = token_shards.Encoder(TOKENIZER)
    asked, library = [], coder._library
    monkeypatch.setattr(coder, "_library", lambda texts: asked.extend(texts) or library(texts))
    texts = [" ".join(f"{a}{b}{c}" for b in "bcdfghjklmnp" for c in WORDS) for a in WORDS[:150]]
    texts += ["a\0 a a\0\0", "é" * 7 + "!" + "é" * 8, "x" * 15 + " " + "x" * 15 + "y " + "x" * 64 + " " + "x" * 90, " \n\n  \t\r\n"]
    for t in texts:
        coder.encode_many([t])
    assert len(coder.cache) > 150_000
    asked.clear()
    want = [coder.library.encode(t, add_special_tokens=False).ids for t in texts[::29] + texts[-4:]]
    assert [np.frombuffer(coder.encode_many([t])[0], coder.type).tolist() for t in texts[::29] + texts[-4:]] == want
    assert asked == [" " + "x" * 64 + "\n " + "x" * 90]  # only those too long to stay
    coder.cache.limit = 1000
    assert [np.frombuffer(coder.encode_many([t])[0], coder.type).tolist() for t in texts[::29] + texts[-4:]] == want


def test_counts_make_no_ids(monkeypatch):
    """Packing needs the number of ids of each text only: no list of ids is put together."""
    coder = token_shards.Encoder(TOKENIZER)
    texts = [t or "" for t in TEXTS] * 3
    want = [len(coder.library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert coder.encode_many([]) == []
    monkeypatch.setattr(token_shards, "spread", None)
    assert coder.counts(texts) == want and coder.counts([]) == []
