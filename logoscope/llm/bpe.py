"""Byte-level BPE over a table of ranks: each merge is found in a segment tree over byte positions.

Pieces of up to BATCHED bytes are merged many at once, one segment tree a row of a numpy array; longer ones alone.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logoscope.llm.pieces import pieces

#: Matches remembered by a worker, in each of two generations, and characters of one that is: both bound its memory whatever the
#: corpus, to some 200 bytes a match of common words and at most about 1 KB.
REMEMBERED, KEPT_CHARS = 120_000, 64


class Remembered(dict):
    """Piece to result; of at most two generations, so that frequent pieces outlive rare ones."""

    def __init__(self, compute, limit=REMEMBERED):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def rotate(self):
        """A new generation, once this one has ``limit`` pieces; callers that add many at once call it before."""
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()

    def __missing__(self, piece):
        found = self.old.get(piece)
        if found is None:
            found = self.compute(piece)
        if len(piece) <= KEPT_CHARS:
            self.rotate()
            self[piece] = found
        return found

    def forget_long(self, added) -> None:
        """Of pieces added for a batch those that are too long to stay."""
        for piece in added:
            if len(piece) > KEPT_CHARS:
                self.pop(piece, None)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one match. Leaf p of the tree is the rank of the pair whose left part starts at byte p, with p itself in
    the low bits, so that a node's minimum is the leftmost pair of least rank; a merge renews the leaves of the merged
    pair, of the part it swallowed and of the live neighbour before it, each along its path to the root."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    bits = n.bit_length()
    size = 1 << (n - 1).bit_length()
    mask, none = (1 << bits) - 1, 1 << 62
    get = ranks.get
    tree = [none] * (2 * size)
    for p in range(n - 1):
        r = get(piece[p : p + 2])
        if r is not None:
            tree[size + p] = r << bits | p
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 2))  # start of the next live part; n: none
    before = list(range(-1, n + 1))
    while (least := tree[1]) != none:
        p = least & mask
        q = after[p]
        end = after[q]
        after[p] = end
        before[end] = p
        renew = [(q, none)]
        r = get(piece[p : after[end]]) if end < n else None
        renew.append((p, none if r is None else r << bits | p))
        left = before[p]
        if left >= 0:
            r = get(piece[left:end])
            renew.append((left, none if r is None else r << bits | left))
        for leaf, value in renew:
            i = size + leaf
            tree[i] = value
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                if b < a:
                    a = b
                if tree[i] == a:
                    break
                tree[i] = a
                i >>= 1
    ids, p = [], 0
    while p < n:
        ids.append(ranks[piece[p : after[p]]])
        p = after[p]
    return tuple(ids)


#: Bytes of the longest pieces that are merged in batches, and the bits of a position in a leaf.
BATCHED, POS_BITS = 32, 6
NONE = np.int64(1) << 62


class Pairs:
    """Rank of the merge of two ids, for arrays of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.span = max(ranks.values()) + 2  # the last id stands for no part
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    found[a * self.span + b] = rank
        self.keys = np.array(sorted(found), np.int64)
        self.rank = np.array([found[k] for k in self.keys.tolist()], np.int64)

    def leaf(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaves for the pairs (a, b) whose left parts start at ``at``."""
        key = a * self.span + b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.rank[i] << POS_BITS | at, NONE)


def merge_many(batch: list[bytes], size: int, byte_ids: np.ndarray, pairs: Pairs) -> list[tuple[int, ...]]:
    """As ``merge``, without its look-up of whole pieces, for pieces of at most ``size`` bytes (a power of two)."""
    count, end, none_id = len(batch), size, pairs.span - 1
    lengths = np.fromiter(map(len, batch), np.int64, count)
    flat = np.frombuffer(b"".join(b.ljust(size, b"\0") for b in batch), np.uint8).reshape(count, size)
    columns = np.arange(size)
    part = np.full((count, size + 2), none_id, np.int64)
    part[:, :size] = np.where(columns < lengths[:, None], byte_ids[flat], none_id)
    after = np.tile(np.append(columns + 1, [end, end]), (count, 1))
    after[np.arange(count), lengths - 1] = end
    before = np.tile(np.append(columns - 1, [end, end]), (count, 1))
    before[:, 0] = end + 1  # no part; its leaf, as that of the end, is never read
    tree = np.full((count, 2 * size + 2), NONE, np.int64)
    tree[:, size : 2 * size - 1] = pairs.leaf(part[:, : size - 1], part[:, 1:size], columns[:-1])
    level = size
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    live = np.flatnonzero(tree[:, 1] != NONE)
    while len(live):
        least = tree[live, 1]
        p = least & ((1 << POS_BITS) - 1)
        merged = least >> POS_BITS
        q = after[live, p]
        e = after[live, q]
        left = before[live, p]
        part[live, p] = merged
        part[live, q] = none_id
        after[live, p] = e
        before[live, e] = p
        tree[live, size + q] = NONE
        tree[live, size + p] = pairs.leaf(merged, part[live, e], p)
        first = left == end + 1
        tree[live, size + left] = np.where(first, NONE, pairs.leaf(part[live, left], merged, left))
        nodes = [size + q, size + p, np.where(first, size + p, size + left)]
        for _ in range(size.bit_length() - 1):
            for k in range(3):
                nodes[k] = i = nodes[k] >> 1
                tree[live, i] = np.minimum(tree[live, 2 * i], tree[live, 2 * i + 1])
        live = live[tree[live, 1] != NONE]
    kept = part[:, :size] != none_id
    ids, counts = part[:, :size][kept].tolist(), kept.sum(1).tolist()
    out, at = [], 0
    for n in counts:
        out.append(tuple(ids[at : at + n]))
        at += n
    return out


class Codec:
    """Encodes texts and decodes ids by one table of ranks."""

    def __init__(self, path: str):
        self.ranks = ranks = load_ranks(path)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pairs = Pairs(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.cache = Remembered(lambda piece: merge(piece.encode("utf-8", "surrogatepass"), ranks))

    def learn(self, new: set[str]) -> None:
        """Puts the ids of many pieces in the cache at once."""
        old, sizes = self.cache.old, {4: [], 8: [], 16: [], 32: []}
        for piece in new:
            if piece in old:
                continue
            b = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(b)
            if whole is not None:
                self.cache[piece] = (whole,)
            elif len(b) <= BATCHED:
                sizes[max(4, 1 << (len(b) - 1).bit_length())].append((piece, b))
        for size, some in sizes.items():
            if some:
                self.cache.update(zip([x for x, _ in some], merge_many([b for _, b in some], size, self.byte_ids, self.pairs), strict=True))

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        cut = [pieces(t) for t in texts]
        self.cache.rotate()
        new = set().union(*cut) - self.cache.keys()
        self.learn(new)
        found = [list(chain.from_iterable(map(self.cache.__getitem__, x))) for x in cut]
        self.cache.forget_long(new)
        return found

    def in_turn(self, texts, chars: int = 1 << 21):
        """Ids of each text, encoded in batches of about so many characters, which bounds memory."""
        some, held = [], 0
        for t in texts:
            some.append(t)
            held += len(t)
            if held >= chars:
                yield from self.encode_many(some)
                some, held = [], 0
        if some:
            yield from self.encode_many(some)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """This process's codec for a file of ranks: its tables are built once a worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_column(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row; null text counts as empty and gives no ids. Extra columns are ignored."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        coder = codec(path)
        for b in batches:
            ids = list(coder.in_turn(t.as_py() or "" for t in b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row, in one pass without shuffle.

    Null text counts as empty: no ids. Empty tables give no rows, repeated rows are encoded each, extra columns are
    ignored. Texts of any length are encoded whole; a match of n bytes takes O(n log n) steps.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        coder = codec(path)
        decimal = [str(i) for i in range(max(coder.bytes_of) + 1)]
        for b in batches:
            n, enc, dec = [], [], []
            for ids in coder.in_turn(text.as_py() or "" for text in b.column(1)):
                n.append(len(ids))
                enc.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                dec.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(enc, pa.string()), pa.array(dec, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, out).withColumnRenamed("id", id_col)
