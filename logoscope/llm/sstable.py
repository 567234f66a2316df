"""Sorted-string tables of token ids: the file format, its writer and its reader.

A file holds entries in ascending key order: data blocks, a sparse block index, a Bloom filter and a footer.

* key: the signed 64-bit identifier with its sign bit flipped, big-endian (so bytes sort as numbers); empty for null.
* entry: varint shared key bytes, varint further key bytes, varint value bytes, key rest, value. Every RESTART-th entry
  of a block shares nothing. The value is the ids as little-endian unsigned integers of the file's width (2 or 4 bytes).
* block: zstd(entries, then restart offsets as uint32, then their count), then crc32 of the compressed bytes.
* index: zstd of one entry a block: key lengths and bytes as above with the block's last key, varint offset, length.
* Bloom filter: bits set by BLOOM_HASHES probes of xxhash64 of the key.
* footer: FOOTER, at the end of the file.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
import zstandard

MAGIC = b"SSTOKEN1"
#: index offset, index length, bloom offset, bloom length, bloom bits, entries, ids, width, magic
FOOTER = struct.Struct("<QQQQQQQB8s")
BLOCK_BYTES, RESTART = 1 << 16, 16
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7
#: Bytes of neighbouring blocks that a pass in order reads at once.
READ_BYTES = 4 << 20
_SIGN = 1 << 63


def to_key(ident: int | None) -> bytes:
    return b"" if ident is None else ((ident + _SIGN) & (2**64 - 1)).to_bytes(8, "big")


def from_key(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - _SIGN if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _shared(a: bytes, b: bytes) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _probes(h: int, bits: int) -> list[int]:
    step = (h >> 32) | 1
    return [(h + i * step) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Writes entries, which must come in ascending key order, to a binary stream."""

    def __init__(self, stream, width: int):
        self.stream, self.width, self.at = stream, width, 0
        self.pack = zstandard.ZstdCompressor(level=1)
        self.block, self.restarts, self.in_block, self.last = bytearray(), [], 0, b""
        self.index, self.index_last, self.hashes, self.entries, self.ids = bytearray(), b"", array("Q"), 0, 0

    def add(self, key: bytes, value: bytes) -> None:
        same = 0
        if self.in_block % RESTART:
            same = _shared(self.last, key)
        else:
            self.restarts.append(len(self.block))
        self.block += _varint(same) + _varint(len(key) - same) + _varint(len(value)) + key[same:] + value
        self.last = key
        self.in_block += 1
        self.entries += 1
        self.ids += len(value) // self.width
        self.hashes.append(xxhash.xxh64_intdigest(key))
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def _flush(self) -> None:
        if not self.in_block:
            return
        body = self.pack.compress(bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts)))
        same = _shared(self.index_last, self.last)
        self.index += _varint(same) + _varint(len(self.last) - same) + self.last[same:] + _varint(self.at) + _varint(len(body) + 4)
        self.index_last = self.last
        self._put(body + struct.pack("<I", zlib.crc32(body)))
        self.block, self.restarts, self.in_block = bytearray(), [], 0

    def close(self) -> None:
        self._flush()
        index = self.pack.compress(bytes(self.index))
        index_at = self.at
        self._put(index)
        bits = max(64, -(-len(self.hashes) * BLOOM_BITS_PER_KEY // 8) * 8)
        bloom = bytearray(bits // 8)
        for h in self.hashes:
            for p in _probes(h, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_at = self.at
        self._put(bytes(bloom))
        self._put(FOOTER.pack(index_at, len(index), bloom_at, len(bloom), bits, self.entries, self.ids, self.width, MAGIC))


class Reader:
    """Reads a file by ranges: in order, or single keys by Bloom filter, index and block.

    ``read(offset, length)`` gives bytes of the file of ``size`` bytes. Only footer and index are read at the start.
    """

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        f = FOOTER.unpack(read(size - FOOTER.size, FOOTER.size))
        if f[8] != MAGIC:
            raise ValueError("not a table of token ids")
        self.bloom_at, self.bits, self.entries, self.ids, self.width = f[2:4], *f[4:8]
        self.unpack = zstandard.ZstdDecompressor()
        self.bloom = None
        raw, at, last = self.unpack.decompress(read(f[0], f[1])), 0, b""
        self.last_keys, self.spots = [], []
        while at < len(raw):
            same, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            last = last[:same] + raw[at : at + rest]
            at += rest
            offset, at = _read_varint(raw, at)
            length, at = _read_varint(raw, at)
            self.last_keys.append(last)
            self.spots.append((offset, length))

    def _block(self, data: bytes) -> tuple[bytes, list[int]]:
        body = data[:-4]
        if zlib.crc32(body) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block is damaged")
        raw = self.unpack.decompress(body)
        n = struct.unpack_from("<I", raw, len(raw) - 4)[0]
        end = len(raw) - 4 - 4 * n
        return raw[:end], list(struct.unpack_from(f"<{n}I", raw, end))

    def _blocks(self) -> Iterator[bytes]:
        first = 0
        while first < len(self.spots):
            start = self.spots[first][0]
            end, past = start + self.spots[first][1], first + 1
            while past < len(self.spots) and end - start < READ_BYTES:
                end += self.spots[past][1]
                past += 1
            data = memoryview(self.read(start, end - start))
            for offset, length in self.spots[first:past]:
                yield data[offset - start : offset - start + length]
            first = past

    @staticmethod
    def _entry(raw: bytes, at: int, last: bytes) -> tuple[bytes, int, int]:
        same, at = _read_varint(raw, at)
        rest, at = _read_varint(raw, at)
        size, at = _read_varint(raw, at)
        key = last[:same] + raw[at : at + rest]
        return key, at + rest, at + rest + size

    def _numbers(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, "<u2" if self.width == 2 else "<u4")

    def __iter__(self):
        for data in self._blocks():
            raw, _ = self._block(data)
            at, key = 0, b""
            while at < len(raw):
                key, start, at = self._entry(raw, at, key)
                yield from_key(key), self._numbers(raw[start:at])

    def get(self, ident: int | None) -> np.ndarray | None:
        """The ids of one document (of equal identifiers the first), or None."""
        key = to_key(ident)
        if self.bloom is None:
            self.bloom = self.read(*self.bloom_at)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(xxhash.xxh64_intdigest(key), self.bits)):
            return None
        i = bisect_left(self.last_keys, key)
        if i == len(self.last_keys):
            return None
        raw, restarts = self._block(self.read(*self.spots[i]))
        lo, hi = 0, len(restarts)
        while hi - lo > 1:  # the last restart whose key is below
            mid = (lo + hi) // 2
            if self._entry(raw, restarts[mid], b"")[0] < key:
                lo = mid
            else:
                hi = mid
        at, found = restarts[lo], b""
        while at < len(raw):
            found, start, at = self._entry(raw, at, found)
            if found == key:
                return self._numbers(raw[start:at])
            if found > key:
                break
        return None
