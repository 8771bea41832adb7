"""Words of many texts at once, by numpy over the Arrow buffers: no Python object is made for a word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D (all ASCII, so runs of UTF-8 bytes are runs of code points).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are hashed in blocks of about so many bytes, so that memory does not follow the longest text.
BLOCK = 2 << 20
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240521))
_TABLE = _rng.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASE = _rng.integers(0, 2**64, 2, dtype=np.uint64) | _U(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(stream: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    have = _powers.get(stream)
    if have is None or len(have[0]) < n:
        base = int(_BASE[stream])
        size = max(n, 1 << 16)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size <= BLOCK + 1:
            _powers[stream] = have
    return have


class Words:
    """data: the bytes of all texts; first: where each text begins, and the end; starts, ends: of the words; per: index of each text's first word, and the end."""

    def __init__(self, data: np.ndarray, first: np.ndarray):
        self.data, self.first = data, first
        word = (data != 32) & ((data - np.uint8(9)) > 4)
        begin = np.empty(len(data), bool)
        if len(data):
            begin[0] = True
            begin[1:] = ~word[:-1]
            inner = first[(first > 0) & (first < len(data))]
            begin[inner] = True
            begin &= word
            stop = np.empty(len(data), bool)
            stop[-1] = True
            stop[:-1] = ~word[1:]
            stop[inner - 1] = True
            stop &= word
            self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.per = np.searchsorted(self.starts, first)

    def hashes(self, stream: int = 0) -> np.ndarray:
        """64 bits a word; two streams are independent."""
        out, s, e = np.empty(len(self.starts), np.uint64), self.starts, self.ends
        at = 0
        while at < len(s):
            to = max(at + 1, int(np.searchsorted(e, s[at] + BLOCK, side="right")))
            a, b = int(s[at]), int(e[to - 1])
            if b - a > BLOCK:  # one enormous word
                out[at] = int.from_bytes(hashlib.blake2b(self.data[a:b].tobytes(), digest_size=8, salt=bytes([stream])).digest(), "little")
            else:
                up, down = _power(stream, b - a + 1)
                sums = np.zeros(b - a + 1, np.uint64)
                np.cumsum(_TABLE[stream][self.data[a:b]] * up[: b - a], out=sums[1:])
                i, j = s[at:to] - a, e[at:to] - a
                out[at:to] = mix64((sums[j] - sums[i]) * down[i] + (j - i).astype(np.uint64))
            at = to
        return out


def scan(texts: pa.Array | pa.ChunkedArray) -> Words:
    """The words of an array of texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, values = texts.buffers()
    first = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        first = np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8)[first[0] : first[-1]] if values is not None else np.zeros(0, np.uint8)
    return Words(data, first - first[0])


def slices(batch: pa.RecordBatch | pa.Table, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch | pa.Table]:
    """Parts of a batch whose texts have about `limit` bytes at most (or one row)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, total = 0, np.cumsum(size)
    while at < len(size):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def windows(h: np.ndarray, n: int, salt: int) -> np.ndarray:
    """A hash for each n consecutive words, from joining ever longer runs; h holds one document's words after the other's, len(h) - n + 1 results."""
    done: dict[int, np.ndarray] = {1: h}

    def run(k: int) -> np.ndarray:
        if k not in done:
            a, b = (k + 1) // 2, k // 2
            x, y = run(a), run(b)
            m = max(0, len(h) - k + 1)
            done[k] = mix64(x[:m] * _U(0x9E3779B97F4A7C15) + y[a : a + m] + _U(salt + k))
        return done[k]

    out = run(n)
    done.clear()  # run refers to itself, so what it holds would stay until the garbage collector comes
    return out


def by_group(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Rows sorted by a whole number, in tables that hold all rows of each number in them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(column).to_numpy()
        if held and k[0] == k[-1] and held[-1].column(column)[-1].as_py() == k[-1]:
            held.append(b)  # a group that goes on
            continue
        at = int(np.searchsorted(k, k[-1]))
        ready = [*held, b.slice(0, at)]
        held = [b.slice(at)]
        if sum(x.num_rows for x in ready):
            yield pa.Table.from_batches(ready)
    if held:
        yield pa.Table.from_batches(held)


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the runs of equal values; none if there are no values."""
    if not len(values):
        return []
    edge = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]).tolist()
    return list(zip(edge, [*edge[1:], len(values)], strict=True))
