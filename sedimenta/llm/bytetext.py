"""Vectorised work on UTF-8 bytes: texts of an Arrow column, word hashes, rolling hashes.

Everything is numpy over bounded chunks; no loop runs per word or per byte."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers, so that each has an inverse modulo 2**64.
BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
CHUNK = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits with good avalanche (two multiply-xorshift rounds)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        m = max(n, CHUNK + 1)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(m, b, dtype=U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=U))
        have = _powers[base] = (both[0], both[1])
    return have


def column(batch: pa.RecordBatch | pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string column; null is the empty text."""
    arr = batch.column(name) if isinstance(name, str) else batch.column(batch.schema.names.index(name))
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_string())
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(arr.buffers()[1], np.int64, n + 1, arr.offset * 8)
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[offs[0] : offs[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def chunks(data: np.ndarray, offs: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts (first row, end row, bytes, offsets), each of about limit bytes or one text."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def rolling(data: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums from which span() takes the hash of any run of bytes."""
    h = np.empty(len(data) + 1, dtype=U)
    h[0] = 0
    p = powers(base, len(data) + 1)[0]
    np.cumsum((data.astype(U) + U(1)) * p[: len(data)], out=h[1:])
    return h


def span(h: np.ndarray, base: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of bytes [a, b) for each pair; equal bytes have equal hashes wherever they lie."""
    return (h[b] - h[a]) * powers(base, len(h))[1][a]


def word_classes(separators: bytes) -> np.ndarray:
    """A table of 256 bytes: 0 for separators, A-Z lower-cased, the rest as it is (0 never in words)."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[np.frombuffer(separators, np.uint8)] = 0
    return t


#: Separators of the contracts: white space alone, or all ASCII that is neither letter nor digit.
SPACES = bytes([32, *range(9, 14)])
NOT_ALNUM = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


class Words:
    """Words of a chunk of texts: doc (text of each word), start and end byte, and 64-bit hash."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, separators: bytes):
        table = word_classes(separators)
        is_sep = np.zeros(256, bool)
        is_sep[np.frombuffer(separators, np.uint8)] = True
        low = table[data]
        inside = ~is_sep[data]
        n = len(data)
        first = np.zeros(n + 1, bool)
        first[offs[offs < n]] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | first[:n]))
        ends = np.flatnonzero(inside & ~(np.append(inside[1:], False) & ~first[1:])) + 1
        self.start, self.end = starts, ends
        self.doc = np.searchsorted(offs, starts, side="right") - 1
        self.low = low
        self.h = rolling(low, BASE[0])
        self.hash = mix(span(self.h, BASE[0], starts, ends))
        #: first word of each text, and the end
        self.of = np.searchsorted(self.doc, np.arange(len(offs)))


def gram_hash(w: np.ndarray, n: int, size: int, salt: int = 1) -> np.ndarray:
    """Hash of each run of size words; n is the number of runs wanted."""
    out = np.full(n, U(0x51ED270B7F4A7C15 * salt & (1 << 64) - 1), dtype=U)
    for j in range(size):
        out = mix(out + w[j : j + n] * U((0xD6E8FEB86659FD93 + 2 * j * 0x9E3779B97F4A7C15) & ((1 << 64) - 1) | 1))
    return out
