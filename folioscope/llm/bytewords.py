"""Vectorised words, hashes and fingerprints over the UTF-8 bytes of a whole Arrow string column.

Hashes are sums of random table values times powers of an odd base, modulo 2**64: any substring's hash comes from
two prefix sums, and equal substrings have equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
BASE_INV = U64(pow(int(BASE), -1, 1 << 64))


def byte_values(seed: int, fold: bool) -> np.ndarray:
    """A random 64-bit value for each byte; with fold, A-Z have those of a-z."""
    out = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
    if fold:
        out[65:91] = out[97:123]
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, U64)

    def __reduce__(self):
        return Powers, ()  # never shipped: each process grows its own

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", BASE), ("down", BASE_INV)):
                step = np.full(size, base, U64)
                step[0] = 1
                setattr(self, name, np.cumprod(step, dtype=U64))


POWERS = Powers()


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets, from 0; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = (1 << 20) - 1):
    """Slices of a batch with at most limit text bytes each, one row at least."""
    _, at = raw(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def word_class(excluded: set[int]) -> np.ndarray:
    out = np.ones(256, bool)
    out[list(excluded)] = False
    return out


#: `[^\x20\x09-\x0D]+`
SPACED = word_class({0x20, *range(0x09, 0x0E)})
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: digits, letters and whatever isn't ASCII.
ALNUM = word_class({*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})


def bounds(body: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, which never cross rows, and each row's first word as offsets into them."""
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = is_word[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def prefix(body: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Prefix sums c: the hash of body[a:b] is (c[b] - c[a]) * BASE_INV ** a."""
    POWERS.upto(len(body) + 1)
    out = np.zeros(len(body) + 1, U64)
    np.cumsum(values[body] * POWERS.up[: len(body)], dtype=U64, out=out[1:])
    return out


def spans_hash(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((c[ends] - c[starts]) * POWERS.down[starts])


def runs(words: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Hash of size consecutive words from each position; positions whose run crosses a row must be left out."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(size):
        out += words[j : j + n] * POWERS_OF_WORDS[j]
    return mix(out)


POWERS_OF_WORDS = np.random.default_rng(97).integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)


def sha_hex(data: bytes) -> str:
    import hashlib

    return hashlib.sha256(data).hexdigest()
