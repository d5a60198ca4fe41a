"""Word shingles of whole texts as 64-bit hashes, for many texts at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = U(0xD6E8FEB86659FD93)
BATCH_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x + U((seed * _BASE + 0x632BE59BD9B4E019) & (2 ** 64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of the rolling hash's base and of its inverse modulo 2^64."""

    def __init__(self):
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            inverse = pow(_BASE, -1, 1 << 64)
            self.up = np.concatenate([[U(1)], np.full(n - 1, _BASE, np.uint64)]).cumprod(dtype=np.uint64)
            self.down = np.concatenate([[U(1)], np.full(n - 1, inverse, np.uint64)]).cumprod(dtype=np.uint64)
        return self.up, self.down


def prefix_hash(data: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(s, down): the hash of data[i:j] is (s[j] - s[i]) * down[i]."""
    up, down = powers.to(len(data) + 1)
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * up[:len(data)], out=s[1:])
    return s, down


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; NULL has no bytes."""
    column = column.fill_null("") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) \
        else column.fill_null(b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, a row at least."""
    _, offsets = text_bytes(batch.column(text))
    at = 0
    while at < len(batch):
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(len(batch), max(end, at + 1))
        yield batch.slice(at, end - at)
        at = end


def shingle_sets(column: pa.Array, powers: Powers, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): each row's distinct shingles, ascending, in hashes[ends[i-1]:ends[i]].

    Words are runs without ASCII white space, A-Z lower-cased; a row of 1 to
    k - 1 words has one shingle of all of them.
    """
    data, offsets = text_bytes(column)
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    data = _LOWER[data]
    inside = ~_BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][(offsets[1:] > offsets[:-1])]
    first[begins] = inside[begins]
    start = np.flatnonzero(first)
    # a word ends at the next blank, at its row's end or at the end of all
    stop = np.ones(len(data) + 1, bool)
    stop[:-1] = ~inside
    stop[offsets] = True
    ends = np.flatnonzero(stop)
    end = ends[np.searchsorted(ends, start, side="right")]
    s, down = prefix_hash(data, powers)
    word = mix((s[end] - s[start]) * down[start], 1)
    row = np.searchsorted(offsets, start, side="right") - 1
    n_words = np.bincount(row, minlength=rows)
    word_at = np.concatenate([[0], np.cumsum(n_words)])
    hashes = np.zeros(len(word), np.uint64)
    for i in range(k):
        hashes[:len(word) - i] = hashes[:len(word) - i] * _STEP + word[i:] if i else word
    hashes = mix(hashes, 2)
    out, sizes = [], np.zeros(rows, np.int64)
    for r in range(rows):
        a, n = word_at[r], n_words[r]
        if n >= k:
            own = np.sort(hashes[a:a + n - k + 1])
            keep = np.ones(len(own), bool)
            keep[1:] = own[1:] != own[:-1]
            own = own[keep]
        elif n:
            own = np.array([n], np.uint64)
            for i in range(a, a + n):
                own = mix(own * _STEP + word[i:i + 1], 3)
        else:
            continue
        out.append(own)
        sizes[r] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(sizes)
