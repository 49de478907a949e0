"""Vectorised text primitives on the UTF-8 bytes of Arrow batches.

Texts are never turned into Python strings here: a block is one byte array and
the offsets of its documents, and words, lines and shingles are arrays of
positions, and of 64-bit hashes or exact numbers. Blocks hold whole documents and about
``BLOCK_BYTES`` bytes, so a worker's memory follows the longest document and
not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
ALNUM = np.zeros(256, bool)  # after lower-casing: digits, a-z and every byte of non-ASCII characters
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit integers (splitmix64)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LANE_MASK = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
_keys = mix(np.arange(1, 1025, dtype=np.uint64) * _ODD)


def _lane_keys(n: int) -> np.ndarray:
    """At least n constants, one for each place of eight bytes in a range."""
    global _keys
    if len(_keys) < n:
        _keys = mix(np.arange(1, (1 << (n - 1).bit_length()) + 1, dtype=np.uint64) * _ODD)
    return _keys


def _lanes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eight bytes each, place in the range, first lane of each range) of byte ranges that are not empty; the last is filled up with zeros."""
    many = (lengths + 7) >> 3
    first = np.cumsum(many) - many
    place = np.arange(int(many.sum())) - np.repeat(first, many)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    every = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    rest = np.repeat(lengths, many) - 8 * place
    return every[np.repeat(starts, many) + 8 * place] & _LANE_MASK[np.minimum(rest, 8)], place, first


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, int64 offsets) of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole documents."""
    data, offsets = utf8(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags over the ranges between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes within documents, and each document's range of words."""
    inside = is_word[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before[edge], after[edge - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range: the sum of its lanes, each mixed with a constant of its place."""
    lengths = ends - starts
    out = np.zeros(len(starts), np.uint64)
    full = np.flatnonzero(lengths)
    if len(full):
        lanes, place, first = _lanes(data, starts[full], lengths[full])
        out[full] = np.add.reduceat(mix(lanes ^ _lane_keys(int(place.max()) + 1)[place]), first)
    return mix(out + lengths.astype(np.uint64) * _ODD)


def equal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, i: np.ndarray, j: np.ndarray) -> bool:
    """Are the bytes of range i[k] those of range j[k], for every k?"""
    lengths = ends - starts
    if (lengths[i] != lengths[j]).any():
        return False
    full = lengths[i] > 0
    i, j = i[full], j[full]
    return not len(i) or bool((_lanes(data, starts[i], lengths[i])[0] == _lanes(data, starts[j], lengths[j])[0]).all())


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number of each byte range, the same for equal bytes and for no others: hashes find them, bytes decide."""
    if not len(starts):
        return np.zeros(0, np.int64)
    hashed = hashes(data, starts, ends)
    order = np.argsort(hashed, kind="stable")
    ranked = hashed[order]
    same = np.flatnonzero(ranked[1:] == ranked[:-1])
    if not equal(data, starts, ends, order[same], order[same + 1]):
        raw, known = data.tobytes(), {}
        return np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    out = np.empty(len(starts), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
    return out


def shingles(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width consecutive words of the block; runs across documents are the caller's to drop."""
    n = len(word_hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + word_hashes[j : j + n]
    return mix(out)


def doc_of(ranges: np.ndarray) -> np.ndarray:
    """Document index of each word, from the documents' ranges of words."""
    return np.repeat(np.arange(len(ranges) - 1), np.diff(ranges))
