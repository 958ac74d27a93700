"""Word shingles of a slice of documents as 64-bit hashes, by whole arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
NO_WORD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all others (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and how many words come before each document."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    raw = np.frombuffer(data.lower(), np.uint8)  # of bytes: A-Z only
    gap = BLANK[raw]
    behind = np.empty(len(gap), bool)
    behind[0] = True
    behind[1:] = gap[:-1]
    behind[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    starts = np.flatnonzero(~gap & behind)
    letters = raw[~gap]
    bounds = np.append(np.cumsum(~gap)[starts] - 1, len(letters)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return known[coded.indices.to_numpy(zero_copy_only=False)], np.searchsorted(starts, offsets)


def shingle_hashes(data: bytes, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every shingle of width words; fewer words make one shingle, none make none. Not distinct."""
    words, before = word_hashes(data, offsets)
    first, last = before[:-1], before[1:]
    n = last - first
    count = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
    owner = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    stop = np.repeat(last, count)
    out = np.zeros(len(owner), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            word = words[np.minimum(at + j, len(words) - 1)] if len(words) else words
            if j:
                word = np.where(at + j < stop, word, NO_WORD)
            out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + word)
    return owner, out


def shingle_sets(data: bytes, offsets: np.ndarray, width: int, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct hashes of each document in the global order, document after document.

    The order is (rank of the hash's cell, hash); without ranks it is by hash."""
    owner, h = shingle_hashes(data, offsets, width)
    if rank is None:
        order = np.lexsort((h, owner))
    else:
        order = np.lexsort((h, owner * 256 + rank[cells(h, len(rank))]))
    owner, h = owner[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    owner, h = owner[fresh], h[fresh]
    return h, np.searchsorted(owner, np.arange(len(offsets)))


def cells(h: np.ndarray, width: int) -> np.ndarray:
    """The cell of a table of width (a power of two) for each hash."""
    return (h >> np.uint64(64 - (width.bit_length() - 1))).astype(np.int64)
