"""Word shingles of whole texts as sets of 64-bit hashes, and SuperMinHash signatures of such sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import blocks, mix, parts, span_hash, word_spans

WORDS = 5
#: A prime: ranks of an element are an affine permutation of the slots.
SLOTS = 127
ROWS = 4
BANDS = SLOTS // ROWS
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sets_of(column: pa.Array, words: int = WORDS, seed: int = 0):
    """Yields (row, sorted distinct shingle hashes) for every row of a text column; other seeds give independent hashes.

    A-Z is lower-cased; fewer than `words` words are one shingle; no word gives an empty set.
    """
    for row, w, found, _ in _sets(column, words, seed, False):
        yield row, found


def keyed_sets_of(column: pa.Array, words: int = WORDS):
    """Yields (row, sequence key, set): the key is two independent hashes of the word sequence, of independent word hashes."""
    for row, w, found, other in _sets(column, words, 0, True):
        yield row, (sequence_hash(w), sequence_hash(other)) if len(w) else (0, 0), found


def _sets(column, words, seed, both):
    for first, buf, offsets in blocks(column):
        starts, ends, counts = word_spans(buf, offsets)
        p = parts(buf, lower=True)
        w = span_hash(p, starts, ends, seed)
        other = span_hash(p, starts, ends, seed + 1) if both else w
        n = len(w)
        if n >= words:
            s = w[: n - words + 1].copy()
            for k in range(1, words):
                s = mix(s + np.uint64(0x9E3779B97F4A7C15)) + w[k : n - words + 1 + k]
            s = mix(s)
        for r in range(len(offsets) - 1):
            a, b = int(counts[r]), int(counts[r + 1])
            if b - a >= words:
                found = distinct(s[a : b - words + 1])
            else:
                found = np.array([sequence_hash(w[a:b])], dtype=np.uint64)[: b - a]
            yield first + r, w[a:b], found, other[a:b]


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def sequence_hash(w: np.ndarray) -> int:
    """A 64-bit hash of a word sequence, from its words' hashes and places."""
    at = np.arange(1, len(w) + 1, dtype=np.uint64)
    return int(np.add.reduce(mix(w ^ (at * np.uint64(0xA0761D6478BD642F))), dtype=np.uint64))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash: uint64 [len(sets), SLOTS]; all ones for empty sets.

    Each element has one value in each slot: the rank that its own permutation gives the slot, then a random
    fraction. A slot holds the least of them over the set. Ranks are dealt level by level: a level is left out
    once each slot of a set holds a value of a lower one (early stopping), after one or two for usual texts.
    """
    out = np.full((len(sets), SLOTS), _EMPTY, dtype=np.uint64)
    live = np.array([k for k, s in enumerate(sets) if len(s)], dtype=np.int64)
    if not len(live):
        return out
    e = np.concatenate([sets[k] for k in live])
    row = np.repeat(live, [len(sets[k]) for k in live])
    prime = np.uint64(SLOTS)
    slot = mix(e ^ np.uint64(0x5851F42D4C957F2D)) % prime
    step = mix(e ^ np.uint64(0x14057B7EF767814F)) % np.uint64(SLOTS - 1) + np.uint64(1)
    flat = out.reshape(-1)
    for level in range(SLOTS):
        value = (mix(e + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(8)) | np.uint64(level << 56)
        np.minimum.at(flat, row * SLOTS + slot.astype(np.int64), value)
        todo = (out == _EMPTY).any(axis=1)
        keep = todo[row]
        if not keep.any():
            break
        if not keep.all():
            e, row, slot, step = e[keep], row[keep], slot[keep], step[keep]
        slot = (slot + step) % prime
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """int64 [rows, BANDS]: one hash for each band of ROWS slots; the band's number is part of the hash."""
    x = sig[:, : BANDS * ROWS].reshape(len(sig), BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(sig), 1), np.uint64)
    for k in range(ROWS):
        h = mix(h ^ x[:, :, k]) + np.uint64(k)
    return h.view(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0
