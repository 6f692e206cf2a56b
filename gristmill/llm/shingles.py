"""Distinct word-shingle sets of texts, and one-permutation sketches of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from gristmill.llm import words as W


def shingle_sets(batch: pa.RecordBatch, column: str, size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batch with each row's sorted distinct shingle hashes.

    A-Z are lower-cased; words are runs of non-white-space. A text of fewer
    words than ``size`` has its whole sequence as its only shingle, one without
    words has none.
    """
    for part in W.runs(batch, column):
        data, offsets = W.flat(part.column(column))
        words = W.split(W.LOWER[data], offsets, W.NOT_SPACE)
        hashed = W.hashes(words)
        rolled = W.window_hashes(hashed, size)
        sets = []
        for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
            sets.append(np.unique(rolled[a : b - size + 1] if b - a >= size else W.window_hashes(hashed[a:b], b - a) if b > a else rolled[:0]))
        yield part, sets


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation sketches, a row per set: the least hash in each of ``bins`` equal ranges of the hash space.

    A shingle hash serves as its own permutation value: its leading bits name
    the bin and the sorted set gives each bin's minimum directly. An empty bin
    borrows from a bin that a hash of (bin, attempt) names, attempts going up
    until a non-empty one is met (optimal densification), so sets agree in a
    borrowed bin with probability equal to their similarity. Rows of empty sets
    are zero.
    """
    shift = np.uint64(64 - bins.bit_length() + 1)
    out = np.zeros((len(sets), bins), np.uint64)
    full = np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):
        if len(s):
            at = (s >> shift).astype(np.intp)
            first = np.flatnonzero(np.diff(at, prepend=-1))
            out[i, at[first]] = s[first]
            full[i, at[first]] = True
    some = full.any(1)
    row, bin_ = np.nonzero(~full & some[:, None])
    own, attempt = out.copy(), 0
    while len(row):
        attempt += 1
        donor = (W.mix(bin_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(bins)).astype(np.intp)
        met = full[row, donor]
        out[row[met], bin_[met]] = own[row[met], donor[met]]
        row, bin_ = row[~met], bin_[~met]
    return out


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit bucket key of each band of each sketch."""
    parts = sketch.reshape(len(sketch), bands, -1)
    keys = np.broadcast_to(W.mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(sketch), bands)).copy()
    for k in range(parts.shape[2]):
        keys = W.mix(keys ^ parts[:, :, k])
    return keys
