"""Words and word hashes of Arrow string columns, by numpy over the UTF-8 bytes.

A column's texts stay one flat byte array; words are (start, end) pairs into it,
and the words of row r are ``bounds[r]:bounds[r + 1]``. No Python object is made
per word. Hashes are polynomials over random byte values modulo 2**64; two
independent ones give 128 bits where equality must hold over a whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes whose eight-byte terms are held at once.
PIECE = 1 << 19
#: Texts of an Arrow batch are handled in runs of about so many bytes.
RUN = 1 << 21

_random = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _random.integers(0, 2**64, (2, 256), np.uint64)
#: Multipliers, 3 modulo 8, so that differences of powers keep few trailing zero bits.
_STEP = [int(x) & ~7 | 3 for x in _random.integers(0, 2**64, 2, np.uint64)]
_WINDOW_STEP = [int(x) & ~7 | 3 for x in _random.integers(0, 2**64, 2, np.uint64)]

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: After lower-casing A-Z: digits, a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Words(NamedTuple):
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets of the rows in them; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def runs(batch: pa.RecordBatch, column: str, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts hold about ``size`` (RUN) bytes; a longer text is a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(lengths) - lengths) // (size or RUN)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(lengths)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def split(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> Words:
    """Maximal runs of bytes that ``letters`` marks, never across rows."""
    inside = letters[data]
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    start[begin] = inside[begin]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = begin[1:] - 1
    end[last] = inside[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def _powers(step: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), step, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(words: Words, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; ``which`` (0 or 1) picks one of two independent functions."""
    n = len(words.starts)
    out = np.empty(n, np.uint64)
    if not n:
        return out
    lengths = words.ends - words.starts
    powers = _powers(_STEP[which], int(lengths.max()))
    total = np.cumsum(lengths)
    at = 0
    while at < n:
        done = int(total[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + PIECE, "right")))
        size, first = lengths[at:to], total[at:to] - lengths[at:to] - done
        within = np.arange(int(size.sum())) - np.repeat(first, size)
        terms = _BYTE[which][words.data[np.repeat(words.starts[at:to], size) + within]] * powers[within]
        out[at:to] = np.add.reduceat(terms, first)
        at = to
    return mix(out)


def window_hashes(word_hashes: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A hash of each run of ``size`` consecutive words; entry i is that of the run which starts at word i."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if size <= 8:
        powers = _powers(_WINDOW_STEP[which], size)
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out += word_hashes[k : k + n] * powers[k]
        return mix(out)
    step = _WINDOW_STEP[which]
    sums = np.zeros(len(word_hashes) + 1, np.uint64)
    np.cumsum(word_hashes * _powers(step, len(word_hashes)), out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * _powers(pow(step, -1, 1 << 64), n))


def text_of(words: Words, i: int) -> bytes:
    return words.data[words.starts[i] : words.ends[i]].tobytes()


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
