"""Wu-Manber multi-pattern search over word sequences.

Symbols are 64-bit word hashes. Patterns of one length m share a table of
shifts keyed by the hash of a block of two words (one where m is 1): how far
the search may advance when that block ends at its position. Blocks at which a
pattern may end have shift 0; a bucket keyed by the block of such suffixes and
the hash of the first word then selects the few patterns to compare, word by
word and byte for byte.
"""

from __future__ import annotations

import numpy as np

from gristmill.llm import words as W

_BLOCK = np.uint64(0x9E3779B97F4A7C15)


def blocks(hashed: np.ndarray, size: int) -> np.ndarray:
    """Entry i: the hash of the block of ``size`` words that ends at word i (the first entry of a two-word block is its last word's own)."""
    if size == 1:
        return hashed
    out = hashed.copy()
    out[1:] ^= hashed[:-1] * _BLOCK
    return out


class Table:
    """The search table of the patterns of one length, in sorted numpy arrays: about 60 bytes a pattern word.

    words: the words of all items, one after another; hashed: their hashes;
    firsts: the first word of each pattern; owners: the place of each in ``items``.
    """

    def __init__(self, words: W.Words, hashed: np.ndarray, firsts: np.ndarray, owners: np.ndarray, items: list, length: int):
        self.words, self.items, self.length, self.block = words, items, length, min(2, length)
        #: How far to go on at a block that no pattern holds.
        self.most = length - self.block + 1
        ends = blocks(hashed, self.block)
        places = range(self.block - 1, length)
        block = np.concatenate([ends[firsts + i] for i in places])
        step = np.concatenate([np.full(len(firsts), length - 1 - i, np.int32) for i in places])
        order = np.lexsort((step, block))
        block, step = block[order], step[order]
        least = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        self.blocks, self.steps = block[least], step[least]
        suffix = self._bucket(ends[firsts + length - 1], hashed[firsts])
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.firsts, self.owners = suffix[order], firsts[order].astype(np.int32), owners[order].astype(np.int32)

    @staticmethod
    def _bucket(end: np.ndarray, first: np.ndarray) -> np.ndarray:
        return W.mix(end ^ W.mix(first))

    def prepared(self, hashed: np.ndarray) -> tuple[list[int], list[int]]:
        """For each word how far the search may go on from it, and where that is 0 its bucket, or -1."""
        ends = blocks(hashed, self.block)
        at = np.minimum(np.searchsorted(self.blocks, ends), len(self.blocks) - 1)
        step = np.where(self.blocks[at] == ends, self.steps[at], self.most)
        bucket = np.full(len(hashed), -1)
        stop = np.flatnonzero(step == 0)
        stop = stop[stop >= self.length - 1]
        key = self._bucket(ends[stop], hashed[stop - self.length + 1])
        at = np.minimum(np.searchsorted(self.suffix, key), len(self.suffix) - 1)
        bucket[stop] = np.where(self.suffix[at] == key, at, -1)
        return step.tolist(), bucket.tolist()

    def search(self, prepared: tuple[list[int], list[int]], a: int, b: int, word) -> list[tuple[int, list]]:
        """(start, owners) of every occurrence within words a to b; ``word(i)`` gives the bytes of word i."""
        (steps, buckets), last, found = prepared, self.length - 1, []
        i = a + last
        while i < b:
            if steps[i]:
                i += steps[i]
                continue
            if buckets[i] >= 0:
                text = [word(k) for k in range(i - last, i + 1)]
                own = [self.items[self.owners[at]] for at in self._members(buckets[i]) if self._reads(int(self.firsts[at]), text)]
                if own:
                    found.append((i - last, own))
            i += 1
        return found

    def _members(self, at: int) -> range:
        return range(at, int(np.searchsorted(self.suffix, self.suffix[at], "right")))

    def _reads(self, first: int, text: list[bytes]) -> bool:
        return all(W.text_of(self.words, first + k) == t for k, t in enumerate(text))


def tables(items: list[tuple[object, str | None]], window: int) -> list[Table]:
    """A table per pattern length. A pattern is a window of consecutive words of an item, or the whole of a shorter item."""
    texts = [(text or "").encode() for _, text in items]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    words = W.split(W.LOWER[np.frombuffer(b"".join(texts), np.uint8)], offsets, W.ALNUM)
    hashed, other, names = W.hashes(words), W.hashes(words, 1), [item for item, _ in items]
    size = np.minimum(np.diff(words.bounds), window)
    out = []
    for length in sorted(set(size[size > 0].tolist())):
        own = np.flatnonzero(size == length)
        count = words.bounds[own + 1] - words.bounds[own] - length + 1
        owners = np.repeat(own, count)
        firsts = np.repeat(words.bounds[own] - np.cumsum(count) + count, count) + np.arange(len(owners))
        # A window that an item repeats is one pattern.
        whole = [W.window_hashes(h, length, k)[firsts] for k, h in enumerate((hashed, other))]
        order = np.lexsort((*whole, owners))
        new = np.append(True, np.any([np.diff(x[order]) != 0 for x in (owners, *whole)], 0))
        one = np.sort(order[new])
        out.append(Table(words, hashed, firsts[one], owners[one], names, length))
    return out
