"""Sorted runs of fixed-width byte keys: front coding, and a merge that knows common prefixes.

A run is a sorted matrix of distinct keys, one row a key, with the length of the prefix each
shares with the one before it. Front-coded, a key is that length and the bytes after it.

The merge is a loser tree whose matches are decided by prefix lengths. Each run's head
knows how many leading bytes it shares with the key that left the tree last. All
heads are at least that key, so of two heads the one that shares more is the smaller;
only heads that share equally much are compared, and only from there on. The length
found is kept by the loser, and the next head of a run brings its own from the front
coding. So no byte that is known to be equal is looked at again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def sort_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows as byte strings (of equal rows the first first), and what each sorted row shares with the one before it.

    Rows are sorted by eight bytes at a time, after the first only those that are still tied.
    """
    n, width = keys.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = keys
    words = padded.view(">u8")
    order, tied, group = np.arange(n), np.arange(n), np.zeros(n, np.int64)
    for k in range(words.shape[1]):
        value = words[order[tied], k].astype(np.uint64)
        by = np.lexsort((value, group)) if k else np.argsort(value, kind="stable")
        order[tied] = order[tied][by]
        value, group = value[by], group[by]
        same = np.zeros(len(tied) + 1, bool)
        same[1:-1] = (value[1:] == value[:-1]) & (group[1:] == group[:-1])
        still = same[:-1] | same[1:]
        tied, group = tied[still], np.cumsum(~same[:-1])[still]
        if not len(tied):
            break
    return order, shared(keys[order])


def shared(rows: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before it; 0 for the first."""
    out = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def pack(rows: np.ndarray, lcp: np.ndarray, owner: np.ndarray, many: np.ndarray) -> bytes:
    """A run, front-coded and compressed, with the least doc_id of each key and whether other documents hold it too."""
    lcp = lcp.copy()
    lcp[:1] = 0
    tails = rows[np.arange(rows.shape[1]) >= lcp[:, None]]
    planes = owner.astype("<i8").view(np.uint8).reshape(-1, 8).T
    raw = b"".join([np.array([len(rows), len(tails)], "<i8").tobytes(), lcp.tobytes(), tails.tobytes(), planes.tobytes(), many.astype(np.uint8).tobytes()])
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def unpack(blob: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True), np.uint8)
    n, size = raw[:16].view("<i8").tolist()
    lcp, tails, planes, many = np.split(raw[16:], np.cumsum([n, size, 8 * n]))
    rows = np.zeros((n, width), np.uint8)
    rows[np.arange(width) >= lcp[:, None]] = tails
    at = np.arange(n, dtype=np.int32)
    for k in range(width):  # what a row shares stands in the last row that shared less
        rows[:, k] = rows[np.maximum.accumulate(np.where(lcp <= k, at, np.int32(0))), k]
    return rows, lcp, np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").ravel(), many.astype(bool)


def merge(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The run of each key in sorted order (of equal keys the lower run first), and what it shares with the key before it."""
    k = len(runs)
    total = sum(len(rows) for rows, _ in runs)
    if k == 1:
        return np.zeros(total, np.int32), runs[0][1].copy()
    width = runs[0][0].shape[1]
    keys, lcps = [], []
    for rows, lcp in runs:
        raw = rows.tobytes()
        keys.append([raw[i : i + width] for i in range(0, len(raw), width)] + [b""])
        lcps.append([*lcp.tolist(), -1])  # an exhausted run shares less than any other and loses
    head, common, place = [x[0] for x in keys], [0 if len(x) > 1 else -1 for x in keys], [0] * k

    def loser(a: int, b: int) -> bool:
        """Whether ``a`` loses to ``b``; a match that reads bytes leaves what it found with the loser."""
        p, q = common[a], common[b]
        if p != q:
            return p < q
        if p < 0:
            return a > b
        x, y = head[a], head[b]
        while p < width and x[p] == y[p]:
            p += 1
        lost = a > b if p == width else x[p] > y[p]
        common[a if lost else b] = p
        return lost

    tree, winner = [0] * k, [0] * k + [*range(k)]
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], tree[node] = (b, a) if loser(a, b) else (a, b)
    best, out, shares = winner[1], [0] * total, [0] * total
    for t in range(total):
        out[t], shares[t] = best, common[best]
        at = place[best] = place[best] + 1
        head[best], p = keys[best][at], lcps[best][at]
        common[best] = p
        node = (best + k) >> 1
        while node:
            other = tree[node]
            q = common[other]
            lost = p < q
            if p == q:
                if p < 0:
                    lost = best > other
                else:
                    x, y = head[best], head[other]
                    while p < width and x[p] == y[p]:
                        p += 1
                    lost = best > other if p == width else x[p] > y[p]
                    common[best if lost else other] = p
                    p = q
            if lost:
                tree[node], best, p = best, other, q
            node >>= 1
    return np.array(out, np.int32), np.array(shares, np.uint8)
