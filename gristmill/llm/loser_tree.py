"""A k-way merge of sorted sequences by a loser tree."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


def merge(runs: Sequence[Sequence], key=lambda x: x) -> Iterator[tuple[int, int]]:
    """(run, position) of every element in the order of ``key``; of equal ones the lower run first.

    Inner node i of the tree holds the run that lost the match there, node 0 the
    winner. After an element leaves, only the matches on the path from its run's
    leaf to the root are played again: log2(k) comparisons an element.
    """
    k = len(runs)
    if not k:
        return
    position = [0] * k
    #: Heads compare as (exhausted, key, run): an exhausted run loses to all others.
    head = [(not len(r), key(r[0]) if len(r) else None, i) for i, r in enumerate(runs)]
    beats = lambda a, b: head[a][0] < head[b][0] or head[a][0] == head[b][0] and (head[a][0] or head[a][1:] <= head[b][1:])
    tree, winner = [0] * k, [0] * (2 * k)
    winner[k:] = range(k)
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], tree[node] = (a, b) if beats(a, b) else (b, a)
    best = winner[1]
    while not head[best][0]:
        yield best, position[best]
        position[best] += 1
        at, run = position[best], runs[best]
        head[best] = (False, key(run[at]), best) if at < len(run) else (True, None, best)
        node = (best + k) // 2
        while node:
            if beats(tree[node], best):
                tree[node], best = best, tree[node]
            node //= 2
