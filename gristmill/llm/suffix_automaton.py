"""Suffix automata, and the cross-parsing of many texts at once against them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class SuffixAutomaton:
    """All substrings of a sequence of symbols: a string occurs in it exactly if its symbols lead from state 0."""

    def __init__(self, text: Sequence):
        self.next: list[dict] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and c not in self.next[at]:
                self.next[at][c] = new
                at = link[at]
            if at >= 0:
                target = self.next[at][c]
                if length[target] == length[at] + 1:
                    link[new] = target
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[target]))
                    length.append(length[at] + 1)
                    link.append(link[target])
                    while at >= 0 and self.next[at].get(c) == target:
                        self.next[at][c] = copy
                        at = link[at]
                    link[target] = link[new] = copy
            last = new

    def phrases(self, text: Sequence) -> int:
        """How many phrases the text is parsed into, each the longest prefix of the rest that occurs in the automaton's text, or one unknown symbol."""
        count, states, root = 0, self.next, self.next[0]
        state = root
        for c in text:
            to = state.get(c)
            if to is None:
                count += state is not root
                to = root.get(c)
                if to is None:
                    count += 1
                    state = root
                    continue
            state = states[to]
        return count + (state is not root)


class Parser:
    """The transitions of an automaton over small integers, in numpy arrays.

    Most states have one way on: it is held beside the state, and only the others
    are looked up among the sorted pairs of state and symbol.
    """

    def __init__(self, automaton: SuffixAutomaton, symbols: int):
        ways, self.symbols = automaton.next, symbols
        self.only = np.array([next(iter(w)) if w else -1 for w in ways], np.int32)
        self.to = np.array([w[s] if w else 0 for w, s in zip(ways, self.only.tolist())], np.int32)
        pairs = sorted((state * symbols + s, to) for state, w in enumerate(ways) if len(w) > 1 for s, to in w.items())
        self.pair = np.array([*(p for p, _ in pairs), len(ways) * symbols], np.int64)
        self.pair_to = np.array([*(to for _, to in pairs), 0], np.int32)
        self.root = np.array([ways[0].get(s, 0) for s in range(symbols)], np.int32)

    def phrases(self, steps: np.ndarray, active: list[int]) -> np.ndarray:
        """Phrases of each lane: row t of ``steps`` holds the lanes' symbols at place t, of which the first ``active[t]`` have one."""
        state, count = np.zeros(steps.shape[1], np.int32), np.zeros(steps.shape[1], np.int32)
        for t, a in enumerate(active):
            now, symbol = state[:a], steps[t, :a]
            to = np.where(self.only[now] == symbol, self.to[now], 0)
            miss = np.flatnonzero(to == 0)
            pair = now[miss].astype(np.int64) * self.symbols + symbol[miss]
            at = np.searchsorted(self.pair, pair)
            found = np.where(self.pair[at] == pair, self.pair_to[at], 0)
            ends = miss[found == 0]
            # A phrase ends here; the symbol starts the next one, or is one itself if it is unknown.
            start = self.root[symbol[ends]]
            to[miss] = found
            to[ends] = start
            count[ends] += (now[ends] != 0).astype(np.int32) + (start == 0)
            state[:a] = to
        return count + (state != 0)
