"""Adaptive context-mixing range coder for token ids, many blocks at once.

A batch of blocks has one table of order 0, its ids' frequencies, and is coded
in blocks that each start from a fresh model, so any block can be read with the
table alone. numpy codes the same position of all blocks in one step; ids are
coded as their places in the table, which are small.

Model. Per block, adaptive tables predict the next id from the ids before it:
order 2 by a hash of the last two gives one candidate, order 1 by a hash of the
last one two, with a confidence of 0 to 3 for the foremost. An id is a choice
(the candidate of order 2; the first or second of order 1; none of them) and,
where none is right, an id by order 0. Choices are coded by the mix, a sum, of
two adaptive frequency tables, one chosen by the confidence of order 2, the
other by that of order 1 and whether the orders agree. A table's four 16-bit
frequencies are one 64-bit integer, of which one multiplication gives the
running sums. The share of the last choice is divided by order 0, so an id is
coded in one step.

Coder. Range coding with a range of 32 to 48 bits that settles 16 bits at a time.
Numbers are integers under 2**53 in float64, whose products, sums and floors of
quotients are exact here and which numpy divides several at once: a quotient q
under T of a number under 2**48 by a unit of at most 2**48 / T is 2**-48 * T or
more below the next integer, and its rounding error is under 2**-53 * T. A carry
stays in the 17th bit of a settled number until the end, when all are brought
forward together.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 1 << 10
_SLOTS1, _SLOTS2 = 128, 256
#: Frequencies of choices start at 1 and grow by STEP a use; every CARE steps those that sum to over LIMIT are halved.
STEP, LIMIT, CARE = 24, 2_000, 64
#: Order 0 has a place for the MOST commonest ids, each with a frequency of 1 at least, together ORDER0 or little more.
#: Any others share a place and follow as they are. Frequencies of choices times those of order 0 stay under _LEAST.
ORDER0, MOST = 1 << 16, 1 << 17
OTHER = -1
#: Ids under this are counted and looked up in arrays, others by sorting and searching.
_SMALL = 1 << 18

_U = np.uint64
_LEAST, _MOST, _DIGIT = float(1 << 32), float(1 << 48), float(1 << 16)
_1 = np.int8(1)
_ONES, _HALF = _U(0x0001000100010001), _U(0x7FFF7FFF7FFF7FFF)
_STEPS = np.array([STEP << 16 * k for k in range(4)], np.uint64)
#: What a slot gains by its confidence, less by 4 if its guess was wrong. A wrong guess of a confidence under 2 loses its place instead.
_GAIN = np.array([1, 1, 1, 0, 0, 0, -1, -2], np.int32)


class _Contexts:
    """Orders 1 and 2 of n blocks, over places."""

    def __init__(self, n: int):
        lane = np.arange(n)
        self.base1, self.base2 = lane * _SLOTS1, lane * _SLOTS2
        self.table1, self.table2, self.lane4 = lane * 8, lane * 4, lane * 4
        # A slot holds place * 4 + confidence, one of order 1 the second candidate behind it; -4 and -1 are no places.
        self.pred1, self.pred2 = np.full((n * _SLOTS1, 2), [-4, -1], np.int32).view(np.int64).ravel(), np.full(n * _SLOTS2, -4, np.int32)
        self.last1, self.last2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.by1, self.by2 = np.full(n * 8, _ONES), np.full(n * 4, _ONES)

    def predict(self, a: int) -> None:
        """For the first a blocks: ``guesses``, and in ``starts`` and ``ends`` the four choices' running sums of frequencies, which are ``total``."""
        one = self.last1[:a]
        self.at1 = (one >> 20 & _SLOTS1 - 1) + self.base1[:a]
        self.at2 = ((one ^ self.last2[:a]) >> 20 & _SLOTS2 - 1) + self.base2[:a]
        self.slot2 = self.pred2.take(self.at2)
        both = self.pred1.take(self.at1).view(np.int32).reshape(a, 2)
        self.slot1, self.second = both[:, 0].copy(), both[:, 1].copy()
        self.conf1, self.conf2 = (self.slot1 & 3).astype(np.int8), (self.slot2 & 3).astype(np.int8)
        self.guess1, self.guess2 = self.slot1 >> 2, self.slot2 >> 2
        self.row1 = self.table1[:a] + (self.conf1 + ((self.guess1 == self.guess2).view(np.int8) << 2))
        self.row2 = self.table2[:a] + self.conf2
        self.freq1, self.freq2 = self.by1.take(self.row1), self.by2.take(self.row2)
        sums = (self.freq1 + self.freq2) * _ONES
        self.ends, self.starts = sums.view("<u2"), (sums << _U(16)).view("<u2")
        self.total = self.ends[3::4].astype(np.float64)

    def compare(self, x: np.ndarray) -> np.ndarray:
        """The choice by which the ids are found: the first of their guesses that is right."""
        self.wrong2, self.wrong1 = (self.guess2 != x).view(np.int8), (self.guess1 != x).view(np.int8)
        return (((self.second != x).view(np.int8) + _1) * self.wrong1 + _1) * self.wrong2

    def learn(self, a: int, x: np.ndarray, choice: np.ndarray, step: int) -> None:
        more = _STEPS.take(choice)
        self.by1[self.row1] = self.freq1 + more
        self.by2[self.row2] = self.freq2 + more
        own = x << 2
        state = self.conf2 - (self.wrong2 << 2)
        self.pred2[self.at2] = np.where(state >= -2, self.slot2 + _GAIN.take(state), own)
        state = self.conf1 - (self.wrong1 << 2)
        keep = state >= -2
        new = np.empty((a, 2), np.int32)
        new[:, 0] = np.where(keep, self.slot1 + _GAIN.take(state), own)
        # A right guess keeps the second candidate; the id takes its place, or else the guess that loses its own.
        new[:, 1] = np.where(state >= 0, self.second, np.where(keep, x, self.guess1))
        self.pred1[self.at1] = new.view(np.int64).ravel()
        self.last2[:a] = self.last1[:a] >> 3
        self.last1[:a] = np.multiply(x, 0x9E3779B1, dtype=np.int64)
        if step % CARE == CARE - 1:
            for table in (self.by1, self.by2):
                heavy = table * _ONES >> _U(48) > _U(LIMIT)
                table[heavy] -= table[heavy] >> _U(1) & _HALF


class Order0:
    """Frequencies of the distinct ids of a batch, in order; OTHER comes first."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        if len(ids) > MOST:
            rare = np.sort(np.argsort(counts, kind="stable")[: len(ids) - MOST])
            ids, counts = np.concatenate([[OTHER], np.delete(ids, rare)]), np.concatenate([[counts[rare].sum()], np.delete(counts, rare)])
        self.ids = ids
        self.sums = np.concatenate([[0], np.cumsum(np.maximum(1, counts * ORDER0 // max(1, int(counts.sum()))))]).astype(np.uint64)
        self.total = self.sums[-1]

    @property
    def others(self) -> bool:
        return len(self.ids) > 0 and int(self.ids[0]) == OTHER

    def place(self, ids: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.ids, ids)
        return np.where(self.ids[np.minimum(at, len(self.ids) - 1)] == ids, at, 0) if self.others else at

    def places(self) -> np.ndarray:
        """The place of each value under the total."""
        return np.repeat(np.arange(len(self.ids)), np.diff(self.sums.astype(np.int64)))

    def packed(self) -> bytes:
        return zlib.compress(np.concatenate([np.diff(self.ids, prepend=OTHER), np.diff(self.sums.astype(np.int64))]).astype("<u4").tobytes(), 6)

    @staticmethod
    def unpacked(packed: bytes) -> Order0:
        both = np.frombuffer(zlib.decompress(packed), "<u4").astype(np.int64)
        found = Order0.__new__(Order0)
        found.ids = np.cumsum(both[: len(both) // 2]) + OTHER
        found.sums = np.concatenate([[0], np.cumsum(both[len(both) // 2 :])]).astype(np.uint64)
        found.total = found.sums[-1]
        return found


class _Encoder:
    def __init__(self, n: int, most: int):
        """``most``: of 16-bit numbers a block."""
        self.n, self.lane = n, np.arange(n)
        self.low, self.range = np.zeros(n), np.full(n, _MOST)
        # The k-th numbers of all blocks lie side by side; those with k = 0 only part blocks.
        self.out, self.at = np.zeros((most + 2) * n, np.uint32), self.lane + n

    def put(self, a: int, start: np.ndarray, count: np.ndarray, total) -> None:
        """For the first a blocks."""
        unit = np.floor(self.range[:a] / total)
        low, rng = self.low[:a], self.range[:a]
        low += start * unit
        np.multiply(count, unit, out=rng)
        need = rng < _LEAST
        settled = np.floor(low * (1 / _LEAST))
        # Where nothing settles yet, the next to settle is written over this.
        self.out[self.at[:a]] = settled.astype(np.uint32)
        self.at[:a] += need * self.n
        need = need.astype(np.float64)
        shift = need * (_DIGIT - 1) + 1
        need *= _LEAST
        settled *= need
        low -= settled
        low *= shift
        rng *= shift
        self._settle(np.flatnonzero(rng < _LEAST))

    def _settle(self, more: np.ndarray) -> None:
        while len(more):
            low = self.low.take(more)
            settled = np.floor(low * (1 / _LEAST))
            self.out[self.at[more]] = settled
            self.at[more] += self.n
            self.low[more] = (low - settled * _LEAST) * _DIGIT
            self.range[more] *= _DIGIT
            more = more[self.range[more] < _LEAST]

    def put_few(self, lanes: np.ndarray, start: np.ndarray, count: float, total: float) -> None:
        unit = np.floor(self.range[lanes] / total)
        self.low[lanes] += start * unit
        self.range[lanes] = count * unit
        self._settle(lanes[self.range[lanes] < _LEAST])

    def finish(self) -> list[bytes]:
        # The least multiple of 2**32 in the range; the decoder reads zeros behind it.
        self.out[self.at] = np.ceil(self.low * (1 / _LEAST))
        sizes = self.at // max(1, self.n) + 1
        by_block = np.ascontiguousarray(self.out[: int(sizes.max(initial=0)) * self.n].reshape(-1, self.n).T)
        out = by_block[np.arange(by_block.shape[1]) < sizes[:, None]]
        # A carry out of a block's first number would be a number of 1 or more, so no carry passes the place before it.
        while len(over := np.flatnonzero(out >> 16)):
            out[over] &= 0xFFFF
            out[over - 1] += 1
        ends, out = np.cumsum(sizes), out.astype("<u2")
        return [out[a + 1 : b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist())]


class _Decoder:
    def __init__(self, blocks: list[bytes]):
        n = len(blocks)
        # The k-th numbers of all blocks lie side by side. Behind a sound block no more than three zeros are read; others differ from their checksum.
        self.n, sizes = n, np.array([len(b) // 2 for b in blocks])
        by_block = np.zeros((n, int(sizes.max()) + 3), "<u2")
        by_block[np.arange(by_block.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(b[: len(b) // 2 * 2] for b in blocks), "<u2")
        self.data, self.at = np.ascontiguousarray(by_block.T).ravel(), np.arange(n)
        self.range, self.code = np.full(n, _MOST), np.zeros(n)
        for _ in range(3):
            self.code = self.code * _DIGIT + self.data.take(self.at)
            self.at += n

    def target(self, a: int, total) -> np.ndarray:
        self.unit = np.floor(self.range[:a] / total)
        return np.floor(self.code[:a] / self.unit)

    def take(self, a: int, start: np.ndarray, count: np.ndarray) -> None:
        code, rng = self.code[:a], self.range[:a]
        code -= start * self.unit
        np.multiply(count, self.unit, out=rng)
        need = rng < _LEAST
        at = self.at[:a]
        more = self.data.take(at, mode="clip").astype(np.float64)
        at += need * self.n
        need = need.astype(np.float64)
        shift = need * (_DIGIT - 1) + 1
        more *= need
        code *= shift
        rng *= shift
        code += more
        self._settle(np.flatnonzero(rng < _LEAST))

    def _settle(self, more: np.ndarray) -> None:
        # A damaged block can come to a range of 0, which no shift mends.
        for _ in range(3):
            if not len(more):
                break
            self.code[more] = self.code[more] * _DIGIT + self.data.take(self.at[more], mode="clip")
            self.range[more] *= _DIGIT
            self.at[more] += self.n
            more = more[self.range[more] < _LEAST]

    def take_few(self, lanes: np.ndarray, total: float) -> np.ndarray:
        """A number under the total, all of which are as likely."""
        unit = np.floor(self.range[lanes] / total)
        found = np.clip(np.nan_to_num(np.floor(self.code[lanes] / unit)), 0, total - 1)
        self.code[lanes] -= found * unit
        self.range[lanes] = unit
        self._settle(lanes[unit < _LEAST])
        return found.astype(np.int64)


def _by_length(lengths: np.ndarray):
    """Blocks in falling order of length, the number of steps, and how many blocks have an id at each step."""
    order = np.argsort(-lengths, kind="stable")
    steps = int(lengths.max(initial=0))
    return order, steps, np.searchsorted(-lengths[order], -np.arange(steps), "left").tolist()


def _counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, in order, and how often each occurs."""
    if not len(ids) or ids.max() >= _SMALL:
        return np.unique(ids.astype(np.int64), return_counts=True)
    counts = np.bincount(ids)
    found = np.flatnonzero(counts)
    return found, counts[found]


def _shares(order0: Order0) -> tuple[np.ndarray, np.ndarray]:
    """Where each place starts in order 0, and its frequency; one more place, at the end, stands for all of it."""
    counts = np.diff(order0.sums.astype(np.float64))
    return np.append(order0.sums[:-1].astype(np.float64), 0.0), np.append(counts, float(order0.total))


def encode_blocks(blocks: list[np.ndarray]) -> tuple[bytes, list[bytes]]:
    """The batch's table of order 0, and the code of each block of ids (under 2**31)."""
    n = len(blocks)
    lengths = np.array([len(b) for b in blocks], np.int64)
    order, steps, active = _by_length(lengths)
    joined = np.concatenate(blocks) if blocks else np.zeros(0, np.int64)
    order0 = Order0(*_counted(joined))
    if len(order0.ids) and order0.ids[-1] < _SMALL:
        places = order0.place(np.arange(int(max(joined.max(), 0)) + 1)).astype(np.int32).take(joined)
    else:
        places = order0.place(joined).astype(np.int32)
    by_block, ends = np.zeros((n, steps), np.int32), np.cumsum(lengths)
    for p, b in enumerate(order.tolist()):
        by_block[p, : lengths[b]] = places[ends[b] - lengths[b] : ends[b]]
    by_step = np.ascontiguousarray(by_block.T)
    contexts, out = _Contexts(n), _Encoder(n, steps * (5 if order0.others else 3))
    (firsts, counts), whole, total = _shares(order0), len(order0.ids), float(order0.total)
    for t in range(steps):
        a = active[t]
        x = by_step[t, :a]
        contexts.predict(a)
        choice = contexts.compare(x)
        at = contexts.lane4[:a] + choice
        start, end = contexts.starts.take(at).astype(np.float64), contexts.ends.take(at)
        share = end - start
        part = np.where(choice == 3, x, whole)
        out.put(a, start * total + share * firsts.take(part), share * counts.take(part), contexts.total * total)
        if order0.others and len(rest := np.flatnonzero(x == 0)):
            own = np.array([blocks[order[p]][t] for p in rest.tolist()], np.int64)
            for shift in (16, 0):
                out.put_few(rest, own >> shift & 0xFFFF, 1.0, _DIGIT)
        contexts.learn(a, x, choice, t)
    coded, result = out.finish(), [b""] * n
    for p, b in enumerate(order.tolist()):
        result[b] = coded[p]
    return order0.packed(), result


@np.errstate(all="ignore")  # only damaged blocks divide by 0
def decode_blocks(table: bytes, coded: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The ids of each block, given the batch's table, their codes and numbers of ids."""
    n = len(coded)
    if not n:
        return []
    order0, sizes = Order0.unpacked(table), np.array(lengths, np.int64)
    order, steps, active = _by_length(sizes)
    found, others = np.zeros((max(steps, 1), n), np.int32), []
    contexts, src = _Contexts(n), _Decoder([coded[b] for b in order.tolist()])
    (firsts, counts), whole, total = _shares(order0), len(order0.ids), float(order0.total)
    places = order0.places().astype(np.int32)
    candidates = np.empty((n, 4), np.int32)
    for t in range(steps):
        a = active[t]
        contexts.predict(a)
        target = src.target(a, contexts.total * total)
        sums, part = contexts.ends.reshape(a, 4), np.floor(target * (1 / total)) if total == ORDER0 else np.floor(target / total)
        part = part.astype(np.uint16)
        choice = (sums[:, 0] <= part).view(np.int8) + (sums[:, 1] <= part).view(np.int8) + (sums[:, 2] <= part).view(np.int8)
        at = contexts.lane4[:a] + choice
        start, end = contexts.starts.take(at).astype(np.float64), contexts.ends.take(at)
        share = end - start
        start *= total
        own = places.take(((target - start) / share).astype(np.int32), mode="clip")
        for k, guess in enumerate((contexts.guess2, contexts.guess1, contexts.second, own)):
            candidates[:a, k] = guess
        x = candidates.ravel().take(at)
        part = np.where(choice == 3, x, whole)
        src.take(a, start + share * firsts.take(part, mode="clip"), share * counts.take(part, mode="clip"))
        if order0.others and len(rest := np.flatnonzero(x == 0)):
            others.append((t, rest, src.take_few(rest, _DIGIT) << 16 | src.take_few(rest, _DIGIT)))
        found[t, :a] = x
        contexts.compare(x)
        contexts.learn(a, x, choice, t)
    ids = order0.ids.astype(np.int32).take(found, mode="clip") if whole else found
    for t, rest, own in others:
        ids[t, rest] = own
    ids, result = np.ascontiguousarray(ids.T), [np.zeros(0, np.int32)] * n
    for place, b in enumerate(order.tolist()):
        result[b] = ids[place, : sizes[b]]
    return result


def checksum(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
