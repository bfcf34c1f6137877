"""Which texts of two blocks are alike, in memory: bounds on the longest common subsequence that are words of bits.

Characters are numbered by occurrence ("a1", "a2"), so that what two texts have in common at most is a number of shared
bits. Pairs with enough of them are looked at in halves: the characters of a text's first half must stand before a place of
the other text and those of its second half behind it. Neither rules out a link. What passes is compared in full.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

from landq.functions.similarity import Texts

#: Bits of a word, and those of them that say how many characters of a text share the bit of another one.
WORD, UNARY = 64, 6
#: Characters of a text for each word, on average, and words of a text.
FILLED, WORDS = 32, 3
#: Pairs that are looked at together, so that their words stay near the processor, and texts of a row of them.
CELLS, ROW = 131_072, 16_384
#: Candidates that are looked at, and compared in full, together.
SOME = 32_768
#: Longest texts whose halves are looked at.
HALVED = 63
ONE = np.uint64(1)


def _dealt(counts: np.ndarray, bits: int) -> np.ndarray:
    """A bit for each kind: the most frequent ones have their own, others go where the fewest are so far."""
    out = np.empty(len(counts), dtype=np.int64)
    load = [(0, b) for b in range(bits)]
    for kind in np.argsort(-counts, kind="stable").tolist():
        least, out[kind] = load[0]
        heapq.heapreplace(load, (least + int(counts[kind]), int(out[kind])))
    return out


def _places(flags: np.ndarray) -> np.ndarray:
    """Places of few true values among a multiple of eight: first the eights that have any."""
    eights = flags.view(np.uint64)
    some = np.flatnonzero(eights != 0)
    at = np.flatnonzero(eights[some].view(bool))
    # eights that have none are left out before each place
    left_out = (some - np.arange(len(some))) * 8
    return at + left_out[at >> 3]


class Meeting:
    """Texts of two blocks, or of one block (``longs`` is None) that meets itself; none is empty. Texts are linked if their
    ratio is ``cutoff`` at least; each pair is found once. ``bits`` of a word stand for characters."""

    def __init__(self, classes: np.ndarray, shorts: np.ndarray, longs: np.ndarray | None, cutoff: int, bits: int):
        self.texts = Texts(classes)
        self.cutoff = cutoff
        self.alone = longs is None
        by_length = lambda places: places[np.argsort(self.texts.length[places], kind="stable")]
        self.shorts = by_length(shorts)
        self.longs = self.shorts if self.alone else by_length(longs)
        self.n_short, self.n_long = self.texts.length[self.shorts], self.texts.length[self.longs]
        count = int(np.clip(np.ceil(self.texts.length.mean() / FILLED), 1, WORDS))
        single, half, back = self._bits(count, bits)
        words = np.bitwise_or.reduceat(single, self.texts.start[:-1], axis=1)
        over = self.texts.length - np.bitwise_count(words).sum(axis=0, dtype=np.int64)
        for word in words:
            unary = np.minimum(over, UNARY)
            word |= (ONE << unary.astype(np.uint64)) - ONE
            over -= unary
        self.over = over[self.shorts]
        self.short_words, self.long_words = words[:, self.shorts], words[:, self.longs]
        self.halved = int(self.texts.length.max()) <= HALVED
        if self.halved:
            self._halve(half, back)

    def _bits(self, count: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each character of all texts: its bit in ``count`` words, and its bit in one word if equal ones are numbered from
        the start and from the end."""
        t = self.texts
        numbers = t.numbers[: t.start[-1]].astype(np.int64)
        key = np.repeat(np.arange(len(t.length)), t.length) * t.size + numbers
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.diff(key[order], prepend=-1))
        sizes = np.diff(np.append(new, len(key)))
        nth, last = np.empty(len(key), dtype=np.int64), np.empty(len(key), dtype=np.int64)
        nth[order] = np.arange(len(key)) - np.repeat(new, sizes)
        last[order] = np.repeat(sizes - 1, sizes)
        most = int(sizes.max())
        kinds = numbers * most + nth
        counts = np.bincount(kinds)
        known = np.flatnonzero(counts)
        bit = np.zeros(len(counts), dtype=np.int64)
        bit[known] = _dealt(counts[known], bits * count)
        # unary bits are the lowest ones
        at = ONE << (UNARY + bit // count).astype(np.uint64)
        words = np.where(np.arange(count)[:, None] == bit % count, at, np.uint64(0))
        half = ONE << (bit % WORD).astype(np.uint64)
        return words[:, kinds], half[kinds], half[numbers * most + last - nth]

    def _halve(self, half: np.ndarray, back: np.ndarray) -> None:
        """Bits of the halves of the short texts; bits of the long ones before and behind each place."""
        t = self.texts
        middle = t.length // 2
        cuts = np.stack([t.start[:-1], t.start[:-1] + middle], axis=1).ravel()
        first = np.where(middle > 0, np.bitwise_or.reduceat(half, cuts)[::2], np.uint64(0))[self.shorts]
        second = np.bitwise_or.reduceat(back, cuts)[1::2][self.shorts]
        self.first, self.second = first, second
        self.missing = (self.n_short - np.bitwise_count(first) - np.bitwise_count(second)).astype(np.uint8)
        at = np.arange(int(self.n_long.max()) + 1)

        def matrix(bits: np.ndarray, shift: int) -> np.ndarray:
            """Bits of the long texts by place, after ``shift`` columns without any; a column more than characters."""
            out = bits[np.clip(t.start[self.longs, None] + at - shift, 0, len(bits) - 1)]
            out[(at < shift) | (at - shift >= self.n_long[:, None])] = 0
            return out

        self.before, self.behind = matrix(half, 1), matrix(back, 0)
        np.bitwise_or.accumulate(self.before, axis=1, out=self.before)
        ends = self.behind[:, ::-1]
        np.bitwise_or.accumulate(ends, axis=1, out=ends)

    def _strips(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each length of the short texts: it, what each long text needs in common, and numbers of short and long texts
        that have so much in common, in any order."""
        lengths, first = np.unique(self.n_short, return_index=True)
        cells = np.empty(CELLS, np.uint64), np.empty(CELLS, np.uint8), np.empty(CELLS, np.uint8), np.empty(CELLS + 8, bool)
        step = max(1, CELLS // min(len(self.longs), ROW))
        for n, start, end in zip(lengths.tolist(), first.tolist(), [*first[1:].tolist(), len(self.shorts)]):
            # 200 * common >= cutoff * (la + lb)
            need = -(-(n + self.n_long) * self.cutoff // 200)
            last = None
            for at in range(start, end, step):
                rows = slice(at, min(at + step, end))
                over = int(self.over[rows].max())
                if over != last:
                    last, least = over, np.clip(need - over, 0, 255).astype(np.uint8)
                # of one block only later texts are met
                for left in range(at if self.alone else 0, len(self.longs), ROW):
                    i, j = self._shared(rows, slice(left, min(left + ROW, len(self.longs))), least, cells)
                    if self.alone:
                        later = np.flatnonzero(j > i)
                        i, j = i[later], j[later]
                    yield n, need, i, j

    def _shared(self, rows: slice, cols: slice, least: np.ndarray, cells: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of short and long texts that share enough bits."""
        shape = rows.stop - rows.start, cols.stop - cols.start
        size = shape[0] * shape[1]
        both, bits, more, flags = (x[:size].reshape(shape) for x in cells)
        for k, (x, y) in enumerate(zip(self.short_words, self.long_words)):
            np.bitwise_and(x[rows, None], y[cols], out=both)
            np.bitwise_count(both, out=more if k else bits)
            if k:
                bits += more
        np.greater_equal(bits, least[cols], out=flags)
        cells[-1][size : size + 8] = False
        found = _places(cells[-1][: -(-size // 8) * 8])
        row = found // shape[1]
        return rows.start + row, cols.start + found - row * shape[1]

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of texts that have enough characters in common."""
        for _, _, i, j in self._strips():
            yield self.shorts[i], self.longs[j]

    def _gathered(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Strips, but more candidates at once."""
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        size, now = 0, None
        for n, need, i, j in self._strips():
            if kept and (n != now[0] or size >= SOME):
                yield *now, *(np.concatenate(x) for x in zip(*kept))
                kept, size = [], 0
            now = n, need
            kept.append((i, j))
            size += len(i)
        if kept:
            yield *now, *(np.concatenate(x) for x in zip(*kept))

    def _in_order(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Candidates whose halves allow a link, and what they need."""
        last = None
        for n, need, i, j in self._gathered():
            if self.halved:
                if n != last:
                    last, rows, small = n, np.arange(len(self.longs)), need.astype(np.uint8)
                    # the middle of a short text is met in this range of a long one, of which there are two parts
                    low = np.clip(n // 2 - (n - need), 0, self.n_long)
                    high = np.clip(n // 2 + (self.n_long - need), low, self.n_long)
                    mid = (low + high) // 2
                    to_high, to_mid = self.before[rows, high], self.before[rows, mid]
                    from_low, from_mid = self.behind[rows, low], self.behind[rows, mid]
                first, second = self.first[i], self.second[i]
                common = np.bitwise_count(first & to_high[j]) + np.bitwise_count(second & from_mid[j])
                np.maximum(common, np.bitwise_count(first & to_mid[j]) + np.bitwise_count(second & from_low[j]), out=common)
                kept = np.flatnonzero(common + self.missing[i] >= small[j])
                i, j = i[kept], j[kept]
            yield i, j, need[j]

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of linked texts and their ratio."""
        kept: list[tuple[np.ndarray, ...]] = []
        for found in self._in_order():
            kept.append(found)
            if sum(len(i) for i, _, _ in kept) >= SOME:
                yield self._compared(kept)
                kept = []
        if kept:
            yield self._compared(kept)

    def _compared(self, kept: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, need = (np.concatenate(x) for x in zip(*kept))
        a, b = self.shorts[i], self.longs[j]
        scores = self.texts.ratios(a, b, need)
        linked = np.flatnonzero(scores >= self.cutoff)
        return a[linked], b[linked], scores[linked]
