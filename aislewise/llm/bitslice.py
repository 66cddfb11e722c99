"""Bit-sliced Hamming comparison inside one task.

Fingerprints are stored vertically: plane ``p`` holds bit ``p`` of 64 fingerprints in one word.
A query flips the planes it has set, and the differing bits of 64 pairs are counted at once with
carry-save adders. The counters saturate into an ``over`` word; a block whose ``over`` words are
full has no pair left within the radius and is abandoned.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
ONE = np.uint64(1)
BITS = 64
CHECK = 9             # planes between two looks at the ``over`` words
COLUMNS = 16384       # fingerprints per block of a long run
QUERIES = 64          # queries that go through a block together
CELLS = 1 << 19       # bit cells unpacked at a time


class Counter:
    """Vertical counters with carry-save addition; ``over``: past the largest count they hold."""

    def __init__(self, over: np.ndarray, radius: int):
        self.radius, self.over = radius, over
        self.level = [np.zeros_like(over) for _ in range(max(1, radius.bit_length()))]

    def _add(self, word: np.ndarray, level: int) -> None:
        for k in range(level, len(self.level)):
            carry = self.level[k] & word
            self.level[k] = self.level[k] ^ word
            word = carry
        self.over = self.over | word

    def add(self, planes: list[np.ndarray]) -> None:
        """Up to three planes: one full adder, then its sum and its carry join the counters."""
        a, b, c = planes + [np.uint64(0)] * (3 - len(planes))
        half = a ^ b
        self._add(half ^ c, 0)
        self._add((a & b) | (c & half), 1) if len(self.level) > 1 else self._overflow(a, b, c)

    def _overflow(self, a, b, c) -> None:
        self.over = self.over | (a & b) | (c & (a ^ b))

    def keep(self, rows: np.ndarray) -> None:
        self.over, self.level = self.over[rows], [x[rows] for x in self.level]

    def within(self) -> np.ndarray:
        more, same = np.zeros_like(self.over), np.full_like(self.over, FULL)
        for k in reversed(range(len(self.level))):
            if self.radius >> k & 1:
                same = same & self.level[k]
            else:
                more, same = more | (same & self.level[k]), same & ~self.level[k]
        return ~(self.over | more)


def _mask(values: np.ndarray, bit: int) -> np.ndarray:
    """All ones where the bit is set."""
    return np.uint64(0) - ((values >> np.uint64(bit)) & ONE)


def _bits(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), axis=-1, bitorder="little")


def _short_runs(fps: np.ndarray, sizes: np.ndarray, radius: int):
    """(run, first, second) of the pairs within radius; fps (runs, width <= 64), padded."""
    runs, width = fps.shape
    columns = np.arange(width, dtype=np.uint64)
    planes = np.empty((runs, BITS), dtype=np.uint64)
    for b in range(BITS):
        planes[:, b] = (((fps >> np.uint64(b)) & ONE) << columns).sum(axis=1, dtype=np.uint64)
    # A pair counts once, as (earlier, later); pads and queries past the end count as over.
    later = np.array([FULL << np.uint64(i + 1) if i < 63 else 0 for i in range(width)],
                     dtype=np.uint64)
    real = np.where(sizes >= 64, FULL, (ONE << sizes.astype(np.uint64)) - ONE)
    over = ~(later[None, :] & real[:, None])
    over[np.arange(width)[None, :] >= sizes[:, None]] = FULL
    counter, alive = Counter(over, radius), np.arange(runs)
    for start in range(0, BITS, 3):
        counter.add([planes[:, b][:, None] ^ _mask(fps, b) for b in range(start, min(start + 3, BITS))])
        if start % CHECK == 0 and start:
            open_runs = (counter.over != FULL).any(axis=1)
            if open_runs.sum() * 2 < len(open_runs):  # abandon the runs without a pair left
                counter.keep(open_runs)
                planes, fps, alive = planes[open_runs], fps[open_runs], alive[open_runs]
                if not len(alive):
                    break
    run, query, column = np.nonzero(_bits(counter.within()[..., None]))
    return alive[run], query, column


def _long_run(fps: np.ndarray, radius: int, join) -> None:
    """Call ``join(first, second)`` with the pairs of one run within radius, block by block."""
    n = len(fps)
    for low in range(0, n, COLUMNS):
        block = fps[low:low + COLUMNS]
        words = -(-len(block) // 64)
        padded = np.zeros(words * 64, dtype=np.uint64)
        padded[:len(block)] = block
        planes = np.packbits(
            ((padded[None, :] >> np.arange(BITS, dtype=np.uint64)[:, None]) & ONE).astype(np.uint8),
            axis=1, bitorder="little").view(np.uint64)
        live = [b for b in range(BITS) if ((fps ^ fps[0]) >> np.uint64(b) & ONE).any()]
        place = low + np.arange(words * 64)
        for start in range(0, min(n, low + len(block)), QUERIES):
            queries = fps[start:start + QUERIES]
            closed = (place[None, :] <= start + np.arange(len(queries))[:, None]) | (
                place >= n)[None, :]
            over = np.packbits(closed, axis=1, bitorder="little").view(np.uint64)
            counter = Counter(over, radius)
            for k in range(0, len(live), 3):
                counter.add([planes[b][None, :] ^ _mask(queries, b)[:, None]
                             for b in live[k:k + 3]])
                if k % CHECK == 0 and (counter.over == FULL).all():
                    break
            query, column = np.nonzero(_bits(counter.within()))
            if len(query):
                join(start + query, low + column)


def spanning_links(run_starts: np.ndarray, fps: np.ndarray, radius: int):
    """Links (row, row) that span the components of each run of distinct fingerprints.

    ``run_starts`` holds the first row of every run and, last, the number of rows. No pair
    within the radius is missed; of a component of m rows m - 1 links come out.
    """
    label = np.arange(len(fps))

    def join(first: np.ndarray, second: np.ndarray) -> None:
        while True:
            a, b = label[first], label[second]
            apart = a != b
            if not apart.any():
                return
            first, second, a, b = first[apart], second[apart], a[apart], b[apart]
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label[label] != label).any():
                label[:] = label[label]

    sizes, starts = np.diff(run_starts), run_starts[:-1]
    for least, width in pairwise((1, 2, 4, 8, 16, 32, 64)):
        chosen = np.nonzero((sizes > least) & (sizes <= width))[0]
        step = max(1, CELLS // (width * 64))
        for k in range(0, len(chosen), step):
            runs = chosen[k:k + step]
            rows = np.minimum(starts[runs][:, None] + np.arange(width)[None, :], len(fps) - 1)
            run, first, second = _short_runs(fps[rows], sizes[runs], radius)
            if len(run):
                join(starts[runs][run] + first, starts[runs][run] + second)
    for run in np.nonzero(sizes > 64)[0]:
        base = starts[run]
        _long_run(fps[base:base + sizes[run]], radius,
                  lambda a, b, base=base: join(base + a, base + b))
    moved = np.nonzero(label != np.arange(len(fps)))[0]
    return label[moved], moved
