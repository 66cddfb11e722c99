"""Word and shingle hashes of a text, computed by numpy over its bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from aislewise.llm.common import give_back

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = bytes(c in b" \t\n\v\f\r" for c in range(256))
PART = 1 << 16       # powers kept; those of longer texts are computed for each


def _cumulative(base: np.uint64, count: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(count - 1, base, dtype=np.uint64)],
                      dtype=np.uint64)


_POWERS, _INVERSES = _cumulative(_BASE, PART), _cumulative(_INVERSE, PART)


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``count`` powers of the base and of its inverse modulo 2**64."""
    if count <= PART:
        return _POWERS[:count], _INVERSES[:count]
    return _cumulative(_BASE, count), _cumulative(_INVERSE, count)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; a bijection."""
    y = x >> np.uint64(30)
    y ^= x
    y *= _M1
    y ^= y >> np.uint64(27)
    y *= _M2
    y ^= y >> np.uint64(31)
    return y


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))  # of each byte


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word."""
    space = np.ones(len(raw) + 2, dtype=bool)
    space[1:-1] = np.frombuffer(raw.translate(_SPACE), bool)
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length, wherever the word stands."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    # Sum of byte * base**(place in word), as a difference of sums over the whole text.
    powers, inverses = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    letters = _BYTES.take(np.frombuffer(raw, np.uint8))
    letters *= powers
    np.cumsum(letters, out=sums[1:])
    found = sums[ends]
    found -= sums[starts]
    found *= inverses[starts]
    for k in np.flatnonzero(ends - starts >= PART):  # powers begin anew every PART bytes
        inside = np.arange(int(ends[k] - starts[k]))
        found[k] = (_BYTES.take(np.frombuffer(raw, np.uint8)[starts[k]:ends[k]]) * (
            _POWERS[inside % PART] + (inside // PART).astype(np.uint64))).sum()
    found += (ends - starts).astype(np.uint64)
    return mixed(found)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; of all words when there are fewer; none for none."""
    n = len(words) - size + 1
    if n < 1:
        size, n = len(words), min(1, len(words))
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = mixed(out * _M1 + words[k:k + n])
    return out


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, at a cost that does not grow with ``size``; none for
    fewer words."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    powers, inverses = _powers(len(words))
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * powers, out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * inverses[:n])


def permutations(count: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of ``count`` hash permutations."""
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 1 << 63, count, dtype=np.uint64))


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def key_runs(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 1 << 17,
             size: int = 16 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches sorted by their first ``keys`` columns to tables of whole runs of equal keys.

    Yields each table with the first row of every run and, last, its number of rows. A table holds
    about ``rows`` rows or ``size`` bytes, or one run if that is longer. Keys are integers.
    """
    held: list[pa.RecordBatch] = []
    count = weight = 0

    def edges(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        new[0] = True
        for k in range(keys):
            column = table.column(k).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        return np.r_[np.nonzero(new)[0], table.num_rows]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count, weight = count + batch.num_rows, weight + batch.nbytes
        if count >= rows or weight >= size:
            table = pa.Table.from_batches(held).combine_chunks()
            starts = edges(table)
            last = int(starts[-2])
            if last:  # the last run may go on in the next batch
                yield table.slice(0, last), starts[:-1]
                rest = table.slice(last)
                held = rest.to_batches()
                count, weight = rest.num_rows, rest.nbytes
            else:
                held = table.to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        held = []
        yield table, edges(table)
        del table
    give_back()
