"""Array helpers for texts inside Arrow batches: whole batches of UTF-8 bytes, no per-row loops.

A *piece* is a run of rows of one Arrow batch with a bounded number of text bytes (one row may
exceed the bound; it is then a piece of its own). All functions are pure and work on numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: One fixed random 64-bit value per byte value.
BYTE_CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def pieces(
    batch: pa.RecordBatch, column: str = "text", most_bytes: int = PIECE_BYTES
) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of the text column; nulls are empty texts. Offsets start at 0."""
    texts = batch.column(column).cast(pa.large_binary())
    lengths = texts.fill_null(b"")
    if len(lengths) == 0:
        return
    buffers = lengths.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[lengths.offset : lengths.offset + len(lengths) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    start = 0
    while start < len(lengths):
        stop = int(np.searchsorted(offsets, offsets[start] + most_bytes, side="right")) - 1
        stop = min(max(stop, start + 1), len(lengths))
        base = offsets[start]
        yield slice(start, stop), data[base : offsets[stop]], offsets[start : stop + 1] - base
        start = stop


def words(
    data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACES
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words before each row (rows + 1).

    A word is a maximal run of bytes that aren't ``between`` words: by default space, tab, line feed,
    vertical tab, form feed and carriage return. No word crosses a row.
    """
    inside = ~between[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Runs:
    """Hashes of any run of a sequence of 64-bit codes in constant time each."""

    def __init__(self, codes: np.ndarray):
        self.down = powers(INVERSE, len(codes))
        sums = powers(MULTIPLIER, len(codes))[:-1]
        sums *= codes
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(sums, out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Equal runs have equal hashes, wherever they are."""
        out = self.sums[ends] - self.sums[starts]
        out *= self.down[starts]
        out += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix(out)

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all windows of k codes, by start."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = self.sums[k:] - self.sums[:n]
        out *= self.down[:n]
        return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by its start."""
    if len(values) < width:
        return values[:0]
    out, done = values, 1
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All members of the given ranges, one after another."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    if not total:
        return out
    out[0] = starts[0]
    at = np.cumsum(lengths[:-1])
    out[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the half-open ranges."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0
