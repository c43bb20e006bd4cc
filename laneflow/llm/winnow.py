"""Content-defined places that equal windows of two texts share.

Of all grams of ``k`` codes inside a window of ``width`` codes the one with the least hash (the
leftmost of several) is the window's anchor. Equal windows have equal anchors at equal places, so
repeated windows are found by comparing only windows of one anchor. Consecutive windows with one
anchor form a segment; there are about ``2 / (width - k + 2)`` segments a code.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from laneflow.llm import arrays

PLACE_BITS = 24


class Segments(NamedTuple):
    row: np.ndarray  # row in the piece
    anchor: np.ndarray  # hash of the anchor gram
    lead: np.ndarray  # codes from the first window's start to the anchor
    first: np.ndarray  # first window's start, from the row's start
    count: np.ndarray  # windows


def segments(codes: np.ndarray, bounds: np.ndarray, width: int, k: int, runs: arrays.Runs | None = None) -> Segments:
    """Segments of the rows ``codes[bounds[i]:bounds[i + 1]]``; windows never cross a row."""
    runs = runs or arrays.Runs(codes)
    found = [
        _segments(runs, bounds, width, k, lo, hi)
        for lo in range(0, max(1, len(codes)), (1 << PLACE_BITS) - width)
        for hi in [min(len(codes), lo + (1 << PLACE_BITS))]
    ]
    return found[0] if len(found) == 1 else Segments(*map(np.concatenate, zip(*found, strict=True)))


def _segments(runs: arrays.Runs, bounds: np.ndarray, width: int, k: int, lo: int, hi: int) -> Segments:
    n = hi - lo - width + 1
    if n <= 0:
        return Segments(*(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64)))
    grams = np.arange(lo, hi - k + 1)
    hashes = runs.hashes(grams, grams + k)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    place = (grams - lo).astype(np.uint64)
    anchor = (arrays.sliding_min((hashes & ~mask) | place, width - k + 1) & mask).astype(np.int64)
    rows = np.searchsorted(bounds, np.arange(lo, lo + n), side="right") - 1
    valid = bounds[rows + 1] - np.arange(lo, lo + n) >= width
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1])
    starts = np.flatnonzero(new & valid)
    edges = np.append(np.flatnonzero(new | ~valid), n)
    ends = edges[np.searchsorted(edges, starts, side="right")]
    at = anchor[starts]
    return Segments(rows[starts], hashes[at], at - starts, starts + lo - bounds[rows[starts]], ends - starts)
