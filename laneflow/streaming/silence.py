"""Windows that a site was silent in, on a stream.

An aggregate has no row for a window without data, so a history over it would be short. This stage
knows, per site, which window comes next: it adds the missing ones as soon as the watermark has
passed them, whether or not the site ever reports again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from laneflow.config import SiteConfig

PLACED = "location string, start long, matrix array<array<array<int>>>"
EXPECTED = "start long, until long"
FOREVER = 1 << 62


class SilentWindows(StatefulProcessor):
    """Passes a site's windows on, with a row without a matrix for each window that it is silent in.

    The state of a site is two numbers: the start of the next window, and the end of its patience.
    Windows arrive once the watermark has passed them, so a batch never brings one from before the
    windows of an earlier batch; inside a batch they come in any order.
    """

    def __init__(self, window_ms: int, patience: int | None):
        self.window_ms, self.patience = window_ms, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expected = handle.getValueState("expected", EXPECTED)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seen = set()
        for row in rows:
            seen.add(row.start)
            yield Row(location=row.location, start=row.start, matrix=row.matrix)
        expected = self.expected.get()
        for start in sorted(seen):
            if expected:
                yield from self._silent(key, expected[0], min(start, expected[1]))
            expected = self._after(start)
        self._expect(*expected)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        start, until = self.expected.get()
        whole = (timerValues.getCurrentWatermarkInMs() - start) // self.window_ms
        end = min(start + whole * self.window_ms, until)
        yield from self._silent(key, start, end)
        if end < until:
            self._expect(end, until)
        else:
            self.expected.clear()

    def close(self) -> None:
        pass

    def _silent(self, key: tuple, start: int, end: int) -> Iterator[Row]:
        for at in range(start, end, self.window_ms):
            yield Row(location=key[0], start=at, matrix=None)

    def _after(self, start: int) -> tuple[int, int]:
        ahead = start + self.window_ms
        return ahead, FOREVER if self.patience is None else ahead + self.patience * self.window_ms

    def _expect(self, start: int, until: int) -> None:
        """Wake up when the window from ``start`` on is over; a site has one timer at most."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if start < until:
            self.expected.update((start, until))
            self.handle.registerTimer(start + self.window_ms)
        else:
            self.expected.clear()


def empty_speeds(site: SiteConfig, with_ramp: bool) -> Column:
    """The matrix of a window without data, as :func:`stages.window_matrices` lays it out."""
    cell = F.array(F.lit(site.default_speed))
    return F.array_repeat(F.array_repeat(cell, site.sections), site.lanes(with_ramp))


def filled_matrices(
    matrices: DataFrame, site: SiteConfig, with_ramp: bool, window_ms: int, patience: int | None = None
) -> DataFrame:
    """Window matrices with the default one for each window that a site is silent in.

    Windows are filled from a site's first one up to the watermark; with a ``patience`` at most so many
    in a row, then the site counts as gone until it reports again. What comes out doesn't depend on
    how the messages fell into batches. Rows of an unknown site (NULL) are a site of their own.
    The session needs the RocksDB state store (``session.timer_state``).
    """
    placed = matrices.withColumn("start", F.unix_millis("timewindow.start"))
    filled = placed.groupBy("location").transformWithState(
        SilentWindows(window_ms, patience), PLACED, "append", "eventTime"
    )
    ends = [F.timestamp_millis(F.col("start") + F.lit(ms)) for ms in (0, window_ms)]
    window = F.struct(ends[0].alias("start"), ends[1].alias("end"))
    matrix = F.coalesce("matrix", empty_speeds(site, with_ramp))
    return filled.select("location", window.alias("timewindow"), matrix.alias("matrix"))
