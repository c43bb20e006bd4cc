"""Lane x section matrices built from, and taken apart into, cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANNELS = ("vel", "dens", "acc")  # fixed order of the feature channels


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often ``body`` reads it."""
    return F.transform(F.array(value), body)[0]


def cell_entry(lane: Column, section: Column, payload: Column, lanes: int, sections: int) -> Column:
    """Map entry of one cell, NULL outside the grid so that ``collect_list`` leaves it out.

    Section ``sections`` is kept as an overflow column: :func:`grid` lays it over the last one.
    """
    inside = lane.between(1, lanes) & section.between(0, sections)
    key = lane * F.lit(sections + 1) + section
    return F.when(inside, F.struct(key.alias("key"), payload.alias("value")))


def grid(entries: Column, default: Column, lanes: int, sections: int) -> Column:
    """Dense ``lanes`` x ``sections`` matrix of the payloads in ``entries``.

    ``entries`` holds at most one :func:`cell_entry` per lane and section. A missing cell takes
    ``default``; a value past the last section replaces that section's own.
    """
    stride = F.lit(sections + 1)

    def row(cells: Column, lane: Column) -> Column:
        def cell(section: Column) -> Column:
            past_end = F.try_element_at(cells, lane * stride + F.lit(sections))
            own = F.try_element_at(cells, lane * stride + section)
            return F.coalesce(F.when(section == sections - 1, past_end), own, default)

        return F.transform(F.sequence(F.lit(0), F.lit(sections - 1)), cell)

    return let(
        F.map_from_entries(entries),
        lambda cells: F.transform(
            F.sequence(F.lit(1), F.lit(lanes)), lambda lane: row(cells, lane)
        ),
    )


def channel(matrix: Column, name: str) -> Column:
    """One feature of a matrix, flattened lane by lane to ``lanes * sections`` values."""
    return F.transform(F.flatten(matrix), lambda cell: cell[name])


def channels_last(matrix: Column) -> Column:
    """``(lanes, sections, 3)`` doubles in the order of :data:`CHANNELS`."""
    return F.transform(
        matrix,
        lambda row: F.transform(
            row, lambda cell: F.array(*[cell[c].cast("double") for c in CHANNELS])
        ),
    )


def unflatten(values: Column, lanes: int, sections: int) -> Column:
    """The inverse of :func:`channel`: rows of ``sections`` values."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(lanes - 1)),
        lambda lane: F.slice(values, lane * F.lit(sections) + F.lit(1), F.lit(sections)),
    )


def lane_of(position: Column, sections: int) -> Column:
    """1-based lane of a position in a flattened matrix."""
    return F.floor(position / F.lit(sections)).cast("int") + F.lit(1)


def section_of(position: Column, sections: int) -> Column:
    return F.pmod(position, F.lit(sections)).cast("int")
