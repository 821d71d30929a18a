"""Column predicates with the warehouse's exact semantics.

All are plain Catalyst expressions on source columns, so the comparisons
reach the Parquet reader as pushed filters.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts_lit(value: str) -> Column:
    """A wall-clock timestamp literal ('2018-06-01' means midnight)."""
    return F.lit(value).cast("timestamp_ntz")


def ts_between(col: str | Column, start: str, end: str) -> Column:
    """Inclusive ``BETWEEN`` on a timestamp.

    A date-only ``end`` is midnight, so almost all of the end day is outside
    the window; this is the warehouse behaviour and is kept.
    """
    c = F.col(col) if isinstance(col, str) else col
    return c.between(ts_lit(start), ts_lit(end))


def exclude_dates(col: str, dates: Iterable[str], mode: str = "instant") -> Column:
    """Drop rows on the given dates.

    ``instant`` (faithful): ``ts <> 'YYYY-MM-DD'`` removes only the exact
    midnight instant.  ``day``: removes the whole calendar day.  NULL
    timestamps are dropped in both modes, as ``<>`` on NULL is not true.
    """
    dates = list(dates)
    c = F.col(col)
    cond = c.isNotNull()
    if mode == "instant":
        for d in dates:
            cond = cond & (c != ts_lit(d))
    elif mode == "day":
        if dates:
            cond = cond & ~F.to_date(c).isin([F.lit(d).cast("date") for d in dates])
    else:
        raise ValueError(f"unknown exclude mode {mode!r}")
    return cond


def is_true(col: str) -> Column:
    """``col = True``: NULL is not true."""
    return F.col(col) == F.lit(True)


def is_false(col: str) -> Column:
    """``col = False``: NULL is not false."""
    return F.col(col) == F.lit(False)


def not_in(col: str | Column, values: Iterable) -> Column:
    """``col NOT IN (values)``: a NULL ``col`` does not pass."""
    c = F.col(col) if isinstance(col, str) else col
    values = list(values)
    if not values:
        return c.isNotNull()
    return c.isNotNull() & ~c.isin(values)
