"""Date helpers (T3, T4, DATE_DIFF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: day-first text dates.  Single-letter day and month accept one
# or two digits ("8/11/2017" and "08/11/2017"), as the day-first format of
# the original load does.
DAY_FIRST = "d/M/yyyy"


def parse_day_first(col: str | Column, strict: bool = True) -> Column:
    """Parse day-first text to a date.

    strict: an unparseable value fails the job (ANSI ``to_date``), which is
    the whole-batch failure of the original load.  lenient: it becomes null
    and the caller can quarantine the row.
    """
    c = F.col(col) if isinstance(col, str) else col
    if strict:
        return F.to_date(c, DAY_FIRST)
    return F.try_to_date(c, DAY_FIRST)


def days_between(end: str | Column, start: str | Column) -> Column:
    """Whole days from ``start`` to ``end`` (may be negative), as bigint."""
    e = F.col(end) if isinstance(end, str) else end
    s = F.col(start) if isinstance(start, str) else start
    return F.datediff(e, s).cast("bigint")
