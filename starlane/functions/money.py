"""Exact money arithmetic.

Sales are summed as ``MONEY`` decimals, so sums do not depend on the order in
which partitions are combined.  Six decimals and fourteen digits before the
point hold any price that a source states to a millionth; a line that does not
fit stops the job instead of vanishing from a sum.  Sums widen to
``decimal(30,6)``, weighted sums to ``decimal(38,6)``.  Nothing is rounded
here; results leave as double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(20,6)"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def money(col: str | Column, kind: str = MONEY) -> Column:
    """A source value as exact money; an error (in ANSI mode or not) when
    ``kind`` cannot hold it."""
    exact = _c(col).try_cast(kind)
    message = F.concat(F.lit(f"money value does not fit {kind}: "), _c(col).cast("string"))
    return F.when(_c(col).isNotNull() & exact.isNull(), F.raise_error(message).cast(kind)).otherwise(exact)


def money_sum(col: str | Column) -> Column:
    """Exact sum of a money column (decimal result)."""
    return F.sum(money(col))


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as double; null when den is 0 or null."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def money_avg(sum_col: str | Column, count_col: str | Column) -> Column:
    """Average from an exact sum and a count."""
    return ratio(sum_col, count_col)


def round_half_away(col: str | Column) -> Column:
    """Round to a whole number, half away from zero, as bigint.

    A plain cast truncates; the warehouse cast rounds.
    """
    return F.round(_c(col), 0).cast("bigint")
