"""Bucketing helpers for the dashboard-side summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frequency_bucket(col: str | Column) -> Column:
    """Order-frequency bucket: exactly 1 -> "1", <=2 -> "1-2", <=3 -> "2-3",
    anything else, including null, -> "3+"."""
    x = F.col(col) if isinstance(col, str) else col
    return (
        F.when(x.isNull(), F.lit("3+"))
        .when(x == 1, F.lit("1"))
        .when(x <= 2, F.lit("1-2"))
        .when(x <= 3, F.lit("2-3"))
        .otherwise(F.lit("3+"))
    )


def equal_width_bin(x: str | Column, lo: Column, hi: Column, bins: int) -> Column:
    """1-based bin of ``x`` among ``bins`` equal-width bins over [lo, hi].

    The maximum falls into the last bin; when lo == hi everything is bin 1.
    """
    v = F.col(x) if isinstance(x, str) else x
    width = hi.cast("double") - lo.cast("double")
    raw = F.floor((v.cast("double") - lo.cast("double")) * float(bins) / width) + 1
    return F.when(width == 0, F.lit(1).cast("bigint")).otherwise(
        F.least(raw.cast("bigint"), F.lit(bins).cast("bigint"))
    )
