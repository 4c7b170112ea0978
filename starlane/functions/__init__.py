"""Column-level helpers: all built from pyspark.sql.functions, so they stay
inside whole-stage codegen (no Python UDFs)."""

from starlane.functions.dates import days_between, parse_day_first
from starlane.functions.money import (
    MONEY,
    money,
    money_avg,
    money_sum,
    ratio,
    round_half_away,
)
from starlane.functions.buckets import equal_width_bin, frequency_bucket

__all__ = [
    "days_between",
    "parse_day_first",
    "MONEY",
    "money",
    "money_avg",
    "money_sum",
    "ratio",
    "round_half_away",
    "equal_width_bin",
    "frequency_bucket",
]
