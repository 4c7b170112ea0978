"""starlane: retail order analytics on Spark.

Flat order lines are cleaned, modelled as a star schema with distributed
surrogate keys, and summarised into sales aggregates, KPIs, data marts and
the roll-ups / shares / top-k lists built on them.  Everything is a lazy
DataFrame transformation; the only eager steps are the materialisation
points a user asks for (``materialize``, ``write_tables``).
"""

from starlane.session import get_session, materialize
from starlane.operators.clean import clean_flat
from starlane.operators.star import Star, build_star
from starlane.plans.registry import REPORTS, run, run_all

__all__ = [
    "get_session",
    "materialize",
    "clean_flat",
    "Star",
    "build_star",
    "REPORTS",
    "run",
    "run_all",
]
