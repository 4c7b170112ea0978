"""Order-insensitive comparison of query results (rows, columns, values)."""

from __future__ import annotations

import math
from typing import Any


def _norm(v: Any) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v)


def canonical(records: list[dict], cols: list[str]) -> list[tuple]:
    return sorted(tuple(_norm(r[c]) for c in cols) for r in records)


def diff(spark_rows: list[dict], spark_cols: list[str],
         oracle_rows: list[dict], oracle_cols: list[str]) -> str | None:
    """None when equal, else a short description of the first difference."""
    if sorted(spark_cols) != sorted(oracle_cols):
        return f"columns differ: {sorted(spark_cols)} vs {sorted(oracle_cols)}"
    cols = sorted(spark_cols)
    a, b = canonical(spark_rows, cols), canonical(oracle_rows, cols)
    if len(a) != len(b):
        return f"row counts differ: {len(a)} vs {len(b)}"
    if a != b:
        sa, sb = set(a), set(b)
        return f"values differ: only spark {list(sa - sb)[:2]}, only oracle {list(sb - sa)[:2]}"
    return None


def duck_records(rel) -> tuple[list[dict], list[str]]:
    cols = rel.columns
    return [dict(zip(cols, r)) for r in rel.fetchall()], cols
