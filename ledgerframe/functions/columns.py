"""Column-expression helpers (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(mapping: Mapping, key: Column) -> Column:
    """Value of ``key`` in a small fixed mapping, as a map literal (no join)."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*pairs), key) if pairs else F.lit(None)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den in double; NULL when den is 0 or either side is NULL."""
    return F.try_divide(num.cast("double"), F.nullif(den.cast("double"), F.lit(0.0)))


def growth_pct(cur: Column, prev: Column) -> Column:
    """(cur - prev) / NULLIF(prev, 0) * 100, in double."""
    return safe_ratio(cur.cast("double") - prev.cast("double"), prev) * F.lit(100.0)


def within_rel_tol(a: Column, b: Column, rel_tol: float) -> Column:
    """abs(a-b) <= rel_tol * max(abs(a), abs(b)); NaN never matches."""
    a = a.cast("double")
    b = b.cast("double")
    ok = F.abs(a - b) <= F.lit(rel_tol) * F.greatest(F.abs(a), F.abs(b))
    return ok & ~F.isnan(a) & ~F.isnan(b)
