"""Filters, time derivation, aggregates and ordering as pure column functions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PlanError(ValueError):
    """A step that can't be carried out, with the reason."""


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def literal(value: Any, kind: T.DataType) -> Column:
    """The literal in the column's type, so that no comparison casts the column."""
    if isinstance(value, (list, tuple, dict, set)):
        raise PlanError(f"{value!r} is no single value")
    if value is None or isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.lit(value)
    if isinstance(kind, (T.IntegralType, T.FractionalType)):
        try:
            number = float(value) if not isinstance(value, bool) else float(int(value))
        except (TypeError, ValueError):
            raise PlanError(f"{value!r} is no number") from None
        return F.lit(int(value)) if isinstance(value, int) or number.is_integer() and abs(number) < 2**53 else F.lit(number)
    if isinstance(kind, T.BooleanType):
        if str(value).lower() not in ("true", "false", "1", "0"):
            raise PlanError(f"{value!r} is no truth value")
        return F.lit(str(value).lower() in ("true", "1"))
    return F.lit(str(value)).try_cast(kind)


def condition(col: Column, kind: T.DataType, op: str, value: Any = None) -> Column:
    """The predicate ``col op value``.

    A list means membership (``NOT IN`` and ``!=`` its complement), ``between`` needs two bounds, null with ``=``,
    ``IS`` or ``IN`` tests for null and with any other operator for its absence. Unknown operators are an error.
    """
    op = " ".join(str(op).upper().split())
    many = isinstance(value, (list, tuple, set))
    if op == "IS NULL" or value is None and op in ("=", "==", "IS", "IN"):
        return col.isNull()
    if op == "IS NOT NULL" or value is None:
        return col.isNotNull()
    if op == "BETWEEN":
        if not many or len(value) != 2:
            raise PlanError("between needs two bounds")
        low, high = value
        return col.between(literal(low, kind), literal(high, kind))
    if many or op in ("IN", "NOT IN"):
        values = list(value) if many else [value]
        inside = col.isin(*(literal(v, kind) for v in values)) if values else F.lit(False)
        return ~inside if op in ("NOT IN", "!=", "<>") else inside
    if op in ("LIKE", "NOT LIKE"):
        found = col.cast("string").like(str(value))
        return found if op == "LIKE" else ~found
    right = literal(value, kind)
    tests = {
        "=": lambda: col == right, "==": lambda: col == right, "!=": lambda: col != right, "<>": lambda: col != right,
        ">": lambda: col > right, "<": lambda: col < right, ">=": lambda: col >= right, "<=": lambda: col <= right,
        "IS": lambda: col.eqNullSafe(right), "IS NOT": lambda: ~col.eqNullSafe(right),
    }
    if op not in tests:
        raise PlanError(f"unknown operator {op}")
    return tests[op]()


def year_condition(col: Column, kind: T.DataType, op: str, value: Any) -> Column | None:
    """``year(col) op value`` as bounds on the column itself, which a scan can prune by; None where it can't be said so."""
    if not isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return None
    try:
        years = [int(v) for v in (value if isinstance(value, (list, tuple)) else [value])]
    except (TypeError, ValueError):
        return None
    if any(not 1 <= y < 9999 for y in years) or any(isinstance(v, float) and not v.is_integer() for v in (value if isinstance(value, (list, tuple)) else [value])):
        return None
    start = lambda y: F.lit(f"{y:04d}-01-01").cast(kind)
    op, y = " ".join(str(op).upper().split()), years[0]
    if op == "BETWEEN" and len(years) == 2:
        return (col >= start(y)) & (col < start(years[1] + 1))
    if len(years) != 1:
        return None
    tests = {"=": lambda: (col >= start(y)) & (col < start(y + 1)), "==": lambda: (col >= start(y)) & (col < start(y + 1)), ">": lambda: col >= start(y + 1),
             ">=": lambda: col >= start(y), "<": lambda: col < start(y), "<=": lambda: col < start(y + 1)}
    return tests[op]() if op in tests else None


def derive_time(col: Column, unit: str) -> Column:
    """A part of a date; texts that are no dates give null. Other units give the value as text."""
    day = col.try_cast("date")
    parts = {"year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "day": F.dayofmonth}
    return parts[unit.lower()](day) if unit.lower() in parts else col.cast("string")


AGGREGATES = {
    "sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max, "median": F.median, "count_distinct": F.count_distinct,
    "stddev": F.stddev_samp,
}


def aggregate(col: Column, func: str) -> Column:
    """Sum, avg, count (of non-nulls), min, max, exact median, count_distinct; an unknown function is an error."""
    if func.lower() not in AGGREGATES:
        raise PlanError(f"unknown aggregate {func}")
    return AGGREGATES[func.lower()](col)


def ordering(col: Column, order: str = "desc") -> Column:
    """Nulls last either way; anything but ``asc`` is descending."""
    return col.asc_nulls_last() if str(order).lower() == "asc" else col.desc_nulls_last()


def join_type(name: str | None) -> str:
    """LEFT for unknown names."""
    return {"LEFT": "left", "RIGHT": "right", "INNER": "inner", "OUTER": "full", "FULL": "full", "CROSS": "cross", "SEMI": "left_semi", "ANTI": "left_anti"}.get(
        str(name or "LEFT").upper().removesuffix(" JOIN"), "left"
    )
