"""Logical types, column roles and PII flags."""

from __future__ import annotations

import re

from pyspark.sql import types as T

MEASURE, DIMENSION, TIME, IDENTIFIER, TEXT, UNKNOWN = "MEASURE", "DIMENSION", "TIME", "IDENTIFIER", "TEXT", "UNKNOWN"
NUMERIC = ("int64", "float64")

# fixed values: the name parts that decide roles and PII
TIME_PARTS = {"date", "time", "day", "month", "year", "quarter", "timestamp", "created", "updated", "dt", "period"}
ID_PARTS = {"id", "key", "code", "uuid", "pk", "fk", "index", "no", "number"}
PII_PARTS = {"email", "phone", "ssn", "address", "passport", "credit_card", "ip_address", "name"}
# fixed values: cardinalities that decide roles
MEASURE_RATE, FEW_NUMBERS, TEXT_RATE, FEW_TEXTS = 0.5, 20, 0.8, 100


def logical(kind: T.DataType) -> str:
    """int64, float64, bool, datetime64, object; ``interval`` and ``nested`` can't be queried."""
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.IntegralType):
        return "int64"
    if isinstance(kind, T.FractionalType):
        return "float64"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime64"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "object"
    if isinstance(kind, (T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType)):
        return "interval"
    return "nested"


def name_parts(name: str) -> list[str]:
    return re.split(r"[_\-\s]+", name.lower().strip())


def pii_risk(name: str) -> bool:
    """By the name's parts, and by adjoining parts for the entries that hold an underscore."""
    parts = name_parts(name)
    return bool(PII_PARTS & {*parts, *("_".join(p) for p in zip(parts, parts[1:]))})


def role_of(name: str, dtype: str, n_unique: int, unique_rate: float, key_suffixes: bool = False) -> str:
    """The role by name, type and cardinality; ``key_suffixes`` also takes parts such as ``...key`` and ``...id`` for keys."""
    parts = set(name_parts(name))
    if dtype == "datetime64" or parts & TIME_PARTS:
        return TIME
    if parts & ID_PARTS or key_suffixes and any(p.endswith(("key", "id")) for p in parts):
        return IDENTIFIER
    if dtype in NUMERIC:
        varied = unique_rate > MEASURE_RATE and n_unique > FEW_NUMBERS
        return MEASURE if varied or n_unique > FEW_NUMBERS else DIMENSION
    if dtype == "object":
        return TEXT if unique_rate > TEXT_RATE and n_unique > FEW_TEXTS else DIMENSION
    return DIMENSION if dtype == "bool" else UNKNOWN
