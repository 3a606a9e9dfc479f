"""Predicates of record, log, user and registry searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanset import fixed


def every(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def some(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates)


def contains(c: Column, text: str, ignore_case: bool = False, literal: bool = False) -> Column:
    """``%`` and ``_`` in the text are wildcards unless ``literal``."""
    if literal:
        return F.lower(c).contains(text.lower()) if ignore_case else c.contains(text)
    return c.ilike(f"%{text}%") if ignore_case else c.like(f"%{text}%")


def equals(c: Column, text: str) -> Column:
    return F.lower(c) == F.lower(F.lit(text))


def whole_number(name: str, value: str | int) -> Column:
    try:
        return F.col(name) == F.lit(int(value))
    except ValueError:
        raise ValueError(f"Invalid integer value for parameter '{name}': {value}") from None


def name_contains(text: str) -> Column:
    return contains(F.col("first_name"), text) | contains(F.col("last_name"), text)


def anywhere(text: str, columns: list[str]) -> Column:
    return some([contains(F.col(c), text, ignore_case=True) for c in columns])


def between(name: str, low: str | None, high: str | None) -> Column:
    """Timestamps from ``low`` to ``high``, both included; plain comparisons reach the scan."""
    limits = []
    if low:
        limits.append(F.col(name) >= F.lit(low).cast("timestamp_ntz"))
    if high:
        limits.append(F.col(name) <= F.lit(high).cast("timestamp_ntz"))
    return every(limits)


def lacks(name: str, dashes: bool = False) -> Column:
    blank = ["", "--"] if dashes else [""]
    return F.col(name).isNull() | F.col(name).isin(blank)


def log_kind(kind: str, action: str = "action") -> Column:
    return some([F.col(action).like(p) for p in fixed.LOG_FILTERS[kind]])


def days(name: str, first: str | None, last: str | None) -> Column:
    """Whole days from ``first`` to ``last``, as a range on the timestamp itself."""
    limits = []
    if first:
        limits.append(F.col(name) >= F.lit(first).cast("timestamp_ntz"))
    if last:
        limits.append(F.col(name) < (F.lit(last).cast("date") + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz"))
    return every(limits)


def user_filter(name: str | None = None, role: str | None = None, active: bool | None = None) -> Column:
    limits = []
    if name:
        limits.append(contains(F.col("username"), name))
    if role:
        limits.append(F.col("role") == role)
    if active is not None:
        limits.append(F.col("is_active") == int(active))
    return every(limits)


USER_ORDERS = {
    "username_asc": [F.asc, "username"],
    "username_desc": [F.desc, "username"],
    "newest": [F.desc, "id"],
    "oldest": [F.asc, "id"],
    "role": [F.asc, "role"],
}


def user_order(mode: str) -> list[Column]:
    direction, column = USER_ORDERS.get(mode, USER_ORDERS["username_asc"])
    return [direction(column), F.asc("id")]
