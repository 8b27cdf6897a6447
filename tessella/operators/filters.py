"""Filter operators: one column condition each."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SemanticError

#: Other spellings of the operators.
ALIASES = {"=": "equals", "!=": "notequals", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte", "in": "inlist", "not_in": "notinlist", "is_null": "notset", "is_not_null": "set"}


def name_of(op: str) -> str:
    return ALIASES.get(op.lower(), op.lower())


def literal(value: Any, kind: str = "") -> Column:
    """A value as the column's type has it: dates and times are written as text."""
    out = F.lit(value)
    if kind in ("date", "timestamp", "timestamp_tz") and isinstance(value, str):
        return out.cast({"date": "date", "timestamp": "timestamp_ntz"}.get(kind, "timestamp"))
    return out


def _likely(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def _each(value: Any) -> list:
    return list(value) if isinstance(value, (list, tuple)) else [value]


def relative(c: Column, value: dict) -> Column:
    """Within ``count`` units up to or from today: half-open, whole days."""
    unit, count = str(value.get("unit", "")).lower(), value.get("count")
    if unit not in ("day", "week", "month", "year") or not isinstance(count, int) or count < 1:
        raise SemanticError("FILTER_VALUE", "relative needs a unit (day, week, month, year) and a count above 0")
    past, current = value.get("direction", "past") == "past", value.get("include_current", True)
    today = F.current_date()

    def moved(day: Column, n: int) -> Column:
        return F.date_add(day, n * {"day": 1, "week": 7}[unit]) if unit in ("day", "week") else F.add_months(day, n * {"month": 1, "year": 12}[unit])

    if past:
        end = F.date_add(today, 1) if current else today
        start = moved(end, -count)
    else:
        start = today if current else F.date_add(today, 1)
        end = moved(start, count)
    return (c >= start) & (c < end)


def condition(op: str, c: Column, value: Any = None, kind: str = "") -> Column:
    """The condition of an operator on a column; ``kind`` is the column's declared type."""
    op = name_of(op)
    lit = lambda v: literal(v, kind)
    if op in ("equals", "notequals", "gt", "gte", "lt", "lte"):
        v = lit(value)
        return {"equals": c == v, "notequals": c != v, "gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[op]
    if op in ("inlist", "notinlist"):
        found = c.isin(*map(lit, _each(value)))
        return found if op == "inlist" else ~found
    if op in ("set", "notset"):
        return c.isNotNull() if op == "set" else c.isNull()
    if op in ("contains", "notcontains"):
        found = c.contains(F.lit(str(value)))
        return found if op == "contains" else ~found
    if op in ("starts_with", "ends_with"):
        return c.startswith(F.lit(str(value))) if op == "starts_with" else c.endswith(F.lit(str(value)))
    if op in ("like", "notlike"):
        return c.like(str(value)) if op == "like" else ~c.like(str(value))
    if op in ("between", "notbetween"):
        if not isinstance(value, (list, tuple)) or len(value) != 2:
            return condition("equals" if op == "between" else "notequals", c, value, kind)
        found = c.between(lit(value[0]), lit(value[1]))
        return found if op == "between" else ~found
    if op in ("regex", "notregex"):
        return c.rlike(str(value)) if op == "regex" else ~c.rlike(str(value))
    if op in ("blank", "notblank"):
        found = c.isNull() | (F.trim(c.cast("string")) == "")
        return found if op == "blank" else ~found
    if op in ("length_eq", "length_gt", "length_lt"):
        if not isinstance(value, int):
            raise SemanticError("FILTER_VALUE", f"{op} needs a whole number")
        n = F.length(c)
        return {"length_eq": n == value, "length_gt": n > value, "length_lt": n < value}[op]
    if op == "relative":
        return relative(c, value)
    raise SemanticError("UNKNOWN_OPERATOR", f"no filter operator is called {op!r}")
