"""The portable scalar functions: one meaning each, whatever Spark's own function of that name does."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SemanticError

#: Time units, the longest first.
UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")


def unit(name: str) -> str:
    low = str(name).lower()
    if low not in UNITS:
        raise SemanticError("UNKNOWN_UNIT", f"{name!r} is not one of {', '.join(UNITS)}")
    return low


def date_trunc(unit: str, x: Column, week_start: str = "monday") -> Column:
    """The start of the unit that holds x, as a timestamp without zone."""
    naive = x.cast("timestamp_ntz")
    if unit == "week" and week_start == "sunday":
        day = naive.cast("date")
        return F.date_sub(day, F.dayofweek(day) - 1).cast("timestamp_ntz")
    return F.date_trunc(unit, naive).cast("timestamp_ntz")


def grain_of(unit: str, x: Column, is_date: bool, week_start: str = "monday") -> Column:
    """A dimension's time grain: a date for days and longer where the column is a date."""
    out = date_trunc(unit, x, week_start)
    return out.cast("date") if is_date and unit in UNITS[:5] else out


def interval(unit: str, n: Column) -> Column:
    n = n.cast("int")
    if unit in ("year", "quarter", "month"):
        return F.make_ym_interval(F.lit(0), n * {"year": 12, "quarter": 3, "month": 1}[unit])
    zero = F.lit(0)
    parts = {"week": (n * 7, zero, zero, zero), "day": (n, zero, zero, zero), "hour": (zero, n, zero, zero), "minute": (zero, zero, n, zero), "second": (zero, zero, zero, n)}
    return F.make_dt_interval(*parts[unit])


def date_add(unit: str, n: Column, x: Column) -> Column:
    """x moved by n units, as a timestamp without zone; ends of months are clipped."""
    return x.cast("timestamp_ntz") + interval(unit, n)


def date_diff(unit: str, start: Column, end: Column, week_start: str = "monday") -> Column:
    """How many unit boundaries lie between start and end."""
    return F.timestamp_diff(unit.upper(), date_trunc(unit, start, week_start), date_trunc(unit, end, week_start))


def extract(unit: str, x: Column) -> Column:
    return F.extract(F.lit(unit), x.cast("timestamp_ntz")).cast("int")


def trunc(x: Column, n: Column | None = None) -> Column:
    """Toward zero, in decimal arithmetic so that 2.3 keeps its digits; doubles beyond 10^18 have none behind the point."""
    n = F.lit(0) if n is None else n
    scale, near = F.power(F.lit(10), n), F.abs(x.cast("double")) < 1e18
    exact = (F.abs(x).try_cast("decimal(38,12)") * scale.try_cast("decimal(18,6)")).try_cast("decimal(38,9)")
    cut = F.coalesce(F.when(near, F.floor(exact).cast("double")), F.abs(x.cast("double")) * scale)
    return F.sign(x.cast("double")) * cut / scale


def logarithm(base: Column, x: Column) -> Column:
    return F.when((base > 0) & (base != 1) & (x > 0), F.ln(x.cast("double")) / F.ln(base.cast("double")))


def _strict(choose: Callable[..., Column]) -> Callable[..., Column]:
    def build(*xs: Column) -> Column:
        there = xs[0].isNotNull()
        for x in xs[1:]:
            there = there & x.isNotNull()
        return F.when(there, choose(*xs))

    return build


PATH = re.compile(r"\$(\.[A-Za-z_][A-Za-z0-9_]*|\[\d+\])+")


def json_value(x: Column, path: str) -> Column:
    """A scalar at a path as text; null for objects, arrays, JSON null, what isn't there, and what isn't JSON."""
    if not PATH.fullmatch(path):
        raise SemanticError("JSON_PATH", f"{path!r} is not a path of names and positions")
    variant = F.try_parse_json(x)
    found = F.try_variant_get(variant, path, "variant")
    return F.when(~F.schema_of_variant(found).rlike("^(OBJECT|ARRAY)"), F.try_variant_get(variant, path, "string"))


@dataclass(frozen=True)
class Function:
    build: Callable[..., Column]
    least: int
    most: int
    unit: bool = False
    weeks: bool = False


MANY = 99
#: Canonical name -> what it means.
FUNCTIONS: dict[str, Function] = {
    "substring": Function(lambda x, a, n=None: F.substring(x, a, n) if n is not None else F.substr(x, a), 2, 3),
    "concat": Function(lambda *xs: F.concat(*(x.cast("string") for x in xs)), 2, MANY),
    "upper": Function(F.upper, 1, 1),
    "lower": Function(F.lower, 1, 1),
    "trim": Function(F.trim, 1, 1),
    "ltrim": Function(F.ltrim, 1, 1),
    "rtrim": Function(F.rtrim, 1, 1),
    "length": Function(lambda x: F.char_length(x).cast("bigint"), 1, 1),
    "replace": Function(F.replace, 3, 3),
    "position": Function(lambda needle, hay: F.position(needle, hay).cast("bigint"), 2, 2),
    "split_part": Function(F.split_part, 3, 3),
    "lpad": Function(F.lpad, 3, 3),
    "rpad": Function(F.rpad, 3, 3),
    "starts_with": Function(F.startswith, 2, 2),
    "ends_with": Function(F.endswith, 2, 2),
    "abs": Function(F.abs, 1, 1),
    "sign": Function(lambda x: F.sign(x.cast("double")).cast("int"), 1, 1),
    "floor": Function(F.floor, 1, 1),
    "ceil": Function(F.ceil, 1, 1),
    "sqrt": Function(lambda x: F.when(x >= 0, F.sqrt(x.cast("double"))), 1, 1),
    "exp": Function(lambda x: F.exp(x.cast("double")), 1, 1),
    "ln": Function(lambda x: F.when(x > 0, F.ln(x.cast("double"))), 1, 1),
    "power": Function(lambda b, e: F.power(b.cast("double"), e.cast("double")), 2, 2),
    "round": Function(lambda x, n=None: F.round(x, n) if n is not None else F.round(x), 1, 2),
    "trunc": Function(trunc, 1, 2),
    "mod": Function(lambda a, b: a % F.nullif(b, F.lit(0)), 2, 2),
    "div": Function(lambda a, b: trunc_div(a, b), 2, 2),
    "log": Function(logarithm, 2, 2),
    "coalesce": Function(F.coalesce, 1, MANY),
    "nullif": Function(F.nullif, 2, 2),
    "greatest": Function(_strict(F.greatest), 2, MANY),
    "least": Function(_strict(F.least), 2, MANY),
    "date_trunc": Function(date_trunc, 2, 2, unit=True, weeks=True),
    "date_add": Function(date_add, 3, 3, unit=True),
    "date_diff": Function(date_diff, 3, 3, unit=True, weeks=True),
    "extract": Function(extract, 2, 2, unit=True),
    "last_day": Function(lambda x: F.last_day(x.cast("date")), 1, 1),
    "current_date": Function(F.current_date, 0, 0),
    "json_value": Function(json_value, 2, 2),
}


def trunc_div(a: Column, b: Column) -> Column:
    """Whole part of a / b, toward zero; null where b is zero."""
    low, high = a.try_cast("decimal(38,10)"), F.nullif(b, F.lit(0)).try_cast("decimal(28,10)")
    whole = a.cast("double") / F.nullif(b, F.lit(0)).cast("double")
    return F.coalesce(((low - low % high) / high).try_cast("bigint"), F.when(whole < 0, F.ceil(whole)).otherwise(F.floor(whole)))
