"""Cumulative and window metrics, over the aggregated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..errors import SemanticError
from ..functions import catalog
from ..model import Metric

#: Metrics that are ordered by their time dimension, always upwards.
ALONG_TIME = ("lag", "lead")
RANKS = {"rank": F.rank, "dense_rank": F.dense_rank, "row_number": F.row_number}


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def add(planner, df: DataFrame, metrics: list[Metric], values: dict[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
    """The frame with a column for each metric, and how to name it."""
    labels, values = [d.label for d in planner.dims], dict(values)
    made = {}
    for m in metrics:
        for name in [*m.partition_by, *([m.time_dimension] if m.time_dimension else [])]:
            if name not in labels:
                raise SemanticError("TIME_DIMENSION_NEEDED" if name == m.time_dimension else "PARTITION_NEEDED", f"{m.name} needs {name} selected")
        value = planner.metric_value(m.measure, values) if m.measure else None
        made[m.name] = cumulative(planner, m, value) if m.type == "cumulative" else window(m, value)
    for name, c in made.items():
        df = df.withColumn(name, c)
        values[name] = _q(name)
    return df, values


def cumulative(planner, m: Metric, value: Column) -> Column:
    """Running from the first row, over the last ``window`` rows, or since the start of a longer unit."""
    by = [_q(p) for p in m.partition_by]
    if m.grain_to_date:
        by.append(catalog.date_trunc(m.grain_to_date, _q(m.time_dimension), planner.model.settings.week_start))
    first = -(m.window - 1) if m.window else Window.unboundedPreceding
    over = Window.partitionBy(*by).orderBy(_q(m.time_dimension).asc_nulls_last()).rowsBetween(first, 0)
    return getattr(F, m.cumulative_type)(value).over(over)


def window(m: Metric, value: Column | None) -> Column:
    kind, by = m.window_function.lower(), [_q(p) for p in m.partition_by]
    if kind in ALONG_TIME or kind in ("first_value", "last_value") or value is None:
        if not m.time_dimension:
            raise SemanticError("TIME_DIMENSION_NEEDED", f"{m.name} needs a time dimension")
        key = _q(m.time_dimension)
    else:
        key = value
    up = kind in ALONG_TIME or m.order_direction.lower() == "asc"
    over = Window.partitionBy(*by).orderBy(key.asc_nulls_last() if up else key.desc_nulls_last())
    if kind in RANKS:
        return RANKS[kind]().over(over)
    if kind == "ntile":
        if not m.buckets or m.buckets < 2:
            raise SemanticError("WINDOW_ARGUMENT", f"{m.name} needs at least 2 buckets")
        return F.ntile(m.buckets).over(over)
    if kind in ALONG_TIME:
        if not m.offset or m.offset < 1:
            raise SemanticError("WINDOW_ARGUMENT", f"{m.name} needs a positive offset")
        return getattr(F, kind)(value, m.offset, m.default_value).over(over)
    if kind in ("first_value", "last_value"):
        return getattr(F, kind)(value).over(over)
    raise SemanticError("UNKNOWN_WINDOW", f"{m.name} uses {m.window_function!r}")
