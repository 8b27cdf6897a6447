"""Extension: a star query's grained aggregate over a stream.

The tables of a streamed object come from ``readStream``; the same plan then aggregates by event-time
windows with a watermark.  Only what adds up row by row works: one fact, sum, count, min, max, avg.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SemanticError
from ..model import Model
from ..operators.aggregates import aggregate
from ..plans.planner import Planner
from ..plans.query import query
from ..plans.scope import Scope, q

#: Aggregates that a stream can keep.
KEPT = ("sum", "count", "min", "max", "avg")


def windowed(model: Model, tables, source, time: tuple[str, str], every: str, late: str) -> DataFrame:
    """window_start, window_end, dimensions and measures of a streamed fact; ``time`` is its (object, column)."""
    asked = query(source)
    planner = Planner(model, tables, asked)
    measures = [model.measures[n] for n in asked.select.measures]
    roots = {planner.root_of(m) for m in measures}
    if len(roots) != 1 or any(m.aggregation not in KEPT or m.distinct or m.total or m.grain or m.filter_context for m in measures):
        raise SemanticError("STREAM_UNSUPPORTED", "a stream is aggregated for one fact, by sum, count, min, max or avg")
    scope = Scope(model, planner.graph, tables, roots.pop(), planner.warn)
    dims = [planner.dim_column(scope, d).alias(d.label) for d in planner.dims]
    args = {m.name: planner.measure_args(scope, m) for m in measures}
    at = scope.column(*time).cast("timestamp").alias("__time")
    planner.where(scope, asked.where)
    columns = [c.alias(f"{n}#{i}") for n, cs in args.items() for i, c in enumerate(cs)]
    rows = scope.frame().select(at, *dims, *columns).withWatermark("__time", late)
    over = F.window("__time", every).alias("__window")
    out = rows.groupBy(over, *(q(d.label) for d in planner.dims)).agg(*(aggregate(m, [f"{m.name}#{i}" for i in range(len(args[m.name]))]).alias(m.name) for m in measures))
    return out.select(F.col("__window.start").alias("window_start"), F.col("__window.end").alias("window_end"), *(q(d.label) for d in planner.dims), *(q(m.name) for m in measures))
