"""Aggregations, over columns that hold their arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SemanticError
from ..functions.expressions import divides, parse, spark_type
from ..model import Measure, Model

#: Aggregations of exactly two columns, in the order (y, x).
PAIRS = ("corr", "covar_pop", "covar_samp", "regr_slope", "regr_intercept")
#: What repeated rows don't change.
INSENSITIVE = ("min", "max", "count_distinct", "any_value")
#: How an outer aggregate joins results of inner groups; averages are joined from their sums and counts.
OUTER = {"sum": "sum", "count": "sum", "min": "min", "max": "max", "any_value": "any_value", "avg": ""}
KNOWN = ("sum", "count", "count_distinct", "avg", "min", "max", "any_value", "median", "mode", "listagg", "stddev", "stddev_pop", "variance", "var_pop", *PAIRS)


def aggregate(m: Measure, args: list[str], whole: bool = False) -> Column:
    """The aggregate of a measure over argument columns; ``whole``: the argument is an integer."""
    cols = [F.col(f"`{a}`") for a in args]
    kind = m.aggregation
    if kind == "measure":
        raise SemanticError("UNSUPPORTED_AGGREGATION", f"{m.name} delegates to a metric view, which Spark doesn't have")
    if kind not in KNOWN:
        raise SemanticError("UNKNOWN_AGGREGATION", f"{m.name} uses {kind!r}")
    if kind in PAIRS:
        if len(cols) != 2:
            raise SemanticError("MEASURE_ARITY", f"{m.name}: {kind} takes two columns")
        return getattr(F, kind)(*cols)
    c = cols[0]
    if kind == "count_distinct" or (kind == "count" and m.distinct):
        return F.count_distinct(*cols)
    if kind == "count":
        if len(cols) == 1:
            return F.count(c)
        there = cols[0].isNotNull()
        for x in cols[1:]:
            there = there & x.isNotNull()
        return F.count_if(there)
    if kind == "sum":
        return F.sum_distinct(c) if m.distinct else F.sum(c)
    if kind == "avg":
        if m.distinct:
            return F.expr(f"avg(distinct `{args[0]}`)")
        return F.sum(c).cast("decimal(38,0)") / F.count(c) if whole else F.avg(c)
    if kind == "listagg":
        sep = (m.delimiter if m.delimiter is not None else ",").replace("\\", "\\\\").replace("'", "\\'")
        if m.distinct and m.within_group and m.columns and m.within_group.column != m.columns[0]:
            raise SemanticError("LISTAGG_ORDER", f"{m.name}: distinct values can't be ordered by another column")
        order = f" within group (order by `{args[0 if m.distinct else 1]}` {m.within_group.order})" if m.within_group else ""
        return F.expr(f"listagg({'distinct ' if m.distinct else ''}`{args[0]}`, '{sep}'){order}")
    if kind == "mode":
        return F.mode(c, deterministic=True)
    return {
        "min": F.min, "max": F.max, "any_value": F.any_value, "median": F.median, "stddev": F.stddev_samp, "stddev_pop": F.stddev_pop, "variance": F.var_samp, "var_pop": F.var_pop,
    }[kind](c)


def result_type(model: Model, m: Measure) -> str | None:
    """The type a measure is reported in; None for as it comes."""
    if m.data_type:
        return spark_type(m.data_type)
    if m.aggregation in ("count", "count_distinct"):
        return "bigint"
    if m.aggregation not in ("sum", "avg"):
        return None
    if m.expression and divides(parse(m.expression)):
        return "decimal(18,6)"
    if m.aggregation == "sum" and m.result_type == "int":
        return "bigint"
    return spark_type(model.settings.default_numeric_data_type)
