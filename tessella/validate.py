"""What is wrong, doubtful or unused in a model, without data."""

from __future__ import annotations

from dataclasses import dataclass

from .errors import SemanticError
from .functions import catalog
from .functions.expressions import Call, nodes, parse, refs, spark_type
from .model import Model
from .operators.aggregates import KNOWN, PAIRS
from .plans.graph import Graph


@dataclass(frozen=True)
class Issue:
    code: str
    where: str
    message: str
    severity: str = "error"


#: The comparisons of periods, in lower case.
COMPARISONS = ("ratio", "difference", "previousvalue", "percentchange")


def validate(model: Model) -> list[Issue]:
    """All issues; none of severity error means that queries can be planned."""
    out: list[Issue] = []
    add = lambda code, where, message, severity="error": out.append(Issue(code, where, message, severity))
    objects = model.data_objects

    def has(where: str, obj: str, column: str | None) -> bool:
        if obj not in objects:
            add("UNKNOWN_DATA_OBJECT", where, f"no data object is called {obj!r}")
        elif column is not None and column not in objects[obj].columns:
            add("UNKNOWN_COLUMN", where, f"{obj} has no column {column!r}")
        else:
            return True
        return False

    def expression(where: str, text: str) -> list[tuple[str, ...]]:
        try:
            tree = parse(text)
        except SemanticError as e:
            add(e.code, where, str(e))
            return []
        for n in nodes(tree):
            if isinstance(n, Call) and n.name not in catalog.FUNCTIONS:
                add("NON_PORTABLE_FUNCTION", where, f"{n.name} is not in the catalog", "error" if model.settings.expression_mode == "portable" else "warning")
        return refs(tree)

    names: dict[str, str] = {}
    for kind, group in (("dimension", model.dimensions), ("measure", model.measures), ("metric", model.metrics)):
        for n in group:
            if n.lower() in names:
                add("DUPLICATE_LABEL", n, f"{kind} and {names[n.lower()]} share the label")
            names[n.lower()] = kind
    for o in objects.values():
        paths: dict[tuple[str, str | None], int] = {}
        for c in o.columns.values():
            if c.expression:
                for r in expression(f"{o.name}.{c.name}", c.expression):
                    has(f"{o.name}.{c.name}", *(r if len(r) == 2 else (o.name, r[0])))
                if _cyclic(model, o.name, c.name, ()):
                    add("CYCLIC_COLUMN", f"{o.name}.{c.name}", "the expression leads back to itself")
        for j in o.joins:
            where = f"{o.name} -> {j.join_to}"
            if j.join_type not in ("many-to-one", "one-to-one", "many-to-many"):
                add("JOIN_TYPE", where, f"{j.join_type!r} is no cardinality")
            if len(j.columns_from) != len(j.columns_to) or not j.columns_from:
                add("JOIN_COLUMNS", where, "both sides need the same number of columns")
            for c in j.columns_from:
                has(where, o.name, c)
            for c in j.columns_to:
                has(where, j.join_to, c)
            if j.secondary and not j.path_name:
                add("PATH_NAME", where, "a secondary join needs a pathName")
            key = (j.join_to, j.path_name if j.secondary else None)
            paths[key] = paths.get(key, 0) + 1
            if paths[key] == 2:
                add("DUPLICATE_JOIN", where, "two joins lead there under one name")
            if j.join_type == "many-to-many":
                add("MANY_TO_MANY", where, "measures across this join need allowFanOut", "warning")
        if o.nested_in:
            has(o.name, o.nested_in.data_object, None)
    if any(i.code in ("UNKNOWN_DATA_OBJECT",) for i in out):
        return out
    graph = Graph(model)
    for o in objects:
        if any(e.kind == "many-to-one" and o in graph.distances(e.end) for e in graph.out[o]):
            add("CYCLIC_JOIN", o, "joins lead back here")
    for d in model.dimensions.values():
        if has(d.name, d.data_object, d.column) and d.time_grain and d.time_grain not in catalog.UNITS:
            add("TIME_GRAIN", d.name, f"{d.time_grain!r} is no grain")
        if d.via and has(d.name, d.via, None) and not graph.reaches(d.via, {d.data_object}):
            add("VIA_UNREACHABLE", d.name, f"{d.via} doesn't lead to {d.data_object}")
        if d.time_grain and d.data_object in objects and d.column in objects[d.data_object].columns and objects[d.data_object].columns[d.column].abstract_type not in ("date", "timestamp", "timestamp_tz"):
            add("TIME_GRAIN", d.name, "only dates and timestamps have grains")
        if not d.via and d.data_object in objects and any(len({p[-1] for p in graph.shortest(o, d.data_object) if p}) > 1 for o in objects):
            add("VIA_MISSING", d.name, f"some objects lead to {d.data_object} by several joins: name one with via", "warning")
    for m in model.measures.values():
        if m.aggregation not in (*KNOWN, "measure"):
            add("UNKNOWN_AGGREGATION", m.name, f"no aggregation is called {m.aggregation!r}")
        if m.aggregation == "measure":
            add("UNSUPPORTED_AGGREGATION", m.name, "metric views aren't part of Spark", "warning")
        if m.aggregation in PAIRS and len(m.columns) != 2:
            add("MEASURE_ARITY", m.name, f"{m.aggregation} takes two columns")
        for c in m.columns:
            has(m.name, c.data_object, c.column)
        for r in expression(m.name, m.expression) if m.expression else []:
            has(m.name, *(r if len(r) == 2 else (r[0], None)))
        read = {c.data_object for c in m.columns} | {r[0] for r in (refs(parse(m.expression)) if m.expression and _parses(m.expression) else []) if len(r) == 2}
        if m.anchor and has(m.name, m.anchor, None):
            here = {m.anchor, *graph.distances(m.anchor)}
            for o in sorted(x for x in read if x in objects and x not in here and not here & {x, *graph.distances(x)}):
                add("ANCHOR_UNRELATED", m.name, f"{m.anchor} and {o} share no object")
        elif not m.anchor and len(read) > 1 and read <= set(objects) and graph.root(read) is None:
            add("ANCHOR_NEEDED", m.name, f"no join path connects {', '.join(sorted(read))}: name an anchor")
        for c in _filter_columns(m.filters):
            has(m.name, c.data_object, c.column)
        if m.within_group:
            has(m.name, m.within_group.column.data_object, m.within_group.column.column)
        if m.filter_context:
            fc = m.filter_context
            if fc.mode.upper() not in ("FIXED", "RELATIVE"):
                add("CONTEXT_MODE", m.name, f"{fc.mode!r} is no mode of a filter context")
            if fc.mode.upper() == "FIXED" and fc.exclude:
                add("CONTEXT_MODE", m.name, "FIXED has nothing to exclude from")
            for n in (*fc.exclude, *fc.keep_only, *(x.field for x in fc.include)):
                obj, _, column = n.partition(".")
                if n not in model.dimensions and not (obj in objects and column in objects[obj].columns):
                    add("UNKNOWN_DIMENSION", m.name, f"no dimension or column is called {n!r}")
        if m.distinct and m.within_group and m.columns and m.within_group.column != m.columns[0]:
            add("LISTAGG_ORDER", m.name, "distinct values can't be ordered by another column")
        if m.data_type:
            _type(add, m.name, m.data_type)
        if (m.total or m.grain) and m.aggregation not in ("sum", "count", "count_distinct", "min", "max", "avg"):
            add("TOTAL_UNSUPPORTED", m.name, f"totals of {m.aggregation} have no meaning")
        for g in [m.grain] if m.grain else []:
            if g.mode.upper() == "FIXED" and g.exclude:
                add("GRAIN_MODE", m.name, "FIXED has nothing to exclude from")
            for n in (*g.exclude, *g.include, *g.keep_only):
                if n not in model.dimensions:
                    add("UNKNOWN_DIMENSION", m.name, f"no dimension is called {n!r}")
    for m in model.metrics.values():
        for r in expression(m.name, m.expression) if m.expression else []:
            if r[0] not in model.measures and r[0] not in model.metrics:
                add("UNKNOWN_MEASURE", m.name, f"no measure or metric is called {r[0]!r}")
        if m.type == "derived" and not m.expression or m.type == "cumulative" and not (m.measure and m.time_dimension) or m.type == "period_over_period" and not m.period_over_period or m.type == "window" and not m.window_function:
            add("METRIC_SHAPE", m.name, f"a {m.type} metric lacks what it needs")
        if m.type not in ("derived", "cumulative", "period_over_period", "window"):
            add("METRIC_SHAPE", m.name, f"{m.type!r} is no type of metric")
        if m.period_over_period:
            pop = m.period_over_period
            if pop.time_dimension not in model.dimensions:
                add("UNKNOWN_DIMENSION", m.name, f"no dimension is called {pop.time_dimension!r}")
            elif (c := _column(model, pop.time_dimension)) and c.abstract_type not in ("date", "timestamp", "timestamp_tz"):
                add("TIME_GRAIN", m.name, f"{pop.time_dimension} is no date or timestamp")
            for unit in (pop.grain, pop.offset_grain):
                if unit not in catalog.UNITS:
                    add("TIME_GRAIN", m.name, f"{unit!r} is no grain")
            if pop.comparison.lower() not in COMPARISONS:
                add("METRIC_SHAPE", m.name, f"{pop.comparison!r} is no comparison")
            if m.expression and _parses(m.expression) and len({r[0] for r in refs(parse(m.expression))}) != 1:
                add("PERIOD_MEASURE", m.name, "compares one measure")
        if m.time_dimension and (c := _column(model, m.time_dimension)) and c.abstract_type not in ("date", "timestamp", "timestamp_tz"):
            add("TIME_GRAIN", m.name, f"{m.time_dimension} is no date or timestamp")
        if m.window is not None and m.grain_to_date:
            add("METRIC_SHAPE", m.name, "window and grainToDate exclude each other")
        for n in [m.measure] if m.measure else []:
            if n not in model.measures and n not in model.metrics:
                add("UNKNOWN_MEASURE", m.name, f"no measure or metric is called {n!r}")
        for n in (*m.partition_by, *([m.time_dimension] if m.time_dimension else [])):
            if n not in model.dimensions:
                add("UNKNOWN_DIMENSION", m.name, f"no dimension is called {n!r}")
        if _cyclic_metric(model, m.name, ()):
            add("CYCLIC_METRIC", m.name, "the expression leads back to itself")
    for f in model.filters:
        has("filters", f.data_object, f.column)
    _type(add, "settings", model.settings.default_numeric_data_type)
    return out


def _parses(text: str) -> bool:
    try:
        parse(text)
    except SemanticError:
        return False
    return True


def _filter_columns(filters) -> list:
    """Columns that a measure's filters read, out of all groups."""
    return [c for f in filters for c in (_filter_columns(f.filters) if hasattr(f, "filters") else [f.column] if f.column else [])]


def _column(model: Model, dimension: str):
    """The column below a dimension, if both are there."""
    d = model.dimensions.get(dimension)
    return model.data_objects[d.data_object].columns.get(d.column) if d and d.data_object in model.data_objects else None


def _type(add, where: str, name: str) -> None:
    try:
        spark_type(name)
    except SemanticError as e:
        add(e.code, where, str(e))


def _cyclic(model: Model, obj: str, column: str, trail: tuple) -> bool:
    if (obj, column) in trail:
        return True
    c = model.data_objects[obj].columns.get(column) if obj in model.data_objects else None
    if c is None or not c.expression:
        return False
    try:
        below = refs(parse(c.expression))
    except SemanticError:
        return False
    return any(_cyclic(model, *(r if len(r) == 2 else (obj, r[0])), (*trail, (obj, column))) for r in below)


def _cyclic_metric(model: Model, name: str, trail: tuple) -> bool:
    if name in trail:
        return True
    if name not in model.metrics or name in model.measures or not model.metrics[name].expression:
        return False
    try:
        below = refs(parse(model.metrics[name].expression))
    except SemanticError:
        return False
    return any(_cyclic_metric(model, r[0], (*trail, name)) for r in below)


def health(model: Model) -> dict[str, list[str]]:
    """Objects that nothing joins, fan trap risks, and dimensions that no measure can be asked by."""
    graph = Graph(model)
    joined = {e.end for es in graph.out.values() for e in es} | {o for o, es in graph.out.items() if es}
    orphans = [o for o in model.data_objects if o not in joined]
    traps = sorted({o for o, es in graph.all.items() if sum(e.backward and e.kind == "many-to-one" for e in es) > 1} | {o for o, es in graph.out.items() if any(e.kind == "many-to-many" for e in es)})
    sources = {c.data_object for m in model.measures.values() if not m.meta.get("synthesized") for c in m.columns}
    sources |= {r[0] for m in model.measures.values() if m.expression for r in refs(parse(m.expression)) if len(r) == 2}
    reached = {o for s in sources if s in model.data_objects for o in graph.distances(s)}
    return {"orphans": orphans, "fanTrapRisks": traps, "unreachableDimensions": sorted(d.name for d in model.dimensions.values() if d.data_object not in reached)}
