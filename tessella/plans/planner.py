"""From a query to one DataFrame: scopes, aggregation, and what stands on top of it.

Order of the stages: joins, WHERE, aggregation (with deduplicated measures, other filter contexts and
several facts), period over period, totals, cumulative and window metrics, HAVING, result types,
ORDER BY, LIMIT.
"""

from __future__ import annotations

from collections.abc import Callable
from copy import copy
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import FanoutError, SemanticError
from ..functions import catalog
from ..functions.expressions import Builder, Call, Op, Ref, divided, divides, parse, refs, spark_type
from ..model import Measure, MeasureFilter, Metric, Model
from ..operators import aggregates, windows
from ..operators.filters import condition, name_of
from .graph import Graph
from .query import Dim, FilterGroup, OrderBy, Query, QueryFilter, Select, dim, leaves_of
from .scope import SEP, Scope, q, size_of

#: Bytes of a fact in its source that a task gets where rows are counted once, some 25 times as many in memory; and tasks at most.
TASK_BYTES, MOST_TASKS = 4 << 20, 20_000

Filters = list[QueryFilter | FilterGroup]


@dataclass
class Plan:
    """What was decided, for explain()."""

    kind: str = "star"
    base: str | None = None
    steps: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    kept: list[DataFrame] = field(default_factory=list)  # to be persisted while the result is in use

    def keep(self, df: DataFrame) -> DataFrame:
        """An aggregate that several later steps read."""
        self.kept.append(df)
        return df


class Planner:
    def __init__(self, model: Model, tables: Callable, query: Query, plan: Plan | None = None):
        self.model, self.tables, self.query = model, tables, query
        self.plan = plan or Plan()
        self.graph = Graph(model, {(p.source, p.target): p.path_name for p in query.use_path_names})
        for p in query.use_path_names:
            if not any(j.join_to == p.target and j.path_name == p.path_name for j in getattr(model.data_objects.get(p.source), "joins", [])):
                raise SemanticError("UNKNOWN_PATH", f"{p.source} has no join to {p.target} called {p.path_name!r}")
        self.dims = [dim(d) for d in query.select.dimensions]
        for i, d in enumerate(self.dims):
            if d.label in [x.label for x in self.dims[:i]]:
                raise SemanticError("DUPLICATE_FIELD", f"{d.label} is selected twice")
            for name, _ in d.parts:
                self.dimension(name)
        self.warn = lambda text: self.plan.warnings.append(text) if text not in self.plan.warnings else None

    # labels

    def dimension(self, name: str):
        if name not in self.model.dimensions:
            raise SemanticError("UNKNOWN_DIMENSION", f"no dimension is called {name!r}")
        return self.model.dimensions[name]

    def metric_measures(self, name: str, trail: tuple[str, ...] = ()) -> list[str]:
        """Base measures below a measure or metric."""
        if name in self.model.measures:
            return [name]
        if name not in self.model.metrics:
            raise SemanticError("UNKNOWN_MEASURE", f"no measure or metric is called {name!r}")
        if name in trail:
            raise SemanticError("CYCLIC_METRIC", " -> ".join((*trail, name)))
        m = self.model.metrics[name]
        below = [m.measure] if m.measure else [] if m.expression is None else [p[0] for p in refs(parse(m.expression))]
        return list(dict.fromkeys(b for x in below for b in self.metric_measures(x, (*trail, name))))

    def measure_objects(self, m: Measure) -> set[str]:
        found = {c.data_object for c in m.columns}
        if m.expression:
            found |= {p[0] for p in refs(parse(m.expression)) if len(p) == 2}
        if m.within_group:
            found.add(m.within_group.column.data_object)
        if not found:
            raise SemanticError("MEASURE_SOURCE", f"{m.name} reads no column")
        for o in found:
            if o not in self.model.data_objects:
                raise SemanticError("UNKNOWN_DATA_OBJECT", f"{m.name} reads {o!r}, which isn't there")
        # a computed column may read other objects
        for c in m.columns:
            if c.column and (e := self.model.column(c.data_object, c.column).expression):
                found |= {p[0] for p in refs(parse(e)) if len(p) == 2}
        return found

    def measure_filters(self, m: Measure) -> set[str]:
        def walk(items) -> set[str]:
            return {o for f in items for o in (walk(f.filters) if hasattr(f, "filters") else {f.column.data_object} if f.column else set())}

        return walk(m.filters)

    def field(self, name: str) -> tuple[str, str, str | None] | None:
        """(object, column, via) of a dimension or "Object.Column"; None if it is a measure or metric."""
        if name in self.model.dimensions:
            d = self.model.dimensions[name]
            return d.data_object, d.column, d.via
        if name in self.model.measures or name in self.model.metrics:
            return None
        for o in sorted(self.model.data_objects, key=len, reverse=True):
            if name.startswith(f"{o}.") and name[len(o) + 1 :] in self.model.data_objects[o].columns:
                return o, name[len(o) + 1 :], None
        raise SemanticError("UNKNOWN_FIELD", f"{name!r} is no dimension, measure, metric or Object.Column")

    def filter_objects(self, filters: Filters) -> set[str]:
        return {x for f in leaves_of(filters) for x in self._filter_objects(f)}

    def _filter_objects(self, f: QueryFilter) -> set[str]:
        if (found := self.field(f.field)) is None:
            raise SemanticError("MEASURE_IN_WHERE", f"{f.field} is a measure: use having")
        return {found[0], *([found[2]] if found[2] else [])}

    # WHERE

    def where(self, scope: Scope, filters: Filters) -> None:
        for f in filters:
            if isinstance(f, QueryFilter) and f.subquery:
                self.exists_step(scope, f)
            else:
                cond = self.tree(scope, f)
                scope.steps.append(lambda df, c=cond: df.filter(c))
        for f in self.model.filters:
            value = f.values if f.values else f.value
            same = any(isinstance(x, QueryFilter) and x.field == f"{f.data_object}.{f.column}" and name_of(x.op) == name_of(f.operator) and x.value == value for x in filters)
            if same:
                continue
            if not self.graph.reaches(scope.root, {f.data_object}):
                self.warn(f"STATIC_FILTER_SKIPPED: {f.data_object} is not reached from {scope.root}")
                continue
            cond = condition(f.operator, scope.column(f.data_object, f.column), value, self.model.column(f.data_object, f.column).abstract_type)
            scope.steps.append(lambda df, c=cond: df.filter(c))

    def tree(self, scope: Scope, f: QueryFilter | FilterGroup) -> Column:
        if isinstance(f, FilterGroup):
            parts = [self.tree(scope, x) for x in f.filters]
            cond = reduce((lambda a, b: a & b) if f.logic.lower() == "and" else (lambda a, b: a | b), parts) if parts else F.lit(True)
            return ~cond if f.negated else cond
        if f.subquery:
            return self.exists_mark(scope, f)
        obj, col, via = self.field(f.field)
        return condition(f.op, scope.column(obj, col, via), f.value, self.model.column(obj, col).abstract_type)

    def inner_keys(self, scope: Scope, f: QueryFilter) -> tuple[list[Column], DataFrame, list[str]]:
        """Outer key columns, the distinct keys that exist, and the names of these."""
        obj, _, via = self.field(f.field)
        sub = f.subquery
        if sub.data_object not in self.model.data_objects or self.model.data_objects[sub.data_object].nested_in:
            raise SemanticError("EXISTS_TARGET", f"{sub.data_object!r} can't be the target of {f.op}")
        graph = self.graph
        if sub.path_name:
            found = [(o.name, j.join_to) for o in self.model.data_objects.values() for j in o.joins if j.path_name == sub.path_name and sub.data_object in (o.name, j.join_to)]
            if not found:
                raise SemanticError("UNKNOWN_PATH", f"no join to or from {sub.data_object} is called {sub.path_name!r}")
            graph = Graph(self.model, {found[0]: sub.path_name})
        path = graph.path(obj, sub.data_object, undirected=True)
        if not path:
            raise SemanticError("EXISTS_TARGET", f"{sub.data_object} is the subject itself")
        inner = Scope(self.model, graph, self.tables, path[0].end, self.warn, inner=True)
        inner.instance(sub.data_object, path=path[1:])
        for x in sub.filter:
            name = x.field if self._known(x.field) else f"{sub.data_object}.{x.field}"
            o, c, v = self.field(name)
            target = path[1:] if o == sub.data_object else path[1:] + graph.path(sub.data_object, o, v, undirected=True)
            col = inner.of(inner.instance(o, path=target), o, self.model.column(o, c))
            cond = condition(x.op, col, x.value, self.model.column(o, c).abstract_type)
            inner.steps.append(lambda df, k=cond: df.filter(k))
        scope.marks += 1
        names = [f"__exists{scope.marks}_{i}" for i in range(len(path[0].end_columns))]
        keys = inner.key_of(path[0].end, path[0].end, path[0].end_columns)
        outer = scope.key_of(scope.instance(obj, via), obj, path[0].start_columns)
        return outer, inner.frame().select(*(k.alias(n) for k, n in zip(keys, names))), names

    def _known(self, name: str) -> bool:
        try:
            return self.field(name) is not None
        except SemanticError:
            return False

    def exists_step(self, scope: Scope, f: QueryFilter) -> None:
        outer, keys, names = self.inner_keys(scope, f)
        cond = reduce(lambda a, b: a & b, [o == q(n) for o, n in zip(outer, names)])
        scope.moved = True
        scope.steps.append(lambda df: df.join(keys, cond, "left_semi" if f.op == "exists" else "left_anti"))

    def exists_mark(self, scope: Scope, f: QueryFilter) -> Column:
        """Within OR and NOT: distinct keys are joined, and a mark tells."""
        outer, keys, names = self.inner_keys(scope, f)
        mark = f"__mark{scope.marks}"
        cond = reduce(lambda a, b: a & b, [o == q(n) for o, n in zip(outer, names)])
        scope.moved = True
        scope.steps.append(lambda df: df.join(keys.distinct().withColumn(mark, F.lit(True)), cond, "left").drop(*names))
        found = F.coalesce(q(mark), F.lit(False))
        return found if f.op == "exists" else ~found

    # dimensions and measure arguments

    def dim_column(self, scope: Scope, d: Dim, pop: dict[str, str] | None = None) -> Column:
        out = []
        for name, grain in d.parts:
            x = self.dimension(name)
            via_there = x.via is None or x.via == scope.root or self.graph.reaches(scope.root, {x.via})
            if not self.graph.reaches(scope.root, {x.data_object}) or not via_there:
                continue
            c = scope.column(x.data_object, x.column, x.via)
            kind = self.model.column(x.data_object, x.column).abstract_type
            unit = (pop or {}).get(name) or grain or x.time_grain
            out.append(catalog.grain_of(unit, c, kind == "date" or x.result_type == "date", self.model.settings.week_start) if unit else c)
        if not out:
            return F.lit(None)
        return (out[0] if len(out) == 1 else F.coalesce(*out)).alias(d.label)

    def dim_objects(self) -> set[str]:
        out = set()
        for d in self.dims:
            for name, _ in d.parts:
                x = self.dimension(name)
                out |= {x.data_object, *([x.via] if x.via else [])}
        return out

    def measure_args(self, scope: Scope, m: Measure, resolve=None) -> list[Column]:
        """The columns that the aggregate reads, null where the measure's filters don't hold."""
        if m.expression:
            resolve = resolve or (lambda parts: scope.column(*parts) if len(parts) == 2 else q(parts[0]))
            tree = resolve.tree if isinstance(resolve, _Rewritten) else parse(m.expression)
            args = [scope.builder(resolve).build(tree)]
        else:
            args = [scope.column(c.data_object, c.column) if c.column else F.lit(1) for c in m.columns]
        if m.aggregation == "listagg":
            args = [args[0].cast("string"), *([scope.column(m.within_group.column.data_object, m.within_group.column.column)] if m.within_group else [])]
        if m.filters:
            cond = reduce(lambda a, b: a & b, [self.measure_filter(scope, f) for f in m.filters])
            args = [F.when(cond, a) for a in args]
        return args

    def measure_filter(self, scope: Scope, f) -> Column:
        if not isinstance(f, MeasureFilter):
            parts = [self.measure_filter(scope, x) for x in f.filters]
            cond = reduce((lambda a, b: a & b) if f.logic.lower() == "and" else (lambda a, b: a | b), parts)
            return ~cond if f.negated else cond
        c = scope.column(f.column.data_object, f.column.column)
        values = [v.value for v in f.values]
        kind = self.model.column(f.column.data_object, f.column.column).abstract_type
        many = name_of(f.operator) in ("inlist", "notinlist", "between", "notbetween")
        return condition(f.operator, c, values if many else values[0] if values else None, kind)

    def is_whole(self, m: Measure) -> bool:
        return not m.expression and len(m.columns) == 1 and m.columns[0].column is not None and self.model.column(m.columns[0].data_object, m.columns[0].column).abstract_type == "int" and not self.model.column(m.columns[0].data_object, m.columns[0].column).expression

    def finished(self, m: Measure, c: Column) -> Column:
        return F.coalesce(c, F.lit(m.default_value)) if m.default_value is not None else c

    # aggregation

    def grouped(self, names: list[str], filters: Filters, pop: dict[str, str] | None = None) -> DataFrame:
        """One row per combination of dimensions with all base measures, as aggregated."""
        measures = [self.model.measures[n] for n in names]
        own = [m for m in measures if m.filter_context]
        plain = [m for m in measures if not m.filter_context]
        df = self.facts(plain, filters, pop) if plain or not own else None
        if df is None:
            df = self.facts([], filters, pop) if self.dims else self.model_row()
        for m in own:
            df = self.in_context(df, m, filters)
        return df

    def model_row(self) -> DataFrame:
        any_object = next(iter(self.model.data_objects.values()))
        return self.tables(any_object).sparkSession.range(1).select()

    def root_of(self, m: Measure) -> str:
        objects = self.measure_objects(m)
        if m.anchor:
            return m.anchor
        root = self.graph.root(objects)
        if root is None:
            raise SemanticError("ANCHOR_NEEDED", f"{m.name} reads {', '.join(sorted(objects))}, which no join path connects: name an anchor")
        return root

    def facts(self, measures: list[Measure], filters: Filters, pop: dict[str, str] | None = None) -> DataFrame:
        roots = {m.name: self.root_of(m) for m in measures}
        extra = {o for m in measures for o in self.measure_filters(m)}
        needed = set(roots.values()) | self.dim_objects() | self.filter_objects(filters) | extra
        base = self.graph.root(needed, set(roots.values()))
        if base is not None:
            return self.star(base, measures, roots, filters, pop)
        if len(set(roots.values())) > 1 or (len(self.dims) and any(len(d.parts) > 1 for d in self.dims) and measures):
            return self.union(measures, roots, filters, pop)
        if not measures:
            raise SemanticError("UNREACHABLE_REQUIRED_OBJECT", f"no object leads to all of {', '.join(sorted(needed))}; dimensionsExclude gives combinations that don't occur")
        root = next(iter(roots.values()))
        missing = sorted(o for o in needed if not self.graph.reaches(root, {o}))
        if any(o in self.graph.distances(root, undirected=True) for o in missing):
            if all(m.allow_fan_out for m in measures):
                return self.star(root, measures, roots, filters, pop, undirected=True)
            raise FanoutError(f"{', '.join(missing)} would repeat rows of {root}")
        raise SemanticError("UNREACHABLE_FILTER" if set(missing) <= self.filter_objects(filters) else "UNREACHABLE_REQUIRED_OBJECT", f"{', '.join(missing)} can't be reached from {root}")

    def star(self, base: str, measures: list[Measure], roots: dict[str, str], filters: Filters, pop, undirected: bool = False) -> DataFrame:
        self.plan.base = self.plan.base or base
        self.plan.steps.append(f"scan {base}")
        scope = Scope(self.model, self.graph, self.tables, base, self.warn)
        if undirected:
            scope.inner = False
            scope.graph = _Undirected(self.graph)
        labels = [d.label for d in self.dims]
        dims = [self.dim_column(scope, d, pop).alias(d.label) for d in self.dims]
        args: dict[str, list[Column]] = {}
        for m in measures:
            args[m.name] = self.measure_args(scope, m, self.conform(scope, m) if m.anchor else None)
        self.where(scope, filters)
        siblings = {o for o in self.measure_and_dim_objects(measures) if self.model.data_objects[o].nested_in and not self._above(o, base)}
        if siblings:
            raise FanoutError(f"{', '.join(sorted(siblings))} and {base} are nested side by side")
        scope.check_fanout(all(m.allow_fan_out for m in measures) or self.query.allow_fan_out)
        repeated = {m.name: r for m, r in ((m, roots[m.name]) for m in measures) if r != base and not undirected and self.multiplied(base, r)}
        dedup: dict[str, list[Measure]] = {}
        for m in measures:
            if m.name in repeated and m.aggregation not in aggregates.INSENSITIVE and not m.distinct and not m.allow_fan_out:
                dedup.setdefault(repeated[m.name], []).append(m)
            elif m.name not in repeated and not m.allow_fan_out and not self.query.allow_fan_out and m.aggregation not in aggregates.INSENSITIVE:
                mixed = {o for o in self.measure_objects(m) if o != roots[m.name] and self.multiplied(roots[m.name], o)}
                if mixed and self.measure_objects(m) - mixed:
                    self.warn(f"MIXED_GRAIN: {m.name} reads {', '.join(sorted(mixed))} once per row of {roots[m.name]}")
        keys = {root: self.identity(scope, root) for root in dedup}
        grouped = {root: self.join_columns(scope, root) or own for root, own in keys.items()}
        if dedup:
            scope.tasks = self.tasks(base)
        df = scope.frame()
        arg = lambda m: [f"{m.name}{SEP}{i}" for i in range(len(args[m.name]))]
        main = [m for m in measures if not any(m in ms for ms in dedup.values())]
        columns = [c.alias(n) for m in measures for c, n in zip(args[m.name], arg(m))]
        key_names = {root: [f"{SEP}{root}{SEP}{i}" for i in range(len(k))] for root, k in grouped.items()}
        there = {root: reduce(lambda a, b: a & b, [k.isNotNull() for k in own]).alias(f"{SEP}{root}{SEP}there") for root, own in keys.items()}
        rows = df.select(*dims, *columns, *(c.alias(n) for root in keys for c, n in zip(grouped[root], key_names[root])), *there.values())
        agg = lambda m: self.finished(m, aggregates.aggregate(m, arg(m), self.is_whole(m))).alias(m.name)
        if self.query.grouping:
            if dedup:
                raise SemanticError("DEDUP_GROUPING", f"{', '.join(m.name for ms in dedup.values() for m in ms)} would be counted repeatedly under {self.query.grouping}")
            groups = getattr(rows, self.query.grouping)(*map(q, labels))
            return groups.agg(*map(agg, main), *(F.grouping(q(n)).cast("int").alias(f"_g_{n}") for n in labels))
        if not dedup:
            return rows.groupBy(*map(q, labels)).agg(*map(agg, main)) if main else rows.select(*map(q, labels)).distinct() if labels else rows.limit(0)
        for root, ms in dedup.items():
            self.plan.steps.append(f"count rows of {root} once for {', '.join(m.name for m in ms)}")
        # rows lie as the last large join has dealt them
        there_already = [root for root in dedup if scope.dealt and scope.dealt == scope.path_of(root) and self.join_columns(scope, root)]
        dealt = lambda df, root: df.repartition(scope.tasks, *map(q, key_names[root])) if scope.tasks and root not in there_already else df
        one = self.in_one_pass(rows, labels, main, dedup, key_names, arg, self.chain(scope, dedup), dealt)
        if one is not None:
            return one
        out = rows.groupBy(*map(q, labels)).agg(*map(agg, main)) if main else rows.select(*map(q, labels)).distinct() if labels else None
        for root, ms in dedup.items():
            firsts = [F.any_value(q(a)).alias(a) for m in ms for a in arg(m)]
            once = dealt(rows.filter(q(f"{SEP}{root}{SEP}there")), root).groupBy(*map(q, labels), *map(q, key_names[root])).agg(*firsts)
            part = once.groupBy(*map(q, labels)).agg(*map(agg, ms))
            out = part if out is None else self.joined(out, part, [m.name for m in ms])
        return out

    def tasks(self, obj: str) -> int:
        """Tasks that an object's rows ask for where others are counted once by key; 0 if these are no more than cores, or the size isn't known."""
        while self.model.data_objects[obj].nested_in:
            obj = self.model.data_objects[obj].nested_in.data_object
        df = self.tables(self.model.data_objects[obj])
        size = size_of(df)
        n = 0 if size is None else min(MOST_TASKS, -(-size // TASK_BYTES))
        return n if n > df.sparkSession.sparkContext.defaultParallelism else 0

    def chain(self, scope: Scope, roots) -> list[str] | None:
        """The objects from the nearest to the farthest, if each lies on the way to the next."""
        path = {root: scope.path_of(root) for root in roots}
        out = sorted(path, key=lambda r: len(path[r]))
        return out if all(path[b][: len(path[a])] == path[a] for a, b in zip(out, out[1:])) else None

    def in_one_pass(self, rows: DataFrame, labels: list[str], main: list[Measure], dedup: dict, key_names: dict, arg, chain: list[str] | None, dealt: Callable) -> DataFrame | None:
        """All grains from one scan: partial results by (dimensions, key of the nearest object), then by the next one's key,
        then the whole.  For objects in a chain and results that add up."""
        if chain is None or any(m.aggregation not in aggregates.OUTER or m.distinct for m in (*main, *(m for root in chain[:-1] for m in dedup[root]))):
            return None
        parts = lambda m: (f"{m.name}{SEP}sum", f"{m.name}{SEP}n")
        there = lambda root: f"{SEP}{root}{SEP}there"

        def first(m: Measure) -> list[Column]:
            if m.aggregation != "avg":
                return [aggregates.aggregate(m, arg(m)).alias(m.name)]
            return [how(q(arg(m)[0])).alias(n) for how, n in zip((F.sum, F.count), parts(m))]

        def more(m: Measure) -> list[Column]:
            if m.aggregation != "avg":
                return [getattr(F, aggregates.OUTER[m.aggregation])(q(m.name)).alias(m.name)]
            return [F.sum(q(n)).alias(n) for n in parts(m)]

        def last(m: Measure) -> Column:
            if m.aggregation != "avg":
                return more(m)[0]
            total, n = (F.sum(q(x)) for x in parts(m))
            return (total.cast("decimal(38,0)") if self.is_whole(m) else total) / F.nullif(n, F.lit(0))

        part, raw, partial = rows, main, []
        for i, root in enumerate(chain):
            carried = [x for r in chain[i:] for x in (there(r), *(a for m in dedup[r] for a in arg(m)))] + [k for r in chain[i + 1 :] for k in key_names[r]]
            made = [c for m in raw for c in first(m)] + [c for m in partial for c in more(m)] + [F.any_value(q(x)).alias(x) for x in carried]
            part = dealt(part, root).groupBy(*map(q, labels), *map(q, key_names[root])).agg(*made)
            # what rows without the object say about it doesn't count
            for m in dedup[root]:
                part = part.withColumns({a: F.when(q(there(root)), q(a)) for a in arg(m)})
            partial, raw = [*partial, *raw], dedup[root]
        whole = [self.finished(m, last(m)).alias(m.name) for m in partial]
        own = [self.finished(m, aggregates.aggregate(m, arg(m), self.is_whole(m))).alias(m.name) for m in raw]
        out = part.groupBy(*map(q, labels)).agg(*whole, *own)
        counts = [m.name for m in partial if m.aggregation == "count"]
        return out.withColumns({n: F.coalesce(q(n), F.lit(0)) for n in counts}) if counts and not labels else out

    def measure_and_dim_objects(self, measures: list[Measure]) -> set[str]:
        return {o for m in measures for o in self.measure_objects(m)} | self.dim_objects()

    def _above(self, nested: str, base: str) -> bool:
        """Whether a nested object is the base or one of those that hold it."""
        while base:
            if base == nested:
                return True
            base = self.model.data_objects[base].nested_in.data_object if self.model.data_objects[base].nested_in else ""
        return False

    def multiplied(self, base: str, obj: str) -> bool:
        """Whether a row of ``obj`` can meet several rows of ``base``."""
        if base == obj:
            return False
        path = self.graph.shortest(base, obj)
        return bool(path) and any(e.kind == "many-to-one" for e in path[0])

    def identity(self, scope: Scope, root: str) -> list[Column]:
        instance = scope.instance(root)
        names = self.model.data_objects[root].key
        if not names:
            path = next(p for p, n in scope.instances.items() if n == instance)
            names = list(path[-1].end_columns) if path else []
        if not names:
            raise SemanticError("NO_IDENTITY", f"{root} has no primary key to count its rows once by")
        return scope.key_of(instance, root, tuple(names))

    def join_columns(self, scope: Scope, root: str) -> list[Column] | None:
        """The fact's own columns that name the row of ``root``, if one join by its key leads there: rows stay where the
        join has put them."""
        path = scope.path_of(root)
        names = self.model.data_objects[root].key
        if len(path) != 1 or path[0].nested or path[0].path_name == "nested" or names and set(names) != set(path[0].end_columns):
            return None
        stored = [self.model.column(o, c) for o, cs in ((path[0].start, path[0].start_columns), (root, path[0].end_columns)) for c in cs]
        return scope.key_of(scope.root, path[0].start, path[0].start_columns) if all(c.expression is None for c in stored) else None

    def joined(self, left: DataFrame, right: DataFrame, bring: list[str], labels: list[str] | None = None) -> DataFrame:
        """``right``'s columns on the rows of ``left``, by dimensions (all unless told), null equal to null."""
        labels = [d.label for d in self.dims] if labels is None else labels
        if not labels:
            return left.crossJoin(right.select(*map(q, bring)))
        other = right.select(*(q(n).alias(f"{SEP}{n}") for n in labels), *map(q, bring))
        cond = reduce(lambda a, b: a & b, [q(n).eqNullSafe(q(f"{SEP}{n}")) for n in labels])
        return left.join(other, cond, "left").drop(*(f"{SEP}{n}" for n in labels))

    def conform(self, scope: Scope, m: Measure):
        """Other facts in an anchored expression are summed by the key they share and joined on it."""
        objects = self.measure_objects(m)
        foreign = {o for o in objects if not self.graph.reaches(scope.root, {o})}
        if not foreign:
            return None
        if m.filters and self.measure_filters(m) & foreign:
            raise SemanticError("CONFORMED_FILTER", f"{m.name} filters a fact that is summed first")
        made: dict[str, str] = {}

        def whole(node) -> str | None:
            names = {p[0] for p in refs(node)}
            return next((f for f in foreign if names and names <= set(self.graph.distances(f)) and f in names), None)

        def rewrite(node):
            fact = whole(node)
            if fact:
                name = made.setdefault(repr(node), f"{SEP}{m.name}{SEP}{len(made)}")
                self._conform_join(scope, fact, node, name)
                return Ref((name,))
            if isinstance(node, Op):
                return Op(node.name, tuple(map(rewrite, node.args)))
            if isinstance(node, Call):
                return Call(node.name, tuple(map(rewrite, node.args)))
            return node

        tree = rewrite(parse(m.expression))
        return _Rewritten(tree, lambda parts: scope.column(*parts) if len(parts) == 2 else q(parts[0]))

    def _conform_join(self, scope: Scope, fact: str, node, name: str) -> None:
        here, there = self.graph.distances(scope.root), self.graph.distances(fact)
        shared = sorted((o for o in here if o in there), key=lambda o: (here[o] + there[o], o))
        if not shared:
            raise SemanticError("ANCHOR_UNRELATED", f"{scope.root} and {fact} share no object")
        inner = Scope(self.model, self.graph, self.tables, fact, self.warn)
        left_path, right_path = self.graph.path(scope.root, shared[0]), self.graph.path(fact, shared[0])
        ends = left_path[-1].end_columns if left_path else right_path[-1].end_columns
        left = scope.key_of(scope.instance(shared[0], path=left_path), shared[0], ends)
        keys = inner.key_of(inner.instance(shared[0], path=right_path), shared[0], ends)
        value = inner.builder(lambda parts: inner.column(*parts)).build(node)
        names = [f"{name}{SEP}k{i}" for i in range(len(keys))]
        total = inner.frame().groupBy(*(k.alias(n) for k, n in zip(keys, names))).agg(F.sum(value).alias(name))
        cond = reduce(lambda a, b: a & b, [x == q(n) for x, n in zip(left, names)])
        scope.moved = True
        scope.steps.append(lambda df: df.join(total, cond, "left").drop(*names))

    def union(self, measures: list[Measure], roots: dict[str, str], filters: Filters, pop) -> DataFrame:
        """Independent facts: each leg brings raw arguments, null for the others'; one aggregation over all."""
        self.plan.kind = "union"
        labels = [d.label for d in self.dims]
        by_root: dict[str, list[Measure]] = {}
        for m in measures:
            by_root.setdefault(roots[m.name], []).append(m)
        legs, made = [], {}
        for root, ms in sorted(by_root.items()):
            for m in ms:
                if m.aggregation in aggregates.PAIRS and len({c.data_object for c in m.columns}) > 1:
                    raise SemanticError("CROSS_FACT_PAIR", f"{m.name} pairs columns of different facts")
            lead = self.graph.root({root} | {o for m in ms for o in self.measure_filters(m)} | self.filter_objects(filters), {root})
            if lead is None:
                missing = sorted(o for o in self.filter_objects(filters) if not self.graph.reaches(root, {o}))
                raise SemanticError("UNREACHABLE_FILTER", f"{', '.join(missing)} can't be reached from {root}, and every filter applies to every fact")
            if lead != root:
                raise SemanticError("ONE_SIDE_IN_UNION", f"{', '.join(m.name for m in ms)} would be repeated by {lead}")
            self.plan.steps.append(f"union leg {lead}")
            scope = Scope(self.model, self.graph, self.tables, lead, self.warn)
            dims = {d.label: self.dim_column(scope, d, pop) for d in self.dims}
            args = {m.name: self.measure_args(scope, m) for m in ms}
            self.where(scope, filters)
            scope.check_fanout(all(m.allow_fan_out for m in ms))
            columns = {**{n: c for n, c in dims.items()}, **{f"{n}{SEP}{i}": c for n, cs in args.items() for i, c in enumerate(cs)}}
            legs.append(scope.frame().select(*(c.alias(n) for n, c in columns.items())))
            made |= {n: len(cs) for n, cs in args.items()}
        for label in labels:
            if all(str(leg.schema[label].dataType) == "NullType()" for leg in legs):
                raise SemanticError("UNREACHABLE_REQUIRED_OBJECT", f"no fact leads to {label}")
        all_rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), legs)
        agg = [self.finished(m, aggregates.aggregate(m, [f"{m.name}{SEP}{i}" for i in range(made[m.name])], self.is_whole(m))).alias(m.name) for m in measures]
        if self.query.grouping:
            return getattr(all_rows, self.query.grouping)(*map(q, labels)).agg(*agg, *(F.grouping(q(n)).cast("int").alias(f"_g_{n}") for n in labels))
        return all_rows.groupBy(*map(q, labels)).agg(*agg)

    def in_context(self, df: DataFrame, m: Measure, filters: Filters) -> DataFrame:
        """A measure under its own WHERE: planned as a query of its own and joined back on the dimensions of its grain."""
        fc = m.filter_context
        names = lambda f: {x.field for x in leaves_of([f])}
        if fc.mode.upper() == "FIXED":
            kept = [f for f in filters if names(f) & set(fc.keep_only)]
        elif fc.keep_only:
            kept = [f for f in filters if names(f) & set(fc.keep_only)]
        else:
            kept = [f for f in filters if not names(f) & set(fc.exclude)]
        own = [*kept, *(QueryFilter(x.field, x.op, x.value) for x in fc.include)]
        dims = [d for d in self.dims if m.grain is None or d.label in self.grain(m)]
        dims = [] if m.total else dims
        alone = replace(m, filter_context=None, grain=None, total=False)
        select = Select([self._raw(d) for d in dims], [m.name])
        self.plan.steps.append(f"own filters for {m.name}")
        # subtotals meet subtotals of the same dimensions
        grouping = self.query.grouping and (self.query.grouping if dims == self.dims else "cube" if dims else None)
        sub = Planner(self.model, self.tables, replace(self.query, select=select, grouping=grouping, having=[], order_by=[]), self.plan)
        labels = [d.label for d in dims]
        return self.joined(df, sub.facts([alone], own), [m.name], labels + [f"_g_{n}" for n in labels if grouping])

    def _raw(self, d: Dim) -> Any:
        name = lambda p: f"{p[0]}:{p[1]}" if p[1] else p[0]
        return name(d.parts[0]) if len(d.parts) == 1 else {"coalesce": [name(p) for p in d.parts], "as": d.label}

    def grain(self, m: Measure) -> list[str]:
        """Labels of the dimensions that a measure's own grain keeps."""
        labels, g = [d.label for d in self.dims], m.grain
        if g.mode.upper() == "FIXED":
            kept = [x for x in labels if x in g.keep_only]
        else:
            kept = [x for x in labels if x in g.keep_only] if g.keep_only else [x for x in labels if x not in g.exclude]
        for x in g.include:
            if x not in labels:
                raise SemanticError("GRAIN_NOT_SUBSET", f"{m.name} keeps {x}, which isn't selected")
        return [x for x in labels if x in kept or x in g.include]

    # on top of the aggregation

    def build(self) -> DataFrame:
        s = self.query.select
        if s.fields:
            return self.ordered(self.raw(), [f for f in s.fields])
        if self.query.dimensions_exclude:
            return self.ordered(self.excluded(), [d.label for d in self.dims])
        wanted = list(dict.fromkeys(s.measures))
        hidden = [f.field for f in leaves_of(self.query.having) if f.field not in wanted and f.field not in s.dimensions]
        hidden += [o.field for o in self.query.order_by if not str(o.field).isdigit() and o.field not in wanted and (o.field in self.model.measures or o.field in self.model.metrics) and o.field not in hidden]
        names = wanted + [h for h in dict.fromkeys(hidden)]
        base = list(dict.fromkeys(b for n in names for b in self.metric_measures(n)))
        metrics = self.closure(names)
        pops = [m for m in metrics if m.type == "period_over_period"]
        windowed = [m for m in metrics if m.type in ("cumulative", "window")]
        totals = [self.model.measures[b] for b in base if (self.model.measures[b].total or self.model.measures[b].grain) and not self.model.measures[b].filter_context]
        self.compatible(base, metrics, pops, windowed, totals)
        averages = [m for m in totals if m.aggregation == "avg"]
        extra = self.average_parts(averages)
        if pops:
            if totals or windowed:
                self.warn("TOTALS_SUPPRESSED: totals don't combine with period over period")
                totals = []
            df = self.periods(pops, base)
        else:
            df = self.grouped(base + extra, self.query.where)
        values: dict[str, Column] = {b: q(b) for b in base}
        if totals:
            df = self.with_totals(df, totals)
            values |= {m.name: q(f"{SEP}total{SEP}{m.name}") for m in totals}
        df, values = windows.add(self, df, windowed, values)
        for m in pops:
            values[m.name] = q(m.name)
        metric_values = {m.name: self.metric_value(m.name, values) for m in metrics}
        typed = {n: self.typed(n, metric_values.get(n, values.get(n))) for n in names}
        labels = [d.label for d in self.dims]
        flags = [f"_g_{n}" for n in labels] if self.query.grouping else []
        out = df.select(*map(q, labels), *(c.alias(n) for n, c in typed.items()), *map(q, flags))
        for f in self.query.having:
            out = out.filter(self.having(f))
        return self.ordered(out, [*labels, *wanted, *flags], [n for n in names if n not in wanted])

    def closure(self, names: list[str]) -> list[Metric]:
        out: dict[str, Metric] = {}

        def walk(n: str) -> None:
            if n in self.model.metrics and n not in self.model.measures and n not in out:
                m = self.model.metrics[n]
                for below in ([m.measure] if m.measure else [p[0] for p in refs(parse(m.expression))] if m.expression else []):
                    walk(below)
                out[n] = m

        for n in names:
            walk(n)
        return list(out.values())

    def compatible(self, base, metrics, pops, windowed, totals) -> None:
        own = [b for b in base if self.model.measures[b].filter_context]
        over = [m for m in metrics if m.type == "derived" and any(x in {w.name for w in windowed} for x in (p[0] for p in refs(parse(m.expression))))]
        if over and (own or pops or totals):
            raise SemanticError("DERIVED_OVER_WINDOW", f"{over[0].name} stands on a window metric and doesn't combine with filter contexts, periods or totals")
        if own and pops:
            raise SemanticError("CONTEXT_AND_PERIOD", "filterContext doesn't combine with period over period")
        if pops and any(self.model.measures[b].anchor for b in base):
            raise SemanticError("ANCHOR_AND_PERIOD", "anchored measures don't combine with period over period")
        if own and any(m.aggregation == "avg" for m in totals):
            raise SemanticError("AVERAGE_TOTAL_AND_CONTEXT", "totals of averages don't combine with filterContext")
        if self.query.grouping and (pops or windowed):
            self.warn("GROUPING_WITH_WINDOWS: subtotals are rows of the windows too")
        for m in windowed:
            if not m.partition_by and not m.grain_to_date:
                self.warn(f"ONE_WINDOW: {m.name} orders all groups in one task; partition it where there are many")
        for m in totals:
            if m.aggregation not in ("sum", "count", "count_distinct", "min", "max", "avg"):
                raise SemanticError("TOTAL_UNSUPPORTED", f"{m.name}: totals of {m.aggregation} have no meaning")
            if m.aggregation == "count_distinct":
                self.warn(f"TOTAL_OVERCOUNTS: {m.name} adds distinct counts of groups")

    def average_parts(self, averages: list[Measure]) -> list[str]:
        """Names of sums and counts that totals of averages are made of; measures of this plan alone."""
        out = []
        if averages:
            self.model = copy(self.model)
            self.model.measures = dict(self.model.measures)
        for m in averages:
            for kind in ("sum", "count"):
                name = f"{SEP}{kind}{SEP}{m.name}"
                self.model.measures[name] = replace(m, name=name, aggregation=kind, total=False, grain=None, default_value=None)
                out.append(name)
        return out

    def with_totals(self, df: DataFrame, totals: list[Measure]) -> DataFrame:
        """The groups aggregated once more by the grain of each total, joined back: one row for a grand total.

        Subtotals are not added up again: a total sums groups of all dimensions, and a subtotal shows it for those
        of its grain's dimensions that it keeps.
        """
        df = self.plan.keep(df)
        labels = [d.label for d in self.dims]
        detail = df.filter(reduce(lambda a, b: a & b, [q(f"_g_{n}") == 0 for n in labels])) if self.query.grouping else df
        by_grain: dict[tuple[str, ...], list[Measure]] = {}
        for m in totals:
            by_grain.setdefault(tuple(self.grain(m)) if m.grain and not m.total else (), []).append(m)
        for grain, ms in by_grain.items():
            made = [self.total(m).alias(f"{SEP}total{SEP}{m.name}") for m in ms]
            keys = list(grain)
            if self.query.grouping and grain:
                out = detail.drop(*(f"_g_{n}" for n in labels)).cube(*map(q, grain)).agg(*made, *(F.grouping(q(n)).cast("int").alias(f"_g_{n}") for n in grain))
                keys += [f"_g_{n}" for n in grain]
            else:
                out = detail.groupBy(*map(q, grain)).agg(*made)
            df = self.joined(df, out, [f"{SEP}total{SEP}{m.name}" for m in ms], keys)
        return df

    def total(self, m: Measure) -> Column:
        if m.aggregation == "avg":
            return F.sum(q(f"{SEP}sum{SEP}{m.name}")) / F.nullif(F.sum(q(f"{SEP}count{SEP}{m.name}")), F.lit(0))
        how = {"min": F.min, "max": F.max}.get(m.aggregation, F.sum)
        return how(q(m.name))

    def metric_value(self, name: str, values: dict[str, Column]) -> Column:
        if name in values:
            return values[name]
        m = self.model.metrics[name]
        if m.type != "derived":
            return q(name)
        out = self.builder(lambda parts: self.metric_value(parts[0], values)).build(parse(m.expression))
        return F.coalesce(out, F.lit(m.default_value)) if m.default_value is not None else out

    def builder(self, resolve):
        s = self.model.settings
        return Builder(resolve, s.expression_mode == "portable", s.week_start, self.warn)

    def typed(self, name: str, value: Column) -> Column:
        if name in self.model.measures:
            kind = aggregates.result_type(self.model, self.model.measures[name])
            return value.cast(kind) if kind else value
        m = self.model.metrics[name]
        if m.data_type:
            kind = spark_type(m.data_type)
        elif m.type == "period_over_period":
            kind = "decimal(18,6)" if m.period_over_period.comparison.lower() in ("ratio", "percentchange") else None
        elif m.type in ("cumulative", "window"):
            kind = None
        else:
            kind = "decimal(18,6)" if divides(parse(m.expression)) else spark_type(self.model.settings.default_numeric_data_type)
        return value.cast(kind) if kind else value

    def having(self, f: QueryFilter | FilterGroup) -> Column:
        if isinstance(f, FilterGroup):
            parts = [self.having(x) for x in f.filters]
            cond = reduce((lambda a, b: a & b) if f.logic.lower() == "and" else (lambda a, b: a | b), parts)
            return ~cond if f.negated else cond
        if f.subquery:
            raise SemanticError("EXISTS_IN_HAVING", "exists and nonexists stand in where")
        return condition(f.op, q(f.field), f.value)

    def periods(self, pops: list[Metric], base: list[str]) -> DataFrame:
        """A spine of all periods, the facts on it, and the same facts moved by each offset."""
        first = pops[0].period_over_period
        time = first.time_dimension
        if any((m.period_over_period.time_dimension, m.period_over_period.grain) != (time, first.grain) for m in pops):
            raise SemanticError("PERIOD_MIX", "one query compares along one time dimension and grain")
        if time not in [d.label for d in self.dims]:
            raise SemanticError("TIME_DIMENSION_NEEDED", f"{time} must be selected")
        # read for the spine and once for each offset, aggregated once
        cur = self.plan.keep(self.grouped(base, self.query.where, {time: first.grain}))
        kind = cur.schema[time].dataType.simpleString()
        step = {"year": "interval 1 year", "quarter": "interval 3 month", "month": "interval 1 month", "week": "interval 7 day", "day": "interval 1 day", "hour": "interval 1 hour", "minute": "interval 1 minute", "second": "interval 1 second"}[first.grain]
        spine = cur.agg(F.min(q(time)).alias("a"), F.max(q(time)).alias("b")).select(F.explode(F.expr(f"sequence(a, b, {step})")).alias(f"{SEP}time"))
        self.plan.steps.append(f"spine of {first.grain}s")
        others = [d.label for d in self.dims if d.label != time]
        out = spine.join(cur, q(f"{SEP}time") == q(time), "left").drop(time).withColumnRenamed(f"{SEP}time", time)
        offsets = {(m.period_over_period.offset, m.period_over_period.offset_grain) for m in pops}
        for k, (n, unit) in enumerate(sorted(offsets)):
            moved = catalog.date_add(unit, F.lit(-n), q(time)).cast(kind)
            before = cur.select(moved.alias(f"{SEP}t{k}"), *(q(o).alias(f"{SEP}{k}{o}") for o in others), *(q(b).alias(f"{SEP}{k}{SEP}{b}") for b in base))
            cond = reduce(lambda a, b: a & b, [q(time) == q(f"{SEP}t{k}"), *(q(o).eqNullSafe(q(f"{SEP}{k}{o}")) for o in others)])
            out = out.join(before, cond, "left")
        for m in pops:
            k = sorted(offsets).index((m.period_over_period.offset, m.period_over_period.offset_grain))
            tree = parse(m.expression)
            if len({p[0] for p in refs(tree)}) != 1:
                raise SemanticError("PERIOD_MEASURE", f"{m.name} compares one measure")
            now = self.builder(lambda parts: q(parts[0])).build(tree)
            then = self.builder(lambda parts, k=k: q(f"{SEP}{k}{SEP}{parts[0]}")).build(tree)
            how = m.period_over_period.comparison.lower()
            value = {"ratio": lambda: divided(now, then), "difference": lambda: now - then, "previousvalue": lambda: then, "percentchange": lambda: divided(now - then, then)}[how]()
            out = out.withColumn(m.name, value)
        return out

    def raw(self) -> DataFrame:
        """Rows as they are; of facts that no object leads to together, one below the other."""
        fields = {}
        for f in self.query.select.fields:
            if (found := self.field(f)) is None:
                raise SemanticError("RAW_MODE", f"{f} is a measure")
            fields[f] = found
        objects = {o for o, _, v in fields.values()} | self.filter_objects(self.query.where)
        base = self.graph.root(objects, {o for o, _, _ in fields.values()})
        roots = [base] if base else sorted({r for r in (o for o, _, _ in fields.values()) if not any(r != x and self.graph.reaches(x, {r}) for x in (o for o, _, _ in fields.values()))})
        legs = []
        for root in roots:
            scope = Scope(self.model, self.graph, self.tables, root, self.warn)
            cols = {f: scope.column(o, c, v) for f, (o, c, v) in fields.items() if self.graph.reaches(root, {o})}
            missing = [o for o in self.filter_objects(self.query.where) if not self.graph.reaches(root, {o})]
            if missing:
                raise SemanticError("UNREACHABLE_FILTER", f"{', '.join(missing)} can't be reached from {root}")
            self.where(scope, self.query.where)
            scope.check_fanout(self.query.allow_fan_out)
            legs.append(scope.frame().select(*(c.alias(f) for f, c in cols.items())))
        self.plan.kind, self.plan.base = "raw" if len(legs) == 1 else "raw union", roots[0]
        out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), legs).select(*map(q, fields))
        return out.distinct() if self.query.select.distinct else out

    def excluded(self) -> DataFrame:
        """Combinations of dimension values that no fact row brings together."""
        groups: list[list[Dim]] = []
        for d in self.dims:
            home = next((g for g in groups if self.graph.root({self.dimension(x.parts[0][0]).data_object for x in [*g, d]}, set()) in {self.dimension(x.parts[0][0]).data_object for x in [*g, d]}), None)
            groups.append([d]) if home is None else home.append(d)
        if len(groups) < 2:
            raise SemanticError("EXCLUDE_GROUPS", "dimensionsExclude needs dimensions of at least two unrelated objects")
        # filters hold for the values on either side: each group takes those that it reaches
        parts = []
        for g in groups:
            sub = Planner(self.model, self.tables, replace(self.query, select=Select([self._raw(d) for d in g]), dimensions_exclude=False, order_by=[], limit=None), self.plan)
            own = {self.dimension(p).data_object for d in g for p, _ in d.parts}
            root = self.graph.root(own)
            parts.append(sub.facts([], [f for f in self.query.where if self.graph.reaches(root, self.filter_objects([f]))]))
        self.plan.kind = "exclude"
        every = reduce(lambda a, b: a.crossJoin(b), parts).select(*(q(d.label) for d in self.dims))
        return every.subtract(self.facts([], self.query.where).select(*(q(d.label) for d in self.dims)))

    def ordered(self, df: DataFrame, keep: list[str], hidden: list[str] = ()) -> DataFrame:
        keys = list(self.query.order_by)
        labels = [d.label for d in self.dims]
        if not keys and labels and (self.query.limit is not None or self.query.grouping):
            keys = [OrderBy(n, "asc", "first" if self.query.grouping else None) for n in labels]
        order = []
        for k in keys:
            name = keep[int(k.field) - 1] if str(k.field).isdigit() and int(k.field) <= len(keep) else k.field
            if name not in keep and name not in hidden:
                raise SemanticError("ORDER_FIELD", f"{k.field!r} is not selected")
            first = k.nulls == "first"
            order.append(getattr(q(name), f"{k.direction.lower()}_nulls_{'first' if first else 'last'}")())
        if order:
            df = df.orderBy(*order)
        if self.query.offset:
            df = df.offset(self.query.offset)
        if self.query.limit is not None:
            df = df.limit(self.query.limit)
        return df.select(*map(q, keep)) if hidden else df


class _Rewritten:
    """Resolves references of an expression whose foreign parts were replaced."""

    def __init__(self, tree, resolve):
        self.tree, self.resolve = tree, resolve

    def __call__(self, parts):
        return self.resolve(parts)


class _Undirected(Graph):
    """The same joins, walked both ways, for measures that allow fan-out."""

    def __init__(self, graph: Graph):
        self.model, self.out, self.all = graph.model, graph.all, graph.all
