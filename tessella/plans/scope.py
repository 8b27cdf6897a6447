"""A joined frame that grows as columns are asked for.

Every physical column is renamed to ``<instance>␟<name>`` when its object is scanned, so roles and
self-joins can't clash.  An instance is one object on one join path; Catalyst drops what isn't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import FanoutError, SemanticError
from ..functions.expressions import Builder, parse, spark_type
from ..model import ColumnDef, Model
from .graph import Graph, Path

SEP = "␟"


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def size_of(df: DataFrame) -> int | None:
    """Bytes that Spark estimates for a frame; None if it knows nothing."""
    plan = getattr(df, "_jdf", None)
    size = int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes())) if plan is not None else 1 << 63
    return size if size < 1 << 60 else None


def broadcast(df: DataFrame) -> bool:
    """Whether Spark is going to send a frame to all executors, as far as can be told."""
    size, most = size_of(df), df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return size is not None and size <= most


class Scope:
    """The rows of ``root`` with what they determine.  ``tables`` gives the frame of a data object."""

    def __init__(self, model: Model, graph: Graph, tables, root: str, warn, inner: bool = False):
        self.model, self.graph, self.tables, self.root, self.warn, self.inner = model, graph, tables, root, warn, inner
        self.instances: dict[Path, str] = {(): root}
        self.steps: list = []  # applied to the joined frame in order
        self.marks = 0
        self.tasks = 0  # that large joins deal the rows to; 0: the session's
        self.dealt: Path = ()  # the join by whose columns rows lie in these tasks
        self.moved = False  # whether a step deals them anew

    def instance(self, obj: str, via: str | None = None, path: Path | None = None) -> str:
        if path is None:
            if via and via != self.root and not self.graph.reaches(self.root, {via}):
                raise SemanticError("UNREACHABLE_REQUIRED_OBJECT", f"{via} is not reached from {self.root}")
            path = self.graph.path(self.root, obj, via, undirected=self.inner)
        for n in range(1, len(path) + 1):
            if path[:n] not in self.instances:
                taken, end = set(self.instances.values()), path[n - 1].end
                self.instances[path[:n]] = end if end not in taken else f"{end}@{len(taken)}"
        return self.instances[path]

    def path_of(self, obj: str) -> Path:
        instance = self.instance(obj)
        return next(p for p, n in self.instances.items() if n == instance)

    def column(self, obj: str, name: str, via: str | None = None) -> Column:
        return self.of(self.instance(obj, via), obj, self.model.column(obj, name))

    def of(self, instance: str, obj: str, c: ColumnDef) -> Column:
        if c.expression is None:
            return self.leaf(q(f"{instance}{SEP}{c.name}"), c)

        def resolve(parts: tuple[str, ...]) -> Column:
            if len(parts) == 1:
                if parts[0] == c.name:
                    raise SemanticError("CYCLIC_COLUMN", f"{obj}.{c.name} refers to itself")
                return self.of(instance, obj, self.model.column(obj, parts[0]))
            return self.of(instance, obj, self.model.column(*parts)) if parts[0] == obj else self.column(*parts)

        return self.builder(resolve).build(parse(c.expression))

    def builder(self, resolve) -> Builder:
        s = self.model.settings
        return Builder(resolve, s.expression_mode == "portable", s.week_start, self.warn)

    def leaf(self, out: Column, c: ColumnDef) -> Column:
        """A stored column: in the type its hints name, in the query's time zone."""
        if c.sql_precision:
            out = out.cast(spark_type(f"{c.sql_type or 'decimal'}({c.sql_precision},{c.sql_scale or 0})"))
        s = self.model.settings
        if s.query_timezone and c.abstract_type == "timestamp_tz":
            out = F.convert_timezone(F.current_timezone(), F.lit(s.query_timezone), out.cast("timestamp_ntz"))
        elif s.query_timezone and s.default_timezone and c.abstract_type == "timestamp":
            out = F.convert_timezone(F.lit(s.default_timezone), F.lit(s.query_timezone), out.cast("timestamp_ntz"))
        return out

    def scan(self, obj: str, instance: str) -> DataFrame:
        o, df = self.model.data_objects[obj], self.tables(self.model.data_objects[obj])
        arrays = {x.nested_in.column.split(".")[0] for x in self.model.data_objects.values() if x.nested_in and x.nested_in.data_object == obj}
        stored = {f"{instance}{SEP}{c.name}": c.code or c.name for c in o.columns.values() if c.expression is None} | {f"{instance}{SEP}{SEP}{a}": a for a in sorted(arrays)}
        quoted = lambda name: "`" + name.replace("`", "``") + "`"
        return df.selectExpr(*(f"{quoted(code)} AS {quoted(name)}" for name, code in stored.items()))

    def unnested(self, df: DataFrame, parent: str, child: str, instance: str) -> DataFrame:
        """The elements of the parent's array; a parent without any keeps one row of nulls."""
        o = self.model.data_objects[child]
        head, *rest = o.nested_in.column.split(".")
        array = q(f"{parent}{SEP}{SEP}{head}")
        for part in rest:
            array = array.getField(part)
        df = df.withColumn("__element", F.explode_outer(array))
        inner = {x.nested_in.column.split(".")[0] for x in self.model.data_objects.values() if x.nested_in and x.nested_in.data_object == child}
        stored = {f"{instance}{SEP}{c.name}": F.col("__element").getField(c.code or c.name) for c in o.columns.values() if c.expression is None}
        return df.withColumns(stored | {f"{instance}{SEP}{SEP}{a}": F.col("__element").getField(a) for a in inner}).drop("__element")

    def key_of(self, instance: str, obj: str, names: tuple[str, ...]) -> list[Column]:
        return [self.of(instance, obj, self.model.column(obj, n)) for n in names]

    def base(self) -> DataFrame:
        """The root's rows; of a nested object, with its parents'."""
        chain, obj = [], self.root
        while self.model.data_objects[obj].nested_in:
            chain.append(obj)
            obj = self.model.data_objects[obj].nested_in.data_object
        if not chain:
            return self.scan(self.root, self.root)
        names = {self.root: self.root}
        path: Path = ()
        for child in chain:
            up = next(e for e in self.graph.out[child] if e.path_name == "nested")
            path = (*path, up)
            names[up.end] = self.instance(up.end, path=path)
        df, parent = self.scan(obj, names[obj]), obj
        for child in reversed(chain):
            df, parent = self.unnested(df, names[parent], child, names[child]), child
        return df

    def frame(self) -> DataFrame:
        df, done = self.base(), set()
        while todo := [p for p in self.instances if p and p not in done]:
            for path in sorted(todo, key=len):
                done.add(path)
                edge, instance, parent = path[-1], self.instances[path], self.instances[path[:-1]]
                if edge.path_name == "nested":
                    continue
                if edge.nested:
                    df = self.unnested(df, parent, edge.end, instance)
                    continue
                # asking for key columns may bring computed columns of further objects
                left, right = self.key_of(parent, edge.start, edge.start_columns), self.key_of(instance, edge.end, edge.end_columns)
                on = [a == b for a, b in zip(left, right)]
                cond = on[0]
                for x in on[1:]:
                    cond = cond & x
                other = self.scan(edge.end, instance)
                if self.tasks and not broadcast(other) and [t for _, t in df.select(*left).dtypes] == [t for _, t in other.select(*right).dtypes]:
                    df, self.dealt = df.repartition(self.tasks, *left), path
                df = df.join(other, cond, "inner" if self.inner or edge.required else "left")
        for step in self.steps:
            df = step(df)
        self.dealt = () if self.moved else self.dealt
        return df

    def check_fanout(self, allowed: bool) -> None:
        for path in self.instances:
            for e in path:
                if e.multiplies and not e.nested:
                    if not allowed:
                        raise FanoutError(f"the join from {e.start} to {e.end} repeats rows of {e.start}")
                    self.warn(f"FAN_TRAP_RISK: the join from {e.start} to {e.end} repeats rows")
