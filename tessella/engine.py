"""The engine: a model bound to tables, asked by labels."""

from __future__ import annotations

import weakref
from collections import deque
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from .model import Model, load
from .plans.planner import Plan, Planner
from .plans.query import Query, query
from .sources.tables import Tables


@dataclass
class Compiled:
    """A query's frame, lazily evaluated, with what was decided and warned of on the way."""

    df: DataFrame
    plan: Plan
    query: Query

    @property
    def warnings(self) -> list[str]:
        return self.plan.warnings


#: Queries whose intermediate aggregates stay persisted, the latest ones.
HELD = 16


class Engine:
    """Some queries read an aggregate several times (periods, totals): it is persisted until ``HELD`` later queries
    have done so, or until ``release``; a frame used after that computes it again."""

    def __init__(self, model: Model | dict | str | Path, tables: Tables):
        self.model, self.tables = model if isinstance(model, Model) else load(model), tables
        self.held: deque[list[DataFrame]] = deque()
        weakref.finalize(self, _release, self.held).atexit = False

    def compile(self, source: Query | dict | str) -> Compiled:
        made = self._planned(source, self.tables)
        if made.plan.kept:
            # an equal aggregate of an earlier query may be older than the tables
            self.held.append([df.unpersist().persist() for df in made.plan.kept])
            while len(self.held) > HELD:
                _unpersist(self.held.popleft())
        return made

    def _planned(self, source: Query | dict | str, tables) -> Compiled:
        asked, plan = query(source), Plan()
        return Compiled(Planner(self.model, tables, asked, plan).build(), plan, asked)

    def release(self) -> None:
        """Lets go of all intermediate aggregates."""
        _release(self.held)

    def deterministic(self, source: Query | dict | str) -> bool:
        """Whether the query gives the same on the same tables at any time: no clock, no randomness anywhere below."""
        df = self._planned(source, self.tables).df
        plan, jvm = df._jdf.queryExecution().analyzed(), df.sparkSession._jvm
        return plan.deterministic() and not plan.containsPattern(jvm.org.apache.spark.sql.catalyst.trees.TreePattern.CURRENT_LIKE())

    def query(self, source: Query | dict | str) -> DataFrame:
        """The result of a query: labels in, a DataFrame out."""
        return self.compile(source).df

    def sql(self, text: str) -> DataFrame:
        """The result of a BI-style SELECT over the model's labels."""
        from .bisql import translate

        return self.query(translate(self.model, text))

    def explain(self, source: Query | dict | str, mode: str = "formatted") -> str:
        """The decisions, then Spark's plan."""
        made = self._planned(source, self.tables)
        lines = [f"kind: {made.plan.kind}", f"base: {made.plan.base}", *(f"step: {s}" for s in made.plan.steps), *(f"warning: {w}" for w in made.warnings)]
        jvm = made.df.sparkSession._jvm
        return "\n".join([*lines, jvm.PythonSQLUtils.explainString(made.df._jdf.queryExecution(), mode)])

    def tables_touched(self, source: Query | dict | str) -> list[str]:
        """Codes of the tables that a query reads."""
        touched: list[str] = []

        def get(o):
            touched.append(".".join(p for p in (o.database, o.schema, o.code or o.name) if p))
            return self.tables(o)

        self._planned(source, get)
        return sorted(set(touched))

    def batch(self, queries: dict[str, Any], parallel: int = 4) -> dict[str, list]:
        """Results of several bounded queries, a few at a time."""
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(parallel) as pool:
            return dict(zip(queries, pool.map(lambda x: self.query(x).collect(), queries.values())))


def _release(held: deque[list[DataFrame]]) -> None:
    while held:
        _unpersist(held.popleft())


def _unpersist(frames: list[DataFrame]) -> None:
    for df in frames:
        if df.sparkSession._jsc.sc().isStopped():
            return
        df.unpersist()
