"""Results kept for as long as the data they come from counts as fresh."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

from ..engine import Engine
from ..plans.query import query

#: Seconds of a freshness unit, and the least and most that a result is kept.
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}
LEAST, MOST = 5, 86_400


@dataclass
class Entry:
    df: DataFrame
    until: float
    tables: frozenset[str]


@dataclass
class ResultCache:
    """Persisted frames by canonical query.  ``refresh`` of an object: {"type": "interval", "every": 10, "unit": "minute"}, "static", or "heartbeat"."""

    engine: Engine
    most: int = 100
    clock: Callable[[], float] = time.monotonic
    entries: dict[str, Entry] = field(default_factory=dict)

    def key(self, source) -> str:
        """The same for queries that differ only in spelling."""
        return json.dumps(asdict(query(source)), sort_keys=True, default=str)

    def ttl(self, source) -> float:
        """The shortest freshness among the objects whose tables the query reads; 0 where it depends on the clock or on chance."""
        if not self.engine.deterministic(source):
            return 0
        touched = set(self.engine.tables_touched(source))
        found = [_seconds(o.meta.get("refresh")) for o in self.engine.model.data_objects.values() if ".".join(p for p in (o.database, o.schema, o.code or o.name) if p) in touched]
        return max(LEAST, min([MOST, *found]))

    def query(self, source) -> DataFrame:
        key, now = self.key(source), self.clock()
        self.entries = {k: e for k, e in self.entries.items() if e.until > now or e.df.unpersist() is None}
        if key in self.entries:
            return self.entries[key].df
        df, ttl = self.engine.query(source), self.ttl(source)
        if ttl:
            if len(self.entries) >= self.most:
                self.entries.pop(min(self.entries, key=lambda k: self.entries[k].until)).df.unpersist()
            self.entries[key] = Entry(df := df.persist(), now + ttl, frozenset(self.engine.tables_touched(source)))
        return df

    def heartbeat(self, table: str) -> int:
        """Drops what was read from a table that has changed; says how many."""
        stale = [k for k, e in self.entries.items() if table in e.tables]
        for k in stale:
            self.entries.pop(k).df.unpersist()
        return len(stale)


def _seconds(refresh) -> float:
    if isinstance(refresh, dict) and refresh.get("type") == "interval":
        return refresh.get("every", 1) * UNITS[refresh.get("unit", "hour")]
    return MOST
