"""The join graph: which objects a row of one object determines, and along which joins."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from ..errors import SemanticError
from ..model import Join, Model


@dataclass(frozen=True)
class Edge:
    """A step from one object to another; ``backward`` if the join is declared on the other side."""

    start: str
    end: str
    start_columns: tuple[str, ...]
    end_columns: tuple[str, ...]
    kind: str
    required: bool = False
    backward: bool = False
    nested: bool = False
    path_name: str | None = None

    @property
    def multiplies(self) -> bool:
        """Whether a row can meet several."""
        return self.nested or self.kind == "many-to-many" or (self.backward and self.kind == "many-to-one")


Path = tuple[Edge, ...]


class Graph:
    def __init__(self, model: Model, use_paths: dict[tuple[str, str], str] | None = None):
        self.model, use_paths = model, use_paths or {}
        self.out: dict[str, list[Edge]] = {name: [] for name in model.data_objects}
        self.all: dict[str, list[Edge]] = {name: [] for name in model.data_objects}
        for o in model.data_objects.values():
            for j in o.joins:
                if j.join_to not in self.out:
                    raise SemanticError("UNKNOWN_DATA_OBJECT", f"{o.name} joins {j.join_to!r}, which isn't there")
                wanted = use_paths.get((o.name, j.join_to))
                if j.secondary != (wanted is not None) or (wanted is not None and j.path_name != wanted):
                    continue
                self._add(o.name, j)
            if o.nested_in:
                edge = Edge(o.nested_in.data_object, o.name, (), (), "one-to-many", nested=True)
                self.out[o.name].append(Edge(o.name, o.nested_in.data_object, (), (), "many-to-one", nested=False, backward=False, path_name="nested"))
                self.all[o.name].append(self.out[o.name][-1])
                self.all[edge.start].append(edge)

    def _add(self, name: str, j: Join) -> None:
        forward = Edge(name, j.join_to, tuple(j.columns_from), tuple(j.columns_to), j.join_type, j.required, path_name=j.path_name)
        back = Edge(j.join_to, name, tuple(j.columns_to), tuple(j.columns_from), j.join_type, False, True, path_name=j.path_name)
        self.out[name].append(forward)
        self.all[name].append(forward)
        self.all[j.join_to].append(back)
        if j.join_type in ("one-to-one", "many-to-many"):
            self.out[j.join_to].append(back)

    def distances(self, start: str, undirected: bool = False) -> dict[str, int]:
        edges, out, queue = self.all if undirected else self.out, {start: 0}, deque([start])
        while queue:
            at = queue.popleft()
            for e in edges[at]:
                if e.end not in out:
                    out[e.end] = out[at] + 1
                    queue.append(e.end)
        return out

    def reaches(self, start: str, wanted: set[str]) -> bool:
        return wanted <= set(self.distances(start))

    def shortest(self, start: str, end: str, undirected: bool = False) -> list[Path]:
        """All shortest paths, in the order of declaration."""
        if start == end:
            return [()]
        edges = self.all if undirected else self.out
        queue: deque[tuple[str, Path]] = deque([(start, ())])
        found: list[Path] = []
        while queue:
            at, path = queue.popleft()
            if found and len(path) >= len(found[0]):
                break
            for e in edges[at]:
                if e.end == end:
                    found.append((*path, e))
                elif all(e.end != x.start for x in path) and e.end != start:
                    queue.append((e.end, (*path, e)))
        return found

    def path(self, start: str, end: str, via: str | None = None, undirected: bool = False) -> Path:
        """The path to an object, through ``via`` if given; equally short ones with different last joins are refused."""
        if via and via not in (start, end):
            return self.path(start, via) + self.path(via, end)
        found = self.shortest(start, end, undirected)
        if not found:
            raise SemanticError("UNREACHABLE_REQUIRED_OBJECT", f"no join leads from {start} to {end}")
        if not undirected and len({p[-1] for p in found if p}) > 1:
            raise SemanticError("AMBIGUOUS_JOIN_PATH", f"{end} is reached from {start} by {' or by '.join(sorted({p[-1].start for p in found}))}; name one with via")
        return found[0]

    def root(self, wanted: set[str], prefer: set[str] = frozenset()) -> str | None:
        """The object that determines all wanted ones: among ``prefer`` the one with most joins, else the nearest."""
        able = {o: d for o in self.out if wanted <= set(d := self.distances(o))}
        if not able:
            return None
        among = [o for o in able if o in prefer]
        if among:
            return min(among, key=lambda o: (-len(self.model.data_objects[o].joins), o))
        inside = [o for o in able if o in wanted]
        return min(inside or able, key=lambda o: (sum(able[o][w] for w in wanted), o))
