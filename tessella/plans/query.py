"""Queries: labels only."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..errors import SemanticError
from ..functions.catalog import UNITS
from ..model import load_yaml, read


@dataclass
class Subquery:
    data_object: str
    path_name: str | None = None
    filter: list[QueryFilter] = field(default_factory=list)


@dataclass
class QueryFilter:
    field: str
    op: str
    value: Any = None
    subquery: Subquery | None = None

    def __post_init__(self) -> None:
        if (self.op in ("exists", "nonexists")) != (self.subquery is not None):
            raise SemanticError("FILTER_VALUE", f"{self.op} on {self.field}: exists and nonexists, and only these, take a subquery")


@dataclass
class FilterGroup:
    logic: str = "and"
    filters: list[QueryFilter | FilterGroup] = field(default_factory=list)
    negated: bool = False


@dataclass
class OrderBy:
    field: str
    direction: str = "asc"
    nulls: str | None = None


@dataclass
class PathChoice:
    source: str
    target: str
    path_name: str


@dataclass
class Select:
    dimensions: list[Any] = field(default_factory=list)
    measures: list[str] = field(default_factory=list)
    fields: list[str] = field(default_factory=list)
    distinct: bool = False


@dataclass
class Query:
    select: Select = field(default_factory=Select)
    where: list[QueryFilter | FilterGroup] = field(default_factory=list)
    having: list[QueryFilter | FilterGroup] = field(default_factory=list)
    order_by: list[OrderBy] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None
    use_path_names: list[PathChoice] = field(default_factory=list)
    allow_fan_out: bool = False
    dimensions_exclude: bool = False
    grouping: str | None = None

    def __post_init__(self) -> None:
        s = self.select
        if s.fields and (s.dimensions or s.measures or self.having or self.grouping or self.dimensions_exclude):
            raise SemanticError("RAW_MODE", "fields exclude dimensions, measures, having, grouping and dimensionsExclude")
        if s.distinct and not s.fields:
            raise SemanticError("RAW_MODE", "distinct needs fields")
        if not (s.fields or s.dimensions or s.measures):
            raise SemanticError("EMPTY_SELECT", "nothing is selected")
        if self.grouping and (not s.dimensions or self.grouping not in ("rollup", "cube")):
            raise SemanticError("GROUPING", "grouping is rollup or cube, over at least one dimension")


def query(source: Query | dict | str) -> Query:
    if isinstance(source, Query):
        return source
    return read(Query, load_yaml(source) if isinstance(source, str) else source, "query")


@dataclass(frozen=True)
class Dim:
    """A selected dimension: ``parts`` are its names, more than one for a coalesced one."""

    label: str
    parts: tuple[tuple[str, str | None], ...]


def dim(raw: Any) -> Dim:
    if isinstance(raw, dict):
        return Dim(raw["as"], tuple(_named(x) for x in raw["coalesce"]))
    name, grain = _named(raw)
    return Dim(name, ((name, grain),))


def _named(raw: str) -> tuple[str, str | None]:
    name, colon, grain = raw.rpartition(":")
    return (name, grain) if colon and grain in UNITS else (raw, None)


def leaves_of(filters: list) -> list[QueryFilter]:
    """All single conditions, out of all groups."""
    return [x for f in filters for x in (leaves_of(f.filters) if isinstance(f, FilterGroup) else [f])]
