"""The semantic model: objects, joins, dimensions, measures and metrics, read from dicts or YAML."""

from __future__ import annotations

import re
import types
import typing
from dataclasses import MISSING, dataclass, field, fields
from pathlib import Path
from typing import Any

from .errors import SemanticError

#: Accepted anywhere, kept as metadata only.
METADATA = ("description", "comment", "owner", "synonyms", "customExtensions", "format", "refresh", "num_class")


def _snake(name: str) -> str:
    return re.sub(r"(?<=[a-z])([A-Z])", lambda m: "_" + m[1].lower(), name)


def read(kind: type, data: dict, where: str = "model", **given: Any):
    """An instance of a dataclass from camel-case keys; unknown keys are refused."""
    if not isinstance(data, dict):
        raise SemanticError("MODEL_SYNTAX", f"{where} must be a mapping")
    known = {f.name: f for f in fields(kind)}
    hints = typing.get_type_hints(kind)
    values, meta = dict(given), {}
    for key, value in data.items():
        name = _snake(key)
        if key in METADATA and name not in known:
            meta[key] = value
        elif name not in known:
            raise SemanticError("UNKNOWN_KEY", f"{where} has no {key}")
        elif value is not None:
            values[name] = _value(hints[name], value, f"{where}.{key}")
    if "meta" in known:
        values["meta"] = meta
    lacking = [f.name for f in known.values() if f.name not in values and f.default is MISSING and f.default_factory is MISSING]
    if lacking:
        raise SemanticError("MISSING_KEY", f"{where} needs {', '.join(lacking)}")
    return kind(**values)


def _value(hint: Any, value: Any, where: str) -> Any:
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (typing.Union, types.UnionType):
        options = [a for a in args if a is not type(None)]
        if len(options) == 2 and isinstance(value, dict):  # a filter or a group of filters
            return _value(options[1] if "filters" in value else options[0], value, where)
        return _value(options[0], value, where) if len(options) == 1 else value
    if origin is list:
        return [_value(args[0], v, f"{where}[{i}]") for i, v in enumerate(value)]
    if origin is dict:
        named = getattr(args[1], "__dataclass_fields__", {})
        return {k: read(args[1], v or {}, f"{where}.{k}", **({"name": k} if "name" in named else {})) if named else v for k, v in value.items()}
    return read(hint, value, where) if hasattr(hint, "__dataclass_fields__") else value


@dataclass
class Settings:
    default_numeric_data_type: str = "decimal(18,2)"
    default_timezone: str | None = None
    override_database_timezone: bool = False
    default_dialect: str | None = None
    expression_mode: str = "permissive"
    query_timezone: str | None = None
    week_start: str = "monday"
    default_locale: str | None = None


@dataclass
class ColumnDef:
    name: str
    abstract_type: str
    code: str = ""
    expression: str | None = None
    primary_key: bool = False
    sql_type: str | None = None
    sql_precision: int | None = None
    sql_scale: int | None = None
    num_class: str | None = None
    meta: dict = field(default_factory=dict)


@dataclass
class Join:
    join_type: str
    join_to: str
    columns_from: list[str]
    columns_to: list[str]
    secondary: bool = False
    path_name: str | None = None
    required: bool = False


@dataclass
class Nested:
    data_object: str
    column: str


@dataclass
class DataObject:
    name: str
    code: str = ""
    database: str = ""
    schema: str = ""
    columns: dict[str, ColumnDef] = field(default_factory=dict)
    joins: list[Join] = field(default_factory=list)
    nested_in: Nested | None = None
    countable: bool = True
    count_label: str | None = None
    meta: dict = field(default_factory=dict)

    @property
    def key(self) -> list[str]:
        return [c.name for c in self.columns.values() if c.primary_key]


@dataclass
class Dimension:
    name: str
    data_object: str
    column: str
    result_type: str = "string"
    time_grain: str | None = None
    via: str | None = None
    meta: dict = field(default_factory=dict)


@dataclass
class ColumnRef:
    data_object: str
    column: str | None = None


@dataclass
class FilterValue:
    data_type: str = "string"
    is_null: bool | None = None
    value_string: str | None = None
    value_int: int | None = None
    value_float: float | None = None
    value_date: str | None = None
    value_boolean: bool | None = None

    @property
    def value(self) -> Any:
        return next((v for v in (self.value_string, self.value_int, self.value_float, self.value_date, self.value_boolean) if v is not None), None)


@dataclass
class MeasureFilter:
    operator: str
    column: ColumnRef | None = None
    values: list[FilterValue] = field(default_factory=list)


@dataclass
class MeasureFilterGroup:
    logic: str = "and"
    filters: list[MeasureFilter | MeasureFilterGroup] = field(default_factory=list)
    negated: bool = False


@dataclass
class WithinGroup:
    column: ColumnRef
    order: str = "ASC"


@dataclass
class Grain:
    mode: str = "RELATIVE"
    exclude: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    keep_only: list[str] = field(default_factory=list)


@dataclass
class ContextFilter:
    field: str
    op: str
    value: Any = None


@dataclass
class FilterContext:
    mode: str = "RELATIVE"
    exclude: list[str] = field(default_factory=list)
    include: list[ContextFilter] = field(default_factory=list)
    keep_only: list[str] = field(default_factory=list)


@dataclass
class Measure:
    name: str
    aggregation: str
    columns: list[ColumnRef] = field(default_factory=list)
    result_type: str = "float"
    expression: str | None = None
    distinct: bool = False
    total: bool = False
    default_value: Any = None
    anchor: str | None = None
    grain: Grain | None = None
    filter_context: FilterContext | None = None
    filters: list[MeasureFilter | MeasureFilterGroup] = field(default_factory=list)
    data_type: str | None = None
    allow_fan_out: bool = False
    delimiter: str | None = None
    within_group: WithinGroup | None = None
    meta: dict = field(default_factory=dict)


@dataclass
class PeriodOverPeriod:
    time_dimension: str
    grain: str
    offset_grain: str
    offset: int = -1
    comparison: str = "percentChange"


@dataclass
class Metric:
    name: str
    type: str = "derived"
    expression: str | None = None
    measure: str | None = None
    time_dimension: str | None = None
    cumulative_type: str = "sum"
    window: int | None = None
    grain_to_date: str | None = None
    partition_by: list[str] = field(default_factory=list)
    period_over_period: PeriodOverPeriod | None = None
    window_function: str | None = None
    offset: int | None = None
    buckets: int | None = None
    order_direction: str = "desc"
    default_value: Any = None
    data_type: str | None = None
    meta: dict = field(default_factory=dict)


@dataclass
class ModelFilter:
    data_object: str
    column: str
    operator: str
    value: Any = None
    values: list[Any] = field(default_factory=list)


@dataclass
class Example:
    name: str
    description: str = ""
    intent_tags: list[str] = field(default_factory=list)
    query: dict[str, Any] = field(default_factory=dict)


@dataclass
class Model:
    version: float = 1.0
    name: str | None = None
    settings: Settings = field(default_factory=Settings)
    data_objects: dict[str, DataObject] = field(default_factory=dict)
    dimensions: dict[str, Dimension] = field(default_factory=dict)
    measures: dict[str, Measure] = field(default_factory=dict)
    metrics: dict[str, Metric] = field(default_factory=dict)
    filters: list[ModelFilter] = field(default_factory=list)
    examples: list[Example] = field(default_factory=list)
    expose_counts: bool = True
    count_label_pattern: str = "{object} Count"
    extends: Any = None
    inherits: Any = None
    meta: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        for m in self.measures.values():
            m.aggregation = {"agg": "measure", "aggregate": "measure"}.get(m.aggregation.lower(), m.aggregation.lower())
        if self.expose_counts:
            taken = {**self.dimensions, **self.measures, **self.metrics}
            for o in self.data_objects.values():
                label = o.count_label or self.count_label_pattern.replace("{object}", o.name)
                if o.countable and not o.nested_in and label not in taken:
                    self.measures[label] = Measure(label, "count", [ColumnRef(o.name)], "int", meta={"synthesized": True})

    def column(self, data_object: str, column: str) -> ColumnDef:
        if data_object not in self.data_objects:
            raise SemanticError("UNKNOWN_DATA_OBJECT", f"no data object is called {data_object!r}")
        if column not in self.data_objects[data_object].columns:
            raise SemanticError("UNKNOWN_COLUMN", f"{data_object} has no column {column!r}")
        return self.data_objects[data_object].columns[column]


def merge(base: dict, over: dict) -> dict:
    """``base`` with what ``over`` adds or replaces, mappings merged, filters and examples joined."""
    out = dict(base)
    for k, v in over.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merge(out[k], v) if k in ("dataObjects", "dimensions", "measures", "metrics", "settings", "columns") or isinstance(v.get("columns"), dict) else {**out[k], **v}
        elif k in ("filters", "examples") and isinstance(out.get(k), list):
            out[k] = [*out[k], *v]
        else:
            out[k] = v
    return out


def composed(data: dict, folder: Path | None = None, seen: tuple[str, ...] = ()) -> dict:
    """``extends``: fragments (analytics only) are merged in.  ``inherits``: a parent that this model refines."""
    data = dict(data)
    extends, inherits = data.pop("extends", None), data.pop("inherits", None)
    if extends and inherits:
        raise SemanticError("COMPOSITION", "a model can't both extend and inherit")
    for source in [extends] if isinstance(extends, (str, dict)) else extends or []:
        part = _fragment(source, folder, seen)
        if part.get("dataObjects"):
            raise SemanticError("COMPOSITION", "a fragment that is extended must not declare dataObjects")
        data = merge(part, data)
    if inherits:
        data = merge(_fragment(inherits, folder, seen), data)
    return data


def _fragment(source: Any, folder: Path | None, seen: tuple[str, ...]) -> dict:
    if isinstance(source, dict) and "file" not in source:
        return composed(source, folder, seen)
    path = str(((folder or Path(".")) / (source["file"] if isinstance(source, dict) else source)).resolve())
    if path in seen:
        raise SemanticError("COMPOSITION", f"{path} composes itself")
    return composed(load_yaml(Path(path).read_text()), Path(path).parent, (*seen, path))


#: A YAML text may not be longer, nor have more aliases.
MOST_CHARACTERS, MOST_ALIASES = 10_000_000, 1000


def load_yaml(text: str) -> dict:
    import yaml

    if len(text) > MOST_CHARACTERS or len(re.findall(r"(?m)[\s\[,]\*[A-Za-z0-9_]", text)) > MOST_ALIASES:
        raise SemanticError("MODEL_SYNTAX", "the YAML text is too large")
    return yaml.safe_load(text) or {}


def load(source: dict | str | Path) -> Model:
    """A model from a dict, a YAML text, or a YAML file."""
    if isinstance(source, dict):
        return read(Model, composed(source))
    path = Path(source) if isinstance(source, Path) or "\n" not in source else None
    if path is None:
        return read(Model, composed(load_yaml(source)))
    return read(Model, composed(load_yaml(path.read_text()), path.parent, (str(path.resolve()),)))
