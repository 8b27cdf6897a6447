"""Looking around in a model: what it has, what goes together, what something is called."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .errors import SemanticError
from .functions.expressions import parse, refs
from .model import Model
from .plans.planner import Planner
from .plans.query import query


def metadata(spark: SparkSession, model: Model) -> dict[str, DataFrame]:
    """Frames of the model's dimensions, measures, metrics, columns and joins."""

    def text(x, key: str) -> str | None:
        value = x.meta.get(key)
        return ", ".join(value) if isinstance(value, list) else value

    rows = {
        "dimensions": ("name string, object string, column string, type string, grain string, via string, description string, synonyms string", [(d.name, d.data_object, d.column, d.result_type, d.time_grain, d.via, text(d, "description"), text(d, "synonyms")) for d in model.dimensions.values()]),
        "measures": ("name string, aggregation string, sources string, expression string, total boolean, synthesized boolean, description string, synonyms string", [(m.name, m.aggregation, ", ".join(f"{c.data_object}.{c.column}" if c.column else c.data_object for c in m.columns), m.expression, m.total, bool(m.meta.get("synthesized")), text(m, "description"), text(m, "synonyms")) for m in model.measures.values()]),
        "metrics": ("name string, type string, measure string, expression string, description string, synonyms string", [(m.name, m.type, m.measure, m.expression, text(m, "description"), text(m, "synonyms")) for m in model.metrics.values()]),
        "columns": ("object string, column string, code string, type string, expression string, primary_key boolean", [(o.name, c.name, c.code, c.abstract_type, c.expression, c.primary_key) for o in model.data_objects.values() for c in o.columns.values()]),
        "joins": ("object string, target string, cardinality string, columns_from string, columns_to string, path string, required boolean", [(o.name, j.join_to, j.join_type, ", ".join(j.columns_from), ", ".join(j.columns_to), j.path_name, j.required) for o in model.data_objects.values() for j in o.joins]),
    }
    return {name: spark.createDataFrame(data, schema) for name, (schema, data) in rows.items()}


def composable(model: Model, selected: dict, tables) -> dict[str, list[str]]:
    """Dimensions, measures and metrics that can still be added to a query's select."""
    base = {"dimensions": list(selected.get("dimensions", [])), "measures": list(selected.get("measures", []))}

    def fits(kind: str, name: str) -> bool:
        asked = query({"select": {**base, kind: [*base[kind], name]}})
        try:
            planner = Planner(model, tables, asked)
            measures = [model.measures[b] for n in asked.select.measures for b in planner.metric_measures(n)]
            needed = {planner.root_of(m) for m in measures} | planner.dim_objects()
            if planner.graph.root(needed) is not None:
                return True
            # several facts: every dimension must be led to by one of them
            return len({planner.root_of(m) for m in measures}) > 1 and all(any(planner.graph.reaches(planner.root_of(m), {o}) for m in measures) for o in planner.dim_objects())
        except SemanticError:
            return False

    return {
        "dimensions": [n for n in model.dimensions if n not in base["dimensions"] and fits("dimensions", n)],
        "measures": [n for n in model.measures if n not in base["measures"] and fits("measures", n)],
        "metrics": [n for n in model.metrics if n not in base["measures"] and fits("measures", n)],
    }


def _trigrams(text: str) -> set[str]:
    padded = f"  {text.lower()} "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def find(model: Model, text: str, limit: int = 10) -> list[tuple[str, str, float]]:
    """(label, kind, score) of the labels most like a text, by shared trigrams and edit distance; synonyms count."""
    out = []
    for kind, group in (("dimension", model.dimensions), ("measure", model.measures), ("metric", model.metrics), ("object", model.data_objects)):
        for name, x in group.items():
            score = 0.0
            for other in (name, *(x.meta.get("synonyms") or [])):
                a, b = _trigrams(text), _trigrams(other)
                near = 1 - _distance(text.lower(), other.lower()) / max(len(text), len(other), 1)
                score = max(score, (len(a & b) / len(a | b) + near) / 2, 0.9 if text.lower() in other.lower() else 0)
            out.append((name, kind, round(score, 4)))
    return sorted(out, key=lambda x: (-x[2], x[0]))[:limit]


def diagram(model: Model) -> str:
    """An entity-relationship diagram in Mermaid's notation."""
    name = lambda x: "".join(c if c.isalnum() else "_" for c in x)
    ends = {"many-to-one": "}o--||", "one-to-one": "||--||", "many-to-many": "}o--o{"}
    lines = ["erDiagram"]
    for o in model.data_objects.values():
        lines.append(f"    {name(o.name)} {{")
        lines += [f"        {c.abstract_type} {name(c.name)}{' PK' if c.primary_key else ''}" for c in o.columns.values()]
        lines.append("    }")
        lines += [f'    {name(o.name)} {ends[j.join_type]} {name(j.join_to)} : "{j.path_name or ", ".join(j.columns_from)}"' for j in o.joins]
        if o.nested_in:
            lines.append(f'    {name(o.nested_in.data_object)} ||--o{{ {name(o.name)} : "{o.nested_in.column}"')
    return "\n".join(lines)


def lineage(model: Model, label: str) -> list[str]:
    """Columns that a dimension, measure or metric is made of."""
    if label in model.dimensions:
        d = model.dimensions[label]
        return [f"{d.data_object}.{d.column}"]
    if label in model.measures:
        m = model.measures[label]
        return sorted({f"{c.data_object}.{c.column}" if c.column else c.data_object for c in m.columns} | {".".join(r) for r in (refs(parse(m.expression)) if m.expression else [])})
    if label not in model.metrics:
        raise SemanticError("UNKNOWN_LABEL", f"the model has no {label!r}")
    m = model.metrics[label]
    below = [m.measure] if m.measure else [r[0] for r in refs(parse(m.expression))]
    return sorted({c for b in below for c in lineage(model, b)})
