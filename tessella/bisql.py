"""A BI-style SELECT over the labels of a model: one virtual table, no joins.

``SELECT "Region Name", Revenue FROM trade WHERE Segment = 'BUILDING' AND Revenue > 100 ORDER BY 2 DESC LIMIT 5``

Labels may stand without quotes where they are one word, and in any case.  Conditions on measures go
to HAVING, the others to WHERE, also out of one AND.  MEASURE(x), AGG(x), AGGREGATE(x), and an
aggregate function around a measure name the measure.  ``"Object"."Column"`` selects raw rows.
``[NOT] EXISTS (SELECT 1 FROM "Object" [WHERE ...])`` asks for rows of an object that joins lead to from the first
selected dimension, or from what the first measure reads; its conditions name columns of that object or dimensions.
"""

from __future__ import annotations

import re
from typing import Any

from .errors import SemanticError
from .functions.expressions import Call, Lit, Op, Parser, Ref, parse, refs, tokens
from .model import Model

REFUSED = ("JOIN", "WITH RECURSIVE", "UNION", "INTERSECT", "EXCEPT", "OVER", "QUALIFY", "WINDOW")
#: Wraps that name the measure within.
WRAPS = ("measure", "agg", "aggregate", "sum", "avg", "min", "max", "count")
OPERATORS = {"=": "equals", "<>": "notequals", "<": "lt", "<=": "lte", ">": "gt", ">=": "gte"}
FLIPPED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def translate(model: Model, text: str) -> dict:
    """The query, as Engine.query takes it."""
    return _Translator(model, text).query()


class _Parser(Parser):
    """Expressions, and EXISTS with the one form of SELECT that it takes: Op("exists", (Lit(object), condition or None))."""

    def comparison(self):
        if not (self.peek("EXISTS") and [t.upper() for _, t in self.items[self.at + 1 : self.at + 3]] == ["(", "SELECT"]):
            return super().comparison()
        self.at += 3
        self.joined() if not self.take("*") else None
        self.need("FROM")
        kind, name = self.items[self.at] if self.at < len(self.items) else ("", "")
        if kind not in ("word", "quoted"):
            raise SemanticError("SQL_UNSUPPORTED", "EXISTS reads one object of the model")
        self.at += 1
        where = self.either() if self.take("WHERE") else None
        if not self.take(")"):
            raise SemanticError("SQL_UNSUPPORTED", "EXISTS takes FROM one object, and WHERE")
        return Op("exists", (Lit(name, "object"), where))


class _Translator:
    def __init__(self, model: Model, text: str):
        self.model = model
        self.labels = {n.lower(): n for n in (*model.dimensions, *model.measures, *model.metrics)}
        text = re.sub(r"--[^\n]*|/\*.*?\*/", " ", text, flags=re.S).strip().rstrip(";")
        bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"", "x", text)
        for word in REFUSED:
            if re.search(rf"\b{word}\b", bare, re.I):
                raise SemanticError("SQL_UNSUPPORTED", f"{word} has no place over a semantic model")
        if re.match(r"with\b", bare, re.I) or re.search(r"\bfrom\s*\(", bare, re.I):
            raise SemanticError("SQL_UNSUPPORTED", "no subqueries")
        self.grouping = self.inner = None
        if m := re.search(r"\bwith\s+(rollup|cube)\b", text, re.I):
            self.grouping, text = m[1].lower(), text[: m.start()] + text[m.end() :]
        self.parser, self.items = _Parser(tokens(text)), []

    def keyword(self, *words: str) -> bool:
        p, at = self.parser, self.parser.at
        if all(p.take(w) for w in words):
            return True
        p.at = at
        return False

    def query(self) -> dict:
        p = self.parser
        p.need("SELECT")
        distinct = p.take("DISTINCT")
        items = [self.item()]
        while p.take(","):
            items.append(self.item())
        self.items = items
        if self.keyword("FROM"):
            p.atom()
            if p.take("AS") or (p.at < len(p.items) and p.items[p.at][0] in ("word", "quoted") and not p.peek("WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET")):
                p.at += 1
        where = p.either() if self.keyword("WHERE") else None
        if self.keyword("GROUP", "BY"):
            self.group_by()
        having = p.either() if self.keyword("HAVING") else None
        order = self.order_by(items) if self.keyword("ORDER", "BY") else []
        limit = offset = None
        while p.peek("LIMIT", "OFFSET"):
            word = p.items[p.at][1].upper()
            p.at += 2
            number = int(p.items[p.at - 1][1])
            limit, offset = (number, offset) if word == "LIMIT" else (limit, number)
        if p.at < len(p.items):
            raise SemanticError("SQL_SYNTAX", f"unexpected {p.items[p.at][1]!r}")
        raw = any("." in i and i not in self.labels.values() for i in items)
        select: dict[str, Any] = {"fields": items, "distinct": distinct} if raw else {"dimensions": [i for i in items if self.is_dimension(i)], "measures": [i for i in items if not self.is_dimension(i)]}
        out: dict[str, Any] = {"select": select, "where": [], "having": []}
        for node in (*self.split(where), *self.split(having)):
            if (cond := self.condition(node)) is not None:
                out["having" if self.is_measured(cond) else "where"].append(cond)
        if order:
            out["orderBy"] = order
        out |= {k: v for k, v in (("limit", limit), ("offset", offset), ("grouping", self.grouping)) if v is not None}
        return out

    def item(self) -> str:
        p = self.parser
        if p.peek("*"):
            raise SemanticError("SQL_UNSUPPORTED", "name the labels to select")
        node = p.either()
        if p.take("AS"):
            p.at += 1
        elif p.at < len(p.items) and p.items[p.at][0] == "quoted":
            p.at += 1
        return self.label(node)

    def label(self, node) -> str:
        if isinstance(node, Call) and node.name in WRAPS and len(node.args) == 1 and isinstance(node.args[0], Ref):
            name = self.label(node.args[0])
            if self.is_dimension(name):
                raise SemanticError("SQL_UNSUPPORTED", f"{name} is a dimension; the model declares what is aggregated")
            return name
        if not isinstance(node, Ref):
            raise SemanticError("SQL_UNSUPPORTED", "only labels can be selected")
        if len(node.parts) == 2:
            if (found := self.labels.get(node.parts[1].lower())) and node.parts[0] not in self.model.data_objects:
                return found
            return ".".join(node.parts)
        name, colon, grain = node.parts[0].partition(":")
        found = self.labels.get(name.lower())
        if not found:
            raise SemanticError("UNKNOWN_LABEL", f"the model has no {node.parts[0]!r}")
        return found + colon + grain

    def is_dimension(self, name: str) -> bool:
        return name.partition(":")[0] in self.model.dimensions

    def is_measured(self, cond: dict) -> bool:
        names = self.fields(cond)
        measured = {n for n in names if n in self.model.measures or n in self.model.metrics}
        if measured and measured != names:
            raise SemanticError("SQL_UNSUPPORTED", "one OR can't mix rows and results")
        return bool(measured)

    def fields(self, cond: dict) -> set[str]:
        return {n for f in cond["filters"] for n in self.fields(f)} if "filters" in cond else {cond["field"]}

    def group_by(self) -> None:
        p = self.parser
        if p.peek("ROLLUP", "CUBE"):
            self.grouping = p.items[p.at][1].lower()
            p.at += 1
            p.need("(")
            p.list_to(")")
            return
        if p.take("ALL"):
            return
        p.either()
        while p.take(","):
            p.either()

    def order_by(self, items: list[str]) -> list[dict]:
        p, out = self.parser, []
        while True:
            node = p.joined()
            key = {"field": node.value if isinstance(node, Lit) else self.label(node)}
            if p.peek("ASC", "DESC"):
                key["direction"] = p.items[p.at][1].lower()
                p.at += 1
            if p.take("NULLS"):
                key["nulls"] = p.items[p.at][1].lower()
                p.at += 1
            out.append(key)
            if not p.take(","):
                return out

    def split(self, node) -> list:
        if node is None:
            return []
        if isinstance(node, Op) and node.name == "and":
            return [x for a in node.args for x in self.split(a)]
        return [node]

    def subject(self) -> str:
        """What EXISTS starts from."""
        if not self.items:
            raise SemanticError("SQL_UNSUPPORTED", "EXISTS needs a selected dimension or measure")
        if found := next((i for i in self.items if self.is_dimension(i) or "." in i and i not in self.labels.values()), None):
            return found.partition(":")[0]
        name = self.items[0]
        while name in self.model.metrics and name not in self.model.measures:
            m = self.model.metrics[name]
            name = m.measure or next(p[0] for p in refs(parse(m.expression)))
        m = self.model.measures[name]
        obj = m.columns[0].data_object if m.columns else next(p[0] for p in refs(parse(m.expression)) if len(p) == 2)
        return f"{obj}.{next(iter(self.model.data_objects[obj].columns))}"

    def exists(self, node: Op, op: str) -> dict:
        target = next((o for o in self.model.data_objects if o.lower() == node.args[0].value.lower()), None)
        if target is None:
            raise SemanticError("UNKNOWN_DATA_OBJECT", f"the model has no {node.args[0].value!r}")
        columns = {c.lower(): c for c in self.model.data_objects[target].columns}
        outer, self.inner = self.inner, lambda ref: columns.get(ref.parts[-1].lower()) if len(ref.parts) == 1 or ref.parts[0].lower() == target.lower() else None
        try:
            filters = [self.condition(x) for x in self.split(node.args[1])]
        finally:
            self.inner = outer
        if any(f is None or "filters" in f or "subquery" in f or f["field"] in self.model.measures or f["field"] in self.model.metrics for f in filters):
            raise SemanticError("SQL_UNSUPPORTED", "conditions within EXISTS compare columns or dimensions with values, joined by AND")
        return {"field": self.subject(), "op": op, "subquery": {"dataObject": target, "filter": filters}}

    def condition(self, node) -> dict | None:
        if isinstance(node, Op) and node.name == "exists":
            return self.exists(node, "exists")
        if isinstance(node, Op) and node.name == "not" and isinstance(node.args[0], Op) and node.args[0].name == "exists":
            return self.exists(node.args[0], "nonexists")
        if isinstance(node, Op) and node.name in ("and", "or", "not"):
            parts = [c for a in node.args if (c := self.condition(a)) is not None]
            return {"logic": "or" if node.name == "or" else "and", "filters": parts, "negated": node.name == "not"}
        if not isinstance(node, Op):
            raise SemanticError("SQL_UNSUPPORTED", "a condition compares a label with values")
        first, *rest = node.args
        op = node.name
        if isinstance(first, Lit) and rest and isinstance(rest[0], Ref):
            first, rest, op = rest[0], [first], FLIPPED.get(op, op)
        if isinstance(first, Call) and first.name == "count" and first.args == (Lit("*", "star"),):
            if op in (">", ">=") and self.value(rest[0]) in (0, 1):
                return None  # every group has a row
            raise SemanticError("SQL_UNSUPPORTED", "count rows with the count measure of an object")
        field = self.inner(first) if self.inner and isinstance(first, Ref) else None
        field = field or self.label(first)
        if op in ("isnull", "isnotnull"):
            return {"field": field, "op": "notset" if op == "isnull" else "set"}
        values = [self.value(x) for x in rest]
        if op == "in":
            return {"field": field, "op": "inlist", "value": values}
        if op == "between":
            return {"field": field, "op": "between", "value": values}
        if op == "like":
            return {"field": field, "op": "like", "value": values[0]}
        if op not in OPERATORS:
            raise SemanticError("SQL_UNSUPPORTED", f"{op} is no comparison")
        return {"field": field, "op": OPERATORS[op], "value": values[0]}

    def value(self, node) -> Any:
        if isinstance(node, Op) and node.name == "neg":
            return -self.value(node.args[0])
        if not isinstance(node, Lit):
            raise SemanticError("SQL_UNSUPPORTED", "labels are compared with literals")
        if node.kind == "number":
            return float(node.value) if "." in node.value else int(node.value)
        return node.value
