"""The expression language of models: parsed to a tree, then built as Spark columns.

References are ``{[Object].[Column]}``, ``{[Measure]}`` and ``{sibling}``.  A division by zero is null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, is_dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SemanticError
from . import catalog


@dataclass(frozen=True)
class Lit:
    value: Any
    kind: str = ""


@dataclass(frozen=True)
class Ref:
    parts: tuple[str, ...]


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Case:
    whens: tuple
    other: Any = None


@dataclass(frozen=True)
class Cast:
    arg: Any
    kind: str


TOKEN = re.compile(
    r"""\s*(?:(?P<ref>\{\[[^\]]*\](?:\.\[[^\]]*\])?\})|(?P<name>\{[^}]*\})|(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+)
    |(?P<str>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*"(?:\s*\.\s*"(?:[^"]|"")*")?)|(?P<word>[A-Za-z_][A-Za-z_0-9]*)|(?P<op><>|!=|<=|>=|\|\||[-+*/%(),<>=.]))""",
    re.X,
)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise SemanticError("EXPRESSION_SYNTAX", f"unexpected {text[at:at + 20]!r} in {text!r}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return out


class Parser:
    """Precedence climbing over OR, AND, NOT, comparison, ||, + -, * / %, sign."""

    def __init__(self, items: list[tuple[str, str]]):
        self.items, self.at = items, 0

    def peek(self, *texts: str) -> bool:
        if self.at >= len(self.items):
            return False
        kind, text = self.items[self.at]
        return kind in ("word", "op") and text.upper() in texts

    def take(self, *texts: str) -> bool:
        if self.peek(*texts):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            got = self.items[self.at][1] if self.at < len(self.items) else "the end"
            raise SemanticError("EXPRESSION_SYNTAX", f"expected {text}, got {got}")

    def whole(self):
        node = self.either()
        if self.at < len(self.items):
            raise SemanticError("EXPRESSION_SYNTAX", f"unexpected {self.items[self.at][1]!r}")
        return node

    def either(self):
        node = self.both()
        while self.take("OR"):
            node = Op("or", (node, self.both()))
        return node

    def both(self):
        node = self.negation()
        while self.take("AND"):
            node = Op("and", (node, self.negation()))
        return node

    def negation(self):
        return Op("not", (self.negation(),)) if self.take("NOT") else self.comparison()

    def comparison(self):
        node = self.joined()
        while True:
            if self.peek("=", "<>", "!=", "<", "<=", ">", ">="):
                op = self.items[self.at][1]
                self.at += 1
                node = Op("<>" if op == "!=" else op, (node, self.joined()))
            elif self.take("IS"):
                no = self.take("NOT")
                self.need("NULL")
                node = Op("isnotnull" if no else "isnull", (node,))
            else:
                no = self.peek("NOT") and self.at + 1 < len(self.items) and self.items[self.at + 1][1].upper() in ("IN", "BETWEEN", "LIKE")
                self.at += no
                if self.take("IN"):
                    self.need("(")
                    found = Op("in", (node, *self.list_to(")")))
                elif self.take("BETWEEN"):
                    low = self.joined()
                    self.need("AND")
                    found = Op("between", (node, low, self.joined()))
                elif self.take("LIKE"):
                    found = Op("like", (node, self.joined()))
                else:
                    return node
                node = Op("not", (found,)) if no else found

    def joined(self):
        node = self.sum()
        while self.take("||"):
            node = Call("concat", (node, self.sum()))
        return node

    def sum(self):
        node = self.product()
        while self.peek("+", "-"):
            op = self.items[self.at][1]
            self.at += 1
            node = Op(op, (node, self.product()))
        return node

    def product(self):
        node = self.sign()
        while self.peek("*", "/", "%"):
            op = self.items[self.at][1]
            self.at += 1
            node = Op(op, (node, self.sign()))
        return node

    def sign(self):
        if self.take("-"):
            return Op("neg", (self.sign(),))
        self.take("+")
        return self.atom()

    def list_to(self, end: str) -> list:
        out = []
        if not self.take(end):
            out.append(self.either())
            while self.take(","):
                out.append(self.either())
            self.need(end)
        return out

    def atom(self):
        if self.at >= len(self.items):
            raise SemanticError("EXPRESSION_SYNTAX", "unexpected end")
        kind, text = self.items[self.at]
        self.at += 1
        if kind == "ref":
            return Ref(tuple(re.findall(r"\[([^\]]*)\]", text)))
        if kind == "name":
            return Ref((text[1:-1].strip(),))
        if kind == "quoted":
            return Ref(tuple(p.replace('""', '"') for p in re.findall(r'"((?:[^"]|"")*)"', text)))
        if kind == "num":
            return Lit(float(text) if "e" in text.lower() else text, "" if "e" in text.lower() else "number")
        if kind == "str":
            return Lit(text[1:-1].replace("''", "'"))
        if text == "(":
            node = self.either()
            self.need(")")
            return node
        if text == "*":
            return Lit("*", "star")
        if kind == "word":
            return self.word(text)
        raise SemanticError("EXPRESSION_SYNTAX", f"unexpected {text!r}")

    def word(self, text: str):
        upper = text.upper()
        if upper in ("TRUE", "FALSE"):
            return Lit(upper == "TRUE")
        if upper == "NULL":
            return Lit(None)
        if upper in ("DATE", "TIMESTAMP", "TIME") and self.at < len(self.items) and self.items[self.at][0] == "str":
            self.at += 1
            return Lit(self.items[self.at - 1][1][1:-1], upper.lower())
        if upper == "CASE":
            return self.case()
        if upper == "CAST":
            self.need("(")
            node = self.either()
            self.need("AS")
            depth, parts = 0, []
            while depth or not self.peek(")"):
                depth += self.peek("(") - self.peek(")")
                parts.append(self.items[self.at][1])
                self.at += 1
            self.need(")")
            return Cast(node, "".join(parts) if "(" in parts else " ".join(parts))
        if self.take("("):
            if upper == "EXTRACT" and self.at + 1 < len(self.items) and self.items[self.at + 1][1].upper() == "FROM":
                unit = self.items[self.at][1]
                self.at += 2
                return Call("extract", (Lit(unit), *self.list_to(")")))
            return Call(text.lower(), tuple(self.list_to(")")))
        if upper == "CURRENT_DATE":
            return Call("current_date", ())
        return Ref((text,))

    def case(self):
        subject = None if self.peek("WHEN") else self.either()
        whens = []
        while self.take("WHEN"):
            when = self.either()
            self.need("THEN")
            whens.append((when if subject is None else Op("=", (subject, when)), self.either()))
        other = self.either() if self.take("ELSE") else None
        self.need("END")
        return Case(tuple(whens), other)


def parse(text: str):
    return Parser(tokens(text)).whole()


def nodes(tree) -> Iterator:
    """The tree's nodes, the root first."""
    if isinstance(tree, tuple):
        for x in tree:
            yield from nodes(x)
    elif is_dataclass(tree):
        yield tree
        for f in fields(tree):
            yield from nodes(getattr(tree, f.name))


def refs(tree) -> list[tuple[str, ...]]:
    return [n.parts for n in nodes(tree) if isinstance(n, Ref)]


def divides(tree) -> bool:
    return any(isinstance(n, Op) and n.name == "/" for n in nodes(tree))


#: Names of types in models and SQL, and Spark's.
TYPES = {
    "string": "string", "varchar": "string", "text": "string", "char": "string", "json": "string", "time": "string", "time_tz": "string",
    "int": "bigint", "integer": "int", "bigint": "bigint", "long": "bigint", "smallint": "int",
    "float": "double", "double": "double", "real": "float", "double precision": "double",
    "date": "date", "timestamp": "timestamp_ntz", "timestamp_ntz": "timestamp_ntz", "timestamp_tz": "timestamp", "boolean": "boolean", "bool": "boolean",
}


def spark_type(name: str) -> str:
    """Spark's name for a type of the model; precision is capped at 38."""
    low = name.strip().lower()
    if m := re.fullmatch(r"(?:decimal|numeric)(?:\((\d+)(?:,\s*(\d+))?\))?", low):
        return f"decimal({min(38, int(m[1] or 18))},{int(m[2] or 0)})"
    if m := re.fullmatch(r"(\w+)\(\d+\)", low):
        low = m[1]
    if low not in TYPES:
        raise SemanticError("UNKNOWN_TYPE", f"no type is called {name!r}")
    return TYPES[low]


def _literal(node: Lit) -> Column:
    if node.kind in ("date", "timestamp"):
        return F.lit(node.value).cast("date" if node.kind == "date" else "timestamp_ntz")
    if node.kind == "number":
        return F.expr(node.value)
    return F.lit(node.value)


def divided(a: Column, b: Column) -> Column:
    """a / b in double precision; null where b is zero."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divided, "%": lambda a, b: a % F.nullif(b, F.lit(0)),
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "and": lambda a, b: a & b, "or": lambda a, b: a | b, "like": lambda a, b: F.expr("null") if b is None else F.like(a, b),
}


class Builder:
    """Builds a tree; ``resolve`` gives the column of a reference."""

    def __init__(self, resolve: Callable[[tuple[str, ...]], Column], portable: bool = False, week_start: str = "monday", warn: Callable[[str], None] | None = None):
        self.resolve, self.portable, self.week_start, self.warn = resolve, portable, week_start, warn

    def build(self, node) -> Column:
        if isinstance(node, Lit):
            return _literal(node)
        if isinstance(node, Ref):
            return self.resolve(node.parts)
        if isinstance(node, Cast):
            return self.build(node.arg).cast(spark_type(node.kind))
        if isinstance(node, Case):
            out = None
            for when, then in node.whens:
                w, t = self.build(when), self.build(then)
                out = F.when(w, t) if out is None else out.when(w, t)
            return out if node.other is None else out.otherwise(self.build(node.other))
        if isinstance(node, Op):
            args = [self.build(a) for a in node.args]
            if node.name in BINARY:
                return BINARY[node.name](*args)
            return {
                "not": lambda a: ~a, "neg": lambda a: -a, "isnull": lambda a: a.isNull(), "isnotnull": lambda a: a.isNotNull(),
                "in": lambda a, *xs: a.isin(*xs), "between": lambda a, lo, hi: a.between(lo, hi),
            }[node.name](*args)
        return self.call(node)

    def call(self, node: Call) -> Column:
        if (made := catalog.FUNCTIONS.get(node.name)) is None:
            if self.portable:
                raise SemanticError("NON_PORTABLE_FUNCTION", f"{node.name} is not in the catalog")
            if self.warn:
                self.warn(f"NON_PORTABLE_FUNCTION: {node.name} is not in the catalog")
            return F.call_function(node.name, *map(self.build, node.args))
        if not made.least <= len(node.args) <= made.most:
            raise SemanticError("ARGUMENT_COUNT", f"{node.name} takes {made.least} to {made.most} arguments")
        args: list = [self.build(a) for a in node.args]
        if made.unit:
            unit = node.args[0]
            args[0] = catalog.unit(unit.value if isinstance(unit, Lit) else unit.parts[0] if isinstance(unit, Ref) else "")
            return made.build(*args, week_start=self.week_start) if made.weeks else made.build(*args)
        if node.name == "json_value":
            if not isinstance(node.args[1], Lit):
                raise SemanticError("JSON_PATH", "the path of json_value must be a literal")
            args[1] = node.args[1].value
        return made.build(*args)
