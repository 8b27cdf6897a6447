"""Chat formatting: many layouts in, one template out, and back.

A layout is known by its schema fingerprint, a hash over its nested field paths.  ``LAYOUTS`` declares
for each layout how its fields become turns of (role, text).  Tables are matched by their schema
(``canonical_turns``); a column of JSON texts of mixed layouts is matched row by row
(``turns_of_json``).  ``formatted`` writes turns with control strings around them, escapes control
strings within texts reversibly, and keeps a run-length loss mask; ``read_back`` undoes it.

All of it is DataFrame functions.

Defined results: null role or text is empty; rows of a conversation sort by turn, then role, then
text, nulls first, and repeated rows are repeated turns; a null conv_id is a conversation; an empty
table gives no rows; fields that no layout knows are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, SEPARATOR, STOP = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TURN = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """``rows``: one row per turn.  ``items``: an array of turns.  ``fields``: columns that are turns of a fixed role."""

    name: str
    paths: tuple[str, ...]
    items: str | None = None
    role: str | None = None
    text: str | None = None
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()
    rows: bool = False

    def print(self) -> str:
        return fingerprint(self.paths)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


#: The layouts, by their field paths.
LAYOUTS = [
    Layout("rows", ("conv_id", "role", "text", "turn"), role="role", text="text", rows=True),
    Layout("messages", ("messages[].content", "messages[].role"), "messages", "role", "content"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), "conversations", "from", "value", roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("turns", ("turns[].role", "turns[].text"), "turns", "role", "text"),
    Layout("prompt", ("completion", "prompt"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", ("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("system_prompt", ("prompt", "response", "system"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("question", ("answer", "question"), fields=(("user", "question"), ("assistant", "answer"))),
    Layout("instruction", ("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", ("input", "instruction", "output"), fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
]
KNOWN = sorted({p for x in LAYOUTS for p in x.paths})


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Paths of the leaves of a type: a.b for fields, a[] for elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def layout_of(paths: list[str]) -> Layout:
    """The layout with the fingerprint of the known ones among ``paths``; else the largest whose paths are all there."""
    known = set(paths) & set(KNOWN)
    by_print = {x.print(): x for x in LAYOUTS}
    if (found := by_print.get(fingerprint(known))) is None:
        fits = [x for x in LAYOUTS if set(x.paths) <= known]
        if not fits:
            raise ValueError(f"no layout is declared for the fields {sorted(paths)}")
        found = max(fits, key=lambda x: len(x.paths))
    return found


def _turn(role: Column, text: Column, roles: tuple = ()) -> Column:
    role = F.coalesce(role.cast("string"), F.lit(""))
    for old, new in roles:
        role = F.when(role == old, F.lit(new)).otherwise(role)
    return F.struct(role.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _turn_of(layout: Layout):
    return lambda x: _turn(x[layout.role], x[layout.text], layout.roles)


def canonical_turns(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, turns) of a table in any declared layout."""
    layout = layout_of(field_paths(df.schema))
    if layout.rows:
        rows = df.select(F.col(conv_id).alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), _turn(F.col("role"), F.col("text")).alias("said")).alias("row"))
        return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows")).select("conv_id", F.transform("rows", lambda r: r["said"]).alias("turns"))
    if layout.items:
        turns = F.transform(F.coalesce(F.col(layout.items), F.array().cast(df.schema[layout.items].dataType)), _turn_of(layout))
    else:
        turns = F.array(*(_turn(F.lit(role), F.col(name)) for role, name in layout.fields if name in df.columns))
        turns = F.filter(turns, lambda x: (x["role"] != "user") | (x["text"] != "")) if sum(r == "user" for r, _ in layout.fields) > 1 else turns
    return df.select(F.col(conv_id).alias("conv_id"), turns.alias("turns"))


def _present(json: Column, path: str) -> Column:
    """Whether a parsed JSON text has the path, whatever its value; a list without elements has those of its elements."""
    top, _, field = path.partition("[].")
    if not field:
        return F.try_variant_get(json, f"$.{top}", "variant").isNotNull()
    items = F.try_variant_get(json, f"$.{top}", "array<variant>")
    return F.coalesce((F.size(items) == 0) | F.exists(items, lambda x: F.try_variant_get(x, f"$.{field}", "variant").isNotNull()), F.lit(False))


def json_paths(json: Column) -> Column:
    """The known paths that each JSON text has, in order; null if it isn't JSON."""
    parsed = F.try_parse_json(json)
    known = [p for p in KNOWN if any(p in x.paths for x in LAYOUTS if not x.rows)]
    found = F.transform(F.array(parsed), lambda v: F.array_compact(F.array(*(F.when(_present(v, p), F.lit(p)) for p in known))))
    return F.when(parsed.isNotNull(), F.element_at(found, 1))


def json_fingerprint(paths: Column) -> Column:
    """The fingerprint of an array of paths in order."""
    return F.substring(F.sha2(F.array_join(paths, "\n"), 256), 1, 16)


def turns_of_json(json: Column) -> Column:
    """The turns of each JSON text, by the layout with the fingerprint of its known paths, else the largest whose paths
    are all there; null for others."""

    def turns_of(layout: Layout) -> Column:
        if layout.items:
            read = F.from_json(json, f"{layout.items} array<struct<`{layout.role}`:string,`{layout.text}`:string>>")
            return F.transform(read[layout.items], _turn_of(layout))
        read = F.from_json(json, ", ".join(f"`{n}` string" for _, n in layout.fields))
        turns = F.array(*(_turn(F.lit(role), read[n]) for role, n in layout.fields))
        return F.filter(turns, lambda x: (x["role"] != "user") | (x["text"] != "")) if sum(r == "user" for r, _ in layout.fields) > 1 else turns

    layouts = sorted((x for x in LAYOUTS if not x.rows), key=lambda x: -len(x.paths))

    def choose(paths: Column) -> Column:
        by_print = F.create_map(*(F.lit(y) for x in layouts for y in (x.print(), x.name)))
        fits = (F.when(F.size(F.array_intersect(paths, F.array(*map(F.lit, x.paths)))) == len(x.paths), F.lit(x.name)) for x in layouts)
        return F.coalesce(F.element_at(by_print, json_fingerprint(paths)), *fits)

    chosen = F.element_at(F.transform(F.array(json_paths(json)), choose), 1)
    return F.element_at(F.transform(F.array(chosen), lambda name: F.coalesce(*(F.when(name == x.name, turns_of(x)) for x in layouts), F.lit(None).cast(TURN))), 1)


def escaped(text: Column) -> Column:
    """No "<|" is left: a backslash goes between, one more than were there."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask: for each turn the characters before, under and after the loss."""
    def pieces(t: Column) -> Column:
        head, text = F.concat(F.lit(START), escaped(t["role"]), F.lit(SEPARATOR)), escaped(t["text"])
        return F.struct(head.alias("head"), text.alias("text"), (t["role"] == "assistant").alias("loss"))

    def mask(p: Column) -> Column:
        head, text = F.length(p["head"]), F.length(p["text"])
        return F.struct(
            F.when(p["loss"], head).otherwise(head + text + len(STOP)).cast("int").alias("before"),
            F.when(p["loss"], text).otherwise(0).cast("int").alias("loss"),
            F.when(p["loss"], F.lit(len(STOP))).otherwise(0).cast("int").alias("after"),
        )

    # one pass for the pieces, bound as a lambda variable so that no later step repeats it
    made = F.transform(F.array(F.transform("turns", pieces)), lambda ps: F.struct(F.array_join(F.transform(ps, lambda p: F.concat(p["head"], p["text"], F.lit(STOP))), "").alias("formatted"), F.transform(ps, mask).alias("loss_mask")))
    return turns.select("conv_id", F.inline(made))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns, loss_texts (one for each turn under the loss), from the formatted text and its mask alone."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 2**31 - 1)

    def turn(p: Column) -> Column:
        text = F.substring_index(F.substring_index(p, SEPARATOR, -1), STOP, 1)
        return F.struct(unescaped(F.substring_index(p, SEPARATOR, 1)).alias("role"), unescaped(text).alias("text"))

    under = F.zip_with("pieces", "loss_mask", lambda p, m: F.when(m["loss"] > 0, unescaped(F.substring(p, m["before"] + 1 - len(START), m["loss"]))).otherwise(""))
    cut = chats.select("conv_id", "formatted", "loss_mask", pieces.alias("pieces"))
    return cut.select("conv_id", "formatted", F.transform("pieces", turn).alias("turns"), under.alias("loss_texts"))


def digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
