"""Where results go: rows, Arrow, text tables with formats, files."""

from __future__ import annotations

import re
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame

from ..engine import Compiled
from ..model import Model

#: Rows that an interactive result has unless its query sets a limit.
DEFAULT_LIMIT = 1000
#: Thousands and decimal separators by language.
SEPARATORS = {"en": (",", "."), "de": (".", ","), "es": (".", ","), "it": (".", ","), "nl": (".", ","), "pt": (".", ","), "hr": (".", ","), "fr": (" ", ","), "sv": (" ", ","), "pl": (" ", ","), "cs": (" ", ",")}


def limited(made: Compiled, rows: int = DEFAULT_LIMIT) -> DataFrame:
    """The result with the default limit where the query sets none."""
    return made.df if made.query.limit is not None else made.df.limit(rows)


def pattern(value: Any, form: str, locale: str = "en-US") -> str:
    """A number in a pattern such as ``#,##0.00``, ``0%`` or ``$#,##0``; anything else as text."""
    if value is None:
        return ""
    m = re.search(r"#?[#,0]*0(?:\.(0+))?", form)
    if not m or isinstance(value, bool) or not isinstance(value, (int, float, Decimal)):
        return str(value)
    thousands, point = SEPARATORS.get(locale.split("-")[0].lower(), SEPARATORS["en"])
    digits = len(m[1] or "")
    number = Decimal(str(value)) * (100 if "%" in form else 1)
    text = f"{number.quantize(Decimal(1).scaleb(-digits), 'ROUND_HALF_UP'):,f}" if "," in m[0] else f"{number.quantize(Decimal(1).scaleb(-digits), 'ROUND_HALF_UP'):f}"
    text = text.translate({ord(","): thousands, ord("."): point})
    return form[: m.start()] + text + form[m.end() :]


def tsv(model: Model, made: Compiled, locale: str | None = None, rows: int = DEFAULT_LIMIT) -> str:
    """The bounded result as tab-separated text, numbers in the patterns of their labels."""
    locale = locale or model.settings.default_locale or "en-US"
    df = limited(made, rows)
    forms = {n: x.meta.get("format") for group in (model.dimensions, model.measures, model.metrics) for n, x in group.items()}
    clean = lambda s: s.replace("\t", " ").replace("\n", " ")
    lines = ["\t".join(df.columns)]
    for row in df.collect():
        lines.append("\t".join(clean(pattern(v, forms[n], locale) if forms.get(n) else "" if v is None else str(v)) for n, v in zip(df.columns, row)))
    return "\n".join(lines) + "\n"


def rows(made: Compiled, most: int = DEFAULT_LIMIT) -> list[dict]:
    """The bounded result as dicts."""
    return [r.asDict() for r in limited(made, most).collect()]


def arrow(made: Compiled, most: int = DEFAULT_LIMIT):
    """The bounded result as an Arrow table."""
    return limited(made, most).toArrow()


def save(made: Compiled, path: str, form: str = "parquet", mode: str = "error", **options) -> None:
    """The whole result as files, written by the executors."""
    made.df.write.format(form).mode(mode).options(**options).save(path)
