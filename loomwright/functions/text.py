"""Predicates and small text functions, and the text difference of two versions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# An input section's header line, identifiers in a text, extensions of indexed files.
INPUT_LINE = r"(?imd)^\s*-*\s*input\s*-*\s*:?\s*$"
IDENTIFIER = r"`[^`]+`|\b[a-z]+_[a-z_]+\b|\b[a-z]+[A-Z][A-Za-z]+\b|\bdef \w+|\bclass \w+"
EXTENSIONS = (".js", ".mjs", ".cjs", ".jsx")


def is_contest_style(text: Column) -> Column:
    """An input section, and no fenced Python."""
    return text.rlike(INPUT_LINE) & ~text.contains("```python")


def has_identifier(text: Column) -> Column:
    return text.rlike(IDENTIFIER)


def is_indexed_path(path: Column, include: tuple[str, ...] = ()) -> Column:
    """A script outside of installed modules, under one of the prefixes (any, if none is given)."""
    script = path.rlike("(" + "|".join(e.replace(".", r"\.") for e in EXTENSIONS) + r")\z") & ~path.contains("node_modules/")
    under = F.lit(not include)
    for prefix in include:
        under = under | path.startswith(prefix)
    return script & under


def word_count(text: Column) -> Column:
    """Stretches between white space; 0 for an empty text, NULL for NULL."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def document_text(path: Column, symbol: Column, code: Column) -> Column:
    """What lexical search reads of a snippet: path and symbol, then code."""
    return F.concat(path, F.lit(" "), symbol, F.lit("\n"), code)


def snippet_head(code: Column, lines: int = 6, indent: str = "    ") -> Column:
    """The first lines, indented; an ellipsis line follows if there are more."""
    every = F.split(code, "\n")
    head = F.array_join(F.transform(F.slice(every, 1, lines), lambda x: F.concat(F.lit(indent), x)), "\n")
    return F.concat(head, F.when(F.size(every) > lines, f"\n{indent}…").otherwise(""))


def numeric_first(identifier: Column) -> list[Column]:
    """Sort keys: ids that are numbers by value, then all others in byte order."""
    number = F.when(identifier.rlike(r"^[0-9]{1,38}$"), identifier.cast("decimal(38,0)"))
    return [number.isNull(), number, identifier]


@F.pandas_udf(T.StringType())
def unified_diff(old: pd.Series, new: pd.Series, old_name: pd.Series, new_name: pd.Series) -> pd.Series:
    """The line difference from old to new with one line of context; NULL if a side is NULL."""

    def one(a: str | None, b: str | None, x: str, y: str) -> str | None:
        if a is None or b is None:
            return None
        return "".join(difflib.unified_diff(a.splitlines(True), b.splitlines(True), fromfile=x, tofile=y, n=1))

    return pd.Series([one(*row) for row in zip(old, new, old_name, new_name)], dtype=object)
