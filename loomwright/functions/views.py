"""Deterministic views of a query text, as column expressions; the raw text is a view too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The pattern of a header, of a fenced block and of a numeric line, and the section names.
HEADER = r"^\s*[-#*=_~`]*\s*([A-Za-z][A-Za-z /]{0,28}?)\s*\d*\s*[:#*=_~`-]*\s*$"
FENCE = r"(?s)```[a-zA-Z]*\n(.*?)```"
NUMERIC = r"^[\s\d.,\-+\[\]()]*$"
DROPPED = [
    "example", "examples", "example input", "example output", "sample input", "sample output",
    "sample", "samples", "explanation", "note", "notes", "subtasks", "for example",
    "sample test", "sample tests", "test cases",
]
KEPT = [
    "input", "output", "constraints", "input format", "output format", "input/output",
    "task", "problem statement", "problem", "statement", "description",
]
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}]"


def strip(text: Column) -> Column:
    """Without white space at both ends, line ends included."""
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+\z", "")


def section_name(line: Column) -> Column:
    """The known section that a header line opens, in lower case; NULL for any other line."""
    name = F.lower(F.trim(F.regexp_extract(line, HEADER, 1)))
    return F.when(name.isin([*DROPPED, *KEPT]), name)


def starter_code(text: Column) -> Column:
    """The fenced blocks, stripped, one after another; empty if there is none."""
    blocks = F.transform(F.regexp_extract_all(text, F.lit(FENCE), 1), strip)
    return F.array_join(F.filter(blocks, lambda b: b != ""), "\n")


def _filtered(text: Column, drop_numeric: bool) -> Column:
    lines = F.split(F.regexp_replace(text, FENCE, "\n"), "\n")

    def step(state: Column, line: Column) -> Column:
        section = section_name(line)
        dropping = F.when(section.isNull(), state["dropping"]).otherwise(section.isin(DROPPED))
        out = dropping | (section.isNull() & line.rlike(NUMERIC)) if drop_numeric else dropping
        return F.struct(dropping.alias("dropping"), F.concat(state["keep"], F.when(out, "0").otherwise("1")).alias("keep"))

    # the fold keeps a flag a line, not the lines: a text of many lines isn't copied again and again
    marks = F.aggregate(lines, F.struct(F.lit(False).alias("dropping"), F.lit("").alias("keep")), step)["keep"]
    # marks are zipped, not looked up by place: inside of a lambda the whole fold would run again for each line
    kept = F.filter(F.zip_with(lines, F.split(marks, ""), lambda line, mark: F.when(mark == "1", line)), lambda line: line.isNotNull())
    core = strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))
    starter = starter_code(text)
    return F.when(starter != "", strip(F.concat(core, F.lit("\n\n"), starter))).otherwise(core)


def core_view(text: Column) -> Column:
    """Without sections of examples and notes and without numeric and blank lines; fenced code comes last."""
    return _filtered(text, True)


def core2_view(text: Column) -> Column:
    """Like core_view, but numeric and blank lines outside of dropped sections stay."""
    return _filtered(text, False)


VIEWS: dict[str, Callable[[Column], Column]] = {"raw": lambda t: t, "core": core_view, "core2": core2_view, "starter": starter_code}
