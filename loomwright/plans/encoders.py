"""Encoders by name: what a configuration's `model` stands for, with prompts by role, hooks, lengths and batch sizes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.hashing import recipe_id
from loomwright.functions.tokenize import tokens
from loomwright.functions.vectors import hash_embedding

ROLES = ("query", "document")
#: (rows, keys, text column, longest sequence or None, batch size) -> (keys..., vec array<double>), one row each
Encode = Callable[[DataFrame, list[str], str, int | None, int], DataFrame]


def unchanged(text: Column) -> Column:
    return text


@dataclass(frozen=True)
class Encoder:
    """One model. count tells how many tokens it sees in a text; the hooks change texts before the prompt is put on."""

    name: str
    encode: Encode
    count: Callable[[Column], Column]
    revision: str = ""
    query_prompt: str = ""
    document_prompt: str = ""
    max_length: int | None = None
    query_hook: Callable[[Column], Column] = field(default=unchanged)
    document_hook: Callable[[Column], Column] = field(default=unchanged)

    def prompt(self, role: str) -> str:
        if role not in ROLES:
            raise ValueError(f"unknown role {role}")
        return self.query_prompt if role == "query" else self.document_prompt

    def recipe(self, role: str, view: str = "raw", max_length: int | None = None) -> str:
        """The id of all that decides over a vector, under which stored vectors are kept."""
        return recipe_id({"model": self.name, "revision": self.revision, "prompt": self.prompt(role), "max_seq_length": max_length or self.max_length, "view": view})

    def embed(self, df: DataFrame, keys: list[str], text: str, role: str, max_length: int | None = None, batch_size: int = 32) -> DataFrame:
        """(keys..., vec) of the texts in a role; a NULL text stays NULL for the model."""
        hook = self.query_hook if role == "query" else self.document_hook
        prompted = F.concat(F.lit(self.prompt(role)), hook(F.col(text)))
        return self.encode(df.select(*keys, prompted.alias(text)), keys, text, max_length or self.max_length, batch_size)


def hash256(df: DataFrame, keys: list[str], text: str, max_length: int | None, batch_size: int) -> DataFrame:
    """The encoder that needs no model. Spark's own batches do for it, so batch_size has no effect."""
    return hash_embedding(df, keys, text, limit=max_length)


_known: dict[str, Encoder] = {}


def register(encoder: Encoder) -> Encoder:
    """Make an encoder known by its name; a name stands for one encoder."""
    if _known.get(encoder.name, encoder) != encoder:
        raise ValueError(f"there is another encoder {encoder.name}")
    _known[encoder.name] = encoder
    return encoder


def named(name: str) -> Encoder:
    """The encoder of a name; an unknown one is an error, so no result is reported under another model's name."""
    if name not in _known:
        raise ValueError(f"unknown model {name}; known are {', '.join(sorted(_known))}. Register it first")
    return _known[name]


HASH = register(Encoder("hash256", hash256, lambda text: F.size(tokens(text))))
