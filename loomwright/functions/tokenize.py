"""Identifier-aware tokens."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The pattern of a token, of a hump, and the stop words.
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+"
HUMP = "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
STOP_WORDS = "the a an of to in and or is are be for on with that this it as by at from you your input output print return if else while def int str".split()


def expand(raw: Column) -> Column:
    """The tokens of one raw identifier or number: itself in lower case, and its snake and camel parts if several.

    Stop words and parts of one character are left out.
    """
    whole = F.filter(F.array(F.lower(raw)), lambda t: ~t.isin(STOP_WORDS))
    parts = F.filter(F.split(F.lower(F.regexp_replace(raw, HUMP, "_")), "_"), lambda t: t != "")
    kept = F.filter(parts, lambda t: ~t.isin(STOP_WORDS) & (F.length(t) > 1))
    return F.concat(whole, F.when(F.size(parts) > 1, kept).otherwise(F.array().cast("array<string>")))


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), 0)


def tokens(text: Column) -> Column:
    """All tokens of a text in order, repeated ones repeated; NULL for NULL, empty for a text without any."""
    return F.flatten(F.transform(raw_tokens(text), expand))


def token_counts(df: DataFrame, keys: list[str], text: str, limit: int | None = None) -> DataFrame:
    """(keys..., token, tf): how often each row of unique keys has each token. Rows without tokens have none.

    With a limit the first so many tokens of a text are counted alone.

    Raw identifiers are counted before they are cut into parts, so each distinct one is cut once a row.
    """
    if limit is not None:
        few = df.select(*keys, F.explode(F.slice(tokens(F.col(text)), 1, limit)).alias("token"))
        return few.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("tf"))
    raw = df.select(*keys, F.explode(raw_tokens(F.col(text))).alias("raw")).groupBy(*keys, "raw").agg(F.count(F.lit(1)).alias("n"))
    return raw.select(*keys, "n", F.explode(expand(F.col("raw"))).alias("token")).groupBy(*keys, "token").agg(F.sum("n").alias("tf"))


@lru_cache(1 << 17)
def _keys(raw: str) -> tuple[tuple[int, int], ...]:
    """(64-bit key, last byte) of the md5 of each token of one raw identifier or number: expand in Python, for ASCII letters."""
    parts = [p for p in re.sub(HUMP, "_", raw).lower().split("_") if p]
    found = [raw.lower(), *(p for p in parts if len(p) > 1)] if len(parts) > 1 else [raw.lower()]
    digests = (hashlib.md5(t.encode(), usedforsecurity=False).digest() for t in found if t not in STOP_WORDS)
    return tuple((int.from_bytes(d[:8], "little", signed=True), d[15]) for d in digests)


def hashed_tokens(raw: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, last byte) of all tokens of lists of raw tokens, in order, repeated ones repeated: tokens as hashes.

    Each distinct raw token of the batch is cut once.
    """
    words = raw.flatten().dictionary_encode()
    counts = np.diff(raw.offsets.to_numpy()) if raw.null_count == 0 else raw.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    cut = [_keys(w) for w in words.dictionary.to_pylist()]
    size = np.array([len(c) for c in cut], dtype=np.int64)
    every = np.array([x for c in cut for x in c], dtype=np.int64).reshape(-1, 2)
    which = words.indices.to_numpy().astype(np.int64)
    many = size[which]
    place = np.repeat((np.cumsum(size) - size)[which] - np.cumsum(many) + many, many) + np.arange(many.sum())
    row = np.repeat(np.repeat(np.arange(len(raw)), counts), many)
    return row, every[place, 0], every[place, 1]
