"""Vector arithmetic, and a deterministic encoder that needs no model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.tokenize import hashed_tokens, raw_tokens, token_counts


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision; NULL if a side or a value is NULL or lengths differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def _slots(df: DataFrame, keys: list[str], text: str, dim: int) -> DataFrame:
    """(keys..., slots map<int, double>): unit vectors without their zeros, of each row with a token."""
    if dim != 256:
        raise ValueError("a slot is the last two hex digits of a token's md5")
    slot = F.conv(F.substring(F.md5("token"), 31, 2), 16, 10).cast("int").alias("slot")
    counted = token_counts(df, keys, text).groupBy(*keys, slot).agg(F.sum("tf").alias("n"))
    rows = counted.groupBy(*keys).agg(F.collect_list(F.struct("slot", "n")).alias("ns"))
    norm = F.sqrt(F.aggregate("ns", F.lit(0.0), lambda s, x: s + x["n"] * x["n"]))
    return rows.select(*keys, "ns", norm.alias("norm")).select(*keys, F.map_from_entries(F.transform("ns", lambda x: F.struct(x["slot"], x["n"] / F.col("norm")))).alias("slots"))


def hashed_terms(df: DataFrame, keys: list[str], text: str, dim: int = 256) -> DataFrame:
    """(keys..., slot, value): sparse unit vectors; a token counts in the slot of its md5 modulo 256."""
    return _slots(df, keys, text, dim).select(*keys, F.explode("slots").alias("slot", "value"))


def hash_embedding(df: DataFrame, keys: list[str], text: str, dim: int = 256, limit: int | None = None) -> DataFrame:
    """(keys..., vec array<double>): one vector of each row; zeros for a text without tokens, NULL included.

    With a limit only the first so many tokens count, as an encoder with a longest sequence has it.
    """
    if dim != 256:
        raise ValueError("a slot is the last two hex digits of a token's md5")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, _, slot = hashed_tokens(batch.column("__raw"))
            if limit is not None:
                few = np.arange(len(row)) - np.searchsorted(row, row) < limit
                row, slot = row[few], slot[few]
            counts = np.bincount(row * dim + slot, minlength=batch.num_rows * dim).reshape(batch.num_rows, dim)
            norms = np.sqrt((counts * counts).sum(axis=1))
            values = pa.array((counts / np.where(norms > 0, norms, 1.0)[:, None]).ravel())
            vec = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dim), values)
            yield pa.record_batch({c: batch.column(c) for c in keys} | {"vec": vec})

    rows = df.select(*keys, raw_tokens(F.col(text)).alias("__raw"))
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{schema}, vec array<double>")
