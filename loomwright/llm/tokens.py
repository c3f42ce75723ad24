"""Token counts by a public tokenizer."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("TOKENIZERS", "/opt/tokenizers")
# Fixed value: the public pattern that splits text before the merges of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=1)
def encoding(folder: str):
    """The byte-level BPE of byte_bpe_50k, loaded once per Python worker."""
    import tiktoken

    with open(os.path.join(folder, "byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str, keep: list[str], folder: str = TOKENIZERS) -> DataFrame:
    """(keep..., tokens): the number of tokens of each whole text; 0 for NULL and empty texts."""
    source = df.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(folder).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], "tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{schema}, tokens long")


COPIES_AT_ONCE = 1 << 16


def numbered(df: DataFrame, columns: list[str], weight: int = 0) -> DataFrame:
    """(columns..., nth, row): every row of df with its number among equal rows, and a hash of both.

    Rows that agree in all columns are counted map-side, however many there are, and told apart by nth from 0; so the
    hash spreads repeated and NULL ids, and depends on the values alone, not on how tasks are cut.
    """
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES_AT_ONCE))).alias("part")
    first = F.col("part") * COPIES_AT_ONCE
    nth = F.explode(F.sequence(first, F.least(first + COPIES_AT_ONCE, "copies") - 1)).alias("nth")
    # the parts of a row with very many copies are made in one task, but never held together
    flags = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    each = counted.select(*columns, "copies", parts).select(*columns, nth)
    return each.withColumn("row", F.xxhash64(F.lit(weight), *flags, "nth"))
