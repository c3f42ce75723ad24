"""Exact dense search, block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.operators.blocks import Best, flat, rounded, search_blocks, spread, stored_in_order
from loomwright.session import durable

DIGITS = 6
DOCUMENT_BLOCK, QUERY_BLOCK, AT_ONCE, LEAST_BLOCK = 20_000, 2_000, 64, 2_500
#: Pairs multiplied again at once: few enough for their vectors to stay in a core's cache.
FEW = 1_000


def dense_search(queries: DataFrame, query: str, documents: DataFrame, document: str, vector: str, k: int, source: str = "dense", other_than_self: bool = False) -> DataFrame:
    """(query, source, document, rank, score): the k documents of largest inner product with each query.

    Scores are rounded to DIGITS before they are ranked, equal ones by document id. Rows with a NULL id or vector
    don't count; all vectors must have one length. With other_than_self a document of the query's own id is left out.

    Plan: documents are stored once, in the order of their ids; queries are hashed into parts, and each part is one task that
    multiplies its queries with one block of documents after another (see search_blocks). The product is taken in single
    precision, only to leave out what is below the k-th best by more than its error can be: |q| |d| (n + 2) 2^-24 for n values,
    doubled. What is left is multiplied again in double precision. The work is queries times documents, as exact search has it.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    cores = queries.sparkSession.sparkContext.defaultParallelism
    given = documents.select(F.col(document).alias("d"), F.col(vector).alias("v")).dropna()
    docs = stored_in_order(given, "d", spread(documents.count(), DOCUMENT_BLOCK, cores, LEAST_BLOCK))
    asks = durable(queries.select(F.col(query).alias("q"), F.col(vector).alias("v")).dropna())
    at_once = AT_ONCE

    def prepare(own: pa.Table):
        names = own.column("q").combine_chunks().dictionary_encode()
        names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
        asked = names.indices.to_numpy().astype(np.int64)
        vectors = flat(own.column("v"))[0].astype(np.float64).reshape(own.num_rows, -1)
        lengths, wanted = np.sqrt((vectors * vectors).sum(axis=1)), names.dictionary.to_numpy(zero_copy_only=False)

        def score(block: pa.RecordBatch, best: Best, seen: int) -> pa.Array:
            ids, matrix = block.column("d"), flat(block.column("v"))[0].astype(np.float64).reshape(block.num_rows, -1)
            longest = np.sqrt((matrix * matrix).sum(axis=1).max(initial=0))
            slack = (matrix.shape[1] + 16) * 2.0**-23 * lengths * longest
            kind = np.float32 if lengths.max() * longest < 1e30 and max(lengths.max(), longest) < 1e30 else np.float64
            left, right, own_ids = vectors.astype(kind), matrix.astype(kind).T, ids.to_numpy(zero_copy_only=False) if other_than_self else None
            for start in range(0, len(asked), at_once):
                rows = slice(start, start + at_once)
                row, column = best.passing(left[rows] @ right, asked[rows], slack[rows], int(other_than_self))
                row += start
                if other_than_self:
                    other = own_ids[column] != wanted[asked[row]]
                    row, column = row[other], column[other]
                for at in range(0, len(row), FEW):
                    r, c = row[at : at + FEW], column[at : at + FEW]
                    best.add(asked[r], seen + c, rounded(np.einsum("ij,ij->i", vectors[r], matrix[c]), DIGITS))
            return ids

        return len(names.dictionary), names.dictionary, -np.inf, score

    near = search_blocks(asks, spread(asks.count(), QUERY_BLOCK, cores, AT_ONCE), docs, docs.schema["d"].dataType.simpleString(), ["d", "v"], DOCUMENT_BLOCK, k, prepare)
    return near.select(F.col("q").alias(query), F.lit(source).alias("source"), F.col("d").alias(document), "rank", "score")
