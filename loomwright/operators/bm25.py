"""Lexical search: BM25 over an inverted index kept as a table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions.tokenize import hashed_tokens, raw_tokens
from loomwright.operators.blocks import BLOCK, Best, files_of, flat, read_blocks, rounded, search_blocks, spread, stored_in_order

K1, B, DIGITS = 1.2, 0.75, 6
POSTINGS_BLOCK, QUERY_BLOCK, AT_ONCE, LEAST_BLOCK = 2_000_000, 2_000, 64, 2_500
#: A token is multiplied as a row of a matrix if it's met by this share of all pairs of a task's queries and a block's documents.
COMMON, MOST_COMMON = 0.008, 512


@dataclass
class Index:
    """An inverted index: stored blocks of documents, in the order of their ids, and what weights need of all of them.

    blocks: one row a block with its documents' ids and lengths, its tokens (64-bit hashes, ascending), how many documents have
    each, and these documents' places and term counts, token by token.
    """

    blocks: DataFrame
    id_type: str
    documents: int
    mean: float
    k1: float
    b: float


def _inverted(size: int):
    def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of about `size` tokens at most, repeated ones counted."""
        for batch in batches:
            row, key, _ = hashed_tokens(batch.column("raw"))
            begins = np.searchsorted(row, np.arange(batch.num_rows + 1))
            first = 0
            while first < batch.num_rows:
                end = max(first + 1, int(np.searchsorted(begins, begins[first] + size, "right")) - 1)
                of, token = row[begins[first] : begins[end]] - first, key[begins[first] : begins[end]]
                order = np.lexsort((of, token))
                of, token = of[order], token[order]
                new = np.flatnonzero(np.concatenate([[True], (np.diff(token) != 0) | (np.diff(of) != 0)])) if len(of) else np.zeros(0, dtype=np.int64)
                tokens, counts = np.unique(token[new], return_counts=True)
                ids = batch.column("d").slice(first, end - first)
                yield pa.record_batch({
                    "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    "lengths": lists(np.diff(begins[first : end + 1]), pa.int32()), "tokens": lists(tokens, pa.int64()), "counts": lists(counts, pa.int32()),
                    "docs": lists(of[new], pa.int32()), "tf": lists(np.diff(np.concatenate([new, [len(of)]])), pa.int32()),
                })
                first = end

    return run


def bm25_index(documents: DataFrame, document: str, text: str, k1: float = K1, b: float = B) -> Index:
    """The index of documents: a token weighs idf * tf / (tf + k1 (1 - b + b length / mean length)) in a document.

    idf = ln(1 + (N - df + 1/2) / (df + 1/2)). All documents count for N and the mean length; those without a
    token, NULL texts among them, have no postings. Document ids are unique. Texts are shuffled once, into the order of
    ids; each block is inverted where it is read, so no posting is shuffled.
    """
    n = documents.count()
    given = documents.select(F.col(document).alias("d"), F.col(text).alias("text"))
    kind = given.schema["d"].dataType.simpleString()
    schema = f"ids array<{kind}>, lengths array<int>, tokens array<long>, counts array<int>, docs array<int>, tf array<int>"
    parts = spread(n, BLOCK, documents.sparkSession.sparkContext.defaultParallelism, LEAST_BLOCK)
    # texts are cut behind the shuffle, since finding the ranges reads what is before it twice
    blocks = stored_in_order(given, "d", parts, lambda df: df.select("d", raw_tokens(F.col("text")).alias("raw")).mapInArrow(_inverted(POSTINGS_BLOCK), schema))
    total = blocks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0]
    return Index(blocks, kind, n, (total or 0) / max(1, n), k1, b)


def _prepare(index: Index, files: list[str], at_once: int):
    """What scores blocks of an index for a task's queries, see search_blocks."""
    n, mean, k1, b = index.documents, index.mean, index.k1, index.b

    def look_up(tokens: np.ndarray, voc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(tokens, voc), max(0, len(tokens) - 1))
        return at, tokens[at] == voc if len(tokens) else np.zeros(len(voc), dtype=bool)

    def prepare(own: pa.Table):
        names = own.column("q").combine_chunks().dictionary_encode()
        names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
        raw = own.column("raw").combine_chunks()
        row, key, _ = hashed_tokens(raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw)
        voc = np.unique(key)
        df = np.zeros(len(voc), dtype=np.int64)
        for uri in files:
            for block in read_blocks(uri, ["tokens", "counts"], 1):
                at, known = look_up(flat(block.column("tokens"))[0], voc)
                df[known] += flat(block.column("counts"))[0][at[known]]
        asking = names.indices.to_numpy().astype(np.int64)[row] if len(row) else row
        terms, times = np.unique(asking * max(1, len(voc)) + np.searchsorted(voc, key), return_counts=True)
        asking, term = np.divmod(terms, max(1, len(voc)))
        met = df[term] > 0
        asking, term = asking[met], term[met]
        weight = times[met] * np.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
        total, often = len(names.dictionary), np.bincount(term, minlength=len(voc))

        def score(block: pa.RecordBatch, best: Best, seen: int) -> pa.Array:
            ids = block.column("ids").flatten()
            lengths, tokens, counts, docs, tf = (flat(block.column(c))[0] for c in ("lengths", "tokens", "counts", "docs", "tf"))
            rows = len(ids)
            share = tf / (tf + (k1 * (1 - b + b * lengths / mean))[docs]) if len(docs) else np.zeros(0)
            at, known = look_up(tokens, voc)
            starts = np.concatenate([[0], np.cumsum(counts)])
            first, size = (starts[:-1][at], np.where(known, counts[at], 0)) if len(tokens) else (np.zeros(len(voc), dtype=np.int64), np.zeros(len(voc), dtype=np.int64))
            common = np.flatnonzero(often * size > COMMON * total * rows)
            common = common[np.argsort(-(often * size)[common])[:MOST_COMMON]]
            column = np.full(len(voc), -1)
            column[common] = np.arange(len(common))
            matrix = np.zeros((len(common), rows))
            for i, t in enumerate(common):
                own = slice(first[t], first[t] + size[t])
                matrix[i, docs[own]] = share[own]
            thick = column[term] >= 0
            rare = ~thick & (size[term] > 0)
            left = np.zeros((total, len(common)))
            left[asking[thick], column[term[thick]]] = weight[thick]
            who, what, times_idf = asking[rare], term[rare], weight[rare]
            cuts = np.searchsorted(who, np.arange(0, total + at_once, at_once))
            for i, begin in enumerate(range(0, total, at_once)):
                end, own = min(begin + at_once, total), slice(cuts[i], cuts[i + 1])
                scores, count = left[begin:end] @ matrix, size[what[own]]
                if count.sum():
                    # the postings of all rarer terms of these queries, one after another
                    place = np.repeat(first[what[own]] - np.cumsum(count) + count, count) + np.arange(count.sum())
                    cell = np.repeat((who[own] - begin) * rows, count) + docs[place]
                    scores += np.bincount(cell, share[place] * np.repeat(times_idf[own], count), (end - begin) * rows).reshape(end - begin, rows)
                r, c = best.passing(scores, np.arange(begin, end), np.full(end - begin, 1e-9))
                best.add(r + begin, seen + c, rounded(scores[r, c], DIGITS))
            return ids

        return total, names.dictionary, 0.0, score

    return prepare


def bm25_search(queries: DataFrame, query: str, text: str, postings: Index, document: str, k: int, source: str = "bm25") -> DataFrame:
    """(query, source, document, rank, score): the k best documents of each query.

    A repeated query token counts repeatedly. Only documents that share a token are candidates; scores are rounded to
    DIGITS before they are ranked, equal ones by document id. Ids must not be NULL.

    Plan: queries are hashed into parts, and each part is one task that reads the index block by block (see search_blocks). Tokens
    that many of its queries and documents have are a matrix product; of all others the postings are added up. A join of terms
    with postings would shuffle a row for every query, document and token they share; here only the best k of a query go on.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    asked = queries.select(F.col(query).alias("q"), raw_tokens(F.col(text)).alias("raw")).filter(F.size("raw") > 0)
    parts = spread(queries.count(), QUERY_BLOCK, queries.sparkSession.sparkContext.defaultParallelism, AT_ONCE)
    columns = ["ids", "lengths", "tokens", "counts", "docs", "tf"]
    ranked = search_blocks(asked, parts, postings.blocks, postings.id_type, columns, 1, k, _prepare(postings, files_of(postings.blocks), AT_ONCE))
    return ranked.select(F.col("q").alias(query), F.lit(source).alias("source"), F.col("d").alias(document), "rank", "score")
