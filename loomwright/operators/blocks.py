"""Blocks of documents, stored once, that each task of queries reads one after another."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.sql import DataFrame

from loomwright.operators.topk import top_k
from loomwright.session import durable

#: Rows of output in one Arrow batch; rows that a block of documents has at most; blocks whose ids one task holds.
OUT, BLOCK, BLOCKS_AT_ONCE = 50_000, 20_000, 50


def blocks_of(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def spread(rows: int, size: int, cores: int, least: int) -> int:
    """How many parts: of `size` rows at most and a multiple of all cores, but fewer as long as parts have under `least` rows."""
    whole = cores * blocks_of(rows, size * cores)
    return min(whole, blocks_of(rows, least)) if rows <= size * cores else whole


def stored_in_order(df: DataFrame, key: str, parts: int, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """df as a stored table whose files, in order, have the rows in the order of key; `then` may turn each part into other rows."""
    return durable(then(df.repartitionByRange(parts, key).sortWithinPartitions(key)))


def files_of(stored: DataFrame) -> list[str]:
    """The files of a stored table in the order of the tasks that wrote them."""
    names = ((uri.rpartition("/")[2].split("-"), uri) for uri in stored.inputFiles())
    return [uri for _, _, uri in sorted((int(name[1]), name[-1], uri) for name, uri in names)]


def read_blocks(uri: str, columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    system, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    with system.open_input_file(path) as file:
        yield from pq.ParquetFile(file).iter_batches(rows, columns=columns, use_threads=False)


def rounded(scores: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero, as Spark and SQL round."""
    return np.sign(scores) * np.floor(np.abs(scores) * 10**digits + 0.5) / 10**digits


def flat(lists: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and where each row's begin."""
    whole = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    return whole.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.diff(whole.offsets.to_numpy()))])


class Best:
    """The k best documents of n queries, found in blocks of documents that come in the order of their ids.

    A later document of an equal score is never better, so once a query has k of them, only scores above its bar,
    the least of these, go on.
    """

    def __init__(self, n: int, k: int, least: float) -> None:
        self.n, self.k = n, k
        self.bar, self.full = np.full(n, least, dtype=np.float64), np.zeros(n, dtype=bool)
        self.parts = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        self.waiting, self.rank = 0, np.zeros(0, dtype=np.int64)

    def passing(self, scores: np.ndarray, asked: np.ndarray, slack: np.ndarray, spare: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of the scores that may be among the best: slack is by how much a row's may be wrong, `spare` how many don't count."""
        cut, fresh, at = self.bar[asked] - slack, ~self.full[asked], scores.shape[1] - self.k - spare
        if at > 0 and fresh.any():
            kth = np.partition(scores[fresh], at, axis=1)[:, at]
            cut[fresh] = np.maximum(cut[fresh], kth - 2 * slack[fresh] - 2e-6)  # scores are rounded to six digits later
        return np.divmod(np.flatnonzero(scores > cut.astype(scores.dtype)[:, None]), scores.shape[1])

    def add(self, asked: np.ndarray, places: np.ndarray, scores: np.ndarray) -> None:
        above = scores > self.bar[asked]
        self.parts.append((asked[above], places[above], scores[above]))
        self.waiting += len(self.parts[-1][0])
        if self.waiting > max(1_000_000, 2 * self.n * self.k):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, score) of the best so far, in order; `rank` goes with them."""
        q, d, s = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((d, -s, q))
        q, d, s = q[order], d[order], s[order]
        begins = np.searchsorted(q, np.arange(self.n + 1))
        place = np.arange(len(q)) - begins[q]
        self.full = np.diff(begins) >= self.k
        self.bar[self.full] = s[begins[:-1][self.full] + self.k - 1]
        kept = place < self.k
        self.parts, self.waiting, self.rank = [(q[kept], d[kept], s[kept])], 0, place[kept] + 1
        return self.parts[0]


#: (a task's queries) -> (how many there are, the ids of these, least score, what scores a block: (block, best, documents seen) -> ids)
Prepare = Callable[[pa.Table], tuple[int, pa.Array, float, Callable[[pa.RecordBatch, Best, int], pa.Array]]]


def search_blocks(asked: DataFrame, parts: int, documents: DataFrame, id_type: str, columns: list[str], rows: int, k: int, prepare: Prepare) -> DataFrame:
    """(q, d, score, rank): the k best documents of each row's query q in asked, equal scores by d.

    documents: a table of `stored_in_order`. Each task has a part of the queries and reads the stored files itself, from the
    shared folder, so documents aren't sent to tasks, nor is anything but the best k shuffled. A task holds a block, its
    queries' best so far and the ids of BLOCKS_AT_ONCE files; of more files the best of each such range are ranked together.
    """
    files = files_of(documents)
    schema = f"q {asked.schema['q'].dataType.simpleString()}, d {id_type}, score double, rank int"

    def over(own: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            given = [b for b in batches if b.num_rows]
            if not given:
                return
            n, asking, least, score = prepare(pa.Table.from_batches(given))
            best, ids, seen = Best(n, k, least), [], 0
            for uri in own:
                for block in read_blocks(uri, columns, rows):
                    ids.append(score(block, best, seen))
                    seen += len(ids[-1])
                    if best.waiting >= n * k:
                        best.settle()
            q, d, s = best.settle()
            if len(q):
                every = pa.chunked_array(ids).combine_chunks()
                for at in range(0, len(q), OUT):
                    cut = slice(at, at + OUT)
                    yield pa.record_batch({"q": asking.take(pa.array(q[cut])), "d": every.take(pa.array(d[cut])), "score": pa.array(s[cut]), "rank": pa.array(best.rank[cut].astype(np.int32))})

        return run

    spread_out = asked.repartition(parts, "q")
    ranges = [files[at : at + BLOCKS_AT_ONCE] for at in range(0, len(files), BLOCKS_AT_ONCE)] or [[]]
    found = [spread_out.mapInArrow(over(own), schema) for own in ranges]
    return found[0] if len(found) == 1 else top_k(reduce(DataFrame.unionByName, found).drop("rank"), ["q"], "score", "d", k)
