"""Top N items within every group: secondary sort with streamed Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _differs(column: pa.Array) -> np.ndarray:
    """For each row but the first: whether its value differs from the row before (NULL equals NULL)."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    unequal = pc.fill_null(pc.not_equal(a, b), True)
    if column.null_count:
        unequal = pc.and_(unequal, pc.invert(pc.and_(pc.is_null(a), pc.is_null(b))))
    return unequal.to_numpy(zero_copy_only=False)


def first_n_of_sorted(n_keys: int, n: int, with_place: bool):
    """An Arrow batch function that keeps the first n rows of each run of equal keys (the first n_keys columns).

    It holds one key and one counter between batches, never a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, seen = None, 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            starts = np.zeros(rows, dtype=bool)
            for k in range(n_keys):
                if rows > 1:
                    starts[1:] |= _differs(batch.column(k))
            first_key = tuple(batch.column(k)[0].as_py() for k in range(n_keys))
            index = np.arange(rows)
            begin = np.maximum.accumulate(np.where(starts, index, 0))
            place = index - begin
            if last_key == first_key:
                place[begin == 0] += seen
            last_key = tuple(batch.column(k)[rows - 1].as_py() for k in range(n_keys))
            seen = int(place[-1]) + 1
            keep = place < n
            if not keep.any():
                continue
            out = batch.filter(pa.array(keep))
            if with_place:
                columns = [*out.columns, pa.array((place[keep] + 1).astype(np.int32))]
                out = pa.RecordBatch.from_arrays(columns, names=[*out.schema.names, "place"])
            yield out

    return run


def top_n_per_group(df: DataFrame, groups: list[str], score: str, item: str, n: int, version: str | None = None) -> DataFrame:
    """The n best items of each group, as (groups..., place, item, score), place from 1.

    Order: score from high to low, equal scores by item in byte order, a NULL item last. Rows whose score is NULL
    or NaN don't count. Of several rows of one item in a group the one with the highest `version` counts (without
    `version`, or at equal versions, the highest score); a NULL version is older than any other. A NULL group value
    is a group of its own. Other columns of df are not looked at. An empty table, or n < 1, gives no rows.

    Plan: one hash aggregation on (group, item) with map-side combine removes repeated rows and spreads even a
    group with a third of all rows over all tasks. Each task sorts its share by (group, score, item) and streams
    it, passing on at most n rows a group. The survivors are hash-partitioned by group, sorted and streamed again;
    there no group has more than n rows per first-stage task.
    """
    keys = [f"g{i}" for i in range(len(groups))]
    value = F.col(score).cast("double")
    named = df.select(*(F.col(g).alias(k) for g, k in zip(groups, keys)), F.col(item).alias("item"), value.alias("score"), (F.col(version) if version else F.lit(0)).alias("version"))
    valid = named.filter(F.col("score").isNotNull() & ~F.isnan("score") & F.lit(n >= 1)).withColumn("score", F.col("score") + F.lit(0.0))
    latest = valid.groupBy(*keys, "item").agg(F.max(F.struct("version", "score")).alias("best")).select(*keys, "item", F.col("best.score").alias("score"))
    order = [*(F.col(k).asc() for k in keys), F.col("score").desc(), F.col("item").asc_nulls_last()]
    few = latest.sortWithinPartitions(*order).mapInArrow(first_n_of_sorted(len(keys), n, False), latest.schema)
    schema = T.StructType([*latest.schema.fields, T.StructField("place", T.IntegerType())])
    ranked = few.repartition(*keys).sortWithinPartitions(*order).mapInArrow(first_n_of_sorted(len(keys), n, True), schema)
    return ranked.select(*(F.col(k).alias(g) for g, k in zip(groups, keys)), "place", F.col("item").alias(item), F.col("score").alias(score))
