"""Positions and running sums in a total order, without a task that holds all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.session import durable

ROWS_PER_BLOCK = 1_000_000


def same(keys: list[str], left: str, right: str) -> Column:
    """Null-safe equality of key columns of two aliased tables."""
    return reduce(lambda c, k: c & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")), keys, F.lit(True))


def running(df: DataFrame, keys: list[str], order: list[Column], weight: str, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """df with `upto`, the sum of weight in the row's group up to this row in the order, and `whole`, that of the group.

    The order has to tell rows of a group apart. All rows are cut by (keys, order) into ranges of about rows_per_block
    rows, so a group of any size is spread over as many tasks as it needs and small groups share one. A range's rows
    are summed up by itself; what a group has in lower ranges is taken from a table of (range, group) sums, of which a
    group has at most one a range. Nothing is collected, broadcast or joined on the group alone.
    """
    ranges = max(1, -(-df.count() // rows_per_block))
    cut = durable(df.repartitionByRange(ranges, *map(F.col, keys), *order).withColumn("range", F.spark_partition_id()))
    group = Window.partitionBy(*keys)
    sums = cut.groupBy(*keys, "range").agg(F.sum(weight).alias("w"))
    sums = sums.select(*keys, "range", F.sum("w").over(group).alias("whole"), (F.sum("w").over(group.orderBy("range")) - F.col("w")).alias("lower"))
    own = F.sum(weight).over(Window.partitionBy("range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    placed = cut.withColumn("own", own).alias("d").join(sums.alias("s"), same(["range", *keys], "d", "s"))
    return placed.select(*(F.col(f"d.{c}").alias(c) for c in df.columns), (F.col("own") + F.col("lower")).alias("upto"), "whole")


def positions(df: DataFrame, order: list[Column], name: str = "place", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """df with `name`, the row's place from 1 in the order of all rows."""
    counted = running(df.withColumn("__one", F.lit(1).cast("long")), [], order, "__one", rows_per_block)
    return counted.select(*df.columns, F.col("upto").alias(name))
