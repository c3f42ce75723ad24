"""Ranks and top-k of scored candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators.order import positions


def top_k(scored: DataFrame, groups: list[str], score: str, item: str, k: int | None, rank: str = "rank") -> DataFrame:
    """scored with `rank` from 1: score from high to low, then item in byte order; ranks above k left out.

    The filter stands directly on the window, so Spark cuts each group to k rows before it shuffles.
    """
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc(score), F.asc(item)))
    ranked = scored.withColumn(rank, place)
    return ranked if k is None else ranked.filter(F.col(rank) <= k)


def top_list(ranked: DataFrame, groups: list[str], item: str, k: int = 5) -> DataFrame:
    """(groups..., top): the first k items of each ranked group, in order."""
    few = ranked.filter(F.col("rank") <= k)
    return few.groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item))), lambda x: x[item]).alias("top"))


def every_nth(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """At most n rows, evenly spaced in the given order: every (rows // n)-th, the first included. None if n < 1."""
    if n < 1:
        return df.limit(0)
    step = max(1, df.count() // n)
    placed = positions(df, order, "__place").withColumn("__at", F.col("__place") - 1)
    return placed.filter((F.pmod("__at", F.lit(step)) == 0) & (F.col("__at") < n * step)).select(*df.columns)
