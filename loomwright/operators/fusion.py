"""Fusion of candidate lists: reciprocal ranks and z-scores."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.operators.topk import top_k

DIGITS = 9


def _weight(weights: dict[str, float] | None) -> Column:
    if weights is None:
        return F.lit(1.0)
    return F.coalesce(F.create_map(*chain.from_iterable((F.lit(s), F.lit(float(w))) for s, w in weights.items()))[F.col("source")], F.lit(0.0)) if weights else F.lit(0.0)


def rrf(candidates: DataFrame, groups: list[str], item: str, weights: dict[str, float] | None = None, k: int = 60) -> DataFrame:
    """(groups..., item, score, rank): the sum of weight / (k + rank) over the lists that have the item.

    candidates: (groups..., source, item, rank). Without weights every list counts 1; with weights, a source that they
    don't name counts nothing and its items alone are left out.
    """
    w = _weight(weights)
    lists = candidates.withColumn("w", w)
    if weights is not None:
        lists = lists.filter(F.col("source").isin(list(weights)))
    fused = lists.groupBy(*groups, item).agg(F.round(F.sum(F.col("w") / (k + F.col("rank"))), DIGITS).alias("score"))
    return top_k(fused, groups, "score", item, None)


def zscore(candidates: DataFrame, groups: list[str], item: str, weights: dict[str, float] | None = None) -> DataFrame:
    """(groups..., item, score, rank): the weighted sum of scores, each less its list's mean over its deviation.

    The deviation is the population's, 1 if it is 0. An item that a list lacks gets the list's lowest value there. A
    source without any row for a group has no list there. Sums of all lists' lowest values are taken once a group, and
    each item adds what it has above them, so no grid of items and sources is built.
    """
    lists = candidates.groupBy(*groups, "source").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"), F.min("score").alias("low"))
    sd = F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))
    lists = lists.select(*groups, "source", "low", sd.alias("sd"), (_weight(weights) * (F.col("low") - F.col("mean")) / sd).alias("floor"), _weight(weights).alias("w"))
    base = lists.groupBy(*groups).agg(F.sum("floor").alias("base"))
    gain = candidates.join(lists, [*groups, "source"]).groupBy(*groups, item).agg(F.sum(F.col("w") * (F.col("score") - F.col("low")) / F.col("sd")).alias("gain"))
    fused = gain.join(base, groups).select(*groups, item, F.round(F.col("gain") + F.col("base"), 6).alias("score"))
    return top_k(fused, groups, "score", item, None)


def first_only(candidates: DataFrame, groups: list[str], item: str, source: str) -> DataFrame:
    """(groups..., item, score, rank): no fusion, the list of one source as it is."""
    return candidates.filter(F.col("source") == source).select(*groups, item, "score", "rank")


def fuse(candidates: DataFrame, groups: list[str], item: str, sources: list[str], method: dict | None) -> DataFrame:
    """Fuse by a configuration's `fusion`: none (of one source), rrf or zscore; weights go by place to sources."""
    if not method:
        if len(sources) != 1:
            raise ValueError("several retrievers need a fusion method")
        return first_only(candidates, groups, item, sources[0])
    weights = dict(zip(sources, method["weights"])) if method.get("weights") else None
    if method["method"] == "rrf":
        return rrf(candidates, groups, item, weights, method.get("k", 60))
    if method["method"] == "zscore":
        return zscore(candidates, groups, item, weights)
    raise ValueError(f"unknown fusion method {method['method']}")
