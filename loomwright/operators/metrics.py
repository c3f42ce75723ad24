"""Ranking metrics of runs against judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (10, 50, 100, 200)
MOST_RUNS = 10_000


def judgments(qrels: DataFrame) -> DataFrame:
    """(qid, doc_id, rel), one row a pair: the highest rel, NULL as 0."""
    return qrels.groupBy("qid", "doc_id").agg(F.max(F.coalesce("rel", F.lit(0))).alias("rel"))


def per_query(run: DataFrame, qrels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys..., qid, gold_rank, ndcg10) of every judged query.

    run: (keys..., qid, doc_id, rank). qrels: (qid, doc_id, rel), one row a pair. gold_rank is the best rank of a document
    with rel > 0, NULL if none is in the run. ndcg10 has linear gains and counts 0 for what isn't retrieved, and 0 for a
    query without a relevant document. With keys, each of the run's key values is held against all judged queries.
    """
    keys = keys or []
    relevant = qrels.filter("rel > 0")
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "doc_id"))
    ideal = relevant.withColumn("r", order).filter("r <= 10").groupBy("qid").agg(F.sum(F.col("rel") / F.log2(F.col("r") + 1)).alias("ideal"))
    gain = F.when(F.col("rank") <= 10, F.col("rel") / F.log2(F.col("rank") + 1.0))
    met = run.join(relevant, ["qid", "doc_id"]).groupBy(*keys, "qid").agg(F.min("rank").alias("gold_rank"), F.sum(gain).alias("dcg"))
    every = qrels.select("qid").distinct()
    if keys:
        # the runs to be compared are few by nature: their keys are one array, laid out for each judged query
        listed = run.select(*keys).distinct().limit(MOST_RUNS + 1).agg(F.collect_list(F.struct(*keys)).alias("runs"))
        runs = listed.select(F.when(F.size("runs") > MOST_RUNS, F.raise_error(F.lit(f"more than {MOST_RUNS} runs to compare"))).otherwise(F.col("runs"))).scalar()
        every = every.select("qid", F.explode(runs).alias("run")).select("qid", "run.*")
    full = every.join(ideal, "qid", "left").join(met, [*keys, "qid"], "left")
    return full.select(*keys, "qid", "gold_rank", F.round(F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)), 6).alias("ndcg10"))


def reciprocal(rank: Column, k: int) -> Column:
    """1 / rank within the first k, else 0, NULL included."""
    return F.when(rank <= k, 1.0 / rank).otherwise(0.0)


def aggregate(queries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys..., n_queries, ndcg_at_10, mrr_at_10, mrr_at_100, recall_at_...) of per_query rows; every query counts."""
    rank = F.col("gold_rank")
    columns = [F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("ndcg10"), 6).alias("ndcg_at_10")]
    columns += [F.round(F.avg(reciprocal(rank, k)), 6).alias(f"mrr_at_{k}") for k in (10, 100)]
    columns += [F.round(F.avg(F.coalesce((rank <= k).cast("int"), F.lit(0))), 6).alias(f"recall_at_{k}") for k in (1, 5, *CUTOFFS)]
    return queries.groupBy(*(keys or [])).agg(*columns)


def set_metrics(run: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5, 10, 20, 100, 1000)) -> DataFrame:
    """(k, map, precision, recall, hit_rate), means over all judged queries with a relevant document."""
    relevant = qrels.filter("rel > 0")
    totals = relevant.groupBy("qid").agg(F.count(F.lit(1)).alias("total"))
    hits = run.join(relevant, ["qid", "doc_id"], "left_semi").select("qid", "rank")
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    hits = hits.withColumn("nth", nth)
    each = hits.select("qid", "rank", "nth", F.explode(F.array(*map(F.lit, cutoffs))).alias("k")).filter("rank <= k")
    found = each.groupBy("qid", "k").agg(F.count(F.lit(1)).alias("hits"), F.sum(F.col("nth") / F.col("rank")).alias("ap"))
    grid = totals.select("qid", "total", F.explode(F.array(*map(F.lit, cutoffs))).alias("k"))
    full = grid.join(found, ["qid", "k"], "left").fillna(0, ["hits", "ap"])
    return full.groupBy("k").agg(
        F.round(F.avg(F.col("ap") / F.least("total", "k")), 6).alias("map"),
        F.round(F.avg(F.col("hits") / F.col("k")), 6).alias("precision"),
        F.round(F.avg(F.col("hits") / F.col("total")), 6).alias("recall"),
        F.round(F.avg((F.col("hits") > 0).cast("int")), 6).alias("hit_rate"),
    )


def bottleneck(queries: DataFrame) -> DataFrame:
    """One row: misses at 10, and of them those absent from the first 100 and those in it."""
    rank = F.coalesce("gold_rank", F.lit(1 << 30))
    return queries.agg(F.count_if(rank > 10).alias("n_miss_at_10"), F.count_if(rank > 100).alias("absent_from_top100"), F.count_if((rank > 10) & (rank <= 100)).alias("in_top100_ranked_low"))


def official_metrics(run: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5, 10, 20, 100, 1000)) -> DataFrame:
    """(k, ndcg, mrr, map, precision, recall, accuracy) by cut-off, means over all judged queries with a relevant document.

    run: (qid, doc_id, rank), as deep as the largest cut-off. accuracy is the share of queries with a relevant document
    among the first k. ndcg has linear gains.
    """
    relevant = qrels.filter("rel > 0")
    grid = F.explode(F.array(*map(F.lit, cutoffs))).alias("k")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "doc_id"))
    best = relevant.withColumn("r", place).select("qid", "rel", "r", grid).filter("r <= k").groupBy("qid", "k").agg(F.sum(F.col("rel") / F.log2(F.col("r") + 1.0)).alias("ideal"))
    hits = run.join(relevant, ["qid", "doc_id"]).select("qid", "rank", "rel", grid).filter("rank <= k")
    got = hits.groupBy("qid", "k").agg(F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.min("rank").alias("first"))
    each = best.join(got, ["qid", "k"], "left")
    ranks = each.groupBy("k").agg(F.round(F.avg(F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0))), 6).alias("ndcg"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))
    return ranks.join(set_metrics(run, qrels, cutoffs).withColumnRenamed("hit_rate", "accuracy"), "k")
