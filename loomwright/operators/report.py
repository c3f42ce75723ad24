"""Per-query reports, comparison of two reports, and buckets of misses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.hashing import fold
from loomwright.functions.text import has_identifier, word_count
from loomwright.operators.metrics import CUTOFFS, reciprocal
from loomwright.operators.topk import top_list


def query_report(run: DataFrame, candidates: DataFrame, scored: DataFrame, qrels: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row a judged query: gold document, rank, ndcg10, hits, top five, each source's view of the gold, word counts.

    gold is the smallest id of the highest judged documents. sources maps each source with candidates for the query to
    the gold's rank and score there (NULL if absent) and the source's best score.
    """
    best = qrels.groupBy("qid").agg(F.max("rel").alias("rel"))
    gold = qrels.join(best, ["qid", "rel"]).groupBy("qid").agg(F.min("doc_id").alias("gold"))
    tops = candidates.filter("rank = 1").select("qid", "source", F.col("score").alias("top1_score"))
    at_gold = candidates.join(gold, (candidates["qid"] == gold["qid"]) & (candidates["doc_id"] == gold["gold"])).select(candidates["qid"], "source", "rank", "score")
    views = tops.join(at_gold, ["qid", "source"], "left")
    entry = F.struct("source", F.struct("rank", "score", "top1_score").alias("view"))
    sources = views.groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("sources"))
    hits = [F.coalesce(F.col("rank") <= k, F.lit(False)).alias(f"hit@{k}") for k in CUTOFFS]
    five = top_list(run, ["qid"], "doc_id").withColumnRenamed("top", "top5")
    words = queries.select("qid", word_count(F.col("text")).alias("query_words"))
    gold_words = corpus.select(F.col("doc_id").alias("gold"), word_count(F.col("text")).alias("gold_words"))
    base = scored.withColumnRenamed("gold_rank", "rank").join(gold, "qid").join(five, "qid", "left").join(sources, "qid", "left").join(words, "qid", "left").join(gold_words, "gold", "left")
    return base.select("qid", "gold", "rank", F.round("ndcg10", 4).alias("ndcg10"), *hits, "top5", "sources", "query_words", "gold_words")


def compare_by_fold(base: DataFrame, new: DataFrame, folds: int = 5) -> DataFrame:
    """(fold, n, d_ndcg, d_mrr) over queries that both reports (qid, rank, ndcg10) have."""
    both = _paired(base, new)
    change = reciprocal(F.col("new_rank"), 10) - reciprocal(F.col("base_rank"), 10)
    return both.groupBy(fold(F.col("qid"), folds).alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("new_ndcg") - F.col("base_ndcg")), 6).alias("d_ndcg"), F.round(F.avg(change), 6).alias("d_mrr"))


def compare_summary(base: DataFrame, new: DataFrame, folds: int = 5) -> DataFrame:
    """One row: mean and sample deviation of the folds' changes, folds improved, and counts of queries that moved."""
    by_fold = compare_by_fold(base, new, folds).agg(F.round(F.avg("d_ndcg"), 6).alias("mean_d_ndcg"), F.round(F.stddev_samp("d_ndcg"), 6).alias("fold_sd"), F.count_if(F.col("d_ndcg") > 0).alias("folds_improved"))
    now, then = F.coalesce(F.col("new_rank") <= 10, F.lit(False)), F.coalesce(F.col("base_rank") <= 10, F.lit(False))
    counts = _paired(base, new).agg(F.count_if(F.col("new_ndcg") > F.col("base_ndcg")).alias("better"), F.count_if(F.col("new_ndcg") < F.col("base_ndcg")).alias("worse"), F.count_if(now & ~then).alias("entered"), F.count_if(then & ~now).alias("left"))
    folded = by_fold.select(F.struct("mean_d_ndcg", "fold_sd", "folds_improved")).scalar()
    return counts.select(folded.alias("f"), "*").select("f.*", *counts.columns)


def regressions(base: DataFrame, new: DataFrame, n: int = 8) -> DataFrame:
    """(qid, base_rank, new_rank): the first n queries, by id, that left the top ten."""
    left = F.coalesce(F.col("new_rank"), F.lit(1 << 30)) > 10
    return _paired(base, new).filter((F.col("base_rank") <= 10) & left).select("qid", "base_rank", "new_rank").orderBy("qid").limit(n)


def _paired(base: DataFrame, new: DataFrame) -> DataFrame:
    sides = [df.select("qid", F.col("rank").alias(f"{p}_rank"), F.col("ndcg10").alias(f"{p}_ndcg")) for df, p in ((base, "base"), (new, "new"))]
    return sides[0].join(sides[1], "qid")


def miss_buckets(report: DataFrame, queries: DataFrame) -> DataFrame:
    """(bucket, n, percent, examples): why queries missed the top ten; one may be in several buckets.

    A query is long beyond the 75th percentile of all queries' word counts. percent is of all misses; examples are the
    four smallest ids.
    """
    long_from = report.agg(F.percentile("query_words", F.lit(0.75))).scalar()
    limit = [F.col(c) if c in report.columns else F.lit(False) for c in ("query_truncated", "gold_truncated")]
    misses = report.filter(~F.col("hit@10")).join(queries.select("qid", "text"), "qid")
    somewhere = F.exists(F.map_values("sources"), lambda v: F.coalesce(v["rank"] <= 10, F.lit(False)))
    # The names of the buckets, as reports have them.
    cases = [
        ("candidate: absent from fused top100", ~F.col("hit@100")),
        ("ranking: in top100, ranked >10", F.col("hit@100")),
        ("fusion loss: some source had it in top10", somewhere),
        ("query truncated by encoder", limit[0]),
        ("gold code truncated by encoder", limit[1]),
        ("long query (>p75 words)", F.col("query_words") > long_from),
        ("query has identifiers/starter code", has_identifier(F.col("text"))),
        ("very short gold snippet (<15 words)", F.coalesce("gold_words", F.lit(0)) < 15),
    ]
    named = F.explode(F.array_compact(F.array(*(F.when(when, name) for name, when in cases)))).alias("bucket")
    total = misses.agg(F.count(F.lit(1))).scalar()
    cased = misses.select("qid", named)
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("qid"))
    examples = cased.withColumn("rank", nth).filter("rank <= 4").groupBy("bucket").agg(F.array_sort(F.collect_list("qid")).alias("examples"))
    counts = cased.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(examples, "bucket").select("bucket", "n", F.round(100 * F.col("n") / total, 1).alias("percent"), "examples")


def with_token_lengths(report: DataFrame, queries: DataFrame, documents: DataFrame, limit: int) -> DataFrame:
    """The report with an encoder's token counts of query and gold document, and whether they exceed its limit.

    queries: (qid, query_tokens), of the raw queries; documents: (gold, gold_tokens). A missing count leaves NULLs.
    """
    counted = report.join(queries.select("qid", "query_tokens"), "qid", "left").join(documents.select("gold", "gold_tokens"), "gold", "left")
    return counted.withColumns({"query_truncated": F.col("query_tokens") > limit, "gold_truncated": F.col("gold_tokens") > limit})
