"""One ranking from several differently-scaled scores, by normal scores of percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators.order import running, same
from loomwright.session import durable

HOT_ROWS = 200_000

# Coefficients of Acklam's published rational approximation of the inverse normal distribution.
CENTRE_TOP = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
CENTRE_BOTTOM = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
TAIL_TOP = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
TAIL_BOTTOM = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
TAIL = 0.02425


def _polynomial(coefficients: list[float], x: Column) -> Column:
    value = F.lit(coefficients[0])
    for c in coefficients[1:]:
        value = value * x + F.lit(c)
    return value


def inverse_normal(p: Column) -> Column:
    """The standard normal quantile of 0 < p < 1, relative error about 1e-9."""
    q = p - 0.5
    centre = q * _polynomial(CENTRE_TOP, q * q) / _polynomial(CENTRE_BOTTOM, q * q)
    t = F.sqrt(F.lit(-2.0) * F.log(F.least(p, 1 - p)))
    tail = _polynomial(TAIL_TOP, t) / _polynomial(TAIL_BOTTOM, t)
    return F.when(F.abs(q) <= 0.5 - TAIL, centre).when(q < 0, tail).otherwise(-tail)


def latest_scores(rows: DataFrame, ks: list[str]) -> DataFrame:
    """(g, ks..., source, item, score): one row per item and list, of the highest version, then the highest score.

    Two hash aggregations of fixed-width buffers: the best score of each version, then that of the highest version. A
    NULL version counts if an item has no other.
    """
    valid = rows.filter(F.col("score").isNotNull() & ~F.isnan("score")).withColumn("score", F.col("score") + F.lit(0.0))
    one = ["g", *ks, "source", "item"]
    best = valid.groupBy(*one, "version").agg(F.max("score").alias("score"))
    latest = best.groupBy(*one).agg(F.max_by("score", "version").alias("latest"), F.max(F.when(F.col("version").isNull(), F.col("score"))).alias("undated"))
    return latest.select(*one, F.coalesce("latest", "undated").alias("score"))


def _named(df: DataFrame, keys: list[str], source: str, item: str, score: str, version: str | None) -> DataFrame:
    """(g, k0..., source, item, score, version): g is a hash of the group's keys, NULLs included, to sort and join by."""
    ks = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    g = F.xxhash64(*(part for k in keys for part in (F.col(k).isNull(), F.col(k)))).alias("g")
    return df.select(g, *ks, F.col(source).alias("source"), F.col(item).alias("item"), F.col(score).cast("double").alias("score"), (F.col(version) if version else F.lit(0)).alias("version"))


def normal_scores(rows: DataFrame, ks: list[str], hot: DataFrame | None) -> DataFrame:
    """(g, ks..., source, item, z, floor): the normal score of each item in each list of a source, and the list's least.

    rows: _named. A score's percentile is (rank - 1/2) / n, equal scores sharing their mean rank; so a list of equal
    scores has z = 0 throughout. Rows are shuffled once, by group; lists are sorted there. The lists of `hot` groups
    are ranked in ranges over all tasks (order.running), equal scores counted first.
    """
    cold = rows if hot is None else rows.alias("r").join(hot.alias("h"), same(["g", *ks], "r", "h"), "left_anti")
    lists = Window.partitionBy("g", *ks, "source")
    below, upto = F.rank().over(lists.orderBy("score")) - 1, F.cume_dist().over(lists.orderBy("score"))
    ranked = latest_scores(cold.repartition("g"), ks).withColumns({"below": below, "upto": upto})
    ranked = ranked.withColumns({"n": F.count(F.lit(1)).over(lists), "least": F.min("upto").over(lists)})
    z = ranked.select("g", *ks, "source", "item", inverse_normal((F.col("below") / F.col("n") + F.col("upto")) / 2).alias("z"), inverse_normal(F.col("least") / 2).alias("floor"))
    if hot is None:
        return z
    own = durable(latest_scores(rows.alias("r").join(hot.alias("h"), same(["g", *ks], "r", "h"), "left_semi"), ks))
    of_list = ["g", *ks, "source"]
    steps = running(own.groupBy(*of_list, "score").agg(F.count(F.lit(1)).alias("cnt")), of_list, [F.col("score")], "cnt")
    steps = durable(steps.select(*of_list, "score", inverse_normal((F.col("upto") - F.col("cnt") / 2) / F.col("whole")).alias("z")))
    floors = steps.groupBy(*of_list).agg(F.min("z").alias("floor"))
    back = own.alias("r").join(steps.alias("s"), same([*of_list, "score"], "r", "s")).select("r.*", "z").alias("r").join(floors.alias("f"), same(of_list, "r", "f"))
    return z.unionByName(back.select(*(f"r.{c}" for c in of_list), "r.item", "r.z", "f.floor"))


def judged_weights(z: DataFrame, group: str, judged: DataFrame) -> DataFrame:
    """(source, weight): the mean normal score that each source gives to judged items, 0 if negative.

    z: normal_scores. judged: (group, item), of which `group` is a key column of z. An item that a list lacks counts
    like the list's last. Only lists of groups with judged items count; a source without such lists has no row.
    """
    ks = [c for c in z.columns if c not in ("source", "item", "z", "floor")]
    gold = judged.toDF(group, "item").dropna().distinct()
    due = z.groupBy(*ks, "source").agg(F.first("floor").alias("floor")).join(gold, group)
    hit = z.drop("floor").join(gold, [group, "item"], "left_semi")
    scored = due.alias("d").join(hit.alias("h"), same([*ks, "source", "item"], "d", "h"), "left")
    return scored.groupBy(F.col("d.source").alias("source")).agg(F.greatest(F.lit(0.0), F.round(F.avg(F.coalesce("z", "floor")), 6)).alias("weight"))


def fuse_normal_scores(df: DataFrame, keys: list[str], source: str, item: str, score: str, version: str | None = None, weights: DataFrame | None = None, judged: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(keys..., item, fused, place): all items of each group of keys in one order.

    Each source's list becomes percentiles with averaged ties, then normal scores; fused is their mean, weighted by
    `weights` (source, weight; 1 if not given there or NULL, below 0 as 0), or by judged_weights of `judged` (the last
    of `keys`, item). An item that a source doesn't list counts there like the list's last. place orders by fused
    (rounded to 9 digits) from high to low, then by item in byte order, a NULL item last. A list whose scores are all
    equal moves nothing; if no list has weight, fused is 0.

    Rows with a NULL or NaN score don't count; of several rows of an item in a list the one of the highest `version`
    does, then of the highest score. NULL keys and sources are values of their own. Infinite scores are ordinary
    ends of the order. Other columns are not looked at. An empty table gives no rows.

    Scale: rows are shuffled by group once for normal scores, which are stored, and once for fusion. Groups of more
    than hot_rows rows go another way with the same result: every step of it is keyed by (list, score) or (group, item),
    pre-aggregated, or cut into ranges (order.running), so a group with a third of all rows is no task of its own.
    """
    ks = [f"k{i}" for i in range(len(keys))]
    group = ["g", *ks]
    rows = _named(df, keys, source, item, score, version)
    hot = durable(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows).select(*group))
    hot = None if hot.isEmpty() else hot
    z = durable(normal_scores(rows, ks, hot))
    if judged is not None:
        weights = judged_weights(z, ks[-1], judged)
    if weights is None:
        weighted = z.withColumn("w", F.lit(1.0))
    else:
        w = durable(weights.groupBy("source").agg(F.max("weight").cast("double").alias("w")))
        weighted = z.alias("z").join(w.alias("w"), same(["source"], "z", "w"), "left").select("z.*", F.greatest(F.lit(0.0), F.coalesce("w", F.lit(1.0))).alias("w"))
    lists = weighted.groupBy(*group, "source").agg(F.first("w").alias("w"), F.first("floor").alias("floor"))
    totals = lists.groupBy(*group).agg(F.sum("w").alias("total"), F.sum(F.col("w") * F.col("floor")).alias("floors"))

    def fused(part: DataFrame) -> DataFrame:
        items = part.groupBy(*group, "item").agg(F.sum(F.col("w") * (F.col("z") - F.col("floor"))).alias("gain"))
        # equal hashes bring the sides together; the keys decide
        both = items.alias("i").join(totals.alias("t"), (F.col("i.g") == F.col("t.g")) & same(ks, "i", "t"))
        mean = F.round(F.when(F.col("total") > 0, (F.col("gain") + F.col("floors")) / F.col("total")).otherwise(0.0), 9)
        return both.select(*(f"i.{c}" for c in group), "item", (mean + F.lit(0.0)).alias("fused"))

    order = [F.desc("fused"), F.asc_nulls_last("item")]
    cold = weighted if hot is None else weighted.alias("r").join(hot.alias("h"), same(group, "r", "h"), "left_anti")
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")
    placed = fused(cold.repartition("g")).withColumn("place", place)
    if hot is not None:
        large = fused(weighted.alias("r").join(hot.alias("h"), same(group, "r", "h"), "left_semi"))
        large = running(large.withColumn("one", F.lit(1).cast("long")), group, order, "one")
        placed = placed.unionByName(large.select(*group, "item", "fused", F.col("upto").alias("place")))
    return placed.select(*(F.col(a).alias(k) for a, k in zip(ks, keys)), F.col("item").alias(item), "fused", "place")
