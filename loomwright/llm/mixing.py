"""Mixing sources to target weights: pivotal dependent rounding in a reduction tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.tokens import numbered
from loomwright.session import durable

PER_SHARD = 50_000
FAN_IN = 64


def plain(source: Column) -> Column:
    """A source's plain spelling: trimmed, lower case; NULL for an empty one."""
    return F.nullif(F.lower(F.trim(source.cast("string"))), F.lit(""))


def pivot(sizes: np.ndarray, parts: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round parts (each between 0 and 1) to 0 or 1, all but one at most; the sum of sizes * parts stays as it is.

    Two fractional items at a time: mass (size times part) moves from one to the other until one of them is 0 or 1.
    The direction is drawn so that each part keeps its expectation. Returns the parts and the place of the one that
    is still fractional, or -1.
    """
    parts = parts.copy()
    draws = random.random(len(parts))
    open_at, p, s = -1, 0.0, 0.0
    for i in np.flatnonzero((parts > 0) & (parts < 1)).tolist():
        q, t = float(parts[i]), float(sizes[i])
        if open_at < 0:
            open_at, p, s = i, q, t
            continue
        gain = min((1 - p) * s, q * t)  # mass that can move to the open item
        loss = min(p * s, (1 - q) * t)  # or from it
        if draws[i] * (gain + loss) < loss:
            filled, emptied = gain == (1 - p) * s, gain == q * t
            p, q = (1.0 if filled else p + gain / s), (0.0 if emptied else q - gain / t)
        else:
            emptied, filled = loss == p * s, loss == (1 - q) * t
            p, q = (0.0 if emptied else p - loss / s), (1.0 if filled else q + loss / t)
        parts[open_at], parts[i] = p, q
        if 0 < p < 1:
            continue
        open_at, p, s = (i, q, t) if 0 < q < 1 else (-1, 0.0, 0.0)
    return parts, open_at


def _round_shards(level: int, seed: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["tokens", "draw", "item"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        name = f"{seed}/{level}/{shard['source'].iat[0]}/{shard['shard'].iat[0]}".encode()
        random = np.random.Generator(np.random.PCG64(list(name)))
        parts, open_at = pivot(shard["tokens"].to_numpy(dtype=float), shard["part"].to_numpy(), random)
        fractional = np.zeros(len(shard), dtype=bool)
        if open_at >= 0:
            fractional[open_at] = True
        return pd.DataFrame({"item": shard["item"], "source": shard["source"], "tokens": shard["tokens"], "whole": shard["whole"], "part": parts, "draw": shard["draw"], "shard": shard["shard"], "open": fractional})

    return run


def mix_sources(items: DataFrame, item: str, source: str, size: str, weights: DataFrame, total: float | None = None, seed: int = 7, per_shard: int = PER_SHARD) -> tuple[DataFrame, DataFrame]:
    """Draw items so that each source makes up its target share of the total size.

    items: (item, source, size). weights: (source, target_share, max_repeats). Source names are compared by plain
    spelling. Shares are taken relative to their sum; of several rows of one source the shares add up and the largest
    max_repeats counts; a NULL max_repeats is 1; rows with a NULL source or share, or a share of 0 or less, are left out.
    Items of no or an unlisted source, and those of size NULL or 0 or less, are never drawn. Repeated rows, and rows
    with a NULL item, are items of their own, each drawn by itself. Other columns are not looked at. Empty tables give no rows.

    total is the size of the mixture. By default it is the largest at which every source that has items reaches its share
    without exceeding its cap. A source that is too small for a given total is repeated as often as its cap allows; its
    share falls short, which the report shows.

    Returns (mix, report). mix: (item, source, tokens, copies), copies from 1 to the source's max_repeats, items that
    aren't drawn left out. report: (source, target_share, max_repeats, available, wanted, drawn, share), one row per
    source of weights.

    Method: every item of a source is due total * share / available copies. The whole part is given; the rest is the
    probability of one more copy, rounded by pivotal sampling over sizes: so each item keeps its expectation, and the
    source's size is kept exactly but for one last item. Shards of about per_shard items are rounded each by itself
    and leave one fractional item at most, as a rule a small one, since items go from large to small; these are rounded FAN_IN shards at a time, in a tree, until one is left,
    which is drawn. Draws depend on seed, ids, sizes and the number of an item among equal rows, not on how tasks are cut, so a lost
    task repeats them.

    Scale: sizes are summed map-side; shards are bounded however large one source is, and however many rows have one id. The tables of sources are as
    small as `weights`.
    """
    due = (
        weights.select(plain(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.coalesce(F.col("max_repeats").cast("long"), F.lit(1)).alias("cap"))
        .filter("source IS NOT NULL AND share > 0 AND NOT isnan(share)")
        .groupBy("source")
        .agg(F.sum("share").alias("share"), F.greatest(F.lit(0), F.max("cap")).alias("cap"))
    )
    every = Window.partitionBy()
    due = due.withColumn("share", F.col("share") / F.sum("share").over(every))
    sized = items.select(F.col(item).alias("item"), plain(F.col(source)).alias("source"), F.col(size).cast("long").alias("tokens")).filter("tokens > 0 AND source IS NOT NULL")
    sized = durable(numbered(sized, ["item", "source", "tokens"], seed))
    sums = sized.groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("items"))
    plan = due.join(sums, "source", "left").fillna(0, ["available", "items"])
    reach = F.min(F.when((F.col("available") > 0) & (F.col("cap") > 0), F.col("cap") * F.col("available") / F.col("share"))).over(every)
    plan = plan.withColumn("total", F.lit(float(total)) if total is not None else F.coalesce(reach, F.lit(0.0)))
    wanted = F.least(F.col("total") * F.col("share"), F.col("cap") * F.col("available"))
    # a hair less than the cap would be rounded to a fraction of one item
    rate = F.when(F.col("available") > 0, F.least(F.col("cap").cast("double"), F.round(F.col("total") * F.col("share") / F.col("available"), 12))).otherwise(0.0)
    plan = durable(plan.select("source", "share", "cap", "available", "items", wanted.alias("wanted"), rate.alias("rate"), F.greatest(F.lit(1), F.ceil(F.col("items") / per_shard)).alias("shards")))

    each = sized.join(plan.select("source", "rate", "shards"), "source")
    each = each.select("item", "source", "tokens", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("part"), F.col("row").alias("draw"), F.pmod(F.xxhash64(F.lit(seed + 1), "row"), "shards").alias("shard"))
    item_type = sized.schema["item"].dataType.simpleString()
    schema = f"item {item_type}, source string, tokens long, whole long, part double, draw long, shard long, open boolean"
    rounded = durable(each.groupBy("source", "shard").applyInPandas(_round_shards(0, seed), schema))
    settled = [rounded.filter("NOT open")]
    left = rounded.filter("open").drop("open")
    most = plan.agg(F.max("shards").alias("m")).first()["m"] or 1
    level = 0
    while most > 1:
        level, most = level + 1, -(-most // FAN_IN)
        merged = left.withColumn("shard", F.floor(F.col("shard") / FAN_IN))
        done = durable(merged.groupBy("source", "shard").applyInPandas(_round_shards(level, seed), schema))
        settled.append(done.filter("NOT open"))
        left = done.filter("open").drop("open")
    unit = F.pmod(F.xxhash64(F.lit(seed + 2), "draw"), F.lit(1 << 30)) / float(1 << 30)
    last = left.withColumn("part", F.when(unit < F.col("part"), 1.0).otherwise(0.0)).withColumn("open", F.lit(False))
    whole = last
    for part in settled:
        whole = whole.unionByName(part)
    drawn = whole.select("item", "source", "tokens", (F.col("whole") + F.round("part").cast("long")).alias("copies")).filter("copies > 0")
    reached = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn"))
    report = plan.join(reached, "source", "left").fillna(0, ["drawn"])
    share = F.when(F.sum("drawn").over(every) > 0, F.col("drawn") / F.sum("drawn").over(every)).otherwise(0.0)
    report = report.select("source", F.col("share").alias("target_share"), F.col("cap").alias("max_repeats"), "available", F.round("wanted").cast("long").alias("wanted"), "drawn", F.round(share, 8).alias("share"))
    return drawn.withColumnRenamed("item", item), report
