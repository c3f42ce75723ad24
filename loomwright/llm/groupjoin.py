"""Near-duplicate records, by a prefix join over groups of records with equal prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm import wordblocks as wb
from loomwright.operators.components import connected_components
from loomwright.session import durable


def _run_batches(letters: bytes, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for begin, end in wb.slices(texts):
                values, at = wb.shingle_sets(*wb.word_hashes(texts[begin:end], letters), k)
                sizes = np.diff(at)
                folded = [np.zeros(len(sizes), dtype=np.int64) for _ in range(2)]
                some = np.flatnonzero(sizes)
                if len(some):
                    spread = wb.mix(values.view(np.uint64) + np.uint64(1)).view(np.int64)
                    folded[0][some] = np.bitwise_xor.reduceat(values, at[some])
                    folded[1][some] = np.bitwise_xor.reduceat(spread, at[some])
                rows = batch.slice(begin, end - begin)
                runs = pa.ListArray.from_arrays(pa.array(at.astype("int32")), pa.array(values))
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(sizes), pa.array(folded[0]), pa.array(folded[1]), runs], names=["id", "n", "x", "y", "runs"])

    return run


def near_duplicate_links(records: DataFrame, id_column: str, text_column: str, threshold: float = 0.8, k: int = 5, letters: bytes = wb.LETTERS) -> tuple[DataFrame, DataFrame]:
    """Pairs of records whose sets of runs of k words have a Jaccard similarity of `threshold` or more; all of them.

    id is unique. Records with a NULL id don't count. A NULL, empty or short text without a run of k words is in no
    pair. Words are longest stretches of `letters` in the lower-cased text. Other columns are not looked at. Empty
    tables give no rows.

    Returns (pairs, members). pairs: (a, b, similarity), a < b, of representatives of records with different sets
    of runs. members: (id, representative), for records with a run: those with equal sets have one representative,
    the smallest id, and a similarity of 1. No group of copies is expanded into pairs here.

    Method (grouped prefix join): all runs are counted over all records; a run that one record alone has can't be
    shared and is only counted. A record's runs are ordered from rare to common. Two sets that are similar enough
    share a run among their first n - ceil(threshold n) + 1 runs, their prefixes. Records with equal prefix and size
    form one group, and groups are joined on the runs of their prefixes, under a length and a position filter.
    Only group pairs that pass are expanded into pairs of distinct sets, which are verified by their whole sets.

    Scale: counting is pre-aggregated map-side. What is joined are prefixes, of which most runs are rare; a run that
    a third of all records share is in a prefix only if a record has little else. Whole sets travel once per verified
    pair. Every join is an equi-join, left to adaptive skew handling; nothing is collected or broadcast by hint.
    """
    source = records.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    sets = source.mapInArrow(_run_batches(letters, k), "id string, n long, x long, y long, runs array<long>").filter("n > 0")
    sets = durable(sets)
    classes = durable(sets.groupBy("n", "x", "y").agg(F.min("id").alias("rep")))
    members = sets.select("id", "n", "x", "y").join(classes, ["n", "x", "y"]).select("id", F.col("rep").alias("representative"))
    distinct = sets.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "n", "runs")

    tokens = distinct.select("id", "n", F.explode("runs").alias("run"))
    shared = tokens.groupBy("run").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ordered = tokens.join(shared, "run").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "run"))).alias("runs"))
    own = F.col("n") - F.size("runs")  # runs of this record alone, the first in order
    length = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1 - own).cast("int")
    ranked = ordered.select("id", "n", own.alias("own"), F.transform("runs", lambda r: r["run"]).alias("runs"), length.alias("length")).filter("length > 0")
    ranked = durable(ranked.select("id", "n", "own", "runs", F.slice("runs", 1, F.col("length")).alias("prefix")))

    grouped = ranked.groupBy("n", "own", "prefix").agg(F.min("id").alias("grp"))
    grouped = durable(grouped)
    of_group = ranked.select("id", "n", "own", "prefix").join(grouped, ["n", "own", "prefix"]).select("id", "grp")
    post = grouped.select("grp", "n", "own", F.posexplode("prefix").alias("at", "run"))
    a, b = post.alias("a"), post.alias("b")
    na, nb = F.col("a.n"), F.col("b.n")
    least = F.ceil((na + nb) * (threshold / (1 + threshold)) - 1e-9)
    left = F.least(na - F.col("a.own") - F.col("a.at"), nb - F.col("b.own") - F.col("b.at"))
    meets = (F.col("a.run") == F.col("b.run")) & (na >= nb * threshold - 1e-9) & ((na < nb) | ((na == nb) & (F.col("a.grp") < F.col("b.grp")))) & (left >= least)
    group_pairs = a.join(b, meets).select(F.col("a.grp").alias("ga"), F.col("b.grp").alias("gb")).distinct()
    crowded = of_group.groupBy("grp").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select(F.col("grp").alias("ga"), F.col("grp").alias("gb"))
    expanded = group_pairs.unionByName(crowded).join(of_group.select(F.col("id").alias("x"), F.col("grp").alias("ga")), "ga").join(of_group.select(F.col("id").alias("y"), F.col("grp").alias("gb")), "gb")
    candidates = expanded.filter("ga != gb OR x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    both = candidates
    for s in ("a", "b"):
        both = both.join(ranked.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("runs").alias(f"runs_{s}")), s)
    common = F.size(F.array_intersect("runs_a", "runs_b"))
    similarity = common / (F.col("n_a") + F.col("n_b") - common)
    pairs = both.select("a", "b", similarity.alias("similarity")).filter(F.col("similarity") >= threshold)
    return pairs, members


def expand_links(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All (a, b, similarity) of records, a < b: links of representatives and the pairs among equal records."""
    crowded = members.groupBy("representative").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    own = crowded.select(F.col("representative").alias("a"), F.col("representative").alias("b"), F.lit(1.0).alias("similarity"))
    linked = pairs.withColumn("same", F.lit(False)).unionByName(own.withColumn("same", F.lit(True)))
    both = linked
    for s in ("a", "b"):
        both = both.join(members.select(F.col("representative").alias(s), F.col("id").alias(f"id_{s}")), s)
    both = both.filter("NOT same OR id_a < id_b")
    return both.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "similarity")


def near_duplicate_groups(records: DataFrame, id_column: str, text_column: str, threshold: float = 0.8, k: int = 5, letters: bytes = wb.LETTERS) -> DataFrame:
    """One row per record: (id, group, links).

    group is the smallest id of all records that are connected by links of near_duplicate_links, links the number
    of other records similar to this one. A record without any, a NULL text among them, is a group of its own. Rows
    with a NULL id are left out. Links are counted from the sizes of the groups of equal records, never by expanding
    them into pairs.
    """
    pairs, members = near_duplicate_links(records, id_column, text_column, threshold, k, letters)
    pairs, members = durable(pairs), durable(members)
    sizes = members.groupBy("representative").agg(F.count(F.lit(1)).alias("m"))
    ways = pairs.select(F.col("a").alias("representative"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("representative"), F.col("a").alias("other")))
    counted = ways.join(sizes.withColumnRenamed("representative", "other"), "other").groupBy("representative").agg(F.sum("m").alias("near"))
    component = connected_components(pairs.select("a", "b"))
    of_class = sizes.join(counted, "representative", "left").join(component.withColumnRenamed("node", "representative"), "representative", "left")
    links = (F.col("m") - 1 + F.coalesce("near", F.lit(0))).alias("links")
    known = members.join(of_class.select("representative", F.coalesce("component", "representative").alias("group"), links), "representative").select("id", "group", "links")
    every = records.select(F.col(id_column).cast("string").alias("id")).filter("id IS NOT NULL")
    return every.join(known, "id", "left").select(F.col("id").alias(id_column), F.coalesce("group", "id").alias("group"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
