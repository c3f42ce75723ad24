"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.session import durable


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): the smallest node that it is connected with.

    Edges with a NULL end don't count; an edge of a node with itself makes it a component. Repeated edges count
    once. An empty edge list gives no rows.

    Alternates the large-star and small-star steps of Kiveris et al., "Connected Components in MapReduce and
    Beyond" (2014): every step hangs neighbours onto the smallest node known, until nothing changes; the number of
    rounds grows with the logarithm of the size. Each round is written to the checkpoint folder. A node's smallest
    neighbour is found by hash aggregation, so a node with very many neighbours is pre-aggregated map-side.
    """
    clean = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).dropna()
    nodes = clean.select(F.col("u").alias("node")).unionByName(clean.select(F.col("v").alias("node"))).distinct()
    links = durable(clean.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        after = durable(_small_star(_large_star(links)))
        same = after.exceptAll(links).isEmpty() and links.exceptAll(after).isEmpty()
        links = after
        if same:
            break
    roots = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node are linked to the smallest of the node and its neighbours."""
    ways = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return ways.filter("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    smallest = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = links.join(smallest, "u")
    hung = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
