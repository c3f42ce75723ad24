"""History of changing entity attributes, by Merkle comparison of successive snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.session import durable


ROWS_A_LEAF, MOST_LEVELS = 64, 6


def entity_history(listing: DataFrame, snapshots: DataFrame, scope: str, snapshot: str, order: str, entity: list[str], attributes: list[str], fanout: int = 16, levels: int | None = None) -> DataFrame:
    """Every version of every entity with the period in which it held.

    listing: (snapshot, entity..., attributes...), the full content of each snapshot; repeated rows count once.
    snapshots: (scope, snapshot, order); of several rows of one snapshot the lowest `order` counts. Snapshots of
    one scope follow each other by `order`, equal ones by snapshot id. Rows of `listing` whose snapshot is not in
    `snapshots` don't count; snapshots with a NULL scope, id or order don't either. NULL entity or attribute values
    are values like any other. A snapshot without rows ends all versions. Two attribute values of one entity in one
    snapshot have a period each. Other columns are not looked at. Empty tables give no rows.

    Returns (scope, entity..., attributes..., first_<order>, last_<order>): one row per longest stretch of
    successive snapshots that all hold the entity with these attributes.

    Method: the rows of a snapshot fall into fanout**levels leaf buckets by a hash of the entity. A leaf's digest is
    the exclusive or of its rows' hashes (two, and their number), a node's digest that of its children. A node
    differs from its predecessor if the exclusive or of both digests isn't zero. From the roots down, only children
    of differing nodes are looked at; rows are compared in differing leaves alone. What appears opens a version,
    what disappears closes one; a snapshot of no rows behind the last closes all that is open.

    Scale: the work table is written once. Unless `levels` is given there are as many as leave about ROWS_A_LEAF rows of
    the largest snapshot in a leaf (MOST_LEVELS at most), so a scope with a third of all rows is spread over fanout**levels
    leaves. Digest tables have a row per snapshot and node, and shrink by `fanout` a level. Of the rows only those of
    differing leaves are shuffled for the comparison, so that shuffle falls with the share of leaves that change.
    """
    known = (
        snapshots.select(F.col(scope).alias("scope"), F.col(snapshot).alias("snapshot"), F.col(order).alias("order"))
        .dropna()
        .groupBy("scope", "snapshot")
        .agg(F.min("order").alias("order"))
        .withColumn("r", F.row_number().over(Window.partitionBy("scope").orderBy("order", "snapshot")))
    )
    names = [f"e{i}" for i in range(len(entity))] + [f"a{i}" for i in range(len(attributes))]
    of_entity = names[: len(entity)]
    listed = listing.select(F.col(snapshot).alias("snapshot"), *(F.col(c).alias(n) for c, n in zip([*entity, *attributes], names)))
    listed = listed.join(known.select("scope", "snapshot", "r"), "snapshot").select("scope", "r", *names)
    if levels is None:
        largest = listed.groupBy("scope", "r").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        levels = 1
        while levels < MOST_LEVELS and fanout**levels * ROWS_A_LEAF < largest:
            levels += 1
    leaves = fanout**levels
    rows = (
        listed.withColumn("leaf", F.pmod(_hash(of_entity, 1), F.lit(leaves)).cast("int"))
        .select("scope", "r", "leaf", *names)
        .repartition("scope", "leaf")
        .distinct()
    )
    rows = durable(rows)
    node = rows.groupBy("scope", "r", "leaf").agg(
        F.bit_xor(_hash(names, 2)).alias("x"), F.bit_xor(_hash(names, 3)).alias("y"), F.count(F.lit(1)).alias("n")
    )
    tree = [node.select("scope", "r", F.col("leaf").alias("node"), F.xxhash64("leaf", "x", "y", "n").alias("digest"))]
    tree[0] = durable(tree[0])
    for _ in range(levels):
        below = tree[-1].withColumn("node", F.floor(F.col("node") / fanout).cast("int"))
        tree.append(below.groupBy("scope", "r", "node").agg(F.bit_xor("digest").alias("digest")))
    differing: DataFrame | None = None
    for level in reversed(tree):
        both = _with_predecessor(level)
        if differing is not None:
            parents = differing.withColumnRenamed("node", "parent")
            both = both.withColumn("parent", F.floor(F.col("node") / fanout).cast("int")).join(parents, ["scope", "r", "parent"], "left_semi")
        differing = both.groupBy("scope", "r", "node").agg(F.bit_xor("digest").alias("d")).filter("d != 0").select("scope", "r", "node")
    # a differing leaf at r is compared with the same leaf at r - 1: rows of all other leaves go no further
    leaf_keys = differing.select("scope", F.col("node").alias("leaf"), F.explode(F.array(F.struct(F.col("r").alias("r"), F.lit(1).alias("sign"), F.col("r").alias("at")), F.struct((F.col("r") - 1).alias("r"), F.lit(-1).alias("sign"), F.col("r").alias("at")))).alias("k")).select("scope", "leaf", "k.*")
    in_changed = rows.join(leaf_keys, ["scope", "leaf", "r"]).withColumn("r", F.col("at")).drop("at")
    events = in_changed.groupBy("scope", "leaf", "r", *names).agg(F.sum("sign").alias("sign")).filter("sign != 0")
    version = Window.partitionBy("scope", "leaf", *names).orderBy("r")
    periods = events.withColumn("until", F.lead("r").over(version)).filter("sign > 0").withColumn("last", F.col("until") - 1)
    ends = known.select("scope", F.col("r"), F.col("order"))
    first = ends.withColumnsRenamed({"r": "r", "order": f"first_{order}"})
    last = ends.withColumnsRenamed({"r": "last", "order": f"last_{order}"})
    dated = periods.join(first, ["scope", "r"]).join(last, ["scope", "last"])
    return dated.select(F.col("scope").alias(scope), *(F.col(n).alias(c) for c, n in zip([*entity, *attributes], names)), f"first_{order}", f"last_{order}")


def _with_predecessor(level: DataFrame) -> DataFrame:
    """The rows of each snapshot (sign 1) and those of the snapshot before it (sign -1), under the snapshot's place r."""
    signs = F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign")
    return level.select("*", signs).withColumn("r", F.when(F.col("sign") == 1, F.col("r")).otherwise(F.col("r") + 1))


def _hash(columns: list[str], seed: int) -> Column:
    """A 64-bit hash in which NULL differs from every value and columns don't run into each other."""
    parts = reduce(lambda have, c: [*have, F.col(c).isNull(), F.col(c)], columns, [F.lit(seed)])
    return F.xxhash64(*parts)
