"""Building listings: keys of snippets, and a commit's listing from its parent's and a change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.hashing import content_key, occ_key


def with_keys(snippets: DataFrame) -> DataFrame:
    """Snippets (path, symbol, start_line, end_line, code, ...) with content_key and occ_key."""
    keyed = snippets.withColumn("content_key", content_key(F.col("code")))
    return keyed.withColumn("occ_key", occ_key(F.col("path"), F.col("symbol"), F.col("start_line"), F.col("end_line"), F.col("content_key")))


def number_symbols(snippets: DataFrame, keys: list[str]) -> DataFrame:
    """A symbol that a file (keys) has several times gets #2, #3 and so on, by start line and end line."""
    nth = F.row_number().over(Window.partitionBy(*keys, "symbol").orderBy("start_line", "end_line"))
    return snippets.withColumn("symbol", F.when(nth > 1, F.concat("symbol", F.lit("#"), nth.cast("string"))).otherwise(F.col("symbol")))


def change_actions(changes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., path, action) from (keys..., status, old_path, new_path): what to drop from the parent's listing, what to extract.

    R drops the old path and extracts the new one, C extracts the new one, D drops; all else (A, M, T) does both to the
    path, which is new_path, or old_path if that is NULL.
    """
    path = F.coalesce("new_path", "old_path")
    kind = F.substring("status", 1, 1)

    def act(where, action: str):
        return F.struct(where.alias("path"), F.lit(action).alias("action"))

    old = F.coalesce("old_path", "new_path")
    actions = F.when(kind == "R", F.array(act(old, "drop"), act(path, "extract"))).when(kind == "C", F.array(act(path, "extract"))).when(kind == "D", F.array(act(old, "drop"))).otherwise(F.array(act(path, "drop"), act(path, "extract")))
    return changes.select(*keys, F.explode(actions).alias("a")).select(*keys, "a.*").distinct()


def changes_between(parent: DataFrame, child: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., status, old_path, new_path) from two file manifests (keys..., path, digest): A, M or D; unchanged files left out."""
    a = parent.select(*keys, "path", F.col("digest").alias("old"))
    b = child.select(*keys, "path", F.col("digest").alias("new"))
    status = F.when(F.col("old").isNull(), "A").when(F.col("new").isNull(), "D").otherwise("M")
    both = a.join(b, [*keys, "path"], "full").filter(~F.col("old").eqNullSafe(F.col("new")))
    return both.select(*keys, status.alias("status"), F.col("path").alias("old_path"), F.col("path").alias("new_path"))


def incremental_listing(parent: DataFrame, dropped: DataFrame, extracted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., occ_key): the parent's occurrences (keys..., path, occ_key) outside of dropped paths, and the extracted ones."""
    kept = parent.join(dropped.select(*keys, "path").distinct(), [*keys, "path"], "left_anti")
    return kept.select(*keys, "occ_key").unionByName(extracted.select(*keys, "occ_key")).distinct()


def missing(keys: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of keys, one a key, that stored doesn't have: what an insert-or-ignore adds, or an encoder must compute."""
    return keys.dropDuplicates([key]).join(stored.select(key), key, "left_anti")
