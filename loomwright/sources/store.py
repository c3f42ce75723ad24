"""The versioned store: content-addressed snippets, snapshots and their listings, as Parquet tables.

content and occurrence only grow; membership is partitioned by snapshot; a snapshot's row is written last and is what
publishes it, so a listing without it is not seen. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.operators.indexing import missing, with_keys
from loomwright.operators.versions import known_snapshots, snapshot_of
from loomwright.session import durable

SCHEMAS = {
    "content": "content_key string, code string",
    "occurrence": "occ_key string, content_key string, path string, symbol string, start_line int, end_line int, callees array<string>",
    "membership": "occ_key string, snapshot_id string",
    "snapshot": "snapshot_id string, repo string, commit_sha string, parent_sha string, seq int, mode string, stats map<string, double>, loaded_at timestamp",
    "embedding": "content_key string, vec array<double>, recipe_id string",
    "held": "repo string, commit_sha string, parent_sha string, status string, old_path string, new_path string, source string",
}
PARTITIONS = {"membership": "snapshot_id", "embedding": "recipe_id"}


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def table(self, name: str) -> DataFrame:
        """A table of the store; empty before the first write."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._path(name))
        exists = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        schema = T.StructType.fromDDL(SCHEMAS[name])
        return self.spark.read.schema(schema).parquet(self._path(name)) if exists else self.spark.createDataFrame([], schema)

    def _append(self, df: DataFrame, name: str) -> None:
        part = PARTITIONS.get(name)
        writer = df.write.mode("append")
        (writer.partitionBy(part) if part else writer).parquet(self._path(name))

    def add_snippets(self, snippets: DataFrame) -> DataFrame:
        """Insert what isn't there yet by key; returns the snippets with their keys. Doing it again changes nothing."""
        keyed = durable(with_keys(snippets))
        self._append(missing(keyed.select("content_key", "code"), self.table("content"), "content_key"), "content")
        columns = ["occ_key", "content_key", "path", "symbol", "start_line", "end_line", "callees"]
        self._append(missing(keyed.select(*columns), self.table("occurrence"), "occ_key"), "occurrence")
        return keyed

    def write_listings(self, listings: DataFrame, snapshots: list[str]) -> None:
        """Write or replace the listings (occ_key, snapshot_id) of `snapshots`; all others stay."""
        whole = durable(listings.select("occ_key", "snapshot_id").distinct())
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(self._path("membership"))
        # an empty listing writes no partition: what an earlier publication left has to go
        filled = {r["snapshot_id"] for r in whole.select("snapshot_id").distinct().collect()}
        jvm = self.spark.sparkContext._jvm
        for snapshot in set(snapshots) - filled:
            name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("snapshot_id", snapshot)
            path = jvm.org.apache.hadoop.fs.Path(f"{self._path('membership')}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def announce(self, rows: list[tuple[str, str, str, str | None, str, dict[str, float]]]) -> list[int]:
        """Publish snapshots (snapshot_id, repo, commit, parent, mode, stats) whose listings are written; returns their seqs.

        A seq is the next of its repository and mode, in the order given; publishing again doesn't change it.
        """
        wanted = self.spark.createDataFrame([(r[0], r[1], r[4]) for r in rows], "snapshot_id string, repo string, mode string")
        earlier = self.table("snapshot").join(wanted.select("repo", "mode").distinct(), ["repo", "mode"])
        last = {(r["repo"], r["mode"]): r["last"] for r in earlier.groupBy("repo", "mode").agg(F.max("seq").alias("last")).collect()}
        own = {r["snapshot_id"]: r["seq"] for r in earlier.join(wanted.select("snapshot_id"), "snapshot_id", "left_semi").groupBy("snapshot_id").agg(F.min("seq").alias("seq")).collect()}
        made = []
        for snapshot, repo, commit, parent, mode, stats in rows:
            if snapshot not in own:
                own[snapshot] = last[repo, mode] = last.get((repo, mode), -1) + 1
            made.append((snapshot, repo, commit, parent, own[snapshot], mode, {k: float(v) for k, v in stats.items()}))
        schema = SCHEMAS["snapshot"].rpartition(",")[0]
        self._append(self.spark.createDataFrame(made, schema).withColumn("loaded_at", F.current_timestamp()), "snapshot")
        return [row[4] for row in made]

    def publish(self, snapshot_id: str, repo: str, commit: str, parent: str | None, mode: str, occ_keys: DataFrame, stats: dict[str, float]) -> int:
        """Write or replace a snapshot's listing and then its row; returns its seq."""
        self.write_listings(occ_keys.select("occ_key", F.lit(snapshot_id).alias("snapshot_id")), [snapshot_id])
        return self.announce([(snapshot_id, repo, commit, parent, mode, stats)])[0]

    def listings(self, of: DataFrame) -> DataFrame:
        """(key, occ_key, path) of several snapshots: of is (key, snapshot_id)."""
        return self.table("membership").join(of.select("key", "snapshot_id"), "snapshot_id").join(self.table("occurrence").select("occ_key", "path"), "occ_key").select("key", "occ_key", "path")

    def snapshots(self, repo: str, mode: str = "incremental") -> DataFrame:
        """Published snapshots in order of seq, each once, with the stats of its latest publication."""
        own = self.table("snapshot").filter((F.col("repo") == repo) & (F.col("mode") == mode))
        latest = own.groupBy("snapshot_id").agg(F.max_by("stats", "loaded_at").alias("stats"))
        return known_snapshots(own.drop("stats")).join(latest, "snapshot_id").orderBy("seq")

    def snapshot_id_for(self, repo: str, commit: str, mode: str = "incremental") -> str | None:
        row = snapshot_of(self.table("snapshot"), repo, commit, mode).first()
        return row["snapshot_id"] if row else None

    def listing(self, snapshot_id: str) -> DataFrame:
        """(occ_key, path) of a snapshot; only its partition is read."""
        own = self.table("membership").filter(F.col("snapshot_id") == snapshot_id)
        return own.join(self.table("occurrence"), "occ_key").select("occ_key", "path")

    def hold(self, changes: DataFrame) -> None:
        """Replace the changes that wait for their parent commits."""
        durable(changes).write.mode("overwrite").parquet(self._path("held"))

    def embeddings(self, recipe: str) -> DataFrame:
        return self.table("embedding").filter(F.col("recipe_id") == recipe)

    def embed(self, contents: DataFrame, recipe: str, encode: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
        """Vectors of contents (content_key, code), and how many were new: only contents without a stored vector are encoded.

        encode takes (content_key, code) and returns (content_key, vec). The key travels with its vector in one row.
        Empty contents give an empty table.
        """
        wanted = durable(contents.select("content_key", "code").dropDuplicates(["content_key"]))
        fresh = durable(missing(wanted, self.embeddings(recipe), "content_key"))
        new = fresh.count()
        if new:
            self._append(encode(fresh).select("content_key", "vec", F.lit(recipe).alias("recipe_id")), "embedding")
        return self.embeddings(recipe).join(wanted.select("content_key"), "content_key", "left_semi").select("content_key", "vec"), new
