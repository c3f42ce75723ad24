"""Incremental listings kept from a stream of file changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomwright.functions.hashing import recipe_id
from loomwright.functions.text import is_indexed_path
from loomwright.operators.extract import extract_snippets
from loomwright.operators.indexing import change_actions, incremental_listing
from loomwright.plans.indexer import RECIPE, hash_encoder
from loomwright.session import durable
from loomwright.sources.store import SCHEMAS, SnapshotStore

CHANGES = SCHEMAS["held"]


def index_stream(feed: DataFrame, store: SnapshotStore, checkpoint: str, include: tuple[str, ...] = (), encode=hash_encoder, recipe: dict = RECIPE) -> StreamingQuery:
    """Publish a snapshot for every commit of a stream of changes (columns CHANGES, all changes of a commit in one batch).

    Only indexed paths count (is_indexed_path), contents are embedded as by CommitIndexer. A commit whose parent is
    neither indexed nor in the batch is held back, with its changes, until a batch brings the parent; so no snapshot
    is published from a part of its files. Commits without a parent begin a history. Content addressing makes it safe to
    replay a batch: keys that are there aren't inserted again, and publishing a snapshot again keeps its seq. Commits of
    one generation, whose parents are all indexed, are processed together in one set of jobs; what the driver collects
    are a batch's commits, one line each. Start the query with availableNow semantics for a backlog.
    """

    def publish(batch: DataFrame, _: int) -> None:
        columns = batch.columns
        changes = durable(batch.unionByName(store.table("held").select(*columns)).distinct())
        pending = sorted((tuple(r) for r in changes.select("repo", "commit_sha", "parent_sha").distinct().collect()), key=str)
        parents = store.spark.createDataFrame([(r, p) for r, _, p in pending if p], "repo string, commit_sha string").distinct()
        indexed = store.table("snapshot").filter("mode = 'incremental'").join(parents, ["repo", "commit_sha"]).groupBy("repo", "commit_sha").agg(F.min("snapshot_id").alias("s"))
        known = {(r["repo"], r["commit_sha"]): r["s"] for r in indexed.collect()}
        while ready := [p for p in pending if not p[2] or (p[0], p[2]) in known]:
            known |= _publish_generation(store, changes, ready, known, include, encode, recipe_id(recipe))
            pending = [p for p in pending if p not in ready]
        waiting = store.spark.createDataFrame([(r, c) for r, c, _ in pending], "repo string, commit_sha string")
        store.hold(changes.join(waiting, ["repo", "commit_sha"], "left_semi").select(*columns))

    return feed.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _publish_generation(store: SnapshotStore, changes: DataFrame, commits: list[tuple], known: dict, include: tuple[str, ...], encode, recipe: str) -> dict:
    """Publish commits whose parents are in `known` ((repo, commit) -> snapshot id); returns them as such."""
    named = {(repo, commit): f"{repo}@{commit[:12]}:incremental" for repo, commit, _ in commits}
    rows = [(repo, commit, named[repo, commit], known.get((repo, parent))) for repo, commit, parent in commits]
    of = store.spark.createDataFrame(rows, "repo string, commit_sha string, key string, base string")
    own = durable(changes.join(of.select("repo", "commit_sha", "key"), ["repo", "commit_sha"]))
    kept = is_indexed_path(F.col("path"), include)
    dropped = change_actions(own, ("key",)).filter((F.col("action") == "drop") & kept).select("key", "path")
    before = store.listings(of.filter("base IS NOT NULL").select("key", F.col("base").alias("snapshot_id")))
    files = durable(own.filter(F.substring("status", 1, 1) != "D").select("key", F.coalesce("new_path", "old_path").alias("path"), "source").filter(kept))
    snippets = store.add_snippets(extract_snippets(files, ["key"]))
    listing = durable(incremental_listing(before, dropped, snippets, ["key"]))
    store.write_listings(listing.select("occ_key", F.col("key").alias("snapshot_id")), list(named.values()))
    store.embed(snippets.select("content_key", "code"), recipe, encode)
    parsed = {r["key"]: r["n"] for r in files.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
    listed = {r["key"]: r["n"] for r in listing.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
    ids = [(named[r, c], r, c, p, "incremental", {"files_parsed": parsed.get(named[r, c], 0), "snippets": listed.get(named[r, c], 0)}) for r, c, p in commits]
    store.announce(ids)
    return named


def changes_per_window(feed: DataFrame, time: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, repo, changes): file changes per repository and time window of a stream; later rows than `late` are dropped."""
    timed = feed.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), "repo").agg(F.count(F.lit(1)).alias("changes")).select(F.col("w.start").alias("start"), "repo", "changes")
