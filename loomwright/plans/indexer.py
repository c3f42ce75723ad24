"""Index a repository commit by commit: only files that a commit changed are extracted again."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions.hashing import recipe_id
from loomwright.functions.text import is_indexed_path
from loomwright.functions.vectors import hash_embedding
from loomwright.operators.extract import extract_snippets
from loomwright.operators.indexing import change_actions, incremental_listing
from loomwright.session import durable
from loomwright.sources import git
from loomwright.sources.store import SnapshotStore

RECIPE = {"model": "hash256"}


def hash_encoder(contents: DataFrame) -> DataFrame:
    """(content_key, vec): the encoder that needs no model."""
    return hash_embedding(contents, ["content_key"], "code")


class CommitIndexer:
    """include: path prefixes to index; none means the whole repository."""

    def __init__(self, store: SnapshotStore, name: str, encode=hash_encoder, recipe: dict = RECIPE, include: tuple[str, ...] = ()) -> None:
        self.store, self.name, self.encode, self.recipe, self.include = store, name, encode, recipe_id(recipe), include

    def index_commit(self, repo: str, commit: str, mode: str = "incremental") -> str:
        """Index a commit; returns the snapshot id. Without an incremental snapshot of the parent all files are read."""
        commit, parent = git.lineage(repo, git.resolve(repo, commit), 1)[0]
        base = self.store.snapshot_id_for(self.name, parent) if parent and mode == "incremental" else None
        changed = git.changed_files(self.store.spark, repo, parent, commit) if base else None
        return self.index_changes(repo, commit, parent, base, changed, mode)

    def index_changes(self, repo: str, commit: str, parent: str | None, base: str | None, changed: DataFrame | None, mode: str) -> str:
        """Index a commit from the listing of `base` and a change feed, or from all its files without them."""
        spark, began = self.store.spark, time.perf_counter()
        if base is not None and changed is not None:
            actions = durable(change_actions(changed).filter(is_indexed_path(F.col("path"), self.include)))
            paths, dropped = (actions.filter(F.col("action") == a).select("path") for a in ("extract", "drop"))
            before = self.store.listing(base)
        else:
            paths = git.files_at(spark, repo, commit, self.include)
            dropped = paths.limit(0)
            before = self.store.listing("")
        snippets = self.store.add_snippets(extract_snippets(git.with_sources(paths, repo, commit)))
        listing = durable(incremental_listing(before, dropped, snippets, []))
        contents = listing.join(self.store.table("occurrence"), "occ_key").join(self.store.table("content"), "content_key")
        _, embedded = self.store.embed(contents, self.recipe, self.encode)
        kept = before.join(dropped, "path", "left_anti").select("occ_key")
        stats = {
            "files_parsed": paths.count(), "snippets": listing.count(), "reused_occurrences": kept.count(),
            "new_occurrences": listing.select("occ_key").subtract(kept).count(), "embedded_new_content": embedded,
            "total_s": round(time.perf_counter() - began, 3),
        }
        snapshot = f"{self.name}@{commit[:12]}:{mode}"
        self.store.publish(snapshot, self.name, commit, parent, mode, listing, stats)
        return snapshot
