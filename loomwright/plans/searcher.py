"""Search in the snapshots of a store with prepared indexes, and evaluation against labelled versions."""

from __future__ import annotations

import statistics
import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions.text import document_text
from loomwright.operators import versions
from loomwright.operators.bm25 import Index
from loomwright.plans.encoders import HASH, Encoder
from loomwright.session import durable
from loomwright.sources.store import SnapshotStore


class Searcher:
    """A store, an encoder, and the prepared indexes of the snapshots searched so far.

    Vectors of documents come from the store's embeddings under the encoder's recipe; what isn't there yet is encoded
    once and stored. Queries are encoded by the same encoder in the role of queries.
    """

    def __init__(self, store: SnapshotStore, encoder: Encoder = HASH, most_prepared: int = 32) -> None:
        self.store, self.encoder, self.most = store, encoder, most_prepared
        self.prepared: dict[str, tuple[DataFrame, tuple[Index, DataFrame]]] = {}

    def _embed(self, df: DataFrame, keys: list[str], text: str, role: str) -> DataFrame:
        return self.encoder.embed(df, keys, text, role)

    def _vectors(self, contents: DataFrame) -> DataFrame:
        found, _ = self.store.embed(contents, self.encoder.recipe("document"), lambda fresh: self._embed(fresh, ["content_key"], "code", "document"))
        return found

    def prepare(self, snapshot: str) -> tuple[DataFrame, tuple[Index, DataFrame]]:
        """(occurrences, (postings, vectors)) of a snapshot, made once; of the least recent ones `most_prepared` are kept."""
        if snapshot not in self.prepared:
            tables = (self.store.table(t) for t in ("membership", "occurrence", "content"))
            listed = durable(versions.snapshot_occurrences(*tables, F.col("snapshot_id") == snapshot))
            documents = listed.select("occ_key", document_text(F.col("path"), F.col("symbol"), F.col("code")).alias("words"), "code")
            vectors = self._vectors(listed.select("content_key", "code")).join(listed.select("occ_key", "content_key"), "content_key")
            while len(self.prepared) >= self.most:
                self.prepared.pop(next(iter(self.prepared)))
            self.prepared[snapshot] = listed, versions.prepare_search(documents, "occ_key", "words", "code", vectors=vectors)
        return self.prepared[snapshot]

    def retrieve(self, queries: DataFrame, snapshot: str, k: int = 10, depth: int = 100) -> DataFrame:
        """(qid, rank, score, occ_key, path, symbol, start_line, end_line, content_key, code) of queries (qid, text)."""
        listed, prepared = self.prepare(snapshot)
        hits = versions.search_prepared(prepared, "occ_key", queries, depth, k, self._embed)
        return hits.join(listed.select("occ_key", "path", "symbol", "start_line", "end_line", "content_key", "code"), "occ_key")

    def history(self, repo: str, seqs: tuple[int, int] | None = None) -> DataFrame:
        rows = versions.history(*(self.store.table(t) for t in ("snapshot", "membership", "occurrence", "content")), seqs=seqs)
        return rows.filter(F.col("repo") == repo)

    def retrieve_history(self, queries: DataFrame, repo: str, k: int = 10, depth: int = 200, seqs: tuple[int, int] | None = None) -> DataFrame:
        """Hits over every version of a repository (or its seqs lo to hi), with code and the diff to the nearest version."""
        rows = durable(self.history(repo, seqs))
        contents = self.store.table("content")
        return versions.with_diffs(versions.history_search(rows, contents, queries, k, depth, self._embed), rows, contents)


def evaluate_versions(searcher: Searcher, labels: DataFrame, k: int = 50) -> tuple[DataFrame, dict]:
    """Ranks and a summary of labelled queries: labels (repo, id, query, symbol, commit), as read_labels gives them.

    Returns (rows, summary). rows: (id, repo, symbol, commit, history_rank, version_correct, n_versions, snapshot_rank). The
    gold version is the content of the one occurrence of the symbol in the commit's snapshot; a commit that isn't
    indexed, or a symbol that isn't there exactly once, is an error. summary has the means, hits and milliseconds a query.
    """
    store = searcher.store
    known = versions.known_snapshots(store.table("snapshot").filter("mode = 'incremental'")).select("repo", F.col("commit_sha").alias("commit"), "snapshot_id")
    # labels are written by hand: a few hundred at most
    full = labels.join(known, ["repo", "commit"], "left").select("repo", "id", F.col("id").alias("qid"), F.col("query").alias("text"), "symbol", "commit", "snapshot_id").collect()
    lost = [r["id"] for r in full if r["snapshot_id"] is None]
    if lost:
        raise ValueError(f"commits of labels {', '.join(map(str, lost))} are not indexed")
    schema = "repo string, id string, qid string, text string, symbol string, commit string, snapshot_id string"
    asked = store.spark.createDataFrame([tuple(r) for r in full], schema)
    listed = store.table("membership").join(store.table("occurrence"), "occ_key").select("snapshot_id", "symbol", "content_key").distinct()
    gold = durable(versions.version_labels(asked, listed))

    def timed(found: DataFrame, n: int, times: list[float]) -> DataFrame:
        began = time.perf_counter()
        kept = durable(found)
        times += [1000 * (time.perf_counter() - began) / max(1, n)] * n
        return kept

    past, now, past_ms, now_ms = [], [], [], []
    for repo in sorted({r["repo"] for r in full}):
        own = asked.filter(F.col("repo") == repo)
        rows = durable(searcher.history(repo))
        past.append(timed(versions.history_search(rows, store.table("content"), own.select("qid", "text"), k, embed=searcher._embed).select("qid", "rank", "symbol", "content_key", "n_versions"), sum(r["repo"] == repo for r in full), past_ms))
    for snapshot in sorted({r["snapshot_id"] for r in full}):
        own = asked.filter(F.col("snapshot_id") == snapshot)
        now.append(timed(searcher.retrieve(own.select("qid", "text"), snapshot, k).select("qid", "rank", "symbol"), sum(r["snapshot_id"] == snapshot for r in full), now_ms))
    hits = reduce(DataFrame.unionByName, past)
    ranks = versions.version_ranks(gold, hits).join(versions.snapshot_ranks(gold, reduce(DataFrame.unionByName, now)), "id")
    several = hits.select("qid", F.col("content_key").alias("gold"), "n_versions")
    rows = durable(gold.join(ranks, "id").join(several, ["qid", "gold"], "left").select("id", "repo", "symbol", "commit", "history_rank", "version_correct", "n_versions", "snapshot_rank"))
    history = versions.version_summary(rows).first().asDict() | {"p50_ms": round(statistics.median(past_ms), 1)}
    snapshot = versions.rank_summary(rows, "snapshot_rank").first().asDict() | {"p50_ms": round(statistics.median(now_ms), 1)}
    return rows, {"labels": history.pop("labels"), "model": searcher.encoder.name, "history": history, "snapshot": {k: v for k, v in snapshot.items() if k != "labels"}}
