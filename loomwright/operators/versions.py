"""Reads over the versioned store, search in one snapshot and in the whole history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.text import document_text, unified_diff
from loomwright.functions.vectors import hash_embedding
from loomwright.operators.bm25 import Index, bm25_index, bm25_search
from loomwright.operators.dense import dense_search
from loomwright.operators.fusion import rrf
from loomwright.session import durable


def known_snapshots(snapshots: DataFrame) -> DataFrame:
    """One row a snapshot_id, with its first seq: publishing again doesn't move a snapshot. NULL ids are left out."""
    rest = [c for c in snapshots.columns if c not in ("snapshot_id", "seq")]
    first = F.min_by(F.struct(*rest), F.struct("seq", *[c for c in ("loaded_at",) if c in rest])).alias("r")
    return snapshots.filter("snapshot_id IS NOT NULL").groupBy("snapshot_id").agg(F.min("seq").alias("seq"), first).select("snapshot_id", "seq", "r.*")


def snapshot_of(snapshots: DataFrame, repo: str, commit: str, mode: str = "incremental") -> DataFrame:
    """The snapshot of a commit, no row if there is none."""
    return known_snapshots(snapshots.filter((F.col("repo") == repo) & (F.col("commit_sha") == commit) & (F.col("mode") == mode)))


def snapshot_list(snapshots: DataFrame, repo: str | None = None, mode: str = "incremental") -> DataFrame:
    """Snapshots of a mode, of one repository or all, by repository and seq."""
    own = F.col("repo") == repo if repo is not None else F.lit(True)
    return known_snapshots(snapshots.filter((F.col("mode") == mode) & own)).orderBy("repo", "seq", "snapshot_id")


def snapshot_occurrences(memberships: DataFrame, occurrences: DataFrame, contents: DataFrame, chosen: Column | None = None, paths: list[str] | None = None) -> DataFrame:
    """Occurrences with code of the chosen snapshots (a condition on memberships), at some paths or all.

    The condition stands before the joins, so partitions of other snapshots aren't read.
    """
    listed = memberships.select("snapshot_id", "occ_key")
    listed = (listed.filter(chosen) if chosen is not None else listed).distinct()
    known = occurrences.filter(F.col("path").isin(paths)) if paths is not None else occurrences
    return listed.join(known, "occ_key").join(contents.select("content_key", "code"), "content_key")


def history(snapshots: DataFrame, memberships: DataFrame, occurrences: DataFrame, contents: DataFrame, mode: str = "incremental", seqs: tuple[int, int] | None = None) -> DataFrame:
    """Every (snapshot, occurrence) of a mode, with repo, commit, seq and code; optionally of seqs lo to hi alone."""
    known = known_snapshots(snapshots.filter(F.col("mode") == mode)).select("snapshot_id", "repo", "commit_sha", "seq")
    if seqs is not None:
        known = known.filter(F.col("seq").between(*seqs))
    listed = memberships.select("snapshot_id", "occ_key").distinct().join(known, "snapshot_id")
    return listed.join(occurrences, "occ_key").join(contents.select("content_key", "code"), "content_key")


def content_versions(rows: DataFrame) -> DataFrame:
    """One row a repository and content: where it was first seen, its first and last commit, and how many snapshots hold it.

    A content that moves keeps its first path and symbol. n_versions counts the contents first seen under that path and
    symbol. A content that a snapshot has twice counts once there.
    """
    seen = F.struct("seq", "path", "start_line", "occ_key")
    grouped = rows.groupBy("repo", "content_key").agg(
        F.min_by("path", seen).alias("path"), F.min_by("symbol", seen).alias("symbol"), F.min("seq").alias("first_seq"),
        F.min_by("commit_sha", seen).alias("first_commit"), F.max_by("commit_sha", F.struct("seq", "commit_sha")).alias("last_commit"),
        F.count_distinct("snapshot_id").alias("n_commits"),
    )
    return grouped.withColumn("n_versions", F.count(F.lit(1)).over(Window.partitionBy("repo", "path", "symbol")))


def nearest_versions(versions: DataFrame) -> DataFrame:
    """content_versions with `other`: the content of the same symbol whose first seq is nearest; NULL if it has none.

    Versions stand in order of (first_seq, content_key); of the neighbours on both sides the nearer counts, the earlier
    if equally near. Sorting finds them without pairing the versions of a symbol with each other.
    """
    line = Window.partitionBy("repo", "path", "symbol").orderBy("first_seq", "content_key")
    before, after = (f(F.struct("first_seq", "content_key")).over(line) for f in (F.lag, F.lead))
    sided = versions.withColumns({"before": before, "after": after})
    nearer = F.when(F.col("before").isNull(), F.col("after")).when(F.col("after").isNull(), F.col("before"))
    nearer = nearer.when(F.col("first_seq") - F.col("before.first_seq") <= F.col("after.first_seq") - F.col("first_seq"), F.col("before")).otherwise(F.col("after"))
    return sided.withColumn("nearer", nearer).select(*versions.columns, F.col("nearer.content_key").alias("other"), F.col("nearer.first_seq").alias("other_seq"))


def version_diffs(versions: DataFrame, contents: DataFrame) -> DataFrame:
    """(repo, content_key, other, diff): the text difference from the older to the newer of each nearest pair."""
    near = nearest_versions(versions).filter("other IS NOT NULL")
    commits = versions.select("repo", F.col("content_key").alias("other"), F.col("first_commit").alias("other_commit"))
    code = contents.select("content_key", "code")
    both = near.join(commits, ["repo", "other"]).join(code, "content_key").join(code.withColumnsRenamed({"content_key": "other", "code": "other_code"}), "other")
    swap = F.col("other_seq") < F.col("first_seq")

    def pick(a: str, b: str) -> Column:
        return F.when(swap, F.col(b)).otherwise(F.col(a))

    def label(commit: Column) -> Column:
        return F.concat("path", F.lit("@"), F.substring(commit, 1, 8))

    old, new = pick("code", "other_code"), pick("other_code", "code")
    old_name, new_name = label(pick("first_commit", "other_commit")), label(pick("other_commit", "first_commit"))
    return both.select("repo", "content_key", "other", unified_diff(old, new, old_name, new_name).alias("diff"))


def by_hash(df: DataFrame, keys: list[str], text: str, role: str) -> DataFrame:
    """(keys..., vec): the encoder that needs no model; role (query or document) makes no difference to it."""
    return hash_embedding(df, keys, text)


def prepare_search(documents: DataFrame, document: str, lexical: str, dense: str, embed=by_hash, vectors: DataFrame | None = None) -> tuple[Index, DataFrame]:
    """(postings, vectors) of documents, stored, for any number of searches; given vectors (document, vec) are taken as they are."""
    if vectors is None:
        vectors = embed(documents.select(document, dense), [document], dense, "document")
    return bm25_index(documents.select(document, lexical), document, lexical), durable(vectors.select(document, "vec"))


def search_prepared(prepared: tuple[Index, DataFrame], document: str, queries: DataFrame, depth: int, k: int, embed=by_hash) -> DataFrame:
    """(qid, document, score, rank): dense and lexical search, `depth` candidates each, fused by reciprocal rank."""
    postings, vectors = prepared
    words = bm25_search(queries, "qid", "text", postings, document, depth)
    asked = embed(queries.select("qid", "text"), ["qid"], "text", "query")
    near = dense_search(asked, "qid", vectors, document, "vec", depth)
    return rrf(near.unionByName(words), ["qid"], document).filter(F.col("rank") <= k)


def fused_search(documents: DataFrame, document: str, lexical: str, dense: str, queries: DataFrame, depth: int, k: int, embed=by_hash) -> DataFrame:
    """search_prepared of documents that are searched once."""
    return search_prepared(prepare_search(documents, document, lexical, dense, embed), document, queries, depth, k, embed)


def snapshot_search(occurrences: DataFrame, queries: DataFrame, k: int = 10, depth: int = 100, embed=by_hash) -> DataFrame:
    """(qid, rank, score, occ_key, path, symbol, start_line, end_line, content_key, code): search in one snapshot.

    occurrences: snapshot_occurrences of it. Lexical search reads path and symbol too. An empty snapshot gives no hits.
    """
    documents = occurrences.select("occ_key", document_text(F.col("path"), F.col("symbol"), F.col("code")).alias("words"), "code")
    hits = fused_search(documents, "occ_key", "words", "code", queries, depth, k, embed)
    return hits.join(occurrences.select("occ_key", "path", "symbol", "start_line", "end_line", "content_key", "code"), "occ_key")


def history_search(rows: DataFrame, contents: DataFrame, queries: DataFrame, k: int = 10, depth: int = 200, embed=by_hash) -> DataFrame:
    """Search over every version in `history` rows of one repository: one hit a content, with its commits and versions.

    Returns (qid, rank, score, content_key, path, symbol, first_commit, last_commit, n_commits, n_versions, other); other is
    the nearest version, of which version_diffs has the difference.
    """
    versions = nearest_versions(content_versions(rows))
    documents = versions.join(contents.select("content_key", "code"), "content_key").select("content_key", document_text(F.col("path"), F.col("symbol"), F.col("code")).alias("words"), "code")
    hits = fused_search(documents, "content_key", "words", "code", queries, depth, k, embed)
    return hits.join(versions.drop("repo", "first_seq", "other_seq"), "content_key")


def with_diffs(hits: DataFrame, rows: DataFrame, contents: DataFrame, repo: str | None = None) -> DataFrame:
    """history_search hits with `code` and `diff`: the difference from the older to the newer of the hit and its nearest version.

    rows: the `history` rows that were searched. diff is NULL for a content without another version.
    """
    wanted = hits.select("content_key").distinct()
    found = durable(content_versions(rows))
    diffs = version_diffs(found, contents).join(wanted, "content_key", "left_semi").select("content_key", "diff")
    return hits.join(contents.select("content_key", "code"), "content_key").join(diffs, "content_key", "left")


def version_labels(labels: DataFrame, occurrences: DataFrame) -> DataFrame:
    """labels (id, snapshot_id, symbol, ...) with the gold content_key; a symbol that isn't there exactly once is an error."""
    gold = labels.join(occurrences.select("snapshot_id", "symbol", "content_key"), ["snapshot_id", "symbol"], "left")
    counted = gold.withColumn("n", F.count("content_key").over(Window.partitionBy("id")))
    checked = F.when(F.col("n") == 1, F.col("content_key")).otherwise(F.raise_error(F.format_string("label %s: expected one %s, found %d", F.col("id").cast("string"), "symbol", "n")))
    return counted.select(*labels.columns, checked.alias("gold"))


def snapshot_ranks(labels: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, snapshot_rank): rank of the first hit with the label's symbol, in a search of the label's snapshot.

    labels: (id, qid, symbol); hits: (qid, rank, symbol) of the label's own snapshot.
    """
    own = labels.select("id", "qid", "symbol").join(hits.select("qid", "rank", F.col("symbol").alias("s")), "qid", "left")
    return own.groupBy("id").agg(F.min(F.when(F.col("s") == F.col("symbol"), F.col("rank"))).alias("snapshot_rank"))


def rank_summary(ranks: DataFrame, rank: str) -> DataFrame:
    """One row: labels, mrr, hits at 1 and 5 of a column of ranks, NULL for what wasn't found."""
    r = F.col(rank)
    return ranks.agg(F.count(F.lit(1)).alias("labels"), F.round(F.avg(F.coalesce(1 / r, F.lit(0.0))), 4).alias("mrr"), F.count_if(r == 1).alias("hit_1"), F.count_if(r <= 5).alias("hit_5"))


def version_ranks(labels: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, history_rank, version_correct): rank of the gold version, and whether it precedes all others of its symbol.

    labels: (id, qid, symbol, gold); hits: (qid, rank, symbol, content_key).
    """
    own = labels.join(hits.select("qid", "rank", F.col("symbol").alias("s"), "content_key"), "qid", "left")
    rank = F.min(F.when(F.col("content_key") == F.col("gold"), F.col("rank")))
    rival = F.min(F.when((F.col("s") == F.col("symbol")) & (F.col("content_key") != F.col("gold")), F.col("rank")))
    ranks = own.groupBy("id").agg(rank.alias("history_rank"), rival.alias("rival"))
    correct = F.col("history_rank").isNotNull() & (F.col("rival").isNull() | (F.col("history_rank") < F.col("rival")))
    return ranks.select("id", "history_rank", correct.alias("version_correct"))


def version_summary(ranks: DataFrame) -> DataFrame:
    """One row: labels, mrr, hits at 1 and 5, and versions that are correct."""
    r = F.col("history_rank")
    return ranks.agg(F.count(F.lit(1)).alias("labels"), F.round(F.avg(F.coalesce(1 / r, F.lit(0.0))), 4).alias("mrr"), F.count_if(r == 1).alias("hit_1"), F.count_if(r <= 5).alias("hit_5"), F.count_if("version_correct").alias("version_correct"))
