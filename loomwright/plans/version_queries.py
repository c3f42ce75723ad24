"""Queries over the version track: histories and changes between snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import hashing, text
from loomwright.operators import extract, indexing, versions
from loomwright.operators.history import entity_history
from loomwright.operators.snapshot_diff import snapshot_changes
from loomwright.plans.sql import bm25_ctes, dense_ctes, hash_ctes, token_ctes
from loomwright.plans.encoders import HASH
from loomwright.session import checkpoint_dir, durable
from loomwright.sources.jsonfiles import read_labels, write_lines
from loomwright.sources.store import SnapshotStore
from loomwright.sources.tables import read_table


def _listing(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Memberships with columns of their occurrences."""
    occurrences = read_table(spark, folder, "occurrences").select("occ_key", *columns)
    return read_table(spark, folder, "memberships").join(occurrences, "occ_key")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The periods in which each function of the incremental snapshots had each content."""
    snapshots = read_table(spark, folder, "snapshots").filter("mode = 'incremental'")
    listing = _listing(spark, folder, "path", "symbol", "content_key")
    return entity_history(listing, snapshots, "repo", "snapshot_id", "seq", ["path", "symbol"], ["content_key"])


P2_FOUND_SQL = """
WITH s AS (SELECT repo, snapshot_id, min(seq) AS seq FROM snapshots WHERE mode = 'incremental' GROUP BY repo, snapshot_id),
r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY seq, snapshot_id) AS r FROM s),
m AS (SELECT DISTINCT repo, r, seq, path, symbol, content_key FROM memberships JOIN r USING (snapshot_id) JOIN occurrences USING (occ_key)),
i AS (SELECT *, r - row_number() OVER (PARTITION BY repo, path, symbol, content_key ORDER BY r) AS island FROM m)
SELECT repo, path, symbol, content_key, min(seq) AS first_seq, max(seq) AS last_seq
FROM i GROUP BY repo, path, symbol, content_key, island
"""


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Functions added, removed or changed in each snapshot whose parent is known."""
    known = read_table(spark, folder, "snapshots").select("snapshot_id", "repo", "mode", "commit_sha", "parent_sha").distinct()
    parents = known.select("repo", "mode", F.col("commit_sha").alias("parent_sha"), F.col("snapshot_id").alias("parent_id"))
    pairs = known.join(parents, ["repo", "mode", "parent_sha"]).filter("snapshot_id != parent_id")
    listing = _listing(spark, folder, "path", "symbol")
    changes = snapshot_changes(listing, pairs, "snapshot_id", "parent_id", ["path", "symbol"], "occ_key")
    return changes.select("snapshot_id", "path", "symbol", "change")


P6_FOUND_SQL = """
WITH s AS (SELECT DISTINCT snapshot_id, repo, mode, commit_sha, parent_sha FROM snapshots),
p AS (SELECT DISTINCT c.snapshot_id, d.snapshot_id AS parent_id FROM s c JOIN s d
      ON c.repo = d.repo AND c.mode = d.mode AND c.parent_sha = d.commit_sha AND c.snapshot_id <> d.snapshot_id),
l AS (SELECT snapshot_id, path, symbol, list_sort(list(DISTINCT occ_key)) AS occs
      FROM memberships JOIN occurrences USING (occ_key) GROUP BY snapshot_id, path, symbol),
a AS (SELECT p.snapshot_id, p.parent_id, path, symbol, occs FROM p JOIN l ON l.snapshot_id = p.snapshot_id),
b AS (SELECT p.snapshot_id, p.parent_id, path, symbol, occs FROM p JOIN l ON l.snapshot_id = p.parent_id)
SELECT snapshot_id, path, symbol,
       CASE WHEN b.occs IS NULL THEN 'added' WHEN a.occs IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b USING (snapshot_id, parent_id, path, symbol)
WHERE a.occs IS DISTINCT FROM b.occs
"""

QUERIES = {"p2_found": p2_found, "p6_found": p6_found}
ORACLES = {"p2_found": P2_FOUND_SQL, "p6_found": P6_FOUND_SQL}


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL if given."""

    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def _tables(spark: SparkSession, d: str, *names: str) -> tuple[DataFrame, ...]:
    return tuple(read_table(spark, d, n) for n in names)


@query("key_content", "SELECT content_key, sha256(code) AS computed FROM contents")
def key_content(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "contents").select("content_key", hashing.content_key(F.col("code")).alias("computed"))


@query("key_occurrence", "SELECT occ_key, sha256(path || chr(0) || symbol || chr(0) || start_line || chr(0) || end_line || chr(0) || content_key) AS computed FROM occurrences")
def key_occurrence(spark: SparkSession, d: str) -> DataFrame:
    parts = (F.col(c) for c in ("path", "symbol", "start_line", "end_line", "content_key"))
    return read_table(spark, d, "occurrences").select("occ_key", hashing.occ_key(*parts).alias("computed"))


@query("key_snapshot", "SELECT DISTINCT snapshot_id, repo || '@' || commit_sha[1:12] || ':' || mode AS computed FROM snapshots")
def key_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "snapshots").select("snapshot_id", hashing.snapshot_id(F.col("repo"), F.col("commit_sha"), F.col("mode")).alias("computed")).distinct()


@query("filter_paths", "SELECT DISTINCT path FROM occurrences WHERE regexp_matches(path, '(\\.js|\\.mjs|\\.cjs|\\.jsx)$') AND NOT contains(path, 'node_modules/') AND (starts_with(path, 'lib/') OR starts_with(path, 'src/'))")
def filter_paths(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "occurrences").select("path").filter(text.is_indexed_path(F.col("path"), ("lib/", "src/"))).distinct()


@query("fn_document_text", "SELECT occ_key, path || ' ' || symbol || chr(10) || code AS words FROM occurrences JOIN contents USING (content_key)")
def fn_document_text(spark: SparkSession, d: str) -> DataFrame:
    occurrences, contents = _tables(spark, d, "occurrences", "contents")
    return occurrences.join(contents, "content_key").select("occ_key", text.document_text(F.col("path"), F.col("symbol"), F.col("code")).alias("words"))


@query("fn_callees", "SELECT occ_key, array_to_string(list_sort(list_distinct(callees)), ' ') AS callees, to_json(callees) AS json FROM occurrences WHERE callees IS NOT NULL")
def fn_callees(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "occurrences").filter("callees IS NOT NULL")
    return rows.select("occ_key", F.array_join(F.array_sort(F.array_distinct("callees")), " ").alias("callees"), F.to_json("callees").alias("json"))


KNOWN_SQL = "k AS (SELECT snapshot_id, min(seq) AS seq, any_value(repo) AS repo, any_value(commit_sha) AS commit_sha, any_value(mode) AS mode, any_value(parent_sha) AS parent_sha FROM snapshots GROUP BY snapshot_id)"


@query("store_snapshots", f"WITH {KNOWN_SQL} SELECT repo, snapshot_id, seq, commit_sha, parent_sha FROM k WHERE mode = 'incremental'")
def store_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return versions.snapshot_list(read_table(spark, d, "snapshots")).select("repo", "snapshot_id", "seq", "commit_sha", "parent_sha")


@query("store_snapshot_lookup", f"WITH {KNOWN_SQL}, h AS (SELECT repo, commit_sha FROM k WHERE mode = 'incremental' ORDER BY seq DESC, repo LIMIT 1) SELECT snapshot_id, seq FROM k JOIN h USING (repo, commit_sha) WHERE mode = 'incremental'")
def store_snapshot_lookup(spark: SparkSession, d: str) -> DataFrame:
    snapshots = read_table(spark, d, "snapshots")
    head = _head(snapshots)
    return versions.snapshot_of(snapshots, head["repo"], head["commit_sha"]).select("snapshot_id", "seq")


def _head(snapshots: DataFrame):
    """The last snapshot of the longest history: the argument of queries about one snapshot."""
    return versions.known_snapshots(snapshots.filter("mode = 'incremental'")).orderBy(F.desc("seq"), "repo").first()


@query("store_next_seq", "SELECT repo, mode, CAST(max(seq) + 1 AS INTEGER) AS next_seq FROM snapshots GROUP BY repo, mode")
def store_next_seq(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "snapshots").groupBy("repo", "mode").agg((F.max("seq") + 1).alias("next_seq"))


@query("store_stats", f"""WITH s AS (SELECT DISTINCT repo, snapshot_id, stats FROM snapshots WHERE mode = 'incremental' AND stats IS NOT NULL), f AS (SELECT repo, min(seq) AS first FROM snapshots WHERE mode = 'incremental' GROUP BY repo), {KNOWN_SQL}
SELECT k.repo, count(*) AS increments, round(avg(s.stats.total_s), 6) AS mean_s, max(s.stats.total_s) AS max_s, CAST(sum(s.stats.files_parsed) AS BIGINT) AS files_parsed FROM s JOIN k USING (snapshot_id) JOIN f ON f.repo = k.repo WHERE k.seq > f.first GROUP BY k.repo""")
def store_stats(spark: SparkSession, d: str) -> DataFrame:
    """Times and files of all increments behind the first snapshot of each repository."""
    rows = read_table(spark, d, "snapshots").filter("mode = 'incremental'")
    first = rows.groupBy("repo").agg(F.min("seq").alias("first"))
    stats = rows.filter("stats IS NOT NULL").select("snapshot_id", "stats").distinct()
    later = versions.known_snapshots(rows).select("snapshot_id", "repo", "seq").join(first, "repo").filter(F.col("seq") > F.col("first"))
    # sums of doubles depend on their order, and a mean half-way between two roundings goes either way; decimals are exact
    seconds, exact = F.col("stats.total_s"), F.col("stats.total_s").try_cast("decimal(28,18)")
    mean = F.when(F.count(exact) == F.count(seconds), F.round(F.avg(exact), 6).cast("double")).otherwise(F.round(F.avg(seconds), 6))
    return later.join(stats, "snapshot_id").groupBy("repo").agg(F.count(F.lit(1)).alias("increments"), mean.alias("mean_s"), F.max(seconds).alias("max_s"), F.sum("stats.files_parsed").alias("files_parsed"))


@query("store_listing", "SELECT snapshot_id, occ_key, path, symbol, start_line, content_key, length(code) AS size FROM (SELECT DISTINCT snapshot_id, occ_key FROM memberships) JOIN occurrences USING (occ_key) JOIN contents USING (content_key)")
def store_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = versions.snapshot_occurrences(*_tables(spark, d, "memberships", "occurrences", "contents"))
    return rows.select("snapshot_id", "occ_key", "path", "symbol", "start_line", "content_key", F.length("code").cast("long").alias("size"))


HISTORY_SQL = f"""{KNOWN_SQL}, h AS (SELECT k.repo, k.seq, k.commit_sha, snapshot_id, occ_key, path, symbol, start_line, content_key FROM (SELECT DISTINCT snapshot_id, occ_key FROM memberships) JOIN k USING (snapshot_id) JOIN occurrences USING (occ_key) WHERE mode = 'incremental'),
v0 AS (SELECT repo, content_key, first(path ORDER BY seq, path, start_line, occ_key) AS path, first(symbol ORDER BY seq, path, start_line, occ_key) AS symbol, min(seq) AS first_seq,
  first(commit_sha ORDER BY seq, path, start_line, occ_key) AS first_commit, last(commit_sha ORDER BY seq, commit_sha) AS last_commit, count(DISTINCT snapshot_id) AS n_commits FROM h GROUP BY repo, content_key),
v AS (SELECT *, count(*) OVER (PARTITION BY repo, path, symbol) AS n_versions FROM v0),
w AS (SELECT *, lag(first_seq) OVER l AS bs, lag(content_key) OVER l AS bk, lead(first_seq) OVER l AS ns, lead(content_key) OVER l AS nk FROM v WINDOW l AS (PARTITION BY repo, path, symbol ORDER BY first_seq, content_key)),
near AS (SELECT * EXCLUDE (bs, bk, ns, nk), CASE WHEN bk IS NULL THEN nk WHEN nk IS NULL THEN bk WHEN first_seq - bs <= ns - first_seq THEN bk ELSE nk END AS other FROM w)"""


def _history(spark: SparkSession, d: str) -> DataFrame:
    return versions.history(*_tables(spark, d, "snapshots", "memberships", "occurrences", "contents"))


@query("history_rows", f"WITH {HISTORY_SQL} SELECT repo, seq, commit_sha, occ_key, path, symbol, content_key FROM h WHERE seq BETWEEN 1 AND 5")
def history_rows(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of the commits with seq 1 to 5 (the range is the feature)."""
    rows = versions.history(*_tables(spark, d, "snapshots", "memberships", "occurrences", "contents"), seqs=(1, 5))
    return rows.select("repo", "seq", "commit_sha", "occ_key", "path", "symbol", "content_key")


@query("history_contents", f"WITH {HISTORY_SQL} SELECT repo, content_key, path, symbol, first_seq, first_commit, last_commit, n_commits, n_versions FROM v")
def history_contents(spark: SparkSession, d: str) -> DataFrame:
    return versions.content_versions(_history(spark, d))


@query("history_nearest", f"WITH {HISTORY_SQL} SELECT repo, content_key, path, symbol, other FROM near")
def history_nearest(spark: SparkSession, d: str) -> DataFrame:
    return versions.nearest_versions(versions.content_versions(_history(spark, d))).select("repo", "content_key", "path", "symbol", "other")


@query("history_diffs")
def history_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Text differences of nearest versions; SQL has no such function, tests hold it against the standard library."""
    found = durable(versions.content_versions(_history(spark, d)))
    return versions.version_diffs(found, read_table(spark, d, "contents"))


def search_sql(documents: str, key: str, k: int, depth: int, queries: str = "queries", p: str = "") -> str:
    """CTEs that end in `<p>hits`(qid, key, score, rank) of fused search; documents has (key, words, code)."""
    return f"""{token_ctes(p + 'wt', documents, key, 'words')}, {token_ctes(p + 'ct', documents, key, 'code')}, {token_ctes(p + 'qt', queries, 'qid', 'text')},
{hash_ctes(p + 'dh', p + 'ct', key)}, {hash_ctes(p + 'qh', p + 'qt', 'qid')}, {dense_ctes(p + 'dense', documents, key, queries, p + 'dh', p + 'qh', depth)}, {bm25_ctes(p + 'lex', documents, key, p + 'wt', p + 'qt', k=depth)},
{p}fused AS (SELECT qid, {key}, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT qid, {key}, rank FROM {p}dense UNION ALL SELECT qid, {key}, rank FROM {p}lex) GROUP BY qid, {key}),
{p}hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, {key}) AS INTEGER) AS rank FROM {p}fused) WHERE rank <= {k})"""


HEAD_SQL = f"{KNOWN_SQL}, hd AS (SELECT * FROM k WHERE mode = 'incremental' ORDER BY seq DESC, repo LIMIT 1)"


@query("search_snapshot", f"""WITH {HEAD_SQL}, o AS (SELECT * FROM (SELECT DISTINCT occ_key FROM memberships WHERE snapshot_id = (SELECT snapshot_id FROM hd)) JOIN occurrences USING (occ_key) JOIN contents USING (content_key)),
docs AS (SELECT occ_key, path || ' ' || symbol || chr(10) || code AS words, code FROM o), {search_sql('docs', 'occ_key', 10, 100)}
SELECT qid, rank, hits.score, occ_key, path, symbol, start_line, content_key FROM hits JOIN o USING (occ_key)""")
def search_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """All queries against the last snapshot of the longest history."""
    snapshots, memberships, occurrences, contents, queries = _tables(spark, d, "snapshots", "memberships", "occurrences", "contents", "queries")
    listed = versions.snapshot_occurrences(memberships, occurrences, contents, F.col("snapshot_id") == _head(snapshots)["snapshot_id"])
    hits = versions.snapshot_search(durable(listed), queries)
    return hits.select("qid", "rank", "score", "occ_key", "path", "symbol", "start_line", "content_key")


HISTORY_SEARCH_SQL = f"""WITH {HISTORY_SQL}, hd AS (SELECT repo FROM k WHERE mode = 'incremental' ORDER BY seq DESC, repo LIMIT 1), own AS (SELECT * FROM near WHERE repo = (SELECT repo FROM hd)),
docs AS (SELECT content_key, path || ' ' || symbol || chr(10) || code AS words, code FROM own JOIN contents USING (content_key)), {search_sql('docs', 'content_key', 10, 200)}"""


def _history_hits(spark: SparkSession, d: str) -> DataFrame:
    snapshots, contents, queries = _tables(spark, d, "snapshots", "contents", "queries")
    rows = _history(spark, d).filter(F.col("repo") == _head(snapshots)["repo"])
    return versions.history_search(durable(rows), contents, queries)


@query("search_history", f"{HISTORY_SEARCH_SQL} SELECT qid, rank, hits.score, content_key, path, symbol, first_commit, last_commit, n_commits, n_versions, other FROM hits JOIN own USING (content_key)")
def search_history(spark: SparkSession, d: str) -> DataFrame:
    return _history_hits(spark, d)


LABELLED_SQL = f"""WITH {HISTORY_SQL}, hd AS (SELECT * FROM k WHERE mode = 'incremental' ORDER BY seq DESC, repo LIMIT 1),
o AS (SELECT * FROM (SELECT DISTINCT occ_key FROM memberships WHERE snapshot_id = (SELECT snapshot_id FROM hd)) JOIN occurrences USING (occ_key) JOIN contents USING (content_key)),
l AS (SELECT symbol AS qid, symbol, any_value(content_key) AS gold, any_value(path) || ' ' || symbol || ' ' || coalesce(array_to_string(any_value(callees), ' '), '') AS text FROM o GROUP BY symbol HAVING count(*) = 1),
own AS (SELECT * FROM near WHERE repo = (SELECT repo FROM hd)), docs AS (SELECT content_key, path || ' ' || symbol || chr(10) || code AS words, code FROM own JOIN contents USING (content_key)),
odocs AS (SELECT occ_key, path || ' ' || symbol || chr(10) || code AS words, code FROM o),
{search_sql('docs', 'content_key', 10, 200, 'l')}, {search_sql('odocs', 'occ_key', 10, 100, 'l', 's')},
a AS (SELECT l.qid, min(rank) FILTER (content_key = gold) AS history_rank, min(rank) FILTER (own.symbol = l.symbol AND content_key <> gold) AS rival FROM l LEFT JOIN (hits JOIN own USING (content_key)) ON hits.qid = l.qid GROUP BY l.qid),
b AS (SELECT l.qid, min(rank) FILTER (o.symbol = l.symbol) AS snapshot_rank FROM l LEFT JOIN (shits JOIN o USING (occ_key)) ON shits.qid = l.qid GROUP BY l.qid),
r AS (SELECT qid AS id, history_rank, coalesce(history_rank IS NOT NULL AND (rival IS NULL OR history_rank < rival), false) AS version_correct, snapshot_rank FROM a JOIN b USING (qid))"""


def _labels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Labels (repo, id, query, symbol, commit) written as a label file and read back, and the listing they are about.

    A label asks for the version of a function at the last commit of the longest history, by path, name and callees;
    functions whose name the commit has several times can't be labelled.
    """
    snapshots, memberships, occurrences, contents = _tables(spark, d, "snapshots", "memberships", "occurrences", "contents")
    head = _head(snapshots)
    listed = durable(versions.snapshot_occurrences(memberships, occurrences, contents, F.col("snapshot_id") == head["snapshot_id"]))
    once = listed.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.first("path").alias("path"), F.first("callees").alias("callees")).filter("n = 1")
    text = F.concat("path", F.lit(" "), "symbol", F.lit(" "), F.coalesce(F.array_join("callees", " "), F.lit("")))
    made = once.select(F.lit(head["repo"]).alias("repo"), F.struct(F.col("symbol").alias("id"), text.alias("query"), "symbol", F.lit(head["commit_sha"]).alias("commit")).alias("q"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/labels-{uuid.uuid4().hex}"
    write_lines(made.groupBy("repo").agg(F.collect_list("q").alias("queries")), path)  # functions of one commit
    return read_labels(spark, path), listed


@query("labels_gold", f"{LABELLED_SQL} SELECT qid AS id, gold FROM l")
def labels_gold(spark: SparkSession, d: str) -> DataFrame:
    """The one content that each label means."""
    labels, listed = _labels(spark, d)
    asked = labels.withColumn("snapshot_id", F.lit(_head(read_table(spark, d, "snapshots"))["snapshot_id"]))
    return versions.version_labels(asked, listed.select("snapshot_id", "symbol", "content_key")).select("id", "gold")


@query("versions_ranked", f"{LABELLED_SQL} SELECT id, history_rank, version_correct, snapshot_rank FROM r")
def versions_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of labelled versions in the history and in their snapshot; a gold version may well not be found."""
    labels, listed = _labels(spark, d)
    labels = durable(labels)
    snapshots, contents = _tables(spark, d, "snapshots", "contents")
    head = _head(snapshots)
    marked = labels.select("id", F.col("id").alias("qid"), "symbol", F.lit(head["snapshot_id"]).alias("snapshot_id"))
    gold = durable(versions.version_labels(marked, listed.select("snapshot_id", "symbol", "content_key")))
    asked = labels.select(F.col("id").alias("qid"), F.col("query").alias("text"))
    rows = durable(_history(spark, d).filter(F.col("repo") == head["repo"]))
    past = versions.version_ranks(gold, versions.history_search(rows, contents, asked))
    return past.join(versions.snapshot_ranks(gold, versions.snapshot_search(listed, asked)), "id")


@query("versions_summary", f"""{LABELLED_SQL} SELECT count(*) AS labels, round(avg(coalesce(1.0::DOUBLE / history_rank, 0)), 4) AS mrr, count(*) FILTER (history_rank = 1) AS hit_1, count(*) FILTER (history_rank <= 5) AS hit_5, count(*) FILTER (version_correct) AS version_correct,
round(avg(coalesce(1.0::DOUBLE / snapshot_rank, 0)), 4) AS snapshot_mrr, count(*) FILTER (snapshot_rank = 1) AS snapshot_hit_1, count(*) FILTER (snapshot_rank <= 5) AS snapshot_hit_5 FROM r""")
def versions_summary(spark: SparkSession, d: str) -> DataFrame:
    ranks = durable(versions_ranked(spark, d))
    now = versions.rank_summary(ranks, "snapshot_rank").select(*(F.col(c).alias(f"snapshot_{c}") for c in ("mrr", "hit_1", "hit_5")))
    return versions.version_summary(ranks).join(now)  # one row each


HEAD_LISTING_SQL = f"{HEAD_SQL}, o AS (SELECT * FROM (SELECT DISTINCT occ_key FROM memberships WHERE snapshot_id = (SELECT snapshot_id FROM hd)) JOIN occurrences USING (occ_key) JOIN contents USING (content_key))"


def _published(spark: SparkSession, d: str) -> tuple[SnapshotStore, str, DataFrame]:
    """A new store with the last snapshot of the longest history, published twice under a name with a slash."""
    snapshots, memberships, occurrences, contents = _tables(spark, d, "snapshots", "memberships", "occurrences", "contents")
    head = _head(snapshots)
    listed = versions.snapshot_occurrences(memberships, occurrences, contents, F.col("snapshot_id") == head["snapshot_id"])
    store = SnapshotStore(spark, f"{checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}")
    snippets = store.add_snippets(listed.select("path", "symbol", "start_line", "end_line", "code", "callees"))
    name = f"owner/{head['repo']}"
    for _ in range(2):
        store.add_snippets(listed.select("path", "symbol", "start_line", "end_line", "code", "callees"))
        store.publish(f"{name}@{head['commit_sha'][:12]}:incremental", name, head["commit_sha"], None, "incremental", snippets, {"snippets": 1})
    return store, store.snapshot_id_for(name, head["commit_sha"]), listed


@query("store_publish", f"WITH {HEAD_LISTING_SQL} SELECT occ_key, content_key, path, symbol, length(code) AS size, 0 AS seq FROM o")
def store_publish(spark: SparkSession, d: str) -> DataFrame:
    """What a store reads back of a snapshot: inserted and published twice, it is there once, with its first seq."""
    store, snapshot, _ = _published(spark, d)
    rows = versions.snapshot_occurrences(*(store.table(t) for t in ("membership", "occurrence", "content")), F.col("snapshot_id") == snapshot)
    return rows.join(store.snapshots(store.table("snapshot").first()["repo"]).select("snapshot_id", "seq"), "snapshot_id").select("occ_key", "content_key", "path", "symbol", F.length("code").cast("long").alias("size"), "seq")


@query("store_embed", f"WITH {HEAD_LISTING_SQL}, docs AS (SELECT DISTINCT content_key, code FROM o), {token_ctes('ct', 'docs', 'content_key', 'code')}, {hash_ctes('h', 'ct', 'content_key')} SELECT content_key, slot, round(v, 6) AS value FROM h")
def store_embed(spark: SparkSession, d: str) -> DataFrame:
    """Vectors kept by content: computed once, the second call finds them all."""
    store, _, listed = _published(spark, d)
    recipe = HASH.recipe("document")

    def encode(fresh: DataFrame) -> DataFrame:
        return HASH.embed(fresh, ["content_key"], "code", "document")

    store.embed(listed.select("content_key", "code"), recipe, encode)
    found, new = store.embed(listed.select("content_key", "code"), recipe, encode)
    if new:
        raise AssertionError(f"{new} vectors were computed twice")
    return found.select("content_key", F.posexplode("vec").alias("slot", "value")).filter("value != 0").withColumn("value", F.round("value", 6))


@query("json_lines", "SELECT occ_key, path, symbol, start_line, array_to_string(callees, ' ') AS callees FROM occurrences")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences written as JSON lines, NULL fields included, and read back."""
    rows = read_table(spark, d, "occurrences")
    path = f"{checkpoint_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    write_lines(rows, path)
    return spark.read.schema(rows.schema).json(path).select("occ_key", "path", "symbol", "start_line", F.array_join("callees", " ").alias("callees"))


PAIRS_SQL = """s AS (SELECT DISTINCT snapshot_id, repo, mode, commit_sha, parent_sha FROM snapshots WHERE mode = 'incremental'),
p AS (SELECT DISTINCT c.snapshot_id, b.snapshot_id AS parent_id FROM s c JOIN s b ON c.repo = b.repo AND c.parent_sha = b.commit_sha AND c.snapshot_id <> b.snapshot_id),
m AS (SELECT DISTINCT snapshot_id, path, occ_key FROM memberships JOIN occurrences USING (occ_key)),
f AS (SELECT snapshot_id, path, string_agg(occ_key, ' ' ORDER BY occ_key) AS digest FROM m GROUP BY snapshot_id, path),
a AS (SELECT p.snapshot_id, path, digest FROM p JOIN f USING (snapshot_id)), b AS (SELECT p.snapshot_id, path, digest FROM p JOIN f ON f.snapshot_id = parent_id),
c AS (SELECT snapshot_id, path, CASE WHEN b.digest IS NULL THEN 'A' WHEN a.digest IS NULL THEN 'D' ELSE 'M' END AS status FROM a FULL JOIN b USING (snapshot_id, path) WHERE a.digest IS DISTINCT FROM b.digest)"""


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(snapshot_id, parent_id) of incremental snapshots, and (snapshot_id, path, occ_key) of all listings."""
    known = read_table(spark, d, "snapshots").filter("mode = 'incremental'").select("snapshot_id", "repo", "commit_sha", "parent_sha").distinct()
    parents = known.select("repo", F.col("commit_sha").alias("parent_sha"), F.col("snapshot_id").alias("parent_id"))
    pairs = known.join(parents, ["repo", "parent_sha"]).filter("snapshot_id != parent_id").select("snapshot_id", "parent_id").distinct()
    return pairs, durable(_listing(spark, d, "path").select("snapshot_id", "path", "occ_key").distinct())


def _changed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The change feed of every increment, the parent's listing and the own one, under the increment's id."""
    pairs, listed = _pairs(spark, d)
    own = listed.join(pairs.select("snapshot_id"), "snapshot_id", "left_semi")
    before = pairs.join(listed.withColumnRenamed("snapshot_id", "parent_id"), "parent_id").select("snapshot_id", "path", "occ_key")

    def manifest(rows: DataFrame) -> DataFrame:
        mixed = F.xxhash64("occ_key")
        return rows.groupBy("snapshot_id", "path").agg(F.struct(F.bit_xor(mixed), F.count(F.lit(1))).alias("digest"))

    return indexing.changes_between(manifest(before), manifest(own), ["snapshot_id"]), before, own


@query("index_changes", f"WITH {PAIRS_SQL} SELECT snapshot_id, status, path FROM c")
def index_changes(spark: SparkSession, d: str) -> DataFrame:
    """Files added, modified and deleted by every increment."""
    return _changed(spark, d)[0].select("snapshot_id", "status", F.col("new_path").alias("path"))


@query("index_incremental", f"WITH {PAIRS_SQL} SELECT snapshot_id, occ_key FROM m WHERE snapshot_id IN (SELECT snapshot_id FROM p)")
def index_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Every increment's listing, made of the parent's one and the files changed; the SQL has the full listing."""
    feed, before, own = _changed(spark, d)
    feed = durable(feed)
    dropped = feed.select("snapshot_id", F.col("old_path").alias("path"))
    extracted = own.join(feed.filter("status != 'D'").select("snapshot_id", F.col("new_path").alias("path")), ["snapshot_id", "path"], "left_semi")
    return indexing.incremental_listing(before, dropped, extracted, ["snapshot_id"])


@query("index_new_occurrences", f"WITH {PAIRS_SQL} SELECT p.snapshot_id, count(*) AS added FROM p JOIN m USING (snapshot_id) WHERE (parent_id, occ_key) NOT IN (SELECT (snapshot_id, occ_key) FROM m) GROUP BY p.snapshot_id")
def index_new_occurrences(spark: SparkSession, d: str) -> DataFrame:
    _, before, own = _changed(spark, d)
    return own.select("snapshot_id", "occ_key").subtract(before.select("snapshot_id", "occ_key")).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("added"))


@query("index_full_differs", f"""WITH {KNOWN_SQL}, m AS (SELECT DISTINCT snapshot_id, occ_key FROM memberships), p AS (SELECT DISTINCT c.snapshot_id AS one, b.snapshot_id AS two FROM k c JOIN k b ON c.repo = b.repo AND c.snapshot_id <> b.snapshot_id AND (c.commit_sha = b.commit_sha AND c.mode < b.mode OR c.mode = b.mode AND c.parent_sha = b.commit_sha)),
x AS (SELECT one, two, occ_key FROM p JOIN m ON snapshot_id = one), y AS (SELECT one, two, occ_key FROM p JOIN m ON snapshot_id = two)
SELECT one, two, count(*) FILTER (b IS NULL) AS only_one, count(*) FILTER (a IS NULL) AS only_two FROM (SELECT one, two, x.occ_key AS a, y.occ_key AS b FROM x FULL JOIN y USING (one, two, occ_key)) WHERE a IS NULL OR b IS NULL GROUP BY one, two""")
def index_full_differs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of snapshots whose listings differ, with the occurrences that only one has.

    Compared are the full and the incremental listing of a commit, and each snapshot with its parent's of its mode; in
    the given tables the first never differ.
    """
    known = versions.known_snapshots(read_table(spark, d, "snapshots")).select("snapshot_id", "repo", "commit_sha", "parent_sha", "mode")
    other = known.select("repo", F.col("commit_sha").alias("other_commit"), F.col("mode").alias("other_mode"), F.col("snapshot_id").alias("two"))
    same_commit = known.join(other.withColumnRenamed("other_commit", "commit_sha"), ["repo", "commit_sha"]).filter("mode < other_mode")
    parent = known.join(other.withColumnsRenamed({"other_commit": "parent_sha", "other_mode": "mode"}), ["repo", "mode", "parent_sha"])
    pairs = durable(same_commit.select(F.col("snapshot_id").alias("one"), "two").unionByName(parent.select(F.col("snapshot_id").alias("one"), "two")).filter("one != two").distinct())
    listed = read_table(spark, d, "memberships").distinct()
    sides = [pairs.join(listed.withColumnRenamed("snapshot_id", s), s).select("one", "two", "occ_key") for s in ("one", "two")]
    apart = [x.subtract(y).withColumn("side", F.lit(n)) for n, (x, y) in enumerate((sides, sides[::-1]))]
    return apart[0].unionByName(apart[1]).groupBy("one", "two").agg(F.count_if(F.col("side") == 0).alias("only_one"), F.count_if(F.col("side") == 1).alias("only_two"))


@query("index_numbered_symbols", "SELECT path, CASE WHEN n > 1 THEN symbol || '#' || n ELSE symbol END AS symbol, start_line, end_line FROM (SELECT *, row_number() OVER (PARTITION BY path, symbol ORDER BY start_line, end_line) AS n FROM (SELECT DISTINCT path, symbol, start_line, end_line FROM occurrences))")
def index_numbered_symbols(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "occurrences").select("path", "symbol", "start_line", "end_line").distinct()
    return indexing.number_symbols(rows, ["path"])


@query("store_missing", "SELECT content_key FROM contents WHERE content_key NOT IN (SELECT content_key FROM occurrences JOIN memberships USING (occ_key))")
def store_missing(spark: SparkSession, d: str) -> DataFrame:
    """Contents that no listing uses: what an insert-or-ignore of all contents would add to those in use."""
    contents, occurrences, memberships = _tables(spark, d, "contents", "occurrences", "memberships")
    used = occurrences.join(memberships.select("occ_key"), "occ_key", "left_semi")
    return indexing.missing(contents.select("content_key"), used, "content_key")


@query("store_by_keys", "SELECT occ_key, code FROM occurrences JOIN contents USING (content_key) WHERE occ_key IN (SELECT occ_key FROM memberships)")
def store_by_keys(spark: SparkSession, d: str) -> DataFrame:
    """Codes of a set of occurrence keys, however many."""
    contents, occurrences, memberships = _tables(spark, d, "contents", "occurrences", "memberships")
    return occurrences.join(memberships.select("occ_key"), "occ_key", "left_semi").join(contents, "content_key").select("occ_key", "code")


@query("extract_functions")
def extract_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions and callees found in every content; no SQL parses code, tests hold it against fixtures."""
    files = read_table(spark, d, "contents").select("content_key", F.concat("content_key", F.lit(".js")).alias("path"), F.col("code").alias("source"))
    return extract.extract_snippets(files, ["content_key"]).select("content_key", "symbol", "start_line", "end_line", "callees")
