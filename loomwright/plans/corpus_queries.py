"""Queries over the corpus track: text functions, search, fusion, metrics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import hashing, text, tokenize, vectors, views
from loomwright.operators import bm25, dense, fusion, metrics, report, topk
from loomwright.operators.order import positions
from loomwright.plans.evaluate import evaluate, load_split
from loomwright.plans.sql import bm25_ctes, dense_ctes, hash_ctes, token_ctes, view_ctes
from loomwright.session import durable
from loomwright.sources.tables import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Evaluations look as deep as what they report.
EVALUATION_DEPTH = 200
SETS_DEPTH = 1000


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL if given."""

    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


SPLIT_SQL = """
j AS (SELECT qid, doc_id, max(coalesce(rel, 0)) AS rel FROM qrels JOIN queries USING (qid) WHERE split = 'train' GROUP BY qid, doc_id),
q AS (SELECT qid, text FROM queries WHERE qid IN (SELECT qid FROM j))"""


@query("split_load", f"WITH {SPLIT_SQL} SELECT qid, text, n_judged FROM q JOIN (SELECT qid, count(*) AS n_judged FROM j GROUP BY qid) USING (qid)")
def split_load(spark: SparkSession, d: str) -> DataFrame:
    asked, judged = load_split(read_table(spark, d, "queries"), read_table(spark, d, "qrels"), "train")
    return asked.join(judged.groupBy("qid").agg(F.count(F.lit(1)).alias("n_judged")), "qid")


@query("filter_contest_style", "SELECT qid FROM queries WHERE regexp_matches(text, '(?im)^\\s*-*\\s*input\\s*-*\\s*:?\\s*$') AND NOT contains(text, '```python')")
def filter_contest_style(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "queries").filter(text.is_contest_style(F.col("text"))).select("qid")


FOLD_SQL = "list_sum(list_transform(string_split(sha256(qid), ''), lambda c: strpos('0123456789abcdef', c) - 1)) % 5"


@query("filter_folds", f"SELECT qid, CAST({FOLD_SQL} AS INTEGER) AS fold FROM queries WHERE {FOLD_SQL} IN (0, 3)")
def filter_folds(spark: SparkSession, d: str) -> DataFrame:
    folded = read_table(spark, d, "queries").select("qid", hashing.fold(F.col("qid")).alias("fold"))
    return folded.filter(F.col("fold").isin(0, 3))


@query("fn_tokens", f"WITH {token_ctes('t', 'corpus', 'doc_id', 'text')} SELECT doc_id, token, tf FROM t")
def fn_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.token_counts(read_table(spark, d, "corpus"), ["doc_id"], "text")


@query("fn_token_totals", f"WITH {token_ctes('t', 'documents', 'doc_id', 'text')} SELECT d.doc_id, CAST(coalesce(sum(tf), 0) AS BIGINT) AS n FROM documents d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id")
def fn_token_totals(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", F.coalesce(F.size(tokenize.tokens(F.col("text"))), F.lit(0)).cast("long").alias("n"))


@query("fn_core_view", f"WITH {view_ctes('v', 'queries', 'qid', 'text', True)} SELECT qid, view FROM v")
def fn_core_view(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "queries").filter("text IS NOT NULL").select("qid", views.core_view(F.col("text")).alias("view"))


@query("fn_core2_view", f"WITH {view_ctes('v', 'queries', 'qid', 'text', False)} SELECT qid, view FROM v")
def fn_core2_view(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "queries").filter("text IS NOT NULL").select("qid", views.core2_view(F.col("text")).alias("view"))


FENCED_SQL = "fenced AS (SELECT doc_id, 'Complete this:' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'and call it.' || chr(10) || '```' || chr(10) || split_part(text, chr(10), 1) || chr(10) || '```' AS text FROM corpus)"


@query("fn_starter_code", f"WITH {FENCED_SQL}, {view_ctes('v', 'fenced', 'doc_id', 'text', False)} SELECT doc_id, starter FROM v_f WHERE starter <> ''")
def fn_starter_code(spark: SparkSession, d: str) -> DataFrame:
    """Starter code of statements; no given text has a fence, so every solution is put into a statement with two of them."""
    first = F.split("text", "\n")[0]
    fenced = F.concat(F.lit("Complete this:\n```python\n"), "text", F.lit("\n```\nand call it.\n```\n"), first, F.lit("\n```"))
    return read_table(spark, d, "corpus").select("doc_id", views.starter_code(fenced).alias("starter")).filter("starter != ''")


@query("fn_sections", f"WITH {view_ctes('v', 'queries', 'qid', 'text', False)} SELECT section, count(*) AS n, count(DISTINCT qid) AS texts FROM v_s WHERE section IS NOT NULL GROUP BY section")
def fn_sections(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "queries").select("qid", F.explode(F.split(F.regexp_replace("text", views.FENCE, "\n"), "\n")).alias("line"))
    named = lines.select("qid", views.section_name(F.col("line")).alias("section")).filter("section IS NOT NULL")
    return named.groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("qid").alias("texts"))


@query("fn_word_counts", "SELECT qid, len(list_filter(regexp_split_to_array(text, '[\\s\\x0b]+'), lambda w: w <> '')) AS words, regexp_matches(text, '`[^`]+`|\\b[a-z]+_[a-z_]+\\b|\\b[a-z]+[A-Z][A-Za-z]+\\b|\\bdef \\w+|\\bclass \\w+') AS identifiers FROM queries WHERE text IS NOT NULL")
def fn_word_counts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "queries").filter("text IS NOT NULL").select("qid", text.word_count(F.col("text")).cast("long").alias("words"), text.has_identifier(F.col("text")).alias("identifiers"))


@query("fn_snippet_head", "SELECT content_key, array_to_string(list_transform(string_split(code, chr(10))[1:3], lambda x: '    ' || x), chr(10)) || CASE WHEN len(string_split(code, chr(10))) > 3 THEN chr(10) || '    …' ELSE '' END AS head FROM contents")
def fn_snippet_head(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "contents").select("content_key", text.snippet_head(F.col("code"), 3).alias("head"))


@query("fn_numeric_order", "SELECT qid, row_number() OVER (ORDER BY TRY_CAST(n AS BIGINT) IS NULL, TRY_CAST(n AS BIGINT), n) AS place, n FROM (SELECT qid, CASE WHEN length(qid) % 2 = 0 THEN substr(qid, 2) ELSE qid END AS n FROM queries)")
def fn_numeric_order(spark: SparkSession, d: str) -> DataFrame:
    n = F.when(F.length("qid") % 2 == 0, F.expr("substr(qid, 2)")).otherwise(F.col("qid")).alias("n")
    ids = read_table(spark, d, "queries").select("qid", n)
    return positions(ids, text.numeric_first(F.col("n")))


@query("fn_hash_embedding", f"WITH {token_ctes('t', 'corpus', 'doc_id', 'text')}, {hash_ctes('h', 't', 'doc_id')} SELECT doc_id, slot, round(v, 9) AS value FROM h")
def fn_hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    return vectors.hashed_terms(read_table(spark, d, "corpus"), ["doc_id"], "text").select("doc_id", "slot", F.round("value", 9).alias("value"))


@query("fn_normalise", """WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * 3 * y::DOUBLE * 3))) AS norm FROM embeddings)
SELECT vec_id, CAST(pos - 1 AS INTEGER) AS place, round(x::DOUBLE * 3 / norm, 6) AS value FROM (SELECT vec_id, norm, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM n)""")
def fn_normalise(spark: SparkSession, d: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: x.cast("double") * 3)
    units = read_table(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.normalise(scaled)).alias("place", "value"))
    return units.withColumn("value", F.round("value", 6))


BM25_SQL = f"""WITH {token_ctes('dt', 'corpus', 'doc_id', 'text')}, {token_ctes('qt', 'queries', 'qid', 'text')},
{bm25_ctes('s', 'corpus', 'doc_id', 'dt', 'qt', k=10)} SELECT qid, 'bm25' AS source, doc_id, CAST(rank AS INTEGER) AS rank, score FROM s"""


@query("search_bm25", BM25_SQL)
def search_bm25(spark: SparkSession, d: str) -> DataFrame:
    postings = bm25.bm25_index(read_table(spark, d, "corpus"), "doc_id", "text")
    return bm25.bm25_search(read_table(spark, d, "queries"), "qid", "text", postings, "doc_id", 10)


@query("search_bm25_core_view", f"""WITH {view_ctes('v', 'queries', 'qid', 'text', True)}, {token_ctes('dt', 'corpus', 'doc_id', 'text')}, {token_ctes('qt', 'v', 'qid', 'view')},
{bm25_ctes('s', 'corpus', 'doc_id', 'dt', 'qt', k=10)} SELECT qid, 'bm25:core' AS source, doc_id, CAST(rank AS INTEGER) AS rank, score FROM s""")
def search_bm25_core_view(spark: SparkSession, d: str) -> DataFrame:
    postings = bm25.bm25_index(read_table(spark, d, "corpus"), "doc_id", "text")
    viewed = read_table(spark, d, "queries").select("qid", views.core_view(F.col("text")).alias("text"))
    return bm25.bm25_search(viewed, "qid", "text", postings, "doc_id", 10, "bm25:core")


@query("search_dense_vectors", """WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS doc_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS score
FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT qid, 'dense' AS source, doc_id, CAST(rank AS INTEGER) AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def search_dense_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all."""
    rows = read_table(spark, d, "embeddings")
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return dense.dense_search(asked, "qid", rows.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "embedding", 10, other_than_self=True)


HASH_SQL = f"""{token_ctes('dt', 'corpus', 'doc_id', 'text')}, {token_ctes('qt', 'queries', 'qid', 'text')},
{hash_ctes('dh', 'dt', 'doc_id')}, {hash_ctes('qh', 'qt', 'qid')}"""


@query("search_dense_text", f"WITH {HASH_SQL}, {dense_ctes('s', 'corpus', 'doc_id', 'queries', 'dh', 'qh', 10)} SELECT qid, 'hash256' AS source, doc_id, CAST(rank AS INTEGER) AS rank, score FROM s")
def search_dense_text(spark: SparkSession, d: str) -> DataFrame:
    docs = vectors.hash_embedding(read_table(spark, d, "corpus"), ["doc_id"], "text")
    asked = vectors.hash_embedding(read_table(spark, d, "queries"), ["qid"], "text")
    return dense.dense_search(asked, "qid", docs, "doc_id", "vec", 10, "hash256")


LATEST_SQL = """
valid AS (SELECT * FROM candidates WHERE score IS NOT NULL AND NOT isnan(score)),
latest AS (SELECT run_id, qid, source, snippet_id AS doc_id, score FROM valid
  QUALIFY row_number() OVER (PARTITION BY run_id, qid, source, snippet_id ORDER BY scored_at DESC NULLS LAST, score DESC) = 1),
lists AS (SELECT *, row_number() OVER (PARTITION BY run_id, qid, source ORDER BY score DESC, doc_id) AS rank FROM latest)"""


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """Delivered candidate lists: the latest score of each document, ranked again."""
    rows = read_table(spark, d, "candidates").filter("score IS NOT NULL AND NOT isnan(score)")
    latest = rows.groupBy("run_id", "qid", "source", F.col("snippet_id").alias("doc_id")).agg(F.max(F.struct("scored_at", "score")).alias("s"))
    return topk.top_k(latest.select("run_id", "qid", "source", "doc_id", F.col("s.score").alias("score")), ["run_id", "qid", "source"], "score", "doc_id", None)


RRF_SQL = """
fused AS (SELECT run_id, qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM lists GROUP BY run_id, qid, doc_id),
run AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id, qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM fused)"""


@query("fuse_rrf", f"WITH {LATEST_SQL}, {RRF_SQL} SELECT run_id, qid, doc_id, score, rank FROM run")
def fuse_rrf(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(_lists(spark, d), ["run_id", "qid"], "doc_id")


@query("fuse_rrf_weighted", f"""WITH {LATEST_SQL}, f AS (SELECT run_id, qid, doc_id, round(sum(CASE source WHEN 'cross' THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END / (60 + rank)), 9) AS score FROM lists WHERE source IN ('cross', 'hits') GROUP BY run_id, qid, doc_id)
SELECT run_id, qid, doc_id, score, CAST(row_number() OVER (PARTITION BY run_id, qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f""")
def fuse_rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(_lists(spark, d), ["run_id", "qid"], "doc_id", {"cross": 2.0, "hits": 0.5})


@query("fuse_zscore", f"""WITH {LATEST_SQL}, st AS (SELECT run_id, qid, source, avg(score) AS mean, CASE WHEN min(score) = max(score) THEN 1.0 ELSE stddev_pop(score) END AS sd, min(score) AS low FROM latest GROUP BY ALL),
base AS (SELECT run_id, qid, sum((low - mean) / sd) AS base FROM st GROUP BY ALL),
f AS (SELECT run_id, qid, doc_id, round(sum((score - low) / sd) + any_value(base), 6) AS score FROM latest JOIN st USING (run_id, qid, source) JOIN base USING (run_id, qid) GROUP BY ALL)
SELECT run_id, qid, doc_id, score, CAST(row_number() OVER (PARTITION BY run_id, qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f""")
def fuse_zscore(spark: SparkSession, d: str) -> DataFrame:
    return fusion.zscore(_lists(spark, d), ["run_id", "qid"], "doc_id")


@query("fuse_none", f"WITH {LATEST_SQL} SELECT run_id, qid, doc_id, score, CAST(rank AS INTEGER) AS rank FROM lists WHERE source = 'cross'")
def fuse_none(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(_lists(spark, d), ["run_id", "qid"], "doc_id", ["cross"], None)


JUDGED_SQL = "j AS (SELECT qid, doc_id, max(coalesce(rel, 0)) AS rel FROM qrels JOIN (SELECT qid FROM queries) USING (qid) GROUP BY qid, doc_id)"


def scored_sql(run: str, keys: str) -> str:
    """CTEs that end in `scored`(keys, qid, gold_rank, ndcg10) of a ranked table against j."""
    k = f"{keys}, " if keys else ""
    every = f"(SELECT DISTINCT {keys} FROM {run}) CROSS JOIN" if keys else ""
    return f"""
ideal AS (SELECT qid, sum(rel / log2(r + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS r FROM j WHERE rel > 0) WHERE r <= 10 GROUP BY qid),
met AS (SELECT {k}qid, min(rank) AS gold_rank, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) END) AS dcg FROM {run} JOIN j USING (qid, doc_id) WHERE rel > 0 GROUP BY {k}qid),
scored AS (SELECT {k}qid, gold_rank, round(coalesce(dcg / ideal, 0), 6) AS ndcg10 FROM {every} (SELECT DISTINCT qid FROM j) LEFT JOIN ideal USING (qid) LEFT JOIN met USING ({k}qid))"""


AGGREGATE_SQL = "count(*) AS n_queries, round(avg(ndcg10), 6) AS ndcg_at_10, " + ", ".join(f"round(avg(CASE WHEN gold_rank <= {k} THEN 1.0::DOUBLE / gold_rank ELSE 0 END), 6) AS mrr_at_{k}" for k in (10, 100)) + ", " + ", ".join(f"round(avg(CASE WHEN gold_rank <= {k} THEN 1 ELSE 0 END), 6) AS recall_at_{k}" for k in (1, 5, 10, 50, 100, 200))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    known = read_table(spark, d, "queries").select("qid")
    return metrics.judgments(read_table(spark, d, "qrels").join(known, "qid", "left_semi"))


@query("metrics_per_query", f"WITH {LATEST_SQL}, {RRF_SQL}, {JUDGED_SQL}, {scored_sql('run', 'run_id')} SELECT run_id, qid, gold_rank, ndcg10 FROM scored")
def metrics_per_query(spark: SparkSession, d: str) -> DataFrame:
    return metrics.per_query(durable(fuse_rrf(spark, d)), _judged(spark, d), ["run_id"])


@query("metrics_aggregate", f"WITH {LATEST_SQL}, {RRF_SQL}, {JUDGED_SQL}, {scored_sql('run', 'run_id')} SELECT run_id, {AGGREGATE_SQL} FROM scored GROUP BY run_id")
def metrics_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return metrics.aggregate(metrics_per_query(spark, d), ["run_id"])


@query("metrics_per_source", f"WITH {LATEST_SQL}, {JUDGED_SQL}, {scored_sql('lists', 'run_id, source')} SELECT run_id, source, {AGGREGATE_SQL} FROM scored GROUP BY run_id, source")
def metrics_per_source(spark: SparkSession, d: str) -> DataFrame:
    return metrics.aggregate(metrics.per_query(durable(_lists(spark, d)), _judged(spark, d), ["run_id", "source"]), ["run_id", "source"])


@query("metrics_bottleneck", f"WITH {LATEST_SQL}, {RRF_SQL}, {JUDGED_SQL}, {scored_sql('run', 'run_id')} SELECT count(*) FILTER (coalesce(gold_rank, 1000000) > 10) AS n_miss_at_10, count(*) FILTER (coalesce(gold_rank, 1000000) > 100) AS absent_from_top100, count(*) FILTER (gold_rank > 10 AND gold_rank <= 100) AS in_top100_ranked_low FROM scored")
def metrics_bottleneck(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bottleneck(metrics_per_query(spark, d))


@query("metrics_sets", f"""WITH {token_ctes('dt', 'corpus', 'doc_id', 'text')}, {token_ctes('qt', 'queries', 'qid', 'text')}, {bm25_ctes('s', 'corpus', 'doc_id', 'dt', 'qt', k=SETS_DEPTH)}, {JUDGED_SQL},
hit AS (SELECT qid, rank, row_number() OVER (PARTITION BY qid ORDER BY rank) AS nth FROM s JOIN j USING (qid, doc_id) WHERE rel > 0),
tot AS (SELECT qid, count(*) AS total FROM j WHERE rel > 0 GROUP BY qid), ks AS (SELECT unnest([1, 3, 5, 10, 20, 100, 1000]) AS k),
g AS (SELECT tot.qid, total, k, count(nth) AS hits, coalesce(sum(nth / rank), 0) AS ap FROM tot CROSS JOIN ks LEFT JOIN hit ON hit.qid = tot.qid AND hit.rank <= k GROUP BY ALL)
SELECT k, round(avg(ap / least(total, k)), 6) AS map, round(avg(hits / k), 6) AS precision, round(avg(hits / total), 6) AS recall, round(avg(CASE WHEN hits > 0 THEN 1 ELSE 0 END), 6) AS hit_rate FROM g GROUP BY k""")
def metrics_sets(spark: SparkSession, d: str) -> DataFrame:
    postings = bm25.bm25_index(read_table(spark, d, "corpus"), "doc_id", "text")
    run = bm25.bm25_search(read_table(spark, d, "queries"), "qid", "text", postings, "doc_id", SETS_DEPTH)
    return metrics.set_metrics(run, _judged(spark, d))


HYBRID = {"run_id": "hybrid", "split": "train", "retrievers": [{"type": "dense", "model": "hash256"}, {"type": "bm25"}], "fusion": {"method": "rrf", "k": 60}, "depth": EVALUATION_DEPTH}
LEXICAL = {"run_id": "lexical", "split": "train", "retrievers": [{"type": "bm25"}], "fusion": None, "depth": EVALUATION_DEPTH}


def _evaluated(spark: SparkSession, d: str, config: dict, known: dict | None = None):
    return evaluate(config, *(read_table(spark, d, t) for t in ("corpus", "queries", "qrels")), known)


EVAL_SQL = f"""{SPLIT_SQL}, {token_ctes('dt', 'corpus', 'doc_id', 'text')}, {token_ctes('qt', 'q', 'qid', 'text')}, {hash_ctes('dh', 'dt', 'doc_id')}, {hash_ctes('qh', 'qt', 'qid')},
{dense_ctes('near', 'corpus', 'doc_id', 'q', 'dh', 'qh', EVALUATION_DEPTH)}, {bm25_ctes('lex', 'corpus', 'doc_id', 'dt', 'qt', k=EVALUATION_DEPTH)},
cand AS (SELECT qid, 'hash256' AS source, doc_id, rank, score FROM near UNION ALL SELECT qid, 'bm25', doc_id, rank, score FROM lex),
ev AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM cand GROUP BY qid, doc_id),
run AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM ev), {scored_sql('run', '')},
gold AS (SELECT qid, min(doc_id) AS gold FROM j JOIN (SELECT qid, max(rel) AS rel FROM j GROUP BY qid) USING (qid, rel) GROUP BY qid)"""


@query("evaluate_hybrid", f"WITH {EVAL_SQL} SELECT {AGGREGATE_SQL} FROM scored")
def evaluate_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d, HYBRID).metrics


@query("evaluate_report", f"""WITH {EVAL_SQL},
top AS (SELECT qid, list(doc_id ORDER BY rank) AS top5 FROM run WHERE rank <= 5 GROUP BY qid),
src AS (SELECT a.qid, string_agg(a.source || ':' || coalesce(CAST(g.rank AS VARCHAR), '-'), ' ' ORDER BY a.source) AS sources FROM (SELECT qid, source FROM cand WHERE rank = 1) a JOIN gold USING (qid) LEFT JOIN cand g ON g.qid = a.qid AND g.source = a.source AND g.doc_id = gold GROUP BY a.qid)
SELECT s.qid, gold, gold_rank AS rank, round(ndcg10, 4) AS ndcg10, coalesce(gold_rank <= 10, false) AS hit10, coalesce(gold_rank <= 200, false) AS hit200, array_to_string(top5, ' ') AS top5, sources,
  len(list_filter(regexp_split_to_array(q.text, '[\\s\\x0b]+'), lambda w: w <> '')) AS query_words, len(list_filter(regexp_split_to_array(c.text, '[\\s\\x0b]+'), lambda w: w <> '')) AS gold_words
FROM scored s JOIN gold USING (qid) LEFT JOIN top USING (qid) LEFT JOIN src USING (qid) LEFT JOIN q USING (qid) LEFT JOIN corpus c ON c.doc_id = gold""")
def evaluate_report(spark: SparkSession, d: str) -> DataFrame:
    rows = _evaluated(spark, d, HYBRID).report
    entries = F.transform(F.array_sort(F.map_entries("sources")), lambda e: F.concat(e["key"], F.lit(":"), F.coalesce(e["value"]["rank"].cast("string"), F.lit("-"))))
    return rows.select("qid", "gold", F.col("rank").cast("long").alias("rank"), "ndcg10", F.col("hit@10").alias("hit10"), F.col("hit@200").alias("hit200"), F.array_join("top5", " ").alias("top5"), F.array_join(entries, " ").alias("sources"), F.col("query_words").cast("long").alias("query_words"), F.col("gold_words").cast("long").alias("gold_words"))


LEX_SQL = f"""{SPLIT_SQL}, {token_ctes('dt', 'corpus', 'doc_id', 'text')}, {token_ctes('qt', 'q', 'qid', 'text')}, {bm25_ctes('lex', 'corpus', 'doc_id', 'dt', 'qt', k=EVALUATION_DEPTH)}, {scored_sql('lex', '')}"""
PAIR_SQL = f"""WITH base AS (WITH {LEX_SQL} SELECT qid, gold_rank AS rank, round(ndcg10, 4) AS ndcg FROM scored), new AS (WITH {EVAL_SQL} SELECT qid, gold_rank AS rank, round(ndcg10, 4) AS ndcg FROM scored),
p AS (SELECT qid, CAST({FOLD_SQL} AS INTEGER) AS fold, b.rank AS br, n.rank AS nr, b.ndcg AS bn, n.ndcg AS nn FROM base b JOIN new n USING (qid)),
f AS (SELECT fold, count(*) AS n, round(avg(nn - bn), 6) AS d_ndcg, round(avg(CASE WHEN nr <= 10 THEN 1.0::DOUBLE / nr ELSE 0 END - CASE WHEN br <= 10 THEN 1.0::DOUBLE / br ELSE 0 END), 6) AS d_mrr FROM p GROUP BY fold)"""


def _reports(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What comparisons read of the two reports; both configurations share the list of the retriever they both have."""
    known: dict[str, DataFrame] = {}
    scored = (_evaluated(spark, d, c, known).per_query for c in (LEXICAL, HYBRID))
    return tuple(durable(s.select("qid", F.col("gold_rank").alias("rank"), F.round("ndcg10", 4).alias("ndcg10"))) for s in scored)


@query("compare_folds", f"{PAIR_SQL} SELECT fold, n, d_ndcg, d_mrr FROM f")
def compare_folds(spark: SparkSession, d: str) -> DataFrame:
    return report.compare_by_fold(*_reports(spark, d))


@query("compare_summary", f"""{PAIR_SQL} SELECT round((SELECT avg(d_ndcg) FROM f), 6) AS mean_d_ndcg, round((SELECT stddev_samp(d_ndcg) FROM f), 6) AS fold_sd, (SELECT count(*) FROM f WHERE d_ndcg > 0) AS folds_improved,
count(*) FILTER (nn > bn) AS better, count(*) FILTER (nn < bn) AS worse, count(*) FILTER (coalesce(nr <= 10, false) AND NOT coalesce(br <= 10, false)) AS entered, count(*) FILTER (coalesce(br <= 10, false) AND NOT coalesce(nr <= 10, false)) AS "left" FROM p""")
def compare_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.compare_summary(*_reports(spark, d))


@query("compare_regressions", f"{PAIR_SQL} SELECT qid, br AS base_rank, nr AS new_rank FROM p WHERE br <= 10 AND coalesce(nr, 1000000) > 10 ORDER BY qid LIMIT 8")
def compare_regressions(spark: SparkSession, d: str) -> DataFrame:
    rows = report.regressions(*_reports(spark, d))
    return rows.select("qid", F.col("base_rank").cast("long").alias("base_rank"), F.col("new_rank").cast("long").alias("new_rank"))


WORDS_SQL = "len(list_filter(regexp_split_to_array({}, '[\\s\\x0b]+'), lambda w: w <> ''))"
IDENTIFIER_SQL = "regexp_matches(text, '`[^`]+`|\\b[a-z]+_[a-z_]+\\b|\\b[a-z]+[A-Z][A-Za-z]+\\b|\\bdef \\w+|\\bclass \\w+')"


@query("miss_buckets", f"""WITH {EVAL_SQL},
rep AS (SELECT s.qid, s.gold_rank, q.text, {WORDS_SQL.format('q.text')} AS words, coalesce({WORDS_SQL.format('c.text')}, 0) AS gold_words, coalesce((SELECT bool_or(x.rank <= 10) FROM cand x WHERE x.qid = s.qid AND x.doc_id = g.gold), false) AS somewhere
  FROM scored s JOIN gold g USING (qid) JOIN q USING (qid) LEFT JOIN corpus c ON c.doc_id = g.gold),
cut AS (SELECT quantile_cont(words, 0.75) AS words FROM rep), miss AS (SELECT * FROM rep WHERE coalesce(gold_rank, 1000000) > 10),
b AS (SELECT qid, 'candidate: absent from fused top100' AS bucket FROM miss WHERE coalesce(gold_rank, 1000000) > 100
  UNION ALL SELECT qid, 'ranking: in top100, ranked >10' FROM miss WHERE gold_rank <= 100
  UNION ALL SELECT qid, 'fusion loss: some source had it in top10' FROM miss WHERE somewhere
  UNION ALL SELECT qid, 'long query (>p75 words)' FROM miss WHERE words > (SELECT words FROM cut)
  UNION ALL SELECT qid, 'query has identifiers/starter code' FROM miss WHERE {IDENTIFIER_SQL}
  UNION ALL SELECT qid, 'very short gold snippet (<15 words)' FROM miss WHERE gold_words < 15)
SELECT bucket, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM miss), 1) AS percent, array_to_string((list(qid ORDER BY qid))[1:4], ' ') AS examples FROM b GROUP BY bucket""")
def miss_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Why queries missed; the encoder of the configuration has no longest sequence, so nothing is truncated."""
    found = report.miss_buckets(durable(_evaluated(spark, d, HYBRID).report), read_table(spark, d, "queries"))
    return found.withColumn("examples", F.array_join("examples", " "))


TRUNCATING = HYBRID | {"retrievers": [{"type": "dense", "model": "hash256", "max_seq_length": 60}]} | {"fusion": None}


@query("report_truncation", f"""WITH {SPLIT_SQL}, gold AS (SELECT qid, min(doc_id) AS gold FROM j JOIN (SELECT qid, max(rel) AS rel FROM j GROUP BY qid) USING (qid, rel) GROUP BY qid),
{token_ctes('dt', 'corpus', 'doc_id', 'text')}, {token_ctes('qt', 'q', 'qid', 'text')}, a AS (SELECT qid, sum(tf) AS n FROM qt GROUP BY qid), b AS (SELECT doc_id, sum(tf) AS n FROM dt GROUP BY doc_id)
SELECT q.qid, CAST(CASE WHEN q.text IS NULL THEN NULL ELSE coalesce(a.n, 0) END AS INTEGER) AS query_tokens, CAST(coalesce(b.n, 0) AS INTEGER) AS gold_tokens, CASE WHEN q.text IS NULL THEN NULL ELSE coalesce(a.n, 0) > 60 END AS query_truncated, coalesce(b.n, 0) > 60 AS gold_truncated
FROM q JOIN gold USING (qid) LEFT JOIN a USING (qid) LEFT JOIN b ON b.doc_id = gold""")
def report_truncation(spark: SparkSession, d: str) -> DataFrame:
    """Token counts and truncation flags of an encoder that sees 60 tokens."""
    rows = _evaluated(spark, d, TRUNCATING).report
    return rows.select("qid", "query_tokens", "gold_tokens", "query_truncated", "gold_truncated")


@query("metrics_official", f"""WITH {LATEST_SQL}, {RRF_SQL}, {JUDGED_SQL}, r AS (SELECT qid, doc_id, rank FROM run WHERE run_id = (SELECT min(run_id) FROM run)), ks AS (SELECT unnest([1, 3, 5, 10, 20, 100, 1000]) AS k),
rel AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS i, count(*) OVER (PARTITION BY qid) AS total FROM j WHERE rel > 0),
hit AS (SELECT qid, rank, rel, row_number() OVER (PARTITION BY qid ORDER BY rank) AS nth FROM r JOIN rel USING (qid, doc_id)),
g AS (SELECT t.qid, t.total, k, t.ideal, count(nth) AS hits, coalesce(sum(nth / rank), 0) AS ap, coalesce(sum(rel / log2(rank + 1)), 0) AS dcg, min(rank) AS best
  FROM (SELECT qid, k, any_value(total) AS total, sum(rel / log2(i + 1)) FILTER (i <= k) AS ideal FROM rel, ks GROUP BY qid, k) t LEFT JOIN hit ON hit.qid = t.qid AND hit.rank <= k GROUP BY ALL)
SELECT k, round(avg(dcg / ideal), 6) AS ndcg, round(avg(coalesce(1.0::DOUBLE / best, 0)), 6) AS mrr, round(avg(ap / least(total, k)), 6) AS map, round(avg(hits / k), 6) AS precision, round(avg(hits / total), 6) AS recall, round(avg(CASE WHEN hits > 0 THEN 1 ELSE 0 END), 6) AS accuracy FROM g GROUP BY k""")
def metrics_official(spark: SparkSession, d: str) -> DataFrame:
    """The official family of metrics, by cut-off, of the first run by name, its lists fused."""
    lists = _lists(spark, d)
    first = lists.agg(F.min("run_id")).first()[0]
    run = durable(fusion.rrf(lists.filter(F.col("run_id") == first), ["run_id", "qid"], "doc_id"))
    return metrics.official_metrics(run, _judged(spark, d))


@query("sample_every_nth", """WITH o AS (SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS pos, count(*) OVER () AS c FROM queries)
SELECT qid FROM o WHERE pos % greatest(1, c // 20) = 0 AND pos < 20 * greatest(1, c // 20)""")
def sample_every_nth(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "queries").select("qid")
    return topk.every_nth(rows, [F.col("qid")], 20)


@query("first_by_number", """WITH k AS (SELECT DISTINCT doc_id FROM qrels WHERE rel > 0 AND split = 'test'), e AS (SELECT doc_id FROM corpus WHERE doc_id NOT IN (SELECT doc_id FROM k) ORDER BY CAST(substr(doc_id, 2) AS BIGINT) LIMIT 100)
SELECT doc_id FROM corpus WHERE doc_id IN (SELECT doc_id FROM k) UNION SELECT doc_id FROM e""")
def first_by_number(spark: SparkSession, d: str) -> DataFrame:
    """A small corpus: judged documents and the first others by number (the limit is the feature)."""
    corpus = read_table(spark, d, "corpus").select("doc_id")
    kept = read_table(spark, d, "qrels").filter("rel > 0 AND split = 'test'").select("doc_id").distinct()
    others = corpus.join(kept, "doc_id", "left_anti").orderBy(F.expr("CAST(substr(doc_id, 2) AS BIGINT)")).limit(100)
    return corpus.join(kept, "doc_id", "left_semi").union(others)


@query("score_percentiles", "SELECT source, count(*) AS n, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.95), 6) AS p95 FROM candidates WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY source")
def score_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "candidates").filter("score IS NOT NULL AND NOT isnan(score)")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.percentile("score", F.lit(p)), 6).alias(f"p{round(100 * p)}") for p in (0.5, 0.95)))
