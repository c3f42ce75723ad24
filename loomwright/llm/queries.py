"""Registered queries of this subpackage, and their SQL where SQL is feasible."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import normalfusion as nf
from loomwright.llm.groupjoin import expand_links, near_duplicate_groups, near_duplicate_links
from loomwright.llm.handwritten import foreign_files
from loomwright.llm.mixing import mix_sources
from loomwright.llm.normalfusion import fuse_normal_scores
from loomwright.llm.overlap import cross_split_overlaps, cut_records, expand_pairs, held_overlaps, record_shares
from loomwright.llm.packing import fill_containers, fill_report
from loomwright.llm.subjects import main_subjects, subject_shares
from loomwright.llm.tokens import token_counts
from loomwright.llm.topn import top_n_per_group
from loomwright.sources.tables import read_table


def _records_of_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Query texts and judged solution texts as (space, id, text, train, held)."""
    qrels = read_table(spark, folder, "qrels")
    split = [F.max(F.col("split") == "train").alias("train"), F.max(F.col("split").isin("valid", "test")).alias("held")]
    of_query = qrels.groupBy(F.col("qid").alias("id")).agg(*split)
    of_doc = qrels.filter("rel > 0").groupBy(F.col("doc_id").alias("id")).agg(*split)
    texts = read_table(spark, folder, "queries").select(F.col("qid").alias("id"), "text").join(of_query, "id")
    docs = of_doc.join(read_table(spark, folder, "corpus").select(F.col("doc_id").alias("id"), "text"), "id", "left").select("id", "text", "train", "held")
    return texts.withColumn("space", F.lit("query")).unionByName(docs.withColumn("space", F.lit("doc")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of an evaluation split that are also, exactly or almost, in the training split."""
    pairs = expand_pairs(*cross_split_overlaps(_records_of_splits(spark, folder)), itself=("doc",))
    return pairs.select(F.col("space").alias("kind"), "id_a", "id_b")


P1_FOUND_SQL = """
WITH r AS (
  SELECT 'query' AS kind, q.qid AS id, any_value(q.text) AS text, bool_or(split = 'train') AS t, bool_or(split IN ('valid', 'test')) AS h
  FROM qrels JOIN queries q USING (qid) GROUP BY q.qid
  UNION ALL
  SELECT 'doc', d.doc_id, any_value(d.text), bool_or(split = 'train'), bool_or(split IN ('valid', 'test'))
  FROM qrels JOIN corpus d USING (doc_id) WHERE rel > 0 GROUP BY d.doc_id),
w AS (SELECT kind, id, t, h, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM r WHERE text IS NOT NULL),
s AS (SELECT kind, id, t, h, unnest(list_distinct(list_transform(range(1, len(w) - 2), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3])))) AS run
      FROM w WHERE len(w) >= 4),
n AS (SELECT kind, id, count(*) AS n FROM s GROUP BY kind, id),
c AS (SELECT a.kind, a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b
      ON a.kind = b.kind AND a.run = b.run AND a.id < b.id AND ((a.t AND b.h) OR (a.h AND b.t)) GROUP BY a.kind, a.id, b.id)
SELECT c.kind, c.a AS id_a, c.b AS id_b
FROM c JOIN n x ON x.kind = c.kind AND x.id = c.a JOIN n y ON y.kind = c.kind AND y.id = c.b
WHERE c.c / least(x.n, y.n) >= 0.6
UNION ALL
SELECT 'doc', doc_id, doc_id FROM qrels WHERE rel > 0 GROUP BY doc_id
HAVING bool_or(split = 'train') AND bool_or(split IN ('valid', 'test'))
"""


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per evaluation split and query source: texts, texts found in the training split, and their mean overlap.

    A solution counts for the split and source of each query that it is judged for. Sources are told apart by
    lower-cased, trimmed name; a missing one, or that of a qid that is not in queries, is `unknown`. A text is found if
    another text of the training split overlaps with it, or if it is a solution judged in both.
    """
    pairs, members = cross_split_overlaps(_records_of_splits(spark, folder))
    best = held_overlaps(pairs, members, itself=("doc",))
    source = read_table(spark, folder, "queries").select("qid", F.lower(F.trim("source")).alias("source"), F.lit(True).alias("known"))
    judged = read_table(spark, folder, "qrels").filter("split IN ('valid', 'test')").join(source, "qid", "left")
    judged = judged.withColumn("source", F.coalesce("source", F.lit("unknown")))
    of_query = judged.filter("known").select("split", "source", F.lit("query").alias("space"), F.col("qid").alias("id"))
    of_doc = judged.filter("rel > 0").select("split", "source", F.lit("doc").alias("space"), F.col("doc_id").alias("id"))
    held = of_query.unionByName(of_doc).distinct().join(best, ["space", "id"], "left")
    shares = held.groupBy("split", "source", F.col("space").alias("kind")).agg(F.count(F.lit(1)).alias("texts"), F.count("overlap").alias("found"), F.round(F.avg("overlap"), 4).alias("mean_overlap"))
    return shares.withColumn("share_found", F.round(F.col("found") / F.col("texts"), 6))


P1_REPORT_SQL = P1_FOUND_SQL[: P1_FOUND_SQL.index("SELECT c.kind, c.a AS id_a")] + """,
o AS (SELECT c.kind, c.a, c.b, c.c / least(x.n, y.n) AS o FROM c JOIN n x ON x.kind = c.kind AND x.id = c.a JOIN n y ON y.kind = c.kind AND y.id = c.b WHERE c.c / least(x.n, y.n) >= 0.6),
e AS (SELECT kind, a AS id, b AS other, o FROM o UNION ALL SELECT kind, b, a, o FROM o
  UNION ALL SELECT 'doc', doc_id, doc_id, 1.0 FROM qrels WHERE rel > 0 GROUP BY doc_id HAVING bool_or(split = 'train') AND bool_or(split IN ('valid', 'test'))),
best AS (SELECT e.kind, e.id, max(o) AS o FROM e LEFT JOIN r ON r.kind = e.kind AND r.id = e.other WHERE e.id = e.other OR r.t GROUP BY e.kind, e.id),
j AS (SELECT split, qid, doc_id, rel, coalesce(lower(trim(source)), 'unknown') AS source, queries.qid IS NOT NULL AS known FROM (SELECT split, qid AS q, doc_id, rel FROM qrels WHERE split IN ('valid', 'test')) LEFT JOIN queries ON qid = q),
t AS (SELECT DISTINCT split, source, 'query' AS kind, qid AS id FROM j WHERE known UNION SELECT split, source, 'doc', doc_id FROM j WHERE rel > 0)
SELECT split, source, t.kind, count(*) AS texts, count(o) AS found, round(avg(o), 4) AS mean_overlap, round(count(o) / count(*), 6) AS share_found
FROM t LEFT JOIN best ON best.kind = t.kind AND best.id = t.id GROUP BY split, source, t.kind
"""


def p1_records(spark: SparkSession, folder: str) -> DataFrame:
    """How much of every text of the splits is in chunks, and in runs of four words, of another text of the training split."""
    shares = record_shares(cut_records(_records_of_splits(spark, folder)))
    return shares.select(F.col("space").alias("kind"), "id", "train", "held", "chunk_share", "run_share")


CODE_LETTERS = b"abcdefghijklmnopqrstuvwxyz0123456789_"


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of contents that share most of their text."""
    contents = read_table(spark, folder, "contents")
    links = expand_links(*near_duplicate_links(contents, "content_key", "code", 0.7, 3, CODE_LETTERS))
    return links.select(F.col("a").alias("content_key_a"), F.col("b").alias("content_key_b"))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every content with its group of near-duplicates and the number of its links."""
    return near_duplicate_groups(read_table(spark, folder, "contents"), "content_key", "code", 0.7, 3, CODE_LETTERS)


P3_FOUND_SQL = """
WITH w AS (SELECT content_key, regexp_extract_all(lower(code), '[a-z0-9_]+') AS w FROM contents WHERE code IS NOT NULL),
s AS (SELECT content_key, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])))) AS run
      FROM w WHERE len(w) >= 3),
n AS (SELECT content_key, count(*) AS n FROM s GROUP BY content_key),
c AS (SELECT a.content_key AS a, b.content_key AS b, count(*) AS c FROM s a JOIN s b ON a.run = b.run AND a.content_key < b.content_key
      GROUP BY a.content_key, b.content_key)
SELECT c.a AS content_key_a, c.b AS content_key_b
FROM c JOIN n x ON x.content_key = c.a JOIN n y ON y.content_key = c.b
WHERE c.c / (x.n + y.n - c.c) >= 0.7
"""


P3_GROUPS_SQL = P3_FOUND_SQL.replace("WITH w AS", "WITH RECURSIVE w AS").replace("SELECT c.a AS content_key_a, c.b AS content_key_b", ",l AS (SELECT c.a, c.b") + """),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT k.content_key, least(k.content_key, coalesce((SELECT min(b) FROM reach WHERE reach.a = k.content_key), k.content_key)) AS "group", (SELECT count(*) FROM e WHERE e.a = k.content_key) AS links FROM contents k
"""


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The five best snippets of every candidate list."""
    lists = read_table(spark, folder, "candidates")
    best = top_n_per_group(lists, ["run_id", "qid", "source"], "score", "snippet_id", 5, version="scored_at")
    return best.select("run_id", "qid", "source", "place", "snippet_id")


P4_FOUND_SQL = """
WITH valid AS (SELECT * FROM candidates WHERE score IS NOT NULL AND NOT isnan(score)),
latest AS (
  SELECT * FROM valid
  QUALIFY row_number() OVER (PARTITION BY run_id, qid, source, snippet_id ORDER BY scored_at DESC NULLS LAST, score DESC) = 1)
SELECT run_id, qid, source,
       CAST(row_number() OVER (PARTITION BY run_id, qid, source ORDER BY score DESC, snippet_id) AS INTEGER) AS place, snippet_id
FROM latest
QUALIFY row_number() OVER (PARTITION BY run_id, qid, source ORDER BY score DESC, snippet_id) <= 5
"""


def p5_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """One ranking of all snippets of every run and query; sources are weighted by the training split's judgments."""
    lists = read_table(spark, folder, "candidates")
    train = read_table(spark, folder, "qrels").filter("split = 'train' AND rel > 0").select("qid", F.col("doc_id").alias("snippet_id"))
    return fuse_normal_scores(lists, ["run_id", "qid"], "source", "snippet_id", "score", version="scored_at", judged=train)


def _inverse_sql(p: str) -> str:
    """inverse_normal(p) as SQL."""

    def poly(coefficients: list[float], x: str) -> str:
        return reduce(lambda v, c: f"({v} * {x} + {c!r}::DOUBLE)", coefficients[1:], f"{coefficients[0]!r}::DOUBLE")

    q, t = f"({p} - 0.5::DOUBLE)", f"sqrt(-2.0::DOUBLE * ln(least({p}, 1 - {p})))"
    centre = f"{q} * {poly(nf.CENTRE_TOP, f'({q} * {q})')} / {poly(nf.CENTRE_BOTTOM, f'({q} * {q})')}"
    tail = f"{poly(nf.TAIL_TOP, t)} / {poly(nf.TAIL_BOTTOM, t)}"
    return f"CASE WHEN abs({q}) <= {0.5 - nf.TAIL!r}::DOUBLE THEN {centre} WHEN {q} < 0 THEN {tail} ELSE -({tail}) END"


P5_RANKING_SQL = f"""
WITH latest AS (
  SELECT run_id, qid, source, snippet_id, score FROM candidates WHERE score IS NOT NULL AND NOT isnan(score)
  QUALIFY row_number() OVER (PARTITION BY run_id, qid, source, snippet_id ORDER BY scored_at DESC NULLS LAST, score DESC) = 1),
p AS (SELECT *, ((rank() OVER w - 1)::DOUBLE / count(*) OVER (PARTITION BY run_id, qid, source) + cume_dist() OVER w) / 2 AS p FROM latest
  WINDOW w AS (PARTITION BY run_id, qid, source ORDER BY score)),
z AS (SELECT *, min(z) OVER (PARTITION BY run_id, qid, source) AS f FROM (SELECT *, {_inverse_sql('p')} AS z FROM p)),
g AS (SELECT DISTINCT qid, doc_id AS snippet_id FROM qrels WHERE split = 'train' AND rel > 0),
l AS (SELECT DISTINCT run_id, qid, source, f FROM z),
w AS (SELECT l.source, greatest(0, round(avg(coalesce(z.z, l.f)), 6)) AS w FROM l JOIN g USING (qid)
  LEFT JOIN z ON z.run_id = l.run_id AND z.qid = l.qid AND z.source = l.source AND z.snippet_id = g.snippet_id GROUP BY l.source),
t AS (SELECT run_id, qid, sum(coalesce(w, 1)) AS total, sum(coalesce(w, 1) * f) AS floors FROM l LEFT JOIN w USING (source) GROUP BY run_id, qid),
i AS (SELECT run_id, qid, snippet_id, sum(coalesce(w, 1) * (z - f)) AS gain FROM z LEFT JOIN w USING (source) GROUP BY run_id, qid, snippet_id),
u AS (SELECT run_id, qid, snippet_id, round(CASE WHEN total > 0 THEN (gain + floors) / total ELSE 0 END, 9) + 0.0::DOUBLE AS fused FROM i JOIN t USING (run_id, qid))
SELECT run_id, qid, snippet_id, fused, row_number() OVER (PARTITION BY run_id, qid ORDER BY fused DESC, snippet_id) AS place FROM u
"""


def p5_quality(spark: SparkSession, folder: str) -> DataFrame:
    """(split, queries, mrr_10, hits_10) of p5_ranking against the relevant documents of each split's judged queries.

    Weights come from the training split alone, so valid and test are held out. A query of several runs counts in each.
    """
    best = p5_ranking(spark, folder).filter("place <= 10").select("run_id", "qid", F.col("snippet_id").alias("doc_id"), "place")
    gold = read_table(spark, folder, "qrels").filter("rel > 0").select("split", "qid", "doc_id").distinct()
    asked = read_table(spark, folder, "candidates").select("run_id", "qid").distinct().join(gold.select("split", "qid").distinct(), "qid")
    first = best.join(gold, ["qid", "doc_id"]).groupBy("split", "run_id", "qid").agg(F.min("place").alias("place"))
    each = asked.join(first, ["split", "run_id", "qid"], "left")
    return each.groupBy("split").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.coalesce(1 / F.col("place"), F.lit(0.0))), 6).alias("mrr_10"), F.round(F.avg(F.col("place").isNotNull().cast("double")), 6).alias("hits_10"))


def p7_files(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences in generated, minified, vendored and data files, with the reason."""
    of_snapshot = read_table(spark, folder, "snapshots").select("snapshot_id", "repo").distinct()
    listed = read_table(spark, folder, "memberships").join(of_snapshot, "snapshot_id", "left")
    # an unfinished snapshot is not listed; its id begins with its repository
    holders = listed.select(F.coalesce("repo", F.substring_index("snapshot_id", "@", 1)).alias("repo"), "occ_key")
    return foreign_files(read_table(spark, folder, "occurrences"), read_table(spark, folder, "contents"), holders)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences in files that nobody wrote by hand in their repository."""
    return p7_files(spark, folder).select("occ_key")


def _filled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in containers: each kind alone, and all kinds together as the plan `joint`."""
    # a small fixed table of capacities, part of the plan like a literal
    kinds = {r["container_kind"]: r["capacity_tokens"] for r in read_table(spark, folder, "containers").dropna().collect()}
    sizes = token_counts(read_table(spark, folder, "documents"), "text", ["doc_id"])
    return fill_containers(sizes, "doc_id", "tokens", {"joint": kinds} | {k: {k: c} for k, c in kinds.items()})


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document or piece of one."""
    return _filled(spark, folder)


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """How well the containers are filled."""
    return fill_report(_filled(spark, folder))


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = read_table(spark, folder, "documents")
    sizes = token_counts(documents, "text", ["doc_id", "source"])
    return mix_sources(sizes, "doc_id", "source", "tokens", read_table(spark, folder, "source_weights"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document is used so that all sources reach their target shares."""
    return _mixed(spark, folder)[0]


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    """The shares reached, by source."""
    return _mixed(spark, folder)[1]


def _shares(spark: SparkSession, folder: str) -> DataFrame:
    tables = (read_table(spark, folder, t) for t in ("documents", "subject_labels", "subjects"))
    return subject_shares(*tables)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The subjects that each document is about."""
    return main_subjects(_shares(spark, folder)).select("doc_id", "subject")


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    """By subject: documents about it, and sentences and code lines that deal with it."""
    shares = _shares(spark, folder)
    about = main_subjects(shares).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))
    lines = shares.groupBy("subject").agg(F.sum("count").alias("units"))
    return about.join(lines, "subject")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_report": p1_report, "p1_records": p1_records, "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p5_ranking": p5_ranking, "p5_quality": p5_quality, "p7_found": p7_found, "p7_files": p7_files, "p8_containers": p8_containers, "p8_report": p8_report, "p9_mix": p9_mix, "p9_report": p9_report, "p10_found": p10_found, "p10_composition": p10_composition}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND_SQL, "p1_report": P1_REPORT_SQL, "p3_found": P3_FOUND_SQL, "p3_groups": P3_GROUPS_SQL, "p4_found": P4_FOUND_SQL, "p5_ranking": P5_RANKING_SQL}
