"""Search over stored blocks: whole, exact, and without shuffling documents."""

import random

import numpy as np
import pytest
from test_search import brute_bm25

from loomwright.functions import tokenize
from loomwright.operators import blocks, bm25, dense


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lists(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r["qid"], r["rank"])):
        got.setdefault(r["qid"], []).append(r["doc_id"])
    return got


@pytest.fixture(scope="module")
def texts():
    rng, words = random.Random(4), [f"w{i}" for i in range(30)]
    docs = {f"d{i:03}": " ".join(rng.choices(words, k=rng.randint(0, 9))) for i in range(300)}
    return docs, {f"q{i}": " ".join(rng.choices(words, k=4)) for i in range(150)}


def test_documents_and_scores_of_blocks_are_not_shuffled(spark, texts):
    docs, asked = (spark.createDataFrame(list(t.items()), f"{c} string, text string") for t, c in zip(texts, ("doc_id", "qid")))
    vectors = spark.createDataFrame([(f"d{i}", [1.0, float(i)]) for i in range(9)], "doc_id string, v array<double>")
    found = [bm25.bm25_search(asked, "qid", "text", bm25.bm25_index(docs, "doc_id", "text"), "doc_id", 3), dense.dense_search(vectors.withColumnRenamed("doc_id", "qid"), "qid", vectors, "doc_id", "v", 3)]
    for df in found:
        assert "CoGroup" not in plan(df) and "Window" not in plan(df) and plan(df).count("Exchange") == 1


@pytest.mark.parametrize("at_once", [1, 50])
def test_many_blocks_and_ranges_give_the_lexical_order(spark, monkeypatch, texts, at_once):
    for name, value in (("BLOCK", 40), ("POSTINGS_BLOCK", 60), ("QUERY_BLOCK", 20), ("AT_ONCE", 8)):
        monkeypatch.setattr(bm25, name, value)
    monkeypatch.setattr(blocks, "BLOCKS_AT_ONCE", at_once)
    monkeypatch.setattr(bm25, "COMMON", 0.05)  # some tokens are multiplied, others added up
    docs, asked = (spark.createDataFrame(list(t.items()), f"{c} string, text string") for t, c in zip(texts, ("doc_id", "qid")))
    got = lists(bm25.bm25_search(asked, "qid", "text", bm25.bm25_index(docs, "doc_id", "text"), "doc_id", 7).collect())
    assert got == {q: [d for d, _ in hits[:7]] for q, hits in brute_bm25(*texts).items() if hits}


@pytest.mark.parametrize("scale", [1.0, 1e18])
def test_single_precision_does_not_decide(spark, monkeypatch, scale):
    for name, value in (("DOCUMENT_BLOCK", 30), ("LEAST_BLOCK", 10), ("AT_ONCE", 4)):
        monkeypatch.setattr(dense, name, value)
    rng = np.random.default_rng(7)
    near = 1 + rng.integers(0, 40, (200, 3)) * 1e-6  # differs in the sixth digit, as single precision can't tell
    docs = spark.createDataFrame([(f"d{i:03}", (scale * v).tolist()) for i, v in enumerate(near)], "doc_id string, v array<double>")
    asked = spark.createDataFrame([(f"q{i}", [1 / scale, 0.0, 1 / scale]) for i in range(6)] + [("q_zero", [0.0, 0.0, 0.0])], "qid string, v array<double>")
    got = lists(dense.dense_search(asked, "qid", docs, "doc_id", "v", 9).collect())
    order = np.lexsort((np.arange(200), -np.round(near[:, 0] + near[:, 2], 6)))[:9]
    assert got == {f"q{i}": [f"d{j:03}" for j in order] for i in range(6)} | {"q_zero": [f"d{j:03}" for j in range(9)]}


def test_hashed_tokens_are_the_tokens(spark):
    from pyspark.sql import functions as F

    values = ["fooBar HTTPServer2x _a x1_Y 12 ٣٤ the print", "", None, "a_b snake_case_Id ABc"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").coalesce(1)
    want = [t or [] for t in (r["t"] for r in rows.select("i", tokenize.tokens(F.col("t")).alias("t")).orderBy("i").collect())]
    raw = rows.orderBy("i").select(tokenize.raw_tokens(F.col("t")).alias("raw")).toArrow().column("raw").combine_chunks()
    row, key, _ = tokenize.hashed_tokens(raw)
    import hashlib

    hashes = [[int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "little", signed=True) for t in ts] for ts in want]
    assert [[int(k) for k in key[row == i]] for i in range(4)] == hashes


def test_comparisons_share_the_list_that_both_sides_have(spark, small, monkeypatch):
    from loomwright.plans import corpus_queries, evaluate

    asked = []
    retrieve = evaluate.retrieve
    monkeypatch.setattr(evaluate, "retrieve", lambda spec, *rest: asked.append(spec["type"]) or retrieve(spec, *rest))
    assert sum(r["n"] for r in corpus_queries.compare_folds(spark, small).collect()) > 0
    assert sorted(asked) == ["bm25", "dense"]


def test_comparisons_store_only_what_they_read(spark, small, monkeypatch):
    from loomwright.plans import corpus_queries

    stored = []
    durable = corpus_queries.durable
    monkeypatch.setattr(corpus_queries, "durable", lambda df: stored.append(df.columns) or durable(df))
    assert corpus_queries.compare_summary(spark, small).count() == 1
    assert stored == [["qid", "rank", "ndcg10"]] * 2


def test_buckets_of_misses_send_no_documents_to_blocks_of_queries(spark, small, monkeypatch):
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    from loomwright.plans import corpus_queries

    def refuse(*_):
        raise AssertionError("documents are sent once for each block of queries")

    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", refuse)
    assert corpus_queries.miss_buckets(spark, small).count() > 0
