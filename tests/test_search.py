import math
import random
from collections import Counter

import numpy as np
import pytest
from test_functions import brute_tokens

from loomwright.operators import bm25, dense, fusion, metrics, report, topk

DOCS = {"d1": "alpha beta gamma", "d2": "alpha alpha delta", "d3": "", "d4": None, "d5": "betaGamma x_alpha", "d6": "alpha beta gamma"}
ASKED = {"q1": "alpha gamma gamma", "q2": "nothing here", "q3": "", "q4": None}


def brute_bm25(docs, asked, k1=1.2, b=0.75):
    tf = {d: Counter(brute_tokens(t or "")) for d, t in docs.items()}
    df = Counter(w for c in tf.values() for w in c)
    n, mean = len(docs), sum(sum(c.values()) for c in tf.values()) / len(docs)
    out = {}
    for q, t in asked.items():
        scores = {}
        for d, c in tf.items():
            s = 0.0
            for w, times in Counter(brute_tokens(t or "")).items():
                if c[w]:
                    s += times * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] / (c[w] + k1 * (1 - b + b * sum(c.values()) / mean))
            if s > 0:
                scores[d] = round(s, 6)
        out[q] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
    return out


@pytest.mark.parametrize(("k", "block"), [(2, 2_000_000), (10, 2_000_000), (10, 3)])
def test_bm25_equals_brute_force(spark, monkeypatch, k, block):
    monkeypatch.setattr(bm25, "POSTINGS_BLOCK", block)
    docs = spark.createDataFrame(list(DOCS.items()), "doc_id string, text string")
    asked = spark.createDataFrame(list(ASKED.items()), "qid string, text string")
    rows = bm25.bm25_search(asked, "qid", "text", bm25.bm25_index(docs, "doc_id", "text"), "doc_id", k).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["qid"], r["rank"])):
        got.setdefault(r["qid"], []).append((r["doc_id"], pytest.approx(r["score"], abs=1.1e-6)))
    assert {q: h for q, h in ((q, x[:k]) for q, x in brute_bm25(DOCS, ASKED).items()) if h} == got


def test_bm25_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    asked = spark.createDataFrame([("q", "alpha")], "qid string, text string")
    assert bm25.bm25_search(asked, "qid", "text", bm25.bm25_index(docs, "doc_id", "text"), "doc_id", 3).count() == 0


@pytest.mark.parametrize("blocks", [(20_000, 2_000), (7, 3)])
def test_dense_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(dense, "DOCUMENT_BLOCK", blocks[0])
    monkeypatch.setattr(dense, "QUERY_BLOCK", blocks[1])
    rng = np.random.default_rng(1)
    vectors = rng.integers(-3, 4, size=(30, 4)).astype(float)  # many ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    docs = spark.createDataFrame([*rows, (99, None)], "doc_id long, v array<double>")
    asked = spark.createDataFrame([(i, v) for i, v in rows if i % 5 == 0], "qid long, v array<double>")
    got = dense.dense_search(asked, "qid", docs, "doc_id", "v", 4, other_than_self=True).collect()
    for q in range(0, 30, 5):
        scores = sorted(((-float(vectors[q] @ vectors[d]), d) for d in range(30) if d != q))[:4]
        assert [(r["doc_id"], -r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["qid"] == q] == [(d, s) for s, d in scores]


LISTS = [("q", "a", "x", 1, 3.0), ("q", "a", "y", 2, 1.0), ("q", "b", "y", 1, 5.0), ("q", "b", "z", 2, 5.0), ("p", "a", "x", 1, 2.0)]
SCHEMA = "qid string, source string, doc_id string, rank int, score double"


def test_rrf_by_hand(spark):
    rows = {(r["qid"], r["doc_id"]): (r["rank"], r["score"]) for r in fusion.rrf(spark.createDataFrame(LISTS, SCHEMA), ["qid"], "doc_id").collect()}
    assert rows["q", "y"] == (1, round(1 / 62 + 1 / 61, 9))
    assert rows["q", "x"] == (2, round(1 / 61, 9)) and rows["q", "z"][0] == 3 and rows["p", "x"][0] == 1
    weighted = fusion.rrf(spark.createDataFrame(LISTS, SCHEMA), ["qid"], "doc_id", {"b": 2.0}).collect()
    assert {(r["qid"], r["doc_id"]) for r in weighted} == {("q", "y"), ("q", "z")}


def test_zscore_by_hand(spark):
    rows = {(r["qid"], r["doc_id"]): r["score"] for r in fusion.zscore(spark.createDataFrame(LISTS, SCHEMA), ["qid"], "doc_id").collect()}
    # list a has z 1 and -1; list b is constant, so all of it is 0; absent from a is -1
    assert rows == {("q", "x"): 1.0, ("q", "y"): -1.0, ("q", "z"): -1.0, ("p", "x"): 0.0}


def test_fusion_dispatch(spark):
    df = spark.createDataFrame(LISTS, SCHEMA)
    assert fusion.fuse(df, ["qid"], "doc_id", ["a"], None).count() == 3
    with pytest.raises(ValueError):
        fusion.fuse(df, ["qid"], "doc_id", ["a", "b"], None)
    with pytest.raises(ValueError):
        fusion.fuse(df, ["qid"], "doc_id", ["a"], {"method": "other"})


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q1", "c", 3), ("q2", "x", 1)], "qid string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q1", "b", 1), ("q1", "c", 2), ("q1", "c", 2), ("q2", "y", 1), ("q3", "z", 0), ("q3", "w", None)], "qid string, doc_id string, rel int")
    scored = metrics.per_query(run, metrics.judgments(qrels))
    got = {r["qid"]: (r["gold_rank"], r["ndcg10"]) for r in scored.collect()}
    dcg, ideal = 1 / math.log2(3) + 2 / 2, 2 + 1 / math.log2(3)
    assert got == {"q1": (2, round(dcg / ideal, 6)), "q2": (None, 0.0), "q3": (None, 0.0)}
    total = metrics.aggregate(scored).first()
    assert (total["n_queries"], total["mrr_at_10"], total["recall_at_1"], total["recall_at_5"]) == (3, round(0.5 / 3, 6), 0.0, round(1 / 3, 6))
    sets = {r["k"]: r for r in metrics.set_metrics(run, metrics.judgments(qrels)).collect()}
    assert sets[3]["map"] == round((1 / 2 + 2 / 3) / 2 / 2, 6) and sets[1]["hit_rate"] == 0.0
    assert metrics.bottleneck(scored).first().asDict() == {"n_miss_at_10": 2, "absent_from_top100": 2, "in_top100_ranked_low": 0}


def test_compare_and_misses(spark):
    schema = "qid string, rank int, ndcg10 double"
    ids = [f"q{i}" for i in range(40)]
    rng = random.Random(3)
    base = {q: rng.choice([None, 1, 5, 50]) for q in ids}
    new = {q: rng.choice([None, 1, 5, 50]) for q in ids}
    frames = [spark.createDataFrame([(q, r, 1.0 / r if r else 0.0) for q, r in x.items()], schema) for x in (base, new)]
    got = report.compare_summary(*frames).first()
    top = lambda r: r is not None and r <= 10
    assert got["entered"] == sum(top(new[q]) and not top(base[q]) for q in ids)
    assert got["left"] == sum(top(base[q]) and not top(new[q]) for q in ids)
    assert [r["qid"] for r in report.regressions(*frames).collect()] == sorted(q for q in ids if top(base[q]) and not top(new[q]))[:8]
    assert sum(r["n"] for r in report.compare_by_fold(*frames).collect()) == 40


def test_every_nth(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i,) for i in range(23)], "i int")
    assert [r["i"] for r in topk.every_nth(df, [F.col("i")], 5).orderBy("i").collect()] == [0, 4, 8, 12, 16]
    assert topk.every_nth(df, [F.col("i")], 0).count() == 0


def test_positions_and_running_sums(spark):
    from pyspark.sql import functions as F

    from loomwright.operators.order import positions, running

    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i, rng.randint(1, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i int, w int")
    got = {(r["g"], r["i"]): (r["upto"], r["whole"]) for r in running(df, ["g"], [F.desc("i")], "w", rows_per_block=20).collect()}
    assert got == {(g, i): (sum(w for h, j, w in rows if h == g and j >= i), sum(w for h, _, w in rows if h == g)) for g, i, _ in rows}
    places = {r["i"]: r["place"] for r in positions(df, [F.col("w"), F.desc("i")], rows_per_block=20).collect()}
    assert places == {i: n for n, (_, i, _) in enumerate(sorted(rows, key=lambda r: (r[2], -r[1])), 1)}
    assert positions(df.limit(0), [F.col("i")]).count() == 0


def test_encoders(spark):
    from pyspark.sql import functions as F

    from loomwright.functions.vectors import hash_embedding
    from loomwright.plans import encoders
    from loomwright.plans.evaluate import Config

    with pytest.raises(ValueError, match="unknown model"):
        encoders.named("none")
    with pytest.raises(ValueError, match="unknown model"):
        Config.of({"run_id": "a", "retrievers": [{"type": "dense", "model": "none"}]})
    with pytest.raises(ValueError, match="unknown query filter"):
        Config.of({"run_id": "a", "retrievers": [{"type": "bm25"}], "query_filter": "x"})
    own = encoders.Encoder("own", encoders.hash256, F.length, query_prompt="query: ", document_prompt="passage: ", max_length=3, query_hook=F.upper)
    assert encoders.register(own) is encoders.named("own") and len({own.recipe(r, v) for r in encoders.ROLES for v in ("raw", "core")}) == 4
    df = spark.createDataFrame([("1", "alpha beta gamma delta")], "id string, text string")
    for role, seen in (("query", "query ALPHA BETA"), ("document", "passage alpha beta")):
        want = hash_embedding(spark.createDataFrame([("1", seen)], "id string, text string"), ["id"], "text").first()["vec"]
        assert own.embed(df, ["id"], "text", role).first()["vec"] == pytest.approx(want)
    with pytest.raises(ValueError, match="unknown role"):
        own.embed(df, ["id"], "text", "other")


def test_official_metrics_by_hand(spark):
    run = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q2", "x", 1)], "qid string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q1", "b", 1), ("q1", "c", 2), ("q2", "x", 1)], "qid string, doc_id string, rel int")
    got = {r["k"]: r for r in metrics.official_metrics(run, qrels).collect()}
    assert got[1]["ndcg"] == 0.5 and got[1]["accuracy"] == 0.5 and got[1]["mrr"] == 0.5
    assert got[3]["mrr"] == 0.75 and got[3]["ndcg"] == round((1 + (1 / math.log2(3)) / (2 + 1 / math.log2(3))) / 2, 6) and got[3]["recall"] == 0.75
