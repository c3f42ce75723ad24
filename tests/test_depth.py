"""Registered evaluations reach every cut-off they report."""

import random

import pytest
from oracle import check

from loomwright.plans.corpus_queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """300 documents with the word of all queries; the relevant ones are ranked anywhere among them."""
    path, rng = tmp_path_factory.mktemp("deep"), random.Random(5)
    words = [f"w{i}" for i in range(40)]
    docs = [(f"d{i}", " ".join(["common", *rng.choices(words, k=rng.randint(3, 40))])) for i in range(300)]
    asked = [(f"q{i}", " ".join(["common", *rng.sample(words, 2)]), "s") for i in range(40)]
    judged = [("train", q, f"d{rng.randrange(300)}", 1) for q, _, _ in asked for _ in range(2)]
    for name, rows, schema in (("corpus", docs, "doc_id string, text string"), ("queries", asked, "qid string, text string, source string"), ("qrels", judged, "split string, qid string, doc_id string, rel int")):
        spark.createDataFrame(rows, schema).toPandas().to_parquet(path / f"{name}.parquet")
    return str(path)


@pytest.mark.parametrize(("name", "depth"), [("metrics_sets", 1000), *((n, 200) for n in ("evaluate_hybrid", "evaluate_report", "compare_folds", "compare_summary", "compare_regressions", "miss_buckets"))])
def test_query_equals_its_sql_at_its_own_depth(spark, folder, name, depth):
    assert f"WHERE rank <= {depth})" in ORACLES[name]
    check(spark, folder, QUERIES[name], ORACLES[name])


def test_deep_cut_offs_are_reached(spark, folder):
    recall = {r["k"]: r["recall"] for r in QUERIES["metrics_sets"](spark, folder).collect()}
    assert recall[100] < recall[1000] == 1
    row = QUERIES["evaluate_hybrid"](spark, folder).first()
    assert row["recall_at_100"] < row["recall_at_200"]
