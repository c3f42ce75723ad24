import json

import pytest

from loomwright import run
from loomwright.operators.report import with_token_lengths
from loomwright.plans.evaluate import Config, latency_probe
from loomwright.sources.jsonfiles import read_config, read_labels, read_report
from loomwright.sources.tables import read_table


def test_evaluate_compare_and_misses(spark, small, tmp_path, capsys):
    config = {"run_id": "a", "split": "train", "retrievers": [{"type": "bm25", "query_view": "core"}], "fusion": None, "depth": 20, "latency_probe": 2}
    (tmp_path / "c.json").write_text(json.dumps(config))
    run.main(["evaluate", str(tmp_path / "c.json"), "--data", small, "--out", str(tmp_path / "a")])
    both = ["retrievers=" + json.dumps([{"type": "dense", "model": "hash256"}, {"type": "bm25", "k1": 0.9}]), 'fusion={"method": "zscore", "weights": [1, 2]}', "latency_probe=0", "folds=[0, 1, 2, 3, 4]"]
    run.main(["evaluate", str(tmp_path / "c.json"), *both, "--data", small, "--out", str(tmp_path / "b")])
    result = json.loads((tmp_path / "b/aggregate.json").read_text())
    assert set(result["per_source"]) == {"hash256", "bm25"} and result["profile"]["latency_ms"] == {}
    assert json.loads((tmp_path / "a/aggregate.json").read_text())["profile"]["latency_ms"]["n"] == 1
    report = read_report(spark, str(tmp_path / "a/per_query.jsonl"))
    assert report.count() == result["aggregate"]["n_queries"]
    run.main(["compare", str(tmp_path / "a"), str(tmp_path / "b")])
    run.main(["misses", str(tmp_path / "b"), "--data", small])
    assert "d_ndcg" in capsys.readouterr().out
    counts = spark.createDataFrame([(r["qid"], 600) for r in report.collect()], "qid string, query_tokens int")
    flagged = with_token_lengths(report.drop("query_tokens", "gold_tokens", "query_truncated", "gold_truncated"), counts, spark.createDataFrame([], "gold string, gold_tokens int"), 512)
    assert {(r["query_truncated"], r["gold_truncated"]) for r in flagged.collect()} == {(True, None)}


def test_asking_and_indexing(spark, small, tmp_path, capsys):
    import subprocess

    config = {"run_id": "a", "retrievers": [{"type": "bm25"}], "fusion": None, "depth": 20}
    (tmp_path / "c.json").write_text(json.dumps(config))
    qid = read_table(spark, small, "queries").filter("text != ''").first()["qid"]
    run.main(["ask", "--qid", qid, "--config", str(tmp_path / "c.json"), "--data", small, "-k", "3"])
    run.main(["ask", "read two numbers", "--config", str(tmp_path / "c.json"), "--data", small, "-k", "3"])
    folder = tmp_path / "repository"
    folder.mkdir()
    for name in ("lib", "test"):
        (folder / name).mkdir()
        (folder / name / "a.js").write_text(f"function handle{name}(error) {{ return error.message; }}\n")
    for command in (["init", "-q"], ["add", "."], ["-c", "user.name=a", "-c", "user.email=a@b", "commit", "-q", "-m", "x"]):
        subprocess.run(["git", "-C", str(folder), *command], check=True)
    run.main(["index", str(folder), "--store", str(tmp_path / "s"), "--name", "o/n", "--include", "lib/", "--verify", "--out", str(tmp_path / "i.json")])
    summary = json.loads((tmp_path / "i.json").read_text())
    assert summary["snippets_at_head"] == 1 and summary["verify"]["mismatches"] == [] and summary["distinct_contents_embedded"] == 1
    commit = subprocess.run(["git", "-C", str(folder), "rev-parse", "HEAD"], capture_output=True, text=True).stdout.strip()
    (tmp_path / "l.json").write_text(json.dumps({"repo": "o/n", "queries": [{"id": "1", "query": "handle lib error", "symbol": "handlelib", "commit": commit}]}))
    run.main(["versions", str(tmp_path / "l.json"), "--store", str(tmp_path / "s"), "--out", str(tmp_path / "v")])
    assert json.loads((tmp_path / "v/summary.json").read_text())["history"]["hit_1"] == 1
    run.main(["search", "handle error", "--store", str(tmp_path / "s"), "--name", "o/n", "--history"])
    assert "handlelib" in capsys.readouterr().out


def test_configurations_are_checked(spark, small, tmp_path):
    good = {"run_id": "a", "retrievers": [{"type": "bm25"}], "extra": 1}
    assert Config.of(good).depth == 200 and Config.of(good).rest == {"extra": 1}
    for bad in ({"split": "other"}, {"retrievers": [{"type": "x"}]}, {"retrievers": [{"type": "bm25"}, {"type": "bm25", "k1": 2}]}):
        with pytest.raises(ValueError):
            Config.of(good | bad)
    assert latency_probe(good | {"latency_probe": 0}, read_table(spark, small, "corpus"), read_table(spark, small, "queries")) == {}
    (tmp_path / "c.json").write_text(json.dumps(good))
    assert read_config(str(tmp_path / "c.json"), ["depth=7", "run_id=plain text"])["run_id"] == "plain text"


def test_labels(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"repo": "r", "queries": [{"id": "1", "query": "find it", "symbol": "f", "commit": "abc"}]}))
    assert tuple(read_labels(spark, str(tmp_path / "l.json")).first()) == ("r", "1", "find it", "f", "abc")
