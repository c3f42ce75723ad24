import math

from loomwright.plans import registry


def stats(spark, tmp_path, repos):
    rows = [(f"{repo}@{i}", repo, f"c{i}", None, i, "incremental", (1, 1, s)) for repo, seconds in repos.items() for i, s in enumerate([9.0, *seconds])]
    schema = "snapshot_id string, repo string, commit_sha string, parent_sha string, seq int, mode string, stats struct<files_parsed int, snippets int, total_s double>"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "snapshots.parquet"))
    return {r["repo"]: r for r in registry.queries()["store_stats"](spark, str(tmp_path)).collect()}


def test_means_half_way_round_up_in_any_order(spark, tmp_path):
    # every order of these sums in doubles ends below the half-way mean 0.1074375
    got = stats(spark, tmp_path, {f"r{i}": [0.101] * i + [0.204] + [0.101] * (15 - i) for i in range(16)})
    assert {r["mean_s"] for r in got.values()} == {0.107438}
    assert {(r["increments"], r["max_s"], r["files_parsed"]) for r in got.values()} == {(16, 0.204, 16)}


def test_means_of_odd_seconds(spark, tmp_path):
    got = stats(spark, tmp_path, {"none": [None, None], "some": [0.5, None], "nan": [0.5, math.nan], "endless": [0.5, math.inf], "huge": [1e300, 3e300]})
    assert got["none"]["mean_s"] is None and got["some"]["mean_s"] == 0.5
    assert math.isnan(got["nan"]["mean_s"]) and got["endless"]["mean_s"] == math.inf and got["huge"]["mean_s"] == 2e300
