"""JSON sources and sinks: configurations, reports line by line, labels, and one-row results."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT_SCHEMA = (
    "qid string, gold string, rank int, ndcg10 double, `hit@10` boolean, `hit@50` boolean, `hit@100` boolean, `hit@200` boolean, "
    "top5 array<string>, sources map<string, struct<rank: int, score: double, top1_score: double>>, query_words int, gold_words int, "
    "query_tokens int, gold_tokens int, query_truncated boolean, gold_truncated boolean"
)


def read_config(path: str, overrides: list[str] | None = None) -> dict:
    """A JSON configuration; each override is key=json, or key=text if that is no JSON."""
    config = json.loads(Path(path).read_text())
    for override in overrides or []:
        key, _, value = override.partition("=")
        try:
            config[key] = json.loads(value)
        except json.JSONDecodeError:
            config[key] = value
    return config


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, NULL fields included."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A report that write_lines wrote; fields that it lacks are NULL."""
    return spark.read.schema(REPORT_SCHEMA).json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(repo, id, query, symbol, commit) of a label file {repo, queries: [...]}."""
    schema = "repo string, queries array<struct<id: string, query: string, symbol: string, commit: string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select("repo", F.explode("queries").alias("q")).select("repo", "q.*")


def write_result(result: dict, path: str) -> None:
    """A small result as indented JSON, written by the driver."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(result, indent=2, default=str))
