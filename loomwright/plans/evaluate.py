"""Evaluate a retrieval configuration: candidates, fusion, metrics, report."""

from __future__ import annotations

import json
import resource
import statistics
import sys
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions.hashing import fold
from loomwright.functions.text import is_contest_style, numeric_first
from loomwright.functions.views import VIEWS
from loomwright.operators.bm25 import bm25_index, bm25_search
from loomwright.operators.dense import dense_search
from loomwright.operators.fusion import fuse
from loomwright.operators.metrics import aggregate, bottleneck, judgments, per_query
from loomwright.operators.report import query_report, with_token_lengths
from loomwright.operators.topk import every_nth
from loomwright.plans import encoders
from loomwright.session import durable
from loomwright.sources.jsonfiles import write_lines, write_result

#: What `query_filter` may be, and the condition it stands for.
FILTERS = {None: lambda text: F.lit(True), "stdio": is_contest_style}
SPLITS = ("train", "valid", "test")


@dataclass
class Config:
    """A configuration as its JSON has it; unknown keys are ignored."""

    run_id: str
    retrievers: list[dict]
    split: str = "train"
    folds: list[int] | None = None
    query_filter: str | None = None
    fusion: dict | None = None
    depth: int = 200
    latency_probe: int = 50
    rest: dict = field(default_factory=dict)

    @classmethod
    def of(cls, config: dict) -> Config:
        known = {k: v for k, v in config.items() if k in cls.__dataclass_fields__ and k != "rest"}
        made = cls(**known, rest={k: v for k, v in config.items() if k not in known})
        if made.split not in SPLITS:
            raise ValueError(f"unknown split {made.split}")
        if made.query_filter not in FILTERS:
            raise ValueError(f"unknown query filter {made.query_filter}")
        names = [source_name(r) for r in made.retrievers]
        for retriever in made.retrievers:
            if retriever["type"] == "dense":
                encoders.named(retriever["model"])
        if len(set(names)) < len(names):
            raise ValueError("two retrievers have one name; their results couldn't be told apart")
        return made


def source_name(spec: dict) -> str:
    if spec["type"] not in ("bm25", "dense"):
        raise ValueError(f"unknown retriever type {spec['type']}")
    name = "bm25" if spec["type"] == "bm25" else spec["model"]
    view = spec.get("query_view", "raw")
    return name if view == "raw" else f"{name}:{view}"


def load_split(queries: DataFrame, qrels: DataFrame, split: str) -> tuple[DataFrame, DataFrame]:
    """Queries (qid, text) that the split judges, and its judgments (qid, doc_id, rel)."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split}")
    judged = judgments(qrels.filter(F.col("split") == split))
    asked = queries.select("qid", "text").join(judged.select("qid").distinct(), "qid", "left_semi")
    return asked, judged.join(queries.select("qid"), "qid", "left_semi")


def retrieve(spec: dict, corpus: DataFrame, queries: DataFrame, depth: int) -> DataFrame:
    """(qid, source, doc_id, rank, score) of one retriever; its view applies to queries alone.

    A dense retriever's model is looked up by name, and its max_seq_length and batch_size are passed on.
    """
    viewed = queries.select("qid", VIEWS[spec.get("query_view", "raw")](F.col("text")).alias("text"))
    name = source_name(spec)
    if spec["type"] == "bm25":
        postings = bm25_index(corpus, "doc_id", "text", spec.get("k1", 1.2), spec.get("b", 0.75))
        return bm25_search(viewed, "qid", "text", postings, "doc_id", depth, name)
    model, length, batch = encoders.named(spec["model"]), spec.get("max_seq_length"), spec.get("batch_size", 32)
    vectors = model.embed(corpus.select("doc_id", "text"), ["doc_id"], "text", "document", length, batch)
    return dense_search(model.embed(viewed, ["qid"], "text", "query", length, batch), "qid", vectors, "doc_id", "vec", depth, name)


def token_lengths(report: DataFrame, specs: list[dict], queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """The report with token counts and truncation flags of the first dense retriever; as it is without one.

    Counted are the raw texts. Nothing is truncated by a model without a longest sequence.
    """
    dense = [s for s in specs if s["type"] == "dense"]
    if not dense:
        return report
    model = encoders.named(dense[0]["model"])
    limit = dense[0].get("max_seq_length") or model.max_length
    asked = queries.select("qid", model.count(F.col("text")).cast("int").alias("query_tokens"))
    gold = corpus.select(F.col("doc_id").alias("gold"), model.count(F.col("text")).cast("int").alias("gold_tokens"))
    return with_token_lengths(report, asked, gold, limit if limit is not None else (1 << 31) - 1)


@dataclass
class Evaluation:
    candidates: DataFrame
    run: DataFrame
    per_query: DataFrame
    metrics: DataFrame
    per_source: DataFrame
    bottleneck: DataFrame
    report: DataFrame


def evaluate(config: dict, corpus: DataFrame, queries: DataFrame, qrels: DataFrame, known: dict[str, DataFrame] | None = None) -> Evaluation:
    """All results of a configuration, lazily but for each retriever's list and the run, which are checkpointed since all else reads them.

    known: lists that evaluations of the same tables have in common; those found there are taken, the others are added.
    """
    c = Config.of(config)
    asked, judged = load_split(queries, qrels, c.split)
    if c.folds is not None:
        asked = asked.filter(fold(F.col("qid")).isin(c.folds))
    asked = asked.filter(FILTERS[c.query_filter](F.col("text")))
    judged = judged.join(asked.select("qid"), "qid", "left_semi")
    known, lists = {} if known is None else known, []
    for spec in c.retrievers:
        name = json.dumps([spec, c.depth, c.split, c.folds, c.query_filter], sort_keys=True)
        if name not in known:
            known[name] = durable(retrieve(spec, corpus, asked, c.depth))
        lists.append(known[name])
    candidates = reduce(DataFrame.unionByName, lists)
    names = [source_name(spec) for spec in c.retrievers]
    # a query has few candidates, so one shuffle by query does for both steps of a fusion
    run = durable(fuse(candidates.repartition("qid"), ["qid"], "doc_id", names, c.fusion)) if c.fusion else fuse(candidates, ["qid"], "doc_id", names, None)
    scored = per_query(run, judged)
    by_source = per_query(candidates, judged, ["source"])
    report = token_lengths(query_report(run, candidates, scored, judged, asked, corpus), c.retrievers, asked, corpus)
    return Evaluation(candidates, run, scored, aggregate(scored), aggregate(by_source, ["source"]), bottleneck(scored), report)


def latency_probe(config: dict, corpus: DataFrame, queries: DataFrame) -> dict:
    """Milliseconds of single queries from end to end, the first one left out as warm-up; empty if the probe is 0 or less."""
    c = Config.of(config)
    if c.latency_probe <= 0:
        return {}
    # latency_probe texts at most
    sample = every_nth(queries.select("qid", "text"), numeric_first(F.col("qid")), c.latency_probe).collect()
    times = []
    for row in sample:
        began = time.perf_counter()
        one = queries.filter(F.col("qid") == row["qid"])
        lists = [retrieve(spec, corpus, one, c.depth) for spec in c.retrievers]
        fuse(reduce(DataFrame.unionByName, lists), ["qid"], "doc_id", [source_name(s) for s in c.retrievers], c.fusion).count()
        times.append(1000 * (time.perf_counter() - began))
    times = times[1:]
    if not times:
        return {"n": 0}
    cuts = statistics.quantiles(times, n=20, method="inclusive") if len(times) > 1 else times * 19
    return {"n": len(times), "p50": round(statistics.median(times), 1), "p95": round(cuts[18], 1)}


def peak_memory_mb() -> float:
    """The driver process's largest resident size."""
    size = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    return size / 2**20 if sys.platform == "darwin" else size / 2**10


def write_evaluation(config: dict, found: Evaluation, folder: str, profile: dict | None = None) -> dict:
    """per_query.jsonl (a folder) and aggregate.json (one small file) of an evaluation."""
    write_lines(found.report, f"{folder}/per_query.jsonl")
    rows = {r["source"]: {k: v for k, v in r.asDict().items() if k != "source"} for r in found.per_source.collect()}
    result = {"config": config, "aggregate": found.metrics.first().asDict(), "per_source": rows, "bottleneck": found.bottleneck.first().asDict(), "profile": {"peak_rss_mb": round(peak_memory_mb(), 1)} | (profile or {})}
    write_result(result, f"{folder}/aggregate.json")
    return result
