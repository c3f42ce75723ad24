"""Command line: evaluate a configuration, compare and explain reports, index a repository, search it.

    python -m loomwright.run evaluate CONFIG.json --data FOLDER --out FOLDER [key=json ...]
    python -m loomwright.run compare OUT_A OUT_B
    python -m loomwright.run misses OUT --data FOLDER
    python -m loomwright.run index REPOSITORY --store FOLDER --name NAME [--include PREFIX ...] [--last N] [--verify] [--out FILE]
    python -m loomwright.run search TEXT --store FOLDER --name NAME (--commit SHA | --history) [-k K]
    python -m loomwright.run ask [TEXT] [--qid ID] --config CONFIG.json --data FOLDER [-k K]
    python -m loomwright.run versions LABELS.json --store FOLDER --out FOLDER [--model MODEL] [-k K]
"""

from __future__ import annotations

import argparse
import json
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions.text import snippet_head
from loomwright.operators import report
from loomwright.operators.fusion import fuse
from loomwright.plans import encoders
from loomwright.plans.evaluate import Config, evaluate, latency_probe, retrieve, source_name, write_evaluation
from loomwright.plans.indexer import CommitIndexer
from loomwright.plans.searcher import Searcher, evaluate_versions
from loomwright.session import SETTINGS
from loomwright.sources import git
from loomwright.sources.jsonfiles import read_config, read_labels, read_report, write_lines, write_result
from loomwright.sources.store import SnapshotStore
from loomwright.sources.tables import read_table


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    config = read_config(a.config, a.overrides)
    corpus, queries, qrels = (read_table(spark, a.data, t) for t in ("corpus", "queries", "qrels"))
    found = evaluate(config, corpus, queries, qrels)
    profile = {"latency_ms": latency_probe(config, corpus, queries)}
    print(json.dumps(write_evaluation(config, found, a.out, profile)["aggregate"], indent=2))


def _compare(spark: SparkSession, a: argparse.Namespace) -> None:
    both = [read_report(spark, f"{out}/per_query.jsonl") for out in (a.base, a.new)]
    report.compare_by_fold(*both).orderBy("fold").show()
    report.compare_summary(*both).show()
    report.regressions(*both).show()


def _misses(spark: SparkSession, a: argparse.Namespace) -> None:
    buckets = report.miss_buckets(read_report(spark, f"{a.out}/per_query.jsonl"), read_table(spark, a.data, "queries"))
    buckets.orderBy(F.desc("n"), "bucket").show(truncate=False)


VERIFY_TEXTS = ["parse the request body", "send a response with a status", "merge options with defaults", "handle an error", "register a route"]


def _index(spark: SparkSession, a: argparse.Namespace) -> None:
    store = SnapshotStore(spark, a.store)
    indexer = CommitIndexer(store, a.name, include=tuple(a.include))
    commits, made = git.lineage(a.repository, last=a.last), []
    for commit, _ in commits:
        made.append(indexer.index_commit(a.repository, commit))
        print(made[-1])
    stats = {r["snapshot_id"]: r["stats"] for r in store.snapshots(a.name).collect()}
    rows = [stats[s] for s in made]
    cold = CommitIndexer(SnapshotStore(spark, f"{a.store.rstrip('/')}-cold-{uuid.uuid4().hex}"), a.name, include=tuple(a.include))
    began = time.perf_counter()
    cold.index_commit(a.repository, commits[-1][0], "full")  # of the newest commit, with nothing embedded before
    times = [r["total_s"] for r in rows[1:]]  # the first one reads all files
    summary = {
        "repo": a.name, "include": a.include, "commits": len(commits), "snippets_at_head": rows[-1]["snippets"],
        "cold_full_rebuild_head_s": round(time.perf_counter() - began, 2),
        "incremental_total_s": {"mean": round(sum(times) / max(1, len(times)), 3), "max": max(times, default=0)},
        "incremental_new_embeddings_mean": round(sum(r["embedded_new_content"] for r in rows[1:]) / max(1, len(times)), 2),
        "distinct_contents_embedded": store.embeddings(indexer.recipe).count(), "total_occurrence_versions": sum(r["snippets"] for r in rows),
    }
    if a.verify:
        summary["verify"] = _verify(spark, store, indexer, a.repository, [c for c, _ in commits], made)
    if a.out:
        write_result(summary, a.out)
    print(json.dumps(summary, indent=2))


def _verify(spark: SparkSession, store: SnapshotStore, indexer: CommitIndexer, repository: str, commits: list[str], made: list[str]) -> dict:
    """Differences between the incremental and the full index of each commit: in listings, and in the hits of a few texts."""
    searcher, mismatches = Searcher(store), []
    asked = spark.createDataFrame(list(enumerate(VERIFY_TEXTS)), "qid int, text string").withColumn("qid", F.col("qid").cast("string"))
    for commit, one in zip(commits, made):
        full = indexer.index_commit(repository, commit, "full")
        a, b = (store.listing(s).select("occ_key") for s in (one, full))
        apart = {"only_inc": a.exceptAll(b).count(), "only_full": b.exceptAll(a).count()}
        if any(apart.values()):
            mismatches.append({"commit": commit, "kind": "contents"} | apart)
            continue
        hits = [searcher.retrieve(asked, s).select("qid", "rank", "occ_key", F.round("score", 9)) for s in (one, full)]
        differing = hits[0].exceptAll(hits[1]).unionByName(hits[1].exceptAll(hits[0])).select("qid").distinct().collect()
        mismatches += [{"commit": commit, "kind": "results", "query": VERIFY_TEXTS[int(r["qid"])]} for r in differing]
    return {"commits_checked": len(commits), "queries": len(VERIFY_TEXTS), "mismatches": mismatches}


def _search(spark: SparkSession, a: argparse.Namespace) -> None:
    store = SnapshotStore(spark, a.store)
    searcher = Searcher(store, encoders.named(a.model))
    asked = spark.createDataFrame([("q", a.text)], "qid string, text string")
    if a.history:
        hits = searcher.retrieve_history(asked, a.name, a.k).drop("code")
    else:
        snapshot = store.snapshot_id_for(a.name, a.commit)
        if snapshot is None:
            raise SystemExit(f"{a.commit} is not indexed")
        hits = searcher.retrieve(asked, snapshot, a.k).withColumn("head", snippet_head(F.col("code"), 3)).drop("code")
    hits.drop("qid").orderBy("rank").show(a.k, truncate=60)


def _ask(spark: SparkSession, a: argparse.Namespace) -> None:
    """The best documents of a corpus for a text, or for a query of the tables, whose judged documents are marked."""
    config = Config.of(read_config(a.config))
    corpus, queries, qrels = (read_table(spark, a.data, t) for t in ("corpus", "queries", "qrels"))
    if a.qid is None and a.text is None:
        raise SystemExit("give a text or --qid")
    asked = queries.filter(F.col("qid") == a.qid).select("qid", "text") if a.qid is not None else spark.createDataFrame([("asked", a.text)], "qid string, text string")
    lists = [retrieve(r, corpus, asked, config.depth) for r in config.retrievers]
    found = fuse(reduce(DataFrame.unionByName, lists), ["qid"], "doc_id", [source_name(r) for r in config.retrievers], config.fusion).filter(F.col("rank") <= a.k)
    judged = qrels.filter("rel > 0").select("qid", "doc_id", F.lit(True).alias("gold")).distinct()
    shown = found.join(judged, ["qid", "doc_id"], "left").join(corpus, "doc_id")
    shown.select("rank", "doc_id", F.round("score", 4).alias("score"), "gold", snippet_head(F.col("text"), 3).alias("head")).orderBy("rank").show(a.k, truncate=60)


def _versions(spark: SparkSession, a: argparse.Namespace) -> None:
    rows, summary = evaluate_versions(Searcher(SnapshotStore(spark, a.store), encoders.named(a.model)), read_labels(spark, a.labels), a.k)
    write_lines(rows, f"{a.out}/per_query.jsonl")
    write_result(summary, f"{a.out}/summary.json")
    print(json.dumps(summary, indent=2))


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(required=True)

    def command(name: str, function, *positional: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        sub.set_defaults(run=function)
        for argument in positional:
            sub.add_argument(argument)
        return sub

    sub = command("evaluate", _evaluate, "config")
    sub.add_argument("overrides", nargs="*")
    sub.add_argument("--data", required=True)
    sub.add_argument("--out", required=True)
    command("compare", _compare, "base", "new")
    command("misses", _misses, "out").add_argument("--data", required=True)
    sub = command("index", _index, "repository")
    sub.add_argument("--last", type=int)
    sub.add_argument("--verify", action="store_true")
    sub.add_argument("--include", nargs="*", default=[])
    sub.add_argument("--out")
    other = command("search", _search, "text")
    other.add_argument("-k", type=int, default=10)
    which = other.add_mutually_exclusive_group(required=True)
    which.add_argument("--commit")
    which.add_argument("--history", action="store_true")
    for store in (sub, other):
        store.add_argument("--store", required=True)
        store.add_argument("--name", required=True)
    ask = command("ask", _ask)
    ask.add_argument("text", nargs="?")
    ask.add_argument("--qid")
    ask.add_argument("--config", required=True)
    ask.add_argument("--data", required=True)
    ask.add_argument("-k", type=int, default=10)
    labelled = command("versions", _versions, "labels")
    labelled.add_argument("--store", required=True)
    labelled.add_argument("--out", required=True)
    labelled.add_argument("-k", type=int, default=50)
    for named in (other, labelled):
        named.add_argument("--model", default="hash256")
    a = parser.parse_args(arguments)
    a.run(SparkSession.builder.config(map=SETTINGS).getOrCreate(), a)


if __name__ == "__main__":
    main()
