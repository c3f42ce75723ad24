import difflib
import random
import subprocess
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomwright.operators import indexing, snapshot_diff, versions
from loomwright.operators.components import connected_components
from loomwright.operators.extract import extract_functions, extract_snippets
from loomwright.operators.history import entity_history
from loomwright.operators.snapshot_diff import snapshot_changes
from loomwright.plans.indexer import CommitIndexer
from loomwright.sources.store import SnapshotStore

SCRIPT_ONE = "function verify(user, given) {\n  return user.secret === given;\n}\nfunction enter(user, given) {\n  if (!verify(user, given)) throw new Error('no');\n  return openSession(user);\n}\n"
SCRIPT_TWO = SCRIPT_ONE.replace("return user.secret === given", "return digest.matches(given, user.stored)")
TOOLS = "const clean = (s) => s.trim().toLowerCase();\nclass Box {\n  get(k) { return this.m.get(k); }\n  put(k, v) { this.m.set(k, v); }\n}\n"


def test_extraction_of_styles():
    source = """var out = module.exports = { base: web.Reply.prototype };
out.write = function write(b) { return this.end(b); };
exports.tag = makeTag({ weak: false });
exports.build = (x) => x + 1;
module.exports = function create() { return app; };
var table = { run: function (r) { return r; } };
define(req, 'scheme', function scheme(){ return this.sock.safe ? 'a' : 'b'; });
define(req, 'stale', function(){ return stale(this.h); });
"""
    assert [r[1] for r in extract_functions("a.js", source)] == ["out.write", "exports.build", "module.exports", "run", "req.scheme", "req.stale"]
    assert [r[1] for r in extract_functions("t.js", TOOLS)] == ["clean", "Box.get", "Box.put"]
    enter = extract_functions("s.js", SCRIPT_ONE)[1]
    assert enter[1:4] == ("enter", 4, 7) and enter[5] == ["openSession", "verify"]


def test_extraction_of_odd_sources():
    source = "export default function main() {}\nfunction* g() { yield 1; }\n(function () { function inner() { return /re{g}/.test(x); } })();\nfunction d() {}\nfunction d() {}\nget('/x', function named(q, r) { r.send(`hi ${q.name}`); });\n"
    assert [r[1] for r in extract_functions("a.js", source)] == ["main", "g", "inner", "d", "d#2", "named"]
    assert extract_functions("a.js", "const a = 1;\n")[0][1:4] == ("<module>", 1, 2)
    assert extract_functions("a.js", " \n") == [] and extract_functions("a.js", "function (") is not None
    assert len(extract_functions("a.js", "x" * 9000)[0][4]) == 4000


def test_modules_are_whole(spark):
    sources = {"a.js": "x" * 9000 + ";", "b.js": "x" * 9000 + ",y;"}
    found = extract_snippets(spark.createDataFrame(list(sources.items()), "path string, source string")).collect()
    assert {r["path"]: (r["symbol"], r["code"]) for r in found} == {p: ("<module>", s) for p, s in sources.items()}


def test_extraction_of_tables(spark):
    files = spark.createDataFrame([("r", "a.js", TOOLS), ("r", "b.js", None), ("r", None, "x")], "repo string, path string, source string")
    rows = extract_snippets(files, ["repo"]).collect()
    assert [(r["repo"], r["symbol"]) for r in rows] == [("r", "clean"), ("r", "Box.get"), ("r", "Box.put")]
    assert extract_snippets(files.filter("source IS NULL")).count() == 0


def run(folder, *arguments):
    return subprocess.run(["git", "-C", str(folder), *arguments], check=True, capture_output=True, text=True).stdout.strip()


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    folder = tmp_path_factory.mktemp("repository")
    run(folder, "init", "-q")
    run(folder, "config", "user.email", "a@b")
    run(folder, "config", "user.name", "a")

    def commit(files, *commands):
        for command in commands:
            run(folder, *command)
        for path, source in files.items():
            (folder / path).parent.mkdir(parents=True, exist_ok=True)
            (folder / path).write_text(source)
            run(folder, "add", path)
        run(folder, "commit", "-q", "-m", "x")
        return run(folder, "rev-parse", "HEAD")

    made = [commit({"src/door.js": SCRIPT_ONE, "src/tools.js": TOOLS, "notes.md": "x"}), commit({"src/door.js": SCRIPT_TWO}), commit({"src/größe.js": "function openSession(u) { return {u}; }\n"})]
    (folder / "src/lib").mkdir()
    made.append(commit({}, ("mv", "src/tools.js", "src/lib/tools.js")))
    made.append(commit({}, ("rm", "-q", "src/größe.js")))
    return str(folder), made


@pytest.fixture(scope="module")
def indexed(spark, repository, tmp_path_factory):
    folder, made = repository
    store = SnapshotStore(spark, str(tmp_path_factory.mktemp("store")))
    indexer = CommitIndexer(store, "r")
    return store, made, [(indexer.index_commit(folder, c), indexer.index_commit(folder, c, "full")) for c in made], indexer


def test_incremental_equals_full(indexed):
    store, _, ids, _ = indexed
    for one, full in ids:
        assert {tuple(r) for r in store.listing(one).collect()} == {tuple(r) for r in store.listing(full).collect()}


def test_isolation_and_reuse(indexed, repository):
    store, made, ids, indexer = indexed
    paths = [{r["path"] for r in store.listing(one).collect()} for one, _ in ids]
    assert "src/größe.js" in paths[2] and "src/größe.js" not in paths[4]
    assert "src/lib/tools.js" in paths[3] and "src/tools.js" not in paths[3]
    stats = {r["commit_sha"]: r["stats"] for r in store.snapshots("r").collect()}
    assert [stats[c]["embedded_new_content"] for c in made] == [5, 1, 1, 0, 0]
    assert stats[made[4]]["files_parsed"] == 0
    before = [tuple(r) for r in store.snapshots("r").select("snapshot_id", "seq").collect()]
    indexer.index_commit(repository[0], made[1])
    assert [tuple(r) for r in store.snapshots("r").select("snapshot_id", "seq").collect()] == before
    content = store.table("content")
    assert content.count() == content.select("content_key").distinct().count()


def test_history_distinguishes_versions(spark, indexed):
    store, made, _, _ = indexed
    rows = versions.history(*(store.table(t) for t in ("snapshot", "membership", "occurrence", "content")))
    asked = spark.createDataFrame([("q", "verify given secret")], "qid string, text string")
    hits = versions.history_search(rows, store.table("content"), asked, k=5).collect()
    both = [h for h in hits if h["symbol"] == "verify"]
    assert {h["first_commit"] for h in both} == set(made[:2]) and {h["n_versions"] for h in both} == {2}
    found = versions.content_versions(rows)
    diffs = [r["diff"] for r in versions.version_diffs(found, store.table("content")).collect()]
    old, new = (s.split("}\n")[0] + "}" for s in (SCRIPT_ONE, SCRIPT_TWO))
    names = [f"src/door.js@{c[:8]}" for c in made[:2]]
    assert diffs == ["".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), *names, n=1))] * 2


def test_snapshot_search_of_empty_snapshot(spark, indexed):
    store = indexed[0]
    listed = versions.snapshot_occurrences(store.table("membership"), store.table("occurrence"), store.table("content"), F.col("snapshot_id") == "none")
    asked = spark.createDataFrame([("q", "verify")], "qid string, text string")
    assert versions.snapshot_search(listed, asked).count() == 0


def test_stream_of_changes(spark, tmp_path):
    from loomwright.streaming.commits import CHANGES, index_stream

    rows = [("r", "c1", None, "A", None, "a.js", SCRIPT_ONE), ("r", "c2", "c1", "M", "a.js", "a.js", SCRIPT_TWO), ("r", "c3", "c2", "D", "a.js", None, None)]
    spark.createDataFrame(rows, CHANGES).coalesce(1).write.json(str(tmp_path / "feed"))
    store = SnapshotStore(spark, str(tmp_path / "store"))
    index_stream(spark.readStream.schema(CHANGES).json(str(tmp_path / "feed")), store, str(tmp_path / "check")).awaitTermination()
    sizes = [store.listing(r["snapshot_id"]).count() for r in store.snapshots("r").collect()]
    assert sizes == [2, 2, 0]


def test_stream_filters_holds_and_embeds(spark, tmp_path):
    from loomwright.streaming.commits import CHANGES, index_stream

    rows = [("o/r", "c1", None, "A", None, "a.js", SCRIPT_ONE), ("o/r", "c1", None, "A", None, "README.md", "x"), ("o/r", "c1", None, "A", None, "node_modules/b.js", TOOLS), ("o/r", "c3", "c2", "A", None, "c.js", TOOLS), ("o/s", "d1", None, "A", None, "a.js", TOOLS)]
    late = [("o/r", "c2", "c1", "M", "a.js", "a.js", SCRIPT_TWO), ("o/r", "c9", "c8", "A", None, "z.js", TOOLS)]
    store = SnapshotStore(spark, str(tmp_path / "store"))
    sizes = []
    for n, part in enumerate((rows, late)):
        spark.createDataFrame(part, CHANGES).coalesce(1).write.mode("append").json(str(tmp_path / "feed"))
        index_stream(spark.readStream.schema(CHANGES).json(str(tmp_path / "feed")), store, str(tmp_path / "check")).awaitTermination()
        sizes.append({r["commit_sha"]: (r["seq"], sorted({x["path"] for x in store.listing(r["snapshot_id"]).collect()})) for name in ("o/r", "o/s") for r in store.snapshots(name).collect()})
    assert sizes[0] == {"c1": (0, ["a.js"]), "d1": (0, ["a.js"])}
    assert sizes[1] == sizes[0] | {"c2": (1, ["a.js"]), "c3": (2, ["a.js", "c.js"])}
    assert {r["commit_sha"] for r in store.table("held").collect()} == {"c9"}
    assert store.table("embedding").count() == store.table("content").count() > 0


def test_listings_can_be_replaced(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    keys = spark.createDataFrame([("k1",), ("k2",)], "occ_key string")
    assert [store.publish("a/b@1:incremental", "a/b", "1", None, "incremental", keys, {}), store.publish("a/b@2:incremental", "a/b", "2", "1", "incremental", keys, {})] == [0, 1]
    assert store.publish("a/b@1:incremental", "a/b", "1", None, "incremental", keys.limit(0), {}) == 0
    left = {(r["snapshot_id"], r["occ_key"]) for r in store.table("membership").collect()}
    assert left == {("a/b@2:incremental", "k1"), ("a/b@2:incremental", "k2")}


def test_changes_per_window(spark, tmp_path):
    from loomwright.streaming.commits import changes_per_window

    rows = [("r", "2024-01-01 00:10:00"), ("r", "2024-01-01 00:50:00"), ("s", "2024-01-01 01:10:00"), ("r", "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "repo string, at string").coalesce(1).write.json(str(tmp_path / "feed"))
    feed = spark.readStream.schema("repo string, at string").json(str(tmp_path / "feed"))
    query = changes_per_window(feed, "at").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((str(r["start"]), r["repo"], r["changes"]) for r in spark.table("windows").collect())
    assert got == [("2024-01-01 00:00:00", "r", 2), ("2024-01-01 01:00:00", "s", 1), ("2024-01-02 00:00:00", "r", 1)]


def test_labelled_versions(spark, indexed):
    from loomwright.plans.searcher import Searcher, evaluate_versions

    store, made, ids, _ = indexed
    searcher = Searcher(store)
    labels = spark.createDataFrame([("r", "1", "verify digest matches stored", "verify", made[1]), ("r", "2", "box get", "Box.get", made[0])], "repo string, id string, query string, symbol string, commit string")
    rows, summary = evaluate_versions(searcher, labels)
    got = {r["id"]: r for r in rows.collect()}
    assert got["1"]["version_correct"] and got["1"]["history_rank"] == 1 and got["1"]["snapshot_rank"] == 1 and got["1"]["n_versions"] == 2
    assert summary["labels"] == 2 and summary["snapshot"]["hit_5"] == 2 and summary["history"]["p50_ms"] > 0
    with pytest.raises(ValueError, match="not indexed"):
        evaluate_versions(searcher, labels.withColumn("commit", F.lit("none")))
    before = searcher.prepare(ids[1][0])
    assert searcher.prepare(ids[1][0]) is before
    hits = searcher.retrieve_history(spark.createDataFrame([("q", "verify given secret")], "qid string, text string"), "r", 5).collect()
    assert any(h["symbol"] == "verify" and h["diff"].startswith("--- src/door.js@") for h in hits)


def test_change_actions(spark):
    feed = [("R090", "a", "b"), ("C080", "a", "c"), ("D", "d", None), ("M", "e", "e"), ("A", None, "f")]
    got = {tuple(r) for r in indexing.change_actions(spark.createDataFrame(feed, "status string, old_path string, new_path string")).collect()}
    assert got == {("a", "drop"), ("b", "extract"), ("c", "extract"), ("d", "drop"), ("e", "drop"), ("e", "extract"), ("f", "drop"), ("f", "extract")}


def test_label_must_be_unique(spark):
    occurrences = spark.createDataFrame([("s", "f", "k1"), ("s", "f", "k2"), ("s", "g", "k3")], "snapshot_id string, symbol string, content_key string")
    good = spark.createDataFrame([("l", "s", "g")], "id string, snapshot_id string, symbol string")
    assert versions.version_labels(good, occurrences).first()["gold"] == "k3"
    with pytest.raises(Exception, match="expected one f"):
        versions.version_labels(good.withColumn("symbol", F.lit("f")), occurrences).collect()


LISTING = "snapshot string, path string, symbol string, value string, seq string"


def random_history(seed):
    rng = random.Random(seed)
    snapshots, listing = [], []
    for repo in ("r1", "r2", None):
        for s in range(rng.randint(1, 8)):
            name = f"{repo}-{s}"
            snapshots += [(repo, name, 3 * s + 1, "x")] * rng.randint(1, 2) + [(repo, name, 3 * s + 50, "x")] * rng.randint(0, 1)
            if rng.random() < 0.15:
                continue
            for path in ("a", "b", None, ""):
                for symbol in ("f", "g", None):
                    if rng.random() < 0.7:
                        listing += [(name, path, symbol, rng.choice(["1", "2", None]), "x")] * rng.randint(1, 2)
    return snapshots, [*listing, ("lost", "a", "f", "1", "x"), (None, "a", "f", "1", "x")]


@pytest.mark.parametrize("seed", [1, 2])
def test_entity_history_equals_brute_force(spark, seed):
    snapshots, listing = random_history(seed)
    frames = spark.createDataFrame(listing, LISTING), spark.createDataFrame(snapshots, "repo string, snapshot string, seq int, value string")
    got = sorted(map(str, entity_history(*frames, "repo", "snapshot", "seq", ["path", "symbol"], ["value"], fanout=2, levels=3).collect()))
    want = []
    for repo in ("r1", "r2"):
        first = {}
        for r, name, seq, _ in snapshots:
            if r == repo:
                first[name] = min(seq, first.get(name, seq))
        order = sorted(first, key=lambda n: (first[n], n))
        held = [{row[1:4] for row in listing if row[0] == name} for name in order]
        for entry in set().union(*held):
            start = None
            for i, rows in enumerate([*held, set()]):
                if entry in rows and start is None:
                    start = i
                elif entry not in rows and start is not None:
                    want.append((repo, *entry, first[order[start]], first[order[i - 1]]))
                    start = None
    from pyspark.sql import Row

    kind = Row("repo", "path", "symbol", "value", "first_seq", "last_seq")
    assert got == sorted(str(kind(*w)) for w in want)


def test_colliding_entries_are_told_apart_by_a_join(spark, monkeypatch):
    monkeypatch.setattr(snapshot_diff, "MOST_ROUNDS", 1)
    rows = [("s1", f"p{i}", "f", "1", "x") for i in range(200)] + [("s2", f"q{i}", "f", "1", "x") for i in range(200)]
    frames = spark.createDataFrame(rows, LISTING), spark.createDataFrame([("s2", "s1")], "snapshot string, parent string")
    got = Counter(r["change"] for r in snapshot_changes(*frames, "snapshot", "parent", ["path", "symbol"], "value", keys_per_bucket=400, cells=3).collect())
    assert got == {"added": 200, "removed": 200}


@pytest.mark.parametrize("cells", [3, 24])
def test_snapshot_changes_equal_brute_force(spark, cells):
    _, listing = random_history(5)
    names = sorted({r[0] for r in listing if r[0]})
    rng = random.Random(9)
    pairs = list({(rng.choice(names), rng.choice([*names, "empty"])) for _ in range(15)})
    frames = spark.createDataFrame(listing, LISTING), spark.createDataFrame([*pairs, pairs[0], (None, names[0])], "snapshot string, parent string")
    got = sorted(map(str, map(tuple, snapshot_changes(*frames, "snapshot", "parent", ["path", "symbol"], "value", keys_per_bucket=4, cells=cells).collect())))
    want = []
    for child, parent in pairs:
        a, b = ({k: {r[3] for r in listing if r[0] == s and r[1:3] == k} for k in {r[1:3] for r in listing if r[0] == s}} for s in (child, parent))
        for k in a.keys() | b.keys():
            if a.get(k) != b.get(k):
                want.append((child, parent, *k, "added" if k not in b else "removed" if k not in a else "changed"))
    assert got == sorted(map(str, want))


def test_hashes_agree_with_spark(spark):
    import numpy as np

    values = [0, 1, -1, 2**62, -(2**63)]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select(F.xxhash64(F.lit(101), "v").alias("h")).collect()
    assert [r["h"] for r in rows] == snapshot_diff._xxhash64(101, np.array(values)).tolist()


def test_problem_operators_of_nothing(spark):
    empty = spark.createDataFrame([], LISTING)
    snapshots = spark.createDataFrame([], "repo string, snapshot string, seq int")
    assert entity_history(empty, snapshots, "repo", "snapshot", "seq", ["path"], ["value"]).count() == 0
    assert snapshot_changes(empty, spark.createDataFrame([], "snapshot string, parent string"), "snapshot", "parent", ["path"], "value").count() == 0


def test_components(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("s", "s"), (None, "a")] + [(f"n{i}", f"n{i + 1}") for i in range(10, 40)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[k] for k in "abcd"} == {"a"} and got["y"] == "x" and got["s"] == "s" and {got[f"n{i}"] for i in range(10, 41)} == {"n10"}
