import math
import random
import re
from collections import Counter, defaultdict
from statistics import NormalDist

import numpy as np
import pytest
from brute_units import units_of
from oracle import check
from pyspark.sql import functions as F

from loomwright.llm import mixing, packing, queries, wordblocks
from loomwright.llm.groupjoin import expand_links, near_duplicate_groups, near_duplicate_links
from loomwright.llm.handwritten import code_kind, foreign_files
from loomwright.llm.normalfusion import _named, fuse_normal_scores, inverse_normal, judged_weights, normal_scores
from loomwright.llm.overlap import cross_split_overlaps, cut_records, expand_pairs, held_overlaps, record_shares
from loomwright.llm.subjects import main_subjects, subject_shares
from loomwright.llm.tokens import token_counts
from loomwright.llm.topn import top_n_per_group

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, small, name):
    check(spark, small, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() >= 0


def shingles(text, k, letters="a-z0-9"):
    words = re.findall(f"[{letters}]+", (text or "").lower())
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def edited(rng, words, rate):
    return [rng.choice("abcdefghij") * 3 if rng.random() < rate else w for w in words]


def corpus(seed, n=60, length=60):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            words = edited(rng, rng.choice(texts), rng.choice([0, 0.02, 0.05]))
        else:
            words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, length))]
        texts.append(words)
    sep = [" ", "  ", "\n", ", "]
    return [rng.choice(sep).join(w).upper() if rng.random() < 0.3 else rng.choice(sep).join(w) for w in texts] + [None, "", "one two", "ä" * 50, "w1 " * 5000]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cross_split_overlaps_equal_brute_force(spark, seed):
    rng, texts = random.Random(seed), corpus(seed)
    rows = [("s" if i % 7 else "t", f"i{i}", t, rng.choice([True, False, None]), rng.choice([True, False])) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (None, "x", "a b c d e", True, True)], "space string, id string, text string, train boolean, held boolean")
    got = {(r["space"], r["id_a"], r["id_b"]) for r in expand_pairs(*cross_split_overlaps(df)).collect()}
    want = set()
    for a in rows:
        for b in rows:
            x, y = shingles(a[2], 4), shingles(b[2], 4)
            if a[0] == b[0] and a[1] < b[1] and x and y and ((a[3] and b[4]) or (a[4] and b[3])) and len(x & y) / min(len(x), len(y)) >= 0.6:
                want.add((a[0], a[1], b[1]))
    assert got == want


def test_report_counts_solutions_of_unknown_queries(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(30))
    tables = {
        "queries": ([("q1", "one two three four five", " Site "), ("q2", text, None)], "qid string, text string, source string"),
        "corpus": ([("d1", text), ("d2", text + " more")], "doc_id string, text string"),
        "qrels": ([("train", "q1", "d1", 1), ("test", "gone", "d2", 1), ("valid", "q2", "d2", 0)], "split string, qid string, doc_id string, rel int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).toPandas().to_parquet(tmp_path / f"{name}.parquet")
    found = [("doc", "d1", "d2")]
    assert [tuple(r) for r in queries.p1_found(spark, str(tmp_path)).collect()] == found
    report = {(r["split"], r["source"], r["kind"]): (r["texts"], r["found"]) for r in queries.p1_report(spark, str(tmp_path)).collect()}
    assert report == {("test", "unknown", "doc"): (1, 1), ("valid", "unknown", "query"): (1, 0)}


def test_short_and_repetitive_texts_overlap(spark):
    rng = random.Random(8)
    rows = []
    for i in range(20):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        at = rng.randrange(180)
        rows += [(f"long{i}", " ".join(words), True, False), (f"repeated{i}", " ".join(words[at : at + 14] + ["same"] * 300), False, True)]
        rows += [(f"part{i}.{n}", " ".join(words[at : at + n]), False, True) for n in (4, 5, 6, 8, 11)]
    df = spark.createDataFrame([("s", *r) for r in rows], "space string, id string, text string, train boolean, held boolean")
    sets = {r[0]: shingles(r[1], 4) for r in rows}
    held = [r[0] for r in rows if r[3]]
    want = {tuple(sorted((f"long{i}", h))) for i in range(20) for h in held if len(sets[f"long{i}"] & sets[h]) / min(len(sets[f"long{i}"]), len(sets[h])) >= 0.6}
    assert len(want) == 120
    assert {(r["id_a"], r["id_b"]) for r in expand_pairs(*cross_split_overlaps(df)).collect()} == want


@pytest.mark.parametrize(("threshold", "k"), [(0.7, 3), (0.8, 5), (0.5, 2)])
def test_near_duplicates_equal_brute_force(spark, threshold, k):
    texts = corpus(7, n=80)
    df = spark.createDataFrame([(f"i{i}", t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "x")], "id string, text string, n string")
    sets = {f"i{i}": shingles(t, k) for i, t in enumerate(texts)}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}
    pairs, members = near_duplicate_links(df, "id", "text", threshold, k)
    assert {(r["a"], r["b"]) for r in expand_links(pairs, members).collect()} == want
    groups = {r["id"]: r for r in near_duplicate_groups(df, "id", "text", threshold, k).collect()}
    assert set(groups) == set(sets)
    links = Counter(x for pair in want for x in pair)
    assert all(groups[i]["links"] == links[i] for i in sets)
    assert all(groups[a]["group"] == groups[b]["group"] for a, b in want)
    assert sum(g["group"] == i for i, g in groups.items()) == len({g["group"] for g in groups.values()})


def test_word_hashes_don_t_depend_on_blocks(monkeypatch):
    texts = corpus(3) + ["x" * 700, "ÀB c_d\x00e"]
    whole = wordblocks.word_hashes(texts)
    monkeypatch.setattr(wordblocks, "BLOCK", 16)
    parts = wordblocks.word_hashes(texts)
    assert all((a == b).all() for a, b in zip(whole, parts))
    assert np.diff(whole[1]).tolist() == [len(re.findall("[a-z0-9]+", (t or "").lower())) for t in texts]


def score_rows(seed, n=400):
    rng = random.Random(seed)
    rows = [(rng.choice(["g1", "g2", None]), rng.choice(["s", "t"]), rng.choice([f"i{i}" for i in range(20)] + [None]), rng.choice([None, float("nan"), 1.0, 2.0, -0.0, 0.0, float("inf"), rng.random()]), rng.choice([None, 1, 2, 3]), "x") for _ in range(n)]
    return rows + rows[:50]


SCORED = "g string, source string, item string, score double, version int, place string"


def latest(rows):
    best = {}
    for g, s, i, score, v, _ in rows:
        if score is not None and not math.isnan(score):
            key, value = (g, s, i), (-1 if v is None else v, score + 0.0)
            best[key] = max(best.get(key, value), value)
    lists = defaultdict(dict)
    for (g, s, i), (_, score) in best.items():
        lists[g, s][i] = score
    return lists


@pytest.mark.parametrize("batch", [7, 10_000])
def test_top_n_equals_brute_force(spark, batch):
    rows = score_rows(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {tuple(r) for r in top_n_per_group(spark.createDataFrame(rows, SCORED), ["g", "source"], "score", "item", 3, "version").collect()}
        want = set()
        for (g, s), items in latest(rows).items():
            ordered = sorted(items.items(), key=lambda x: (-x[1], x[0] is None, x[0] or ""))
            want |= {(g, s, p + 1, i, x) for p, (i, x) in enumerate(ordered[:3])}
        assert got == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    empty = spark.createDataFrame([], SCORED)
    assert top_n_per_group(empty, ["g"], "score", "item", 3).count() == 0


@pytest.mark.parametrize("hot_rows", [200_000, 3])
def test_normal_fusion_equals_brute_force(spark, hot_rows):
    rows = [r for r in score_rows(6) if r[3] is None or not math.isinf(r[3])]
    df = spark.createDataFrame(rows, SCORED)
    weights = spark.createDataFrame([("s", 2.0), ("t", -1.0), ("u", None)], "source string, weight double")
    inv = NormalDist().inv_cdf
    for w, frame in (({"s": 1.0, "t": 1.0}, None), ({"s": 2.0, "t": 0.0}, weights)):
        z, groups = {}, defaultdict(set)
        for (g, s), items in latest(rows).items():
            values = sorted(items.values())
            z[g, s] = {i: inv((sum(v < x for v in values) + sum(v == x for v in values) / 2) / len(values)) for i, x in items.items()}
            groups[g] |= set(items)
        want = {}
        for g, items in groups.items():
            own = [s for s in ("s", "t") if (g, s) in z]
            total = sum(w[s] for s in own)
            fused = {i: sum(w[s] * z[g, s].get(i, min(z[g, s].values())) for s in own) / total for i in items}
            want[g] = fused
        got = fuse_normal_scores(df, ["g"], "source", "item", "score", "version", frame, None, hot_rows).collect()
        assert len(got) == sum(map(len, want.values()))
        for r in got:
            assert r["fused"] == pytest.approx(want[r["g"]][r["item"]], abs=1e-6)
        for g in want:
            own = sorted((r for r in got if r["g"] == g), key=lambda r: r["place"])
            assert [r["place"] for r in own] == list(range(1, len(own) + 1))
            keys = [(-r["fused"], r["item"] is None, r["item"] or "") for r in own]
            assert keys == sorted(keys)


def test_inverse_normal(spark):
    ps = [1e-9, 0.001, 0.02, 0.3, 0.5, 0.9, 0.99, 1 - 1e-6]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(inverse_normal(F.col("p")).alias("z")).collect()
    assert [r["z"] for r in got] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=1e-7)


def test_judged_weights_prefer_good_sources(spark):
    rows = [("q", "good", f"i{i}", float(-i), 1) for i in range(9)] + [("q", "bad", f"i{i}", float(i), 1) for i in range(9)]
    df = spark.createDataFrame(rows, "qid string, source string, item string, score double, v int")
    judged = spark.createDataFrame([("q", "i0")], "qid string, item string")
    got = {r["source"]: r["weight"] for r in judged_weights(normal_scores(_named(df, ["qid"], "source", "item", "score", None), ["k0"], None), "k0", judged).collect()}
    assert got["good"] > 1 and got["bad"] == 0.0


MINIFIED = "function q(o,f){var p=q.a,h=525;e.b=function(l,k){return q?g(8253):p};s&&x.c(x,!0);o=[8461,n];for(;o<2325;)z+=k[8218];return t}"
HAND = "function sendReply(request, banner) {\n  const note = '// DO NOT EDIT, generated by ' + this.name;\n  // returns the generated id\n  return request.connection.write(note, banner);\n}"
TABLE = "const shades = {\n" + "".join(f'  "tone{i}": {{ id: {i * 37}, tag: "shade{i}" }},\n' for i in range(12)) + "};"


@pytest.mark.parametrize(("code", "kind"), [(HAND, None), ("// @generated by toolkit\n" + HAND, "generated"), (MINIFIED, "minified"), (TABLE, "data"), ("/*!\n * kit v1\n * (c) the kit people, MIT licence\n */\n" + HAND, "licensed"), ("// SPDX: same licence as the rest of this project\n" + HAND, None), ("", None), ("var a = 1;", None), ("case 0: this.$ = new yy.Node($$[$0-1]); break;", "generated")])
def test_code_kinds(code, kind):
    assert code_kind(code) == kind


def test_foreign_files(spark):
    def lines(n, tag):
        return "".join(f"  store.{tag}Step{i}(value{i}, other{tag});\n" for i in range(n))

    library = f"function kit() {{\n{lines(12, 'kit')}}}"
    patched = library.replace("value3", "fixed3")
    borrowed = f"function mine() {{\n{lines(12, 'kit')}}}"
    contents = [("k1", library), ("k2", patched), ("k3", f"function own() {{\n{lines(20, 'own')}}}"), ("k4", borrowed), ("k5", MINIFIED), ("k6", HAND), ("k7", None)]
    occurrences = [("o1", "k1", "a/kit.js", "kit"), ("o2", "k2", "b/kit.js", "kit"), ("o3", "k3", "a/own.js", "own"), ("o4", "k4", "a/mine.js", "mine"), ("o5", "k5", "a/z.js", "q"), ("o6", "k6", "a/z.js", "sendReply"), ("o7", "k7", None, None), ("o8", "k3", "third_party/own.js", "own"), ("o9", "lost", "c.js", "f"), ("o9", "lost", "c.js", "f"), (None, "k5", "d.js", "f")]
    holders = [("r1", "o1"), ("r2", "o2"), ("r1", "o3"), ("r3", "o4"), ("r3", "o5"), ("r3", "o6"), ("r1", "o8"), ("r1", "o1")]
    tables = spark.createDataFrame(occurrences, "occ_key string, content_key string, path string, symbol string"), spark.createDataFrame(contents, "content_key string, code string"), spark.createDataFrame(holders, "repo string, occ_key string")
    got = {r["occ_key"]: r["reason"] for r in foreign_files(*tables).collect()}
    assert got == {"o1": "vendored", "o2": "vendored", "o5": "minified", "o6": "minified", "o8": "vendored"}
    assert foreign_files(*(t.limit(0) for t in tables)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_packing_is_sound_and_tight(seed):
    sizes = np.random.default_rng(seed).integers(1, 400, size=3000)
    for capacities in ([512], [256, 512, 2048], [2048]):
        fitting = sizes[sizes <= max(capacities)]
        where, capacity = packing.pack(fitting, capacities)
        used = np.bincount(where, fitting, len(capacity))
        assert (used <= capacity).all() and (used > 0).all() and set(capacity) <= set(capacities)
        assert fitting.sum() / capacity.sum() > 0.99


def test_filled_containers_hold_everything(spark):
    rows = [(i, s) for i, s in enumerate([0, None, -3, 5, 10, 11, 25, 7, 7, 1, 10_000])] + [(7, 7)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long")
    got = packing.fill_containers(df, "doc_id", "tokens", {"a": {"small": 10}, "b": {"small": 10, "big": 30}}, per_shard=300).collect()
    for plan, most in (("a", 10), ("b", 30)):
        own = [r for r in got if r["plan"] == plan]
        for i in {i for i, _ in rows}:
            total = sum(max(0, s or 0) for j, s in rows if j == i)
            assert sum(r["tokens"] for r in own if r["doc_id"] == i) == total
        pieces = Counter((r["doc_id"], r["piece"]) for r in own)
        assert all(n == 1 or i == 7 for (i, _), n in pieces.items())
        assert all(p == 0 or dict(rows)[i] > most for i, p in pieces)
        inside = Counter()
        for r in own:
            if r["container"]:
                inside[r["container"], r["capacity"]] += r["tokens"]
        assert all(tokens <= c for (_, c), tokens in inside.items())
    assert sum(r["container"] is None for r in got) == 6
    assert packing.fill_containers(df.limit(0), "doc_id", "tokens", {"a": {"small": 10}}).count() == 0


def test_pivot_keeps_mass_and_expectation():
    sizes, parts = np.array([5.0, 1.0, 9.0, 2.0, 2.0, 7.0]), np.array([0.3, 0.5, 0.25, 0.0, 1.0, 0.6])
    mean = np.zeros(6)
    for seed in range(4000):
        out, left = mixing.pivot(sizes, parts, np.random.Generator(np.random.PCG64(seed)))
        assert (sizes * out).sum() == pytest.approx((sizes * parts).sum())
        assert all(x in (0.0, 1.0) for i, x in enumerate(out) if i != left)
        mean += out / 4000
    assert mean == pytest.approx(parts, abs=0.03)


@pytest.mark.parametrize("per_shard", [50_000, 40])
def test_mixture_reaches_shares(spark, per_shard):
    rng = random.Random(1)
    rows = [(i, rng.choice(["big", "Big ", "BIG", "big", "small", None, "", "other"]), rng.choice([None, 0, 5, 9, 30, 80])) for i in range(3000)]
    weights = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("none", None, 1), ("absent", 0.0, 2)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, n long"), "doc_id", "source", "n", weights, per_shard=per_shard)
    drawn, shares = mix.collect(), {r["source"]: r for r in report.collect()}
    assert set(shares) == {"big", "small"} and {r["source"] for r in drawn} == {"big", "small"}
    assert len({r["doc_id"] for r in drawn}) == len(drawn)
    assert all(1 <= r["copies"] <= shares[r["source"]]["max_repeats"] for r in drawn)
    assert all(abs(r["share"] - 0.5) < 0.005 for r in shares.values())
    again = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, n long").repartition(3), "doc_id", "source", "n", weights, per_shard=per_shard)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, drawn))


def test_small_source_falls_short(spark):
    rows = spark.createDataFrame([(i, "a" if i else "b", 10) for i in range(100)], "doc_id long, source string, n long")
    weights = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 4)], "source string, target_share double, max_repeats int")
    shares = {r["source"]: r["drawn"] for r in mixing.mix_sources(rows, "doc_id", "source", "n", weights, total=1000)[1].collect()}
    assert shares == {"a": 500, "b": 40}
    assert mixing.mix_sources(rows.limit(0), "doc_id", "source", "n", weights)[0].count() == 0


def test_subjects_of_held_out_documents(spark):
    rng = random.Random(5)
    terms = {s: [f"{s}{c}" + "x" * i for i in range(4) for c in "abcdefghij"] for s in ("sea", "sky", "soil")}
    rows, truth = [], {}
    for d in range(600):
        own = rng.sample(sorted(terms), rng.choice([1, 1, 2]))
        sentences = [f"The {rng.choice(terms[s])} and the {rng.choice(terms[s])} meet again." for s in own for _ in range(4)]
        other = rng.choice([s for s in terms if s not in own])
        sentences += ["Store the array and print each loop."] * 2 + [f"A {rng.choice(terms[other])} passes by."]
        rng.shuffle(sentences)
        rows.append((d, " ".join(sentences), "x"))
        truth[d] = set(own)
    rows += [(9001, None, "x"), (9002, "", "x"), (9003, "12 34", "x"), (None, "The seaa.", "x")]
    labels = [(d, rng.choice([s, s.upper(), f" {s} "])) for d in range(0, 200) for s in truth[d]] + [(1, "unknown"), (2, None), (3, "sky")]
    tables = spark.createDataFrame(rows, "doc_id long, text string, subject string"), spark.createDataFrame(labels, "doc_id long, subject string"), spark.createDataFrame([("sea",), ("sky",), ("soil",)], "subject string")
    got = defaultdict(set)
    for r in main_subjects(subject_shares(*tables)).collect():
        got[r["doc_id"]].add(r["subject"])
    assert sum(got[d] == truth[d] for d in range(200, 600)) > 0.97 * 400
    assert not set(got) - set(range(600))
    assert subject_shares(tables[0].limit(0), *tables[1:]).count() == 0
    assert subject_shares(tables[0], tables[1].limit(0), tables[2]).count() == 0


def test_units():
    assert len(units_of("# Title\nOne sentence here. Another one!\nx = call(1)\n-----Input-----\n3 4\n")) == 3
    assert units_of("Only a heading") == [["only", "a", "heading"]] and units_of("12\n") == []


def test_units_equal_regular_expressions():
    from loomwright.llm.units import term_hash, unit_terms

    rng = random.Random(4)
    bits = ["A word. ", "aBcD HTTPServer x1y _foo\n", 'He said "no." Then) .) left', "return x", "returned", "\r\n", "12 3\t", "## Head", "über Größe!", "x = f(y);", " ", "\x00", "日本 語. ", "😀 a"]
    texts = [None, "", "12\n", "Only a heading"] + ["".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(300)]
    terms, places, offsets, units = unit_terms(texts)
    for i, text in enumerate(texts):
        want = units_of((text or "").replace("\x00", " "))
        assert units[i] == len(want)
        got = set(zip(places[offsets[i] : offsets[i + 1]].tolist(), terms[offsets[i] : offsets[i + 1]].tolist()))
        assert got == {(n, term_hash(w)) for n, unit in enumerate(want) for w in unit}
    assert all(len(x) == 0 for x in unit_terms([None, " "])[:2])


def test_repeated_and_missing_ids_are_spread(spark):
    from loomwright.llm.tokens import numbered

    rows = spark.createDataFrame([(None, 5)] * 700 + [(1, 7)] * 300 + [(2, 3)], "doc_id long, tokens long")
    got = numbered(rows, ["doc_id", "tokens"]).collect()
    assert len(got) == len({r["row"] for r in got}) == 1001
    assert Counter((r["doc_id"], r["tokens"]) for r in got) == {(None, 5): 700, (1, 7): 300, (2, 3): 1}
    filled = packing.fill_containers(rows, "doc_id", "tokens", {"a": {"small": 32}}, per_shard=100).collect()
    used = Counter()
    for r in filled:
        used[r["container"]] += r["tokens"]
    assert max(used.values()) <= 32 and sum(used.values()) == 700 * 5 + 300 * 7 + 3
    assert len({c.split("-")[2] for c in used if c.startswith("a-0-")}) > 5
    at_once = packing.pack(np.array([5] * 700 + [7] * 300 + [3]), [32])[1]
    assert len(used) <= 1.02 * len(at_once)
    source = rows.withColumn("source", F.lit("s"))
    weights = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mix_sources(source, "doc_id", "source", "tokens", weights, total=2800, per_shard=50)
    assert abs(report.first()["drawn"] - 2800) <= 7 and mix.count() > 300


def test_renamed_copies_and_repeated_shapes(spark):
    def function(name, seed):
        rng = random.Random(seed)
        return f"function {name}() {{\n" + "".join(f"  {rng.choice(['const', 'let'])} a{rng.randrange(10**6)} = other.step{rng.randrange(10**6)}(value{i});\n" for i in range(9)) + "}"

    contents = [(f"k{i}", function(f"f{i}", i)) for i in range(8)]
    occurrences = [("o1", "k1", "a/kit.js", "f1"), ("o2", "k2", "a/kit.js", "f2"), ("o3", "k1", "b/other.js", "f1"), ("o4", "k2", "b/other.js", "f2"), ("o5", "k3", "c/mine.js", "f3"), ("o6", "k4", "c/mine.js", "f4"), ("o7", "k3", "d/big.js", "f3"), ("o8", "k5", "d/big.js", "f5"), ("o9", "k6", "d/big.js", "f6")]
    holders = [(r, f"o{i}") for r, own in (("r1", (1, 2)), ("r2", (3, 4)), ("r3", (5, 6)), ("r4", (7, 8, 9))) for i in own]
    tables = spark.createDataFrame(occurrences, "occ_key string, content_key string, path string, symbol string"), spark.createDataFrame(contents, "content_key string, code string"), spark.createDataFrame(holders, "repo string, occ_key string")
    assert {r["occ_key"] for r in foreign_files(*tables).collect()} == {"o1", "o2", "o3", "o4"}
    printed = "x.encode = function encode(m, w) {\n" + "".join(f"  if (m.f{i} != null) w.uint32({i}).string(m.f{i});\n" for i in range(8)) + "};"
    assert code_kind(printed) == "generated"


def test_shares_of_records_equal_brute_force(spark):
    texts = corpus(11, 40)
    rng = random.Random(2)
    rows = [("s", f"i{i}", t, rng.random() < 0.5, rng.random() < 0.6) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "space string, id string, text string, train boolean, held boolean")
    pairs, members = cross_split_overlaps(df)
    got = {r["id"]: r for r in record_shares(cut_records(df)).collect()}
    assert set(got) == {r[1] for r in rows if r[3] or r[4]}
    for _, i, t, train, held in rows:
        if train or held:
            own = shingles(t, 4)
            others = set().union(*(shingles(x[2], 4) for x in rows if x[3] and x[1] != i))
            assert got[i]["run_share"] == pytest.approx(len(own & others) / len(own) if own else 0.0, abs=1e-8)
            assert 0 <= got[i]["chunk_share"] <= 1 and (own - others or not own or got[i]["chunk_share"] == 1)
    best = {r["id"]: r["overlap"] for r in held_overlaps(pairs, members).collect()}
    for _, i, t, _, held in rows:
        if held:
            near = [len(shingles(t, 4) & shingles(x[2], 4)) / min(len(shingles(t, 4)), len(shingles(x[2], 4))) for x in rows if x[3] and x[1] != i and shingles(t, 4) and shingles(x[2], 4)]
            want = max([n for n in near if n >= 0.6], default=None)
            assert best[i] == (want if want is None else pytest.approx(want))


def test_token_counts_round_trip(spark):
    from loomwright.llm.tokens import TOKENIZERS, encoding

    texts = ["", None, "Hello wörld\n\n  x", "a" * 20000, "<|endoftext|>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r["id"]: r["tokens"] for r in token_counts(df, "text", ["id"]).collect()}
    for i, text in enumerate(texts):
        pieces = encoding(TOKENIZERS).encode_ordinary(text or "")
        assert got[i] == len(pieces) and encoding(TOKENIZERS).decode(pieces) == (text or "")
