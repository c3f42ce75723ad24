import hashlib
import re

import pytest
from pyspark.sql import functions as F

from loomwright.functions import hashing, text, tokenize, vectors, views

TEXTS = [
    "getHTTPResponse _foo __init__ x_1 parse_queryString2Int", "aBCd ABcDEf 3abc été naïve", "HTML5Parser a1B2 _ __", "",
    "the input_value of int x", "٣٤ 12 a", "Print if_else",
]


def brute_tokens(value):
    stop, out = set(tokenize.STOP_WORDS), []
    for word in re.findall(r"[A-Za-z_][A-Za-z0-9_]*|\d+", value):
        pieces = []
        for piece in word.split("_"):
            start = 0
            for i in range(1, len(piece)):
                rising = piece[i].isupper() and (piece[i - 1].islower() or piece[i - 1].isdigit())
                last_of_run = piece[i].isupper() and piece[i - 1].isupper() and i + 1 < len(piece) and piece[i + 1].islower()
                if rising or last_of_run:
                    pieces.append(piece[start:i])
                    start = i
            pieces.append(piece[start:])
        pieces = [p.lower() for p in pieces if p]
        out += [w for w in [word.lower()] if w not in stop]
        out += [p for p in pieces if len(pieces) > 1 and p not in stop and len(p) > 1]
    return out


def test_tokens_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    got = {r["id"]: r["w"] for r in df.select("id", tokenize.tokens(F.col("t")).alias("w")).collect()}
    assert got == {i: brute_tokens(t) for i, t in enumerate(TEXTS)}
    counts = {(r["id"], r["token"]): r["tf"] for r in tokenize.token_counts(df, ["id"], "t").collect()}
    want = {}
    for i, t in enumerate(TEXTS):
        for w in brute_tokens(t):
            want[i, w] = want.get((i, w), 0) + 1
    assert counts == want


def test_tokens_of_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(tokenize.tokens(F.col("t")).alias("w")).first()["w"] is None


STATEMENT = "Title\nSome words\n12 3\n\n-----Input-----\nA number\nExamples:\n1 2\nshown here\nNote\nmore\n## Output Format\nprint it\n```python\ndef f():\n    pass\n```\nNotes:\nx\n"


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("raw", STATEMENT),
        ("core", "Title\nSome words\n-----Input-----\nA number\n## Output Format\nprint it\n\ndef f():\n    pass"),
        ("core2", "Title\nSome words\n12 3\n\n-----Input-----\nA number\n## Output Format\nprint it\n\ndef f():\n    pass"),
        ("starter", "def f():\n    pass"),
    ],
)
def test_views(spark, name, want):
    df = spark.createDataFrame([(STATEMENT,)], "t string")
    assert df.select(views.VIEWS[name](F.col("t")).alias("v")).first()["v"] == want


def test_views_of_empty_null_and_long(spark):
    long = "word\n" * 20000
    df = spark.createDataFrame([("",), (None,), (long,)], "t string")
    got = [r["v"] for r in df.select(views.core_view(F.col("t")).alias("v")).collect()]
    assert got == ["", None, long.strip()]


@pytest.mark.parametrize(("line", "want"), [("Input:", "input"), ("### Sample Input 1:", "sample input"), ("Good luck!", None), ("input/output", "input/output"), ("Input: 3", None), ("~~ NOTES ~~", "notes"), ("", None)])
def test_section_names(spark, line, want):
    assert spark.createDataFrame([(line,)], "t string").select(views.section_name(F.col("t")).alias("s")).first()["s"] == want


def test_contest_style(spark):
    cases = {"x\n-----Input-----\ny": True, "Input:\r\n3": True, "the input is": False, "Input\n```python\nx\n```": False, "a\x85Input\x85b": False}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["c"] for r in df.select("t", text.is_contest_style(F.col("t")).alias("c")).collect()} == cases


@pytest.mark.parametrize("n", [5, 7])
def test_folds(spark, n):
    ids = [f"q{i}" for i in range(200)] + ["", "ü"]
    df = spark.createDataFrame([(i,) for i in ids], "q string")
    got = {r["q"]: r["f"] for r in df.select("q", hashing.fold(F.col("q"), n).alias("f")).collect()}
    assert got == {i: int(hashlib.sha256(i.encode()).hexdigest(), 16) % n for i in ids}


def test_keys(spark):
    df = spark.createDataFrame([("a/b.js", "f", 1, 2, "k")], "p string, s string, b int, e int, c string")
    row = df.select(hashing.occ_key(*(F.col(c) for c in "psbec")).alias("o"), hashing.content_key(F.col("p")).alias("k")).first()
    assert row["o"] == hashlib.sha256(b"a/b.js\0f\x001\x002\0k").hexdigest()
    assert row["k"] == hashlib.sha256(b"a/b.js").hexdigest()
    assert hashing.recipe_id({"b": 1, "a": 2}) == hashlib.sha256(b'{"a": 2, "b": 1}').hexdigest()[:16]


def test_paths_counts_and_heads(spark):
    paths = {"a.js": True, "a.jsx": True, "a.ts": False, "node_modules/a.js": False, "a.js\n": False, "x.mjs": True}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r["p"]: r["k"] for r in df.select("p", text.is_indexed_path(F.col("p")).alias("k")).collect()} == paths
    words = spark.createDataFrame([("", 0), ("  a  b\n", 2), (None, None)], "t string, n int")
    assert all(r["n"] == r["w"] for r in words.select("n", text.word_count(F.col("t")).alias("w")).collect())
    heads = spark.createDataFrame([("a\nb\nc",), ("a",)], "t string").select(text.snippet_head(F.col("t"), 2, "> ").alias("h")).collect()
    assert [r["h"] for r in heads] == ["> a\n> b\n> …", "> a"]


def test_numeric_first(spark):
    df = spark.createDataFrame([("10",), ("9",), ("q1",), ("a",), ("007",)], "i string")
    assert [r["i"] for r in df.orderBy(*text.numeric_first(F.col("i"))).collect()] == ["007", "9", "10", "a", "q1"]


def test_hash_embedding(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha"), (2, ""), (3, None)], "id int, t string")
    got = {r["id"]: r["vec"] for r in vectors.hash_embedding(df, ["id"], "t").collect()}
    want = [0.0] * 256
    for word, n in (("alpha", 2), ("beta", 1)):
        want[int(hashlib.md5(word.encode()).hexdigest(), 16) % 256] += n
    assert got[1] == pytest.approx([w / 5**0.5 for w in want])
    assert set(got[2]) == set(got[3]) == {0.0} and len(got[2]) == 256


def test_vector_arithmetic(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    rows = df.select(vectors.dot(F.col("a"), F.col("b")).alias("d"), vectors.normalise(F.col("a")).alias("u")).collect()
    assert [r["d"] for r in rows] == [11.0, 0.0]
    assert [r["u"] for r in rows] == [[0.6, 0.8], [0.0, 0.0]]
