import random
from collections import defaultdict

import pytest

from loomwright.llm.handwritten import _copied

SCHEMA = "repo string, path string, symbol string, line long"


def brute(rows):
    """(repo, path) of copied files, every file compared with every other."""
    symbols = defaultdict(set)
    for _, _, s, line in rows:
        symbols[line].add(s)
    files = defaultdict(set)
    for r, p, s, line in rows:
        if len(symbols[line]) <= 3:
            files[r, p].add((s, line))
    own = {f: {line for _, line in held} for f, held in files.items()}
    found = set()
    for (r, p), held in files.items():
        homes = set()
        for (q, o), there in own.items():
            common = [x for x in held if x[1] in there]
            alike = len({s for s, _ in common}) >= 2 or common and p.rsplit("/", 1)[-1] == o.rsplit("/", 1)[-1]
            if q and q != r and alike and 2 * len(common) >= len(held) and 2 * len(common) >= len(there):
                homes.add(q)
        if len(homes) >= (1 if r else 2):
            found.add((r, p))
    return found


def copied(spark, rows):
    return [(r["repo"], r["path"]) for r in _copied(spark.createDataFrame(rows, SCHEMA)).collect()]


def test_copies_that_bundles_outvote_are_found(spark):
    # two files copy each of five libraries, whose every line is in a bundle of each of the ten repositories
    rows = [(f"r{repo}", f"lib/part{repo}.js", f"f{repo // 2}{i % 2}", 100 * (repo // 2) + i) for repo in range(10) for i in range(18)]
    for repo in range(10):
        rows += [(f"r{repo}", f"dist/bundle{repo}.js", f"f{k}{i % 2}", 100 * k + i) for k in range(5) for i in range(18)]
        rows += [(f"r{repo}", f"dist/bundle{repo}.js", f"g{repo}", 10_000 + 1000 * repo + i) for i in range(150)]
    got = copied(spark, rows)
    assert sorted(got) == [(f"r{repo}", f"lib/part{repo}.js") for repo in range(10)] == sorted(brute(rows))


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_copies_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    libraries = [[(f"s{k}{i % rng.choice([1, 2, 4])}", 100 * k + i) for i in range(rng.randrange(4, 30))] for k in range(7)]
    rows = []
    for n in range(150):
        held = [x for k in rng.sample(range(7), rng.choice([1, 1, 1, 2, 4])) for x in libraries[k] if rng.random() < rng.choice([1.0, 0.8, 0.5])]
        if rng.random() < 0.2 and held:
            held = [x for x in held if x[0] == held[0][0]]
        held += [(f"o{n}", 10_000 + 1000 * n + i) for i in range(rng.choice([0, 0, 3, 15, 60]))]
        repo, path = rng.choice(["", *(f"r{i}" for i in range(9))]), f"d{n}/{rng.choice(['a', 'b', f'c{n}'])}.js"
        rows += [(repo, path, s, line) for s, line in held]
    got, want = copied(spark, rows), brute(rows)
    assert len(got) == len(set(got)) and set(got) == want and 10 < len(want) < 140
