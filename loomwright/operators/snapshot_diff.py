"""What changed between full snapshots, by subtracting invertible Bloom lookup tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.session import durable

HASHES = 3
GROWTH = 4
MOST_ROUNDS = 4


def snapshot_changes(listing: DataFrame, pairs: DataFrame, snapshot: str, parent: str, entity: list[str], value: str, keys_per_bucket: int = 64, cells: int = 24) -> DataFrame:
    """Which entities were added, removed or changed in each snapshot against its parent.

    listing: (snapshot, entity..., value), the full content of each snapshot; repeated rows count once. An entity
    with several values in one snapshot counts as changed if the set of values differs. pairs: (snapshot, parent),
    one row per comparison; rows with a NULL side don't count. A snapshot without rows is empty: everything in the
    other side was added or removed. NULL entity parts and values are values like any other. Other columns are not
    looked at. Empty tables give no rows.

    Returns (snapshot, parent, entity..., change), change one of added, removed, changed.

    Method: a snapshot's entries, (hash of the entity, hash of entity and values), are put into buckets by entity
    hash, about `keys_per_bucket` to a bucket, and each bucket into an invertible Bloom lookup table of `cells`
    cells (count, and exclusive or of both hashes; every entry is in three cells). Subtracting the parent's table
    leaves the differing entries alone. They are read off by peeling: a cell that holds one entry gives it up, which
    is then taken out of its other cells. A bucket counts as read if no cell is left and the number and exclusive
    or of the entries read equal the difference of the two sides' bucket digests; all other buckets are built again
    with four times the cells, up to MOST_ROUNDS times. Buckets that still can't be read, where two different entries
    have one hash, say, are compared by an exact join of their entries, so this always ends.

    Scale: listings are hash-aggregated once; the tables' cells are added up map-side before they are shuffled by
    (snapshot, bucket). Peeling runs over Arrow batches of buckets, each of bounded size, not per snapshot, so a
    snapshot with a third of all rows is spread over its buckets.
    """
    names = [f"e{i}" for i in range(len(entity))]
    sides = pairs.select(F.col(snapshot).alias("child"), F.col(parent).alias("parent")).dropna().distinct()
    flags = [part for n in names for part in (F.col(n).isNull(), F.col(n))]
    listed = listing.select(F.col(snapshot).alias("snapshot"), *(F.col(e).alias(n) for e, n in zip(entity, names)), F.col(value).alias("value")).distinct()
    entries = (
        listed.groupBy("snapshot", *names)
        .agg(F.bit_xor(F.xxhash64(F.col("value").isNull(), "value")).alias("v"), F.count(F.lit(1)).alias("n"))
        .withColumn("key", F.xxhash64(F.lit(11), *flags))
        .withColumn("pair", F.xxhash64(F.lit(13), "key", *flags, "v", "n"))
        .drop("v", "n")
    )
    entries = durable(entries)
    sizes = entries.groupBy("snapshot").agg(F.count(F.lit(1)).alias("size"))
    of_child, of_parent = (sizes.withColumnsRenamed({"snapshot": s, "size": f"{s}_size"}) for s in ("child", "parent"))
    larger = F.greatest(F.coalesce("child_size", F.lit(0)), F.coalesce("parent_size", F.lit(0)))
    shaped = sides.join(of_child, "child", "left").join(of_parent, "parent", "left").select("child", "parent", F.greatest(F.lit(1), F.ceil(larger / keys_per_bucket)).alias("buckets"))
    signed = shaped.select("child", "parent", "buckets", F.explode(F.array(F.struct(F.col("child").alias("snapshot"), F.lit(1).alias("sign")), F.struct(F.col("parent").alias("snapshot"), F.lit(-1).alias("sign")))).alias("side")).select("child", "parent", "buckets", "side.*")
    spread = signed.join(entries.select("snapshot", "key", "pair"), "snapshot").select("child", "parent", "sign", "key", "pair", F.pmod("key", "buckets").alias("bucket"))

    found: list[DataFrame] = []
    todo: DataFrame | None = None
    for _ in range(MOST_ROUNDS):
        work = spread if todo is None else spread.join(todo, ["child", "parent", "bucket"], "left_semi")
        peeled = durable(_peel(work, cells))
        found.append(peeled.filter("key IS NOT NULL").select("child", "parent", "key", "sign"))
        todo = peeled.filter("key IS NULL").select("child", "parent", "bucket")
        if todo.isEmpty():
            break
        cells *= GROWTH
    else:
        entry = ["child", "parent", "key", "pair"]
        sides = spread.join(todo, ["child", "parent", "bucket"], "left_semi").select(*entry, "sign")
        one, two = (sides.filter(F.col("sign") == x) for x in (1, -1))
        found += [a.join(b.select(*entry), entry, "left_anti").select("child", "parent", "key", "sign") for a, b in ((one, two), (two, one))]
    recovered = found[0]
    for more in found[1:]:
        recovered = recovered.unionByName(more)
    kinds = recovered.groupBy("child", "parent", "key").agg(F.max(F.col("sign") > 0).alias("here"), F.max(F.col("sign") < 0).alias("there"))
    change = F.when(F.col("here") & F.col("there"), "changed").when(F.col("here"), "added").otherwise("removed")
    kinds = kinds.select("child", "parent", "key", "here", change.alias("change"))
    located = kinds.withColumn("snapshot", F.when(F.col("here"), F.col("child")).otherwise(F.col("parent")))
    resolved = located.join(entries.select("snapshot", "key", *names), ["snapshot", "key"])
    return resolved.select(F.col("child").alias(snapshot), F.col("parent").alias(parent), *(F.col(n).alias(e) for n, e in zip(names, entity)), "change")


def _peel(work: DataFrame, cells: int) -> DataFrame:
    """Entries that differ, per (child, parent, bucket); a row with a NULL key for each bucket that couldn't be read.

    Two equal entries of opposite sign cancel out in every cell and in the bucket's digest.
    """
    share = cells // HASHES
    # the three cells of an entry lie in three equal parts of the table
    at = F.explode(F.array(*(F.pmod(F.xxhash64(F.lit(100 + k), "pair"), F.lit(share)).cast("int") + k * share for k in range(HASHES)), F.lit(-1))).alias("cell")
    filled = work.select("child", "parent", "bucket", at, "sign", "key", "pair").groupBy("child", "parent", "bucket", "cell").agg(F.sum("sign").cast("int").alias("count"), F.bit_xor("key").alias("key"), F.bit_xor("pair").alias("pair"), F.bit_xor(F.xxhash64(F.lit(7), "pair")).alias("check"))
    left = filled.filter("count != 0 OR key != 0 OR pair != 0")
    tables = left.groupBy("child", "parent", "bucket").agg(F.collect_list(F.struct("cell", "count", "key", "pair", "check")).alias("table"))
    arrays = tables.select("child", "parent", "bucket", *(F.col(f"table.{c}").alias(c) for c in ("cell", "count", "key", "pair", "check")))
    return arrays.mapInPandas(_peel_batches(share), "child string, parent string, bucket long, key long, pair long, sign int")


def _peel_batches(share: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield _peel_batch(batch, share)

    return run


def _peel_batch(batch: pd.DataFrame, share: int) -> pd.DataFrame:
    """Peel all buckets of a batch at once, a round at a time."""
    lengths = batch["cell"].map(len).to_numpy()
    row = np.repeat(np.arange(len(batch)), lengths)
    cell, count, key, pair, check = (np.concatenate(batch[c].to_numpy()).astype(t) for c, t in (("cell", np.int64), ("count", np.int64), ("key", np.int64), ("pair", np.int64), ("check", np.int64)))
    total = cell == -1  # the bucket's digest: all entries in one cell
    width = share * HASHES
    size = len(batch) * width
    counts, keys, pairs, checks = (np.zeros(size, dtype=np.int64) for _ in range(4))
    slot = row[~total] * width + cell[~total]
    counts[slot], keys[slot], pairs[slot], checks[slot] = count[~total], key[~total], pair[~total], check[~total]
    want_count, want_pair = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
    want_count[row[total]], want_pair[row[total]] = count[total], pair[total]
    got: list[tuple[np.ndarray, ...]] = []
    while True:
        pure = np.flatnonzero(np.abs(counts) == 1)
        pure = pure[_check(pairs[pure]) == checks[pure]] if len(pure) else pure
        if not len(pure):
            break
        owner = pure // width
        _, once = np.unique(np.stack([owner, pairs[pure]]), axis=1, return_index=True)
        pure, owner = pure[once], owner[once]
        k, p, c, s = keys[pure].copy(), pairs[pure].copy(), checks[pure].copy(), counts[pure].copy()
        got.append((owner, k, p, s))
        for h in range(HASHES):
            where = owner * width + h * share + np.mod(_xxhash64(100 + h, p), share)
            np.subtract.at(counts, where, s)
            np.bitwise_xor.at(keys, where, k)
            np.bitwise_xor.at(pairs, where, p)
            np.bitwise_xor.at(checks, where, c)
    owner, k, p, s = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, dtype=np.int64),) * 4
    have_count, have_pair = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
    np.add.at(have_count, owner, s)
    np.bitwise_xor.at(have_pair, owner, p)
    empty = ~((counts != 0) | (keys != 0) | (pairs != 0)).reshape(len(batch), width).any(axis=1)
    read = empty & (have_count == want_count) & (have_pair == want_pair)
    good, bad = read[owner], np.flatnonzero(~read)
    child, parent, bucket = (batch[c].to_numpy() for c in ("child", "parent", "bucket"))
    nothing = pd.array([pd.NA] * len(bad), dtype="Int64")
    return pd.DataFrame(
        {
            "child": np.concatenate([child[owner[good]], child[bad]]),
            "parent": np.concatenate([parent[owner[good]], parent[bad]]),
            "bucket": np.concatenate([bucket[owner[good]], bucket[bad]]),
            "key": pd.concat([pd.Series(k[good], dtype="Int64"), pd.Series(nothing)], ignore_index=True),
            "pair": pd.concat([pd.Series(p[good], dtype="Int64"), pd.Series(nothing)], ignore_index=True),
            "sign": pd.concat([pd.Series(s[good], dtype="Int32"), pd.Series(nothing).astype("Int32")], ignore_index=True),
        }
    )


# The primes of the public xxHash64 definition.
PRIMES = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _mix(hashed: np.ndarray) -> np.ndarray:
    hashed = (hashed ^ (hashed >> np.uint64(33))) * PRIMES[1]
    hashed = (hashed ^ (hashed >> np.uint64(29))) * PRIMES[2]
    return hashed ^ (hashed >> np.uint64(32))


def _hash_int(value: int, seed: np.ndarray) -> np.ndarray:
    """xxHash64 of a 4-byte integer, as F.xxhash64 has it."""
    h = seed + PRIMES[4] + np.uint64(4)
    h = h ^ (np.uint64(value & 0xFFFFFFFF) * PRIMES[0])
    return _mix(_rotl(h, 23) * PRIMES[1] + PRIMES[2])


def _hash_long(values: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """xxHash64 of 8-byte integers, as F.xxhash64 has it."""
    h = seed + PRIMES[4] + np.uint64(8)
    h = h ^ (_rotl(values.view(np.uint64) * PRIMES[1], 31) * PRIMES[0])
    return _mix(_rotl(h, 27) * PRIMES[0] + PRIMES[3])


def _xxhash64(literal: int, values: np.ndarray) -> np.ndarray:
    """F.xxhash64(F.lit(literal), values): each argument's hash is the next one's seed, the first seed is 42."""
    with np.errstate(over="ignore"):
        seed = _hash_int(literal, np.full(1, 42, dtype=np.uint64))
        return _hash_long(np.ascontiguousarray(values, dtype=np.int64), np.repeat(seed, len(values))).view(np.int64)


def _check(pairs: np.ndarray) -> np.ndarray:
    return _xxhash64(7, pairs)
