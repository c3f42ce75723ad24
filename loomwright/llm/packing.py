"""Filling fixed-capacity containers: variable-capacity best fit."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.tokens import numbered
from loomwright.session import durable

ITEMS_PER_SHARD = 50_000
FAN_IN = 16
OPEN_SHARE = 0.002  # a container with more room than this share left is packed again with those of other shards


class _Remaining:
    """How many items of each size are left, with a bit set per size for finding the largest that fits."""

    def __init__(self, sizes: np.ndarray, largest: int) -> None:
        self.counts = np.bincount(sizes, minlength=largest + 1).tolist()
        self.bits = sum(1 << s for s, c in enumerate(self.counts) if c)

    def take(self, size: int) -> None:
        self.counts[size] -= 1
        if not self.counts[size]:
            self.bits &= ~(1 << size)

    def waste(self, room: int) -> int:
        """What would stay free if the largest items that fit were put in one after another."""
        used: dict[int, int] = {}
        bits = self.bits
        while room:
            fitting = bits & ((1 << (room + 1)) - 1)
            if not fitting:
                break
            size = fitting.bit_length() - 1
            n = min(self.counts[size] - used.get(size, 0), room // size)
            if n <= 0:
                break
            used[size] = used.get(size, 0) + n
            room -= n * size
            if used[size] == self.counts[size]:
                bits &= ~(1 << size)
        return room


def pack(sizes: np.ndarray, capacities: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(container of each item, capacity of each container) for items of 1 to max(capacities).

    Items go from large to small into the open container with the least room that takes them. If none does, the
    capacity is opened that would leave the smallest share unused if filled up with the largest items left; among
    equals the largest. In the end each container is downsized to the smallest capacity that holds its contents.
    """
    capacities = sorted(set(capacities))
    order = np.argsort(-sizes, kind="stable")
    left = _Remaining(sizes, capacities[-1])
    where = np.zeros(len(sizes), dtype=np.int64)
    contents: list[int] = []
    with_room: dict[int, list[int]] = {}
    rooms = 0
    room_of: list[int] = []
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        left.take(size)
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            holder = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
        else:
            able = [c for c in capacities if c >= size]
            room = able[0] if len(able) == 1 else min(able, key=lambda c: (left.waste(c - size) / c, -c))
            holder = len(contents)
            contents.append(0)
            room_of.append(room)
        where[i] = holder
        contents[holder] += size
        room -= size
        if room:
            with_room.setdefault(room, []).append(holder)
            rooms |= 1 << room
    final = np.asarray(capacities)[np.searchsorted(capacities, contents)] if contents else np.zeros(0, dtype=np.int64)
    return where, final


def fill_containers(items: DataFrame, item: str, size: str, plans: dict[str, dict[str, int]], per_shard: int = ITEMS_PER_SHARD) -> DataFrame:
    """Put all items into containers, once for each plan.

    items: (item, size); plans: plan -> {container kind: capacity}, the capacities that may be used together. Returns
    (plan, item, piece, start, tokens, container, kind, capacity): one row per placed piece. An item larger than the
    plan's largest capacity is split into pieces of that capacity and a rest; no other item is split. Items of size
    0, NULL or below 0 take no room: one row with tokens 0 and a NULL container, kind and capacity. Repeated rows are
    items of their own. A NULL item id is an id like any other. Kinds of equal capacity count as the first by name.
    Other columns are not looked at. An empty table, or no plans, gives no rows. Capacities must be 1 or more.

    Scale: pieces are hashed into shards of about `per_shard` pieces by id, size, number among equal rows and piece, so
    neither a NULL nor a repeated id can fill a shard, and each shard is packed by itself. The badly filled containers
    that a shard ends with (at most per_shard / FAN_IN pieces of them, the emptiest first; the rest stay as they are)
    are packed again, those of FAN_IN shards together, until one shard is left. So no task holds more than about
    per_shard pieces. Sizes and each level are checkpointed.
    """
    if not plans:
        raise ValueError("no plans")
    for kinds in plans.values():
        if not kinds or min(kinds.values()) < 1:
            raise ValueError("a plan needs capacities of 1 or more")
    sized = items.select(F.col(item).alias("item"), F.greatest(F.lit(0), F.coalesce(F.col(size), F.lit(0))).cast("long").alias("size"))
    sized = durable(numbered(sized, ["item", "size"], 5))
    largest = F.explode(F.array(*(F.struct(F.lit(p).alias("plan"), F.lit(max(k.values())).cast("long").alias("most")) for p, k in plans.items()))).alias("p")
    planned = sized.select("item", "size", "row", largest).select("item", "size", "row", "p.plan", "p.most")
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / F.col("most")))).alias("piece")
    pieces = planned.filter("size > 0").select("plan", "item", "row", "size", "most", piece)
    start = F.col("piece") * F.col("most")
    pieces = pieces.select("plan", "item", "row", "piece", start.alias("start"), F.least("most", F.col("size") - start).alias("tokens"))
    counts = {r["plan"]: r["count"] for r in pieces.groupBy("plan").count().collect()}  # a row a plan
    shards = {p: max(1, -(-counts.get(p, 0) // per_shard)) for p in plans}
    kind_of = {p: {c: min(n for n, x in k.items() if x == c) for c in k.values()} for p, k in plans.items()}

    def packed(level: int, last: bool):
        def run(shard: pd.DataFrame) -> pd.DataFrame:
            plan = shard["plan"].iat[0]
            shard = shard.sort_values(["tokens", "row", "piece"], ascending=[False, True, True], kind="stable")
            where, capacity = pack(shard["tokens"].to_numpy(), list(kind_of[plan]))
            own, again = capacity[where], np.zeros(len(shard), dtype=bool)
            if not last:
                used = np.bincount(where, shard["tokens"].to_numpy(), len(capacity))
                room = 1 - used / capacity
                order = np.argsort(-room, kind="stable")
                held = np.bincount(where, minlength=len(capacity))
                few = (np.cumsum(held[order]) <= max(1, per_shard // FAN_IN)) & (room[order] > OPEN_SHARE)
                again = np.isin(where, order[few])
            names = [f"{plan}-{level}-{shard['shard'].iat[0]}-{w}" for w in where]
            return shard.assign(container=names, kind=[kind_of[plan][c] for c in own.tolist()], capacity=own, again=again)

        return run

    item_type = sized.schema["item"].dataType.simpleString()
    schema = f"plan string, item {item_type}, row long, piece long, start long, tokens long, shard long, container string, kind string, capacity long, again boolean"
    many = reduce(lambda c, p: c.when(F.col("plan") == p, shards[p]), plans, F.when(F.lit(False), 1)).cast("long")
    todo = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), many))
    full, level, most = None, 0, max(shards.values())
    while True:
        done = durable(todo.groupBy("plan", "shard").applyInPandas(packed(level, most == 1), schema))
        settled = done.filter("NOT again").select("plan", "item", "piece", "start", "tokens", "container", "kind", "capacity")
        full = settled if full is None else full.unionByName(settled)
        if most == 1:
            break
        todo = done.filter("again").select(*todo.columns).withColumn("shard", F.floor(F.col("shard") / FAN_IN))
        level, most = level + 1, -(-most // FAN_IN)
    nothing = planned.filter("size = 0").select("plan", "item", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), F.col("size").alias("tokens"), F.lit(None).cast("string").alias("container"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("capacity"))
    return full.unionByName(nothing).withColumnRenamed("item", item)


def fill_report(filled: DataFrame) -> DataFrame:
    """(plan, kind, containers, tokens, room, fill) of the containers used; fill is tokens / room."""
    each = filled.filter("container IS NOT NULL").groupBy("plan", "kind", "container").agg(F.max("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
    sums = each.groupBy("plan", "kind").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum("capacity").alias("room"))
    return sums.withColumn("fill", F.round(F.col("tokens") / F.col("room"), 6))
