"""Items of varying length put into containers of fixed capacity, by dominance reduction and best fit.

Sizes are whole numbers up to the capacity, so the instance is its histogram: at most ``capacity`` numbers,
whatever the number of items. On the histogram

1. the Martello-Toth reduction fixes container contents that dominate every alternative for their largest
   item: alone where nothing else fits, with its exact complement, with the largest fitting item where only
   one more fits, with a pair that no other pair beats where only two more fit;
2. best fit in order of falling size places the rest.

Both work on classes of equal items and groups of equal containers, so the plan has few thousand steps. It
goes to the workers, where every item looks up its container by its rank among the items of its size. Ranks
are numbered per size and salt, with as many salts as keep a group small, so a size that a third of all items
share is no task's burden.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

CAPACITY = 2048
#: Items numbered in one window group, on average at most.
GROUP = 50_000


@dataclass
class Step:
    """``times`` equal containers, each with ``content[size]`` items of that size."""

    times: int
    content: dict[int, int] = field(default_factory=dict)


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[Step], dict[int, int]]:
    """Contents fixed without loss of optimality, and what remains of the instance."""
    left = {s: c for s, c in counts.items() if c > 0}
    sizes = sorted(left)
    steps: list[Step] = []

    def take(content: dict[int, int], times: int) -> None:
        steps.append(Step(times, content))
        for s, k in content.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
                sizes.pop(bisect.bisect_left(sizes, s))

    def fitting(room: int, less: dict[int, int]) -> int:
        """The largest size up to ``room`` of which an item is left besides ``less``; 0 if none."""
        i = bisect.bisect_right(sizes, room) - 1
        while i >= 0 and left[sizes[i]] <= less.get(sizes[i], 0):
            i -= 1
        return sizes[i] if i >= 0 else 0

    def smallest(n: int, less: dict[int, int]) -> list[int]:
        out: list[int] = []
        for s in sizes:
            out += [s] * min(n - len(out), left[s] - less.get(s, 0))
            if len(out) == n:
                break
        return out

    for j in sorted(left, reverse=True):
        while left.get(j):
            room, own = capacity - j, {j: 1}
            a = fitting(room, own)
            if not a:
                take({j: 1}, left[j] if fitting(room, {}) != j else 1)
                continue
            pair_times = left[j] // 2 if a == j else min(left[j], left[a])
            low = smallest(3, own)
            if a == room or len(low) < 2 or low[0] + low[1] > room:
                take({j: 2} if a == j else {j: 1, a: 1}, pair_times)
                continue
            if len(low) < 3 or sum(low) > room:  # at most two more
                used = dict(own)
                used[a] = used.get(a, 0) + 1
                b = fitting(room - a, used)
                # the largest second item of any pair: it needs a partner at least as large
                v = 0
                for s in reversed(sizes):
                    if 2 * s <= room and s > v:
                        need = left[s] - own.get(s, 0)
                        up = sizes[bisect.bisect_right(sizes, s)] if bisect.bisect_right(sizes, s) < len(sizes) else 0
                        if need >= 2 or (need == 1 and up and s + up <= room and (left[up] > own.get(up, 0))):
                            v = s
                            break
                if b and b >= v:
                    content: dict[int, int] = {}
                    for s in (j, a, b):
                        content[s] = content.get(s, 0) + 1
                    take(content, min(left[s] // k for s, k in content.items()) if len(content) == 3 else 1)
                    continue
            break
    return steps, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Step]:
    """Best fit in order of falling size, on groups of equal containers."""
    open_: dict[int, list[Step]] = {}  # room -> groups
    rooms: list[int] = []
    done: list[Step] = []

    def put(step: Step, room: int) -> None:
        if not room:
            done.append(step)
        elif room in open_:
            open_[room].append(step)
        else:
            open_[room] = [step]
            bisect.insort(rooms, room)

    for s in sorted(counts, reverse=True):
        c = counts[s]
        while c:
            i = bisect.bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                group = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            else:
                room, group = capacity, Step(c, {})
            k = room // s
            full = min(group.times, c // k)
            rest = group.times - full
            if full:
                put(Step(full, group.content | {s: k}), room - k * s)
                c -= full * k
            if rest and c and c < k:  # one more container takes what is left of the class
                put(Step(1, group.content | {s: c}), room - c * s)
                c, rest = 0, rest - 1
            if rest and group.content:
                put(Step(rest, group.content), room)
    for groups in open_.values():
        done += groups
    return done


def plan(counts: dict[int, int], capacity: int) -> list[Step]:
    """Contents of all containers for ``counts`` items of each size up to the capacity."""
    fixed, left = reduce_dominated(counts, capacity)
    return fixed + best_fit(left, capacity)


def pack(df: DataFrame, key: str, size: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(container_id, key, piece, start, n_tokens) of each item.

    ``df`` has one row per item, unique by ``key``. Items of null or no size are left out. An item above the
    capacity is cut into full containers and one last piece, which is placed like any item; every other item
    is whole (piece 0, start 0). Items of equal size are interchangeable and numbered by key. An empty table
    gives no rows.
    """
    items = df.select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("n")).filter("n > 0")
    piece = F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / capacity).cast("bigint")))
    pieces = items.select("key", "n", piece.alias("piece", "q")).select(
        "key", "piece", (F.col("q") * capacity).alias("start"), F.least(F.lit(capacity), F.col("n") - F.col("q") * capacity).cast("int").alias("s")
    )
    pieces = cut(pieces)
    sizes = cut(pieces.groupBy("s").count())  # at most ``capacity`` rows, on the driver as in a broadcast
    counts = {r["s"]: r["count"] for r in sizes.collect()}

    base = 0
    slots: dict[int, list[list[int]]] = {s: [] for s in counts}  # size -> [first rank, first container, items in each]
    at = dict.fromkeys(counts, 0)
    for step in plan(counts, capacity):
        for s, k in step.content.items():
            slots[s].append([at[s], base, k])
            at[s] += k * step.times
        base += step.times
    table = {s: np.array(v, dtype=np.int64) for s, v in slots.items()}

    salts = F.broadcast(sizes.select("s", F.ceil(F.col("count") / group).alias("salts")))
    salted = pieces.join(salts, "s").withColumn("salt", F.pmod(F.xxhash64("key", "piece"), "salts")).drop("salts")
    sums = salted.groupBy("s", "salt").count()
    before = Window.partitionBy("s").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("s", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("s", "salt").orderBy("key", "piece")) - 1
    ranked = salted.withColumn("r", rank).join(sums, ["s", "salt"]).select("key", "piece", "start", "s", (F.col("r") + F.col("offset")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            container = np.empty(len(b), dtype=np.int64)
            rank_of, size_of = b["rank"].to_numpy(), b["s"].to_numpy()
            for s in np.unique(size_of):
                mine = size_of == s
                t = table[int(s)]
                i = np.searchsorted(t[:, 0], rank_of[mine], side="right") - 1
                container[mine] = t[i, 1] + (rank_of[mine] - t[i, 0]) // t[i, 2]
            yield pd.DataFrame({"container_id": container, "key": b["key"], "piece": b["piece"], "start": b["start"], "n_tokens": size_of.astype(np.int64)})

    kind = dict(df.dtypes)[key]
    out = ranked.mapInPandas(place, f"container_id bigint, key {kind}, piece int, start bigint, n_tokens bigint")
    return out.withColumnRenamed("key", key)
