"""Transitive closure of an edge table, as a set, from the bound end only.

Semi-naive: only pairs found in the last round are extended, and known pairs are dropped by an anti-join. A
node reaches itself only along a loop. Each round is cut by a reliable checkpoint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, cut_count

#: Rounds whose new pairs are kept apart before they are put together.
PARTS = 8


def closure(edges: DataFrame, seeds: DataFrame | None = None, backward: bool = False) -> DataFrame:
    """Distinct (s, o) such that o can be reached from s by one or more (s, o) edges.

    ``seeds``: one column ``s`` (or ``o`` with ``backward``) to start from; None: all nodes. Null ends of
    edges reach nothing.
    """
    e = edges.select("s", "o").filter("s is not null and o is not null").distinct()
    if backward:
        e = e.select(F.col("o").alias("s"), F.col("s").alias("o"))
        seeds = seeds.select(F.col("o").alias("s")) if seeds is not None else None
    e = cut(e)
    if seeds is None:
        return _all_pairs(e)
    delta, n = cut_count(e.join(seeds.distinct(), "s", "left_semi"))
    parts = [delta]
    step = e.select(F.col("s").alias("o"), F.col("o").alias("next"))
    while n:
        known = reduce(DataFrame.unionByName, parts)
        delta, n = cut_count(delta.join(step, "o").select("s", F.col("next").alias("o")).distinct().join(known, ["s", "o"], "left_anti"))
        parts.append(delta)
        if len(parts) > PARTS:  # else plans grow with the rounds
            parts = [cut(reduce(DataFrame.unionByName, parts))]
    known = reduce(DataFrame.unionByName, parts)
    return known.select(F.col("o").alias("s"), F.col("s").alias("o")) if backward else known


def _all_pairs(e: DataFrame) -> DataFrame:
    """From every node: paths double in each round, so the rounds are logarithmic in the longest path."""
    known = delta = e
    while delta.limit(1).count():
        on = lambda d: d.select(F.col("s").alias("o"), F.col("o").alias("next"))
        longer = delta.join(on(known), "o").select("s", F.col("next").alias("o"))
        delta = cut(longer.distinct().join(known, ["s", "o"], "left_anti"))
        known = cut(known.unionByName(delta))
    return known


def superclasses(edges: DataFrame) -> DataFrame:
    """Distinct (s, o, depth): each class with each of its superclasses and the least number of steps.

    The reach doubles in each round: a pair further apart has a class on its way that is exactly ``reach`` steps
    up, so only pairs at that depth are extended. If none is new, no pair lies beyond; loops end so as well."""
    known, n = cut_count(edges.select("s", "o").filter("s is not null and o is not null").distinct().withColumn("depth", F.lit(1)))
    reach, before = 1, 0
    while n > before:
        step = known.select(F.col("s").alias("o"), F.col("o").alias("next"), F.col("depth").alias("more"))
        longer = known.filter(F.col("depth") == reach).join(step, "o").select("s", F.col("next").alias("o"), (F.col("depth") + F.col("more")).alias("depth"))
        before = n
        known, n = cut_count(known.unionByName(longer).groupBy("s", "o").agg(F.min("depth").alias("depth")))
        reach *= 2
    return known
