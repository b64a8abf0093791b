"""Joins against a side that is unique per key when the probing side may be skewed.

A key is heavy when it holds more than ``share`` of the probing rows, so there are fewer than
``1 / share`` heavy keys whatever the size of the input: the rows of the unique side for those keys
have a proven bound and are broadcast, and the hot probing rows are never shuffled. All other keys go
through an ordinary shuffle join.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key above this share of the rows is heavy: fewer than 64 such keys can exist.
HEAVY_SHARE = 1 / 64
#: Below this number of rows a key is no burden for one task and is left to the shuffle.
HEAVY_FLOOR = 20_000


def heavy_keys(counts: DataFrame, keys: Sequence[str], n: str, share: float = HEAVY_SHARE, floor: int = HEAVY_FLOOR) -> list[tuple]:
    """Keys holding more than ``share`` of all rows and at least ``floor`` rows, from partial counts.

    The list has fewer than ``1 / share`` entries by the pigeonhole principle. Null keys never match
    in a join and are not listed.
    """
    per_key = counts.groupBy(*keys).agg(F.sum(n).alias("_n"))
    rows = per_key.filter(F.col("_n") >= floor)
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    # at most total / floor rows pass; the largest 1 / share of them hold every heavy key
    top = rows.orderBy(F.desc("_n"), *keys).limit(int(1 / share)).collect()
    if not top:
        return []
    whole = counts.agg(F.sum(n)).first()[0]
    return [tuple(r[k] for k in keys) for r in top if r["_n"] > share * whole]


def _literal(v: object) -> Column:
    # dates before the year 1000 do not pass the bridge to the JVM as they are
    return F.lit(f"{v.year:04d}-{v.month:02d}-{v.day:02d}").cast("date") if type(v) is date else F.lit(v)


def is_heavy(keys: Sequence[str], heavy: list[tuple]) -> Column:
    """Whether a row's key is one of the listed ones; null keys are not heavy."""
    if not heavy:
        return F.lit(False)
    if len(keys) == 1:
        test = F.col(keys[0]).isin([h[0] for h in heavy])
    else:
        test = F.lit(False)
        for h in heavy:
            one = F.lit(True)
            for k, v in zip(keys, h):
                one = one & F.col(k).eqNullSafe(_literal(v))
            test = test | one
    return F.coalesce(test, F.lit(False))


def skew_join(left: DataFrame, right: DataFrame, keys: Sequence[str], heavy: list[tuple], how: str = "left") -> DataFrame:
    """``left`` joined with ``right``, which has at most one row per key, sparing heavy keys the shuffle."""
    keys = list(keys)
    if not heavy:
        return left.join(right, keys, how)
    hot = is_heavy(keys, heavy)
    a = left.filter(hot).join(F.broadcast(right.filter(hot)), keys, how)
    b = left.filter(~hot).join(right.filter(~hot), keys, how)
    return a.unionByName(b)
