import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skylathe.operators.orphans import orphan_counts, orphan_references, references, registrations
from skylathe.session import cut

T0 = datetime(2023, 1, 1)


def frames(spark, refs, regs):
    r = spark.createDataFrame(refs, "row_id bigint, component string, loaded_at timestamp_ntz, key string, day string")
    g = spark.createDataFrame(regs, "component string, registered_at timestamp_ntz, removed_at timestamp_ntz, n int")
    return references(r, "t", "component", "loaded_at"), registrations(g, "component", "registered_at", "removed_at")


def brute(refs, regs):
    key = lambda s: " ".join((s or "").split()).lower()
    out = set()
    for i, name, at, *_ in refs:
        if key(name) and not any(key(n) == key(name) and at is not None and a is not None and a <= at and (b is None or at < b) for n, a, b, *_ in regs):
            out.add(i)
    return out


def case(seed, n=300):
    rnd = random.Random(seed)
    names = ["Hot Part", "hot  part", "A b", "a B", "c", "d", "e", None, "", "  "]
    at = lambda: T0 + timedelta(hours=rnd.randrange(0, 24 * 30), minutes=rnd.choice([0, 30]))
    refs = [(i, rnd.choice(names[:2] * 6 + names), at() if rnd.random() > 0.05 else None, "x", "y") for i in range(n)]
    regs = []
    for _ in range(25):
        a = at()
        regs.append((rnd.choice(names), a if rnd.random() > 0.05 else None, rnd.choice([None, a + timedelta(hours=rnd.randrange(-3, 200))]), 1))
    return refs, regs + regs[:3]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("kw", [{}, {"floor": 10}, {"floor": 10, "broadcast_rows": 0}])
def test_against_brute_force(spark, seed, kw):
    refs, regs = case(seed)
    r, g = frames(spark, refs, regs)
    assert {x["row_id"] for x in orphan_references(r, g, **kw).collect()} == brute(refs, regs)


def test_counts_agree_with_rows(spark):
    refs, regs = case(7)
    r, g = frames(spark, refs, regs)
    counts = orphan_counts(r, g).collect()
    assert sum(c["n_orphans"] for c in counts) == len(brute(refs, regs))
    assert sum(c["n_refs"] for c in counts) == r.count()
    assert any(c["period"] is None for c in counts)


@pytest.mark.parametrize("kw", [{"floor": 10}, {"floor": 10, "broadcast_rows": 0}])
def test_a_hot_day_of_a_hot_key_is_divided(spark, tmp_path, kw):
    refs, regs = case(5)
    day = T0 + timedelta(days=9)
    refs += [(1000 + i, "Hot Part", day + timedelta(seconds=i), "x", "y") for i in range(len(refs))]
    regs = [g for g in regs if (g[0] or "").split() == ["A", "b"]] + [("hot part", day + timedelta(seconds=290), day + timedelta(seconds=295), 1)]
    r, g = frames(spark, refs, regs)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps the partitions apart
    try:
        orphan_references(cut(r.repartition(8, "row_id")), g, **kw).write.parquet(str(tmp_path / "out"))
        rows = spark.read.parquet(str(tmp_path / "out")).select("row_id", F.input_file_name().alias("p")).collect()  # a file a task
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    counts = orphan_counts(r, g, **kw).collect()
    want = brute(refs, regs)
    assert {x["row_id"] for x in rows} == want and sum(c["n_orphans"] for c in counts) == len(want)
    hot = Counter(x["p"] for x in rows if x["row_id"] >= 1000)
    assert len(hot) >= 3 and max(hot.values()) < 0.6 * sum(hot.values())


def test_bounds_of_a_registration(spark):
    end = T0 + timedelta(days=2)
    refs = [(1, "x", T0, "", ""), (2, "x", end, "", ""), (3, "x", end - timedelta(microseconds=1), "", ""), (4, "x", T0 - timedelta(microseconds=1), "", "")]
    r, g = frames(spark, refs, [("X", T0, end, 1)])
    assert {x["row_id"] for x in orphan_references(r, g).collect()} == {2, 4}


def test_empty_sides(spark):
    refs, regs = case(1, 20)
    r, g = frames(spark, refs, [])
    assert orphan_references(r, g).count() == r.count()
    r, g = frames(spark, [], regs)
    assert orphan_references(r, g).count() == 0
    assert orphan_counts(r, g).count() == 0
