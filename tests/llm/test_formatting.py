import random

import pytest

from skylathe.llm.formatting import copies


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", 0) for r in rows], "row_id bigint, problem string, action string, raw string, n int")


def brute(rows):
    def canon(t):
        fields = ("".join(c for c in f if c.isalnum()).lower() for f in (t or "").split(";"))
        return tuple(sorted(f for f in fields if f))

    groups = {}
    for i, p, a in rows:
        k = tuple(sorted((canon(p), canon(a))))
        if k != ((), ()):
            groups.setdefault(k, []).append(i)
    return {(min(g), i) for g in groups.values() for i in g if i != min(g)}, {(min(g), len(g)) for g in groups.values()}


ROWS = [
    (1, "Pump; LEAKS", "fixed."), (2, "leaks ;pump", "FIXED"), (3, "fixed", "pump;leaks"), (4, "pump leaks", "fixed"), (5, None, "fixed"), (6, "Fixed!", ""), (7, "...", None), (8, None, None),
    (9, "a;a;b", "x"), (10, "a;b", "x"), (11, "same", "same"), (12, "same", None), (13, "Ölkühler 7", "-"), (14, "ÖLKÜHLER7", None), (15, "q" * 50000, "w"), (16, "W", "Q" * 50000), (17, ";;a;b;", "X"),
]


@pytest.mark.parametrize("floor", [20_000, 2])
def test_cases(spark, floor):
    pairs, collapsed = copies(frame(spark, ROWS), floor=floor)
    want_pairs, want = brute(ROWS)
    assert {tuple(r) for r in pairs.collect()} == want_pairs
    assert {tuple(r) for r in collapsed.collect()} == want


@pytest.mark.parametrize("floor", [20_000, 5])
def test_random_with_a_hot_group(spark, floor):
    rnd = random.Random(5)
    texts = ["hot TEXT", "Hot-text", "hot;text", "text;HOT", None, "", "b", "c;d", "D ;c"]
    rows = [(i, *(("hot text", "x") if rnd.random() < 0.4 else (rnd.choice(texts), rnd.choice(texts)))) for i in range(300)]
    pairs, collapsed = copies(frame(spark, rows).repartition(4), floor=floor)
    want_pairs, want = brute(rows)
    assert {tuple(r) for r in pairs.collect()} == want_pairs
    assert {tuple(r) for r in collapsed.collect()} == want


def test_empty(spark):
    pairs, collapsed = copies(frame(spark, []))
    assert pairs.count() == collapsed.count() == 0
