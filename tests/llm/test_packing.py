import random
from collections import Counter, defaultdict

import pytest

from skylathe.llm.packing import best_fit, pack, plan, reduce_dominated


def optimum(items, cap):
    items = sorted(items, reverse=True)
    best = [len(items)]

    def rec(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= cap and bins[k] not in bins[:k]:
                bins[k] += items[i]
                rec(i + 1, bins)
                bins[k] -= items[i]
        rec(i + 1, [*bins, items[i]])

    rec(0, [])
    return best[0]


def used(steps, cap):
    n = Counter()
    for s in steps:
        assert s.times > 0 and sum(a * k for a, k in s.content.items()) <= cap
        for a, k in s.content.items():
            n[a] += k * s.times
    return n


@pytest.mark.parametrize("seed", range(4))
def test_reduction_keeps_the_optimum(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        cap = rnd.choice([10, 20, 37])
        items = [rnd.randint(1, cap) for _ in range(rnd.randint(1, 9))]
        fixed, left = reduce_dominated(dict(Counter(items)), cap)
        assert used(fixed, cap) + Counter(left) == Counter(items)
        rest = list(Counter(left).elements())
        assert sum(s.times for s in fixed) + (optimum(rest, cap) if rest else 0) == optimum(items, cap)
        assert used(plan(dict(Counter(items)), cap), cap) == Counter(items)


def test_best_fit_groups_are_best_fit():
    rnd = random.Random(9)
    items = [rnd.randint(1, 50) for _ in range(500)]
    bins = []
    for s in sorted(items, reverse=True):
        fits = [i for i, b in enumerate(bins) if b >= s]
        if fits:
            i = min(fits, key=lambda k: bins[k])
            bins[i] -= s
        else:
            bins.append(60 - s)
    assert sum(s.times for s in best_fit(dict(Counter(items)), 60)) == len(bins)


def test_plan_is_small_and_tight():
    rnd = random.Random(2)
    c = Counter(min(2048, int(rnd.lognormvariate(5, 1)) + 1) for _ in range(200_000))
    p = plan(dict(c), 2048)
    assert used(p, 2048) == c and len(p) < 6000
    assert sum(s * k for s, k in c.items()) / 2048 / sum(s.times for s in p) > 0.999


@pytest.mark.parametrize("group", [50_000, 7])
def test_rows(spark, group):
    rnd = random.Random(4)
    sizes = [rnd.choice([5, 5, 5, 30, 64, 100, 101, 250, 0]) for _ in range(200)] + [None, 100, 1]
    df = spark.createDataFrame([(i, n, 1) for i, n in enumerate(sizes)], "doc_id bigint, n_tokens bigint, piece int")
    rows = pack(df.repartition(3), "doc_id", "n_tokens", capacity=100, group=group).collect()
    load, parts = Counter(), defaultdict(list)
    for r in rows:
        load[r["container_id"]] += r["n_tokens"]
        parts[r["doc_id"]].append((r["start"], r["n_tokens"]))
    assert max(load.values()) <= 100 and sorted(load) == list(range(len(load)))
    assert set(parts) == {i for i, n in enumerate(sizes) if n}
    for i, p in parts.items():
        assert sum(n for _, n in p) == sizes[i]
        assert len(p) == -(-sizes[i] // 100)
        assert [s for s, _ in sorted(p)] == [100 * k for k in range(len(p))]
    total = sum(n or 0 for n in sizes)
    assert len(load) <= total / 100 * 1.05 + 1


@pytest.mark.parametrize(("sizes", "each"), [(2048, 2), (500, 3)])
def test_every_size_may_be_salted(spark, sizes, each):
    df = spark.range(sizes * each).selectExpr("id AS doc_id", f"id % {sizes} + 1 AS n_tokens")
    rows = pack(df, "doc_id", "n_tokens", group=1).collect()
    load = Counter()
    for r in rows:
        load[r["container_id"]] += r["n_tokens"]
    assert len(rows) == len({r["doc_id"] for r in rows}) == sizes * each
    assert max(load.values()) <= 2048 and sorted(load) == list(range(len(load)))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert pack(df, "doc_id", "n_tokens").count() == 0
